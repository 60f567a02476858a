"""Tables on the way of a query, written once in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_open: ContextVar[list[str] | None] = ContextVar("_open", default=None)


def _shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set and all of Spark is on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def stash(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there.

    Unlike executor-local copies the table outlives lost executors.
    """
    spark = df.sparkSession
    path = f"{_shared_dir(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
    if _open.get() is not None:
        _open.get().append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete stashed tables that no later plan reads."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables stashed inside are deleted at its end; take a path off the list to keep its table."""
    token = _open.set([])
    try:
        yield _open.get()
        discard(spark, *_open.get())
    finally:
        _open.reset(token)
