"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stashed import discard, scratch, stash  # noqa: F401

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as no column has it (names are alike whatever their case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        name = f"__{name}"
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def quoted(columns: Sequence[str]) -> list[Column]:
    """Columns by exactly these names, whatever characters they have."""
    return [F.col(f"`{c}`") for c in columns]


def kinds(df: DataFrame) -> str:
    """Columns of ``df`` as a DDL schema."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def placed(df: DataFrame) -> DataFrame:
    """``df`` with columns named c0, c1, ...: what mapInArrow takes, which looks up names with dots in vain."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def bound_batches(spark: SparkSession, most: str = "8m") -> None:
    """Arrow batches of at most ``most`` bytes, unless the session has a bound of its own: what a task's JVM and Python hold of its input at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # Spark's default
        spark.conf.set(name, most)


def sliced(batches: Iterator[pa.RecordBatch], most: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``most`` rows: what a worker turns into Python values at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last, Arrow's pool gives back what it holds unused, else a Python process keeps it as long as it lives."""
    yield from batches
    pa.default_memory_pool().release_unused()


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs: it learns of them when the driver collects garbage."""
    spark.sparkContext._jvm.java.lang.System.gc()
