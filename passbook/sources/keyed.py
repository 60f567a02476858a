"""Tables by key: new rows of a key replace its old ones, and only the partitions that they touch are written again.

A table lies in partitions by a hash of its key. An arrival rewrites its keys'
partitions (dynamic overwrite: a partition is swapped when the job is done, so a lost
executor or a failed job leaves the table as it was). Rows carry the number of the
batch that wrote them; a batch that comes again, or late, changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Partitions of a table; a table keeps the number it began with.
PARTS = 64


def _part(key: str, parts: int):
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows as they stand."""
    return spark.read.parquet(path).drop("__part", "__batch")


def replace(rows: DataFrame, path: str, key: str, batch: int, parts: int = PARTS) -> None:
    """All rows of each key of ``rows`` take the place of the key's old ones, unless a later batch wrote those."""
    spark = rows.sparkSession
    new = rows.withColumn("__batch", F.lit(batch).cast("long")).withColumn("__part", _part(key, parts))
    if _exists(spark, path):
        touched = [r[0] for r in new.select("__part").distinct().collect()]  # at most ``parts``
        old = spark.read.schema(new.schema).parquet(path).where(F.col("__part").isin(touched))
        later = old.where(F.col("__batch") > batch).select(key).distinct()
        new = new.join(later, key, "left_anti")
        new = old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
    new.repartition("__part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__part").parquet(path)


def upsert(rows: DataFrame, path: str, key: str = "document_id", batch: int = 0, parts: int = PARTS) -> None:
    """One row a key: of several in ``rows`` the last by ``created_at`` (then by all columns)."""
    order = F.struct(*[c for c in ("created_at",) if c in rows.columns], *[c for c in rows.columns if c not in (key, "created_at")])
    one = rows.groupBy(key).agg(F.max(order).alias("r")).select(key, "r.*").select(*rows.columns)
    replace(one, path, key, batch, parts)


def get(spark: SparkSession, path: str, key: str, value: object, parts: int = PARTS) -> DataFrame:
    """Rows of one key: its partition only is read."""
    stored = spark.read.parquet(path)
    part = F.pmod(F.xxhash64(F.lit(value).cast(stored.schema[key].dataType)), F.lit(parts)).cast("int")
    where = spark.range(1).select(part).first()[0]
    return stored.where((F.col("__part") == where) & (F.col(key) == value)).drop("__part", "__batch")


def newest(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """The rows stored last: a top-n, not a full sort."""
    return read(spark, path).orderBy(F.desc("created_at")).limit(limit)


def into(stream: DataFrame, path: str, key: str, checkpoint: str, make: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Upsert a stream of rows (of what ``make`` gives for them) as they arrive."""

    def each(rows: DataFrame, batch: int) -> None:
        upsert(make(rows) if make else rows, path, key, batch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
