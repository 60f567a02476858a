"""Ledgers that arrive in files: the batch operators over a drop folder, and windows over posting times.

The batch operators need all rows of an account, so ``follow`` keeps what arrived, by
partitions of accounts, and runs them on each arrival over all rows of the accounts
that it touches. Only the partitions of those accounts are read, and their results
replaced. ``hourly_totals`` is an incremental aggregate with a watermark: late rows
within it still count, state beyond it goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import keyed


def follow(spark: SparkSession, folder: str, schema: str, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "acct", parts: int = keyed.PARTS) -> StreamingQuery:
    """Apply ``operator`` to the accounts of each arrival and keep its rows below ``out``; a repeated batch replaces itself."""
    kept = f"{out}/_ledger"  # readers of ``out`` pass over names with an underscore

    def each(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        placed = rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        placed.withColumn("batch", F.lit(batch)).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(kept)
        stored = session.read.schema(f"{schema}, part int, batch int").parquet(kept)
        mine = stored.where(F.col("batch") == batch).select(key, "part").distinct()
        touched = [r[0] for r in mine.select("part").distinct().collect()]  # at most ``parts``
        ledger = stored.where(F.col("part").isin(touched) & (F.col("batch") <= batch)).join(mine.select(key), key, "left_semi").drop("part", "batch")
        keyed.replace(operator(ledger), f"{out}/results", key, batch, parts)

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The result of each account that ``follow`` wrote last."""
    return keyed.read(spark, f"{out}/results")


def hourly_totals(rows: DataFrame, late: str = "2 hours") -> DataFrame:
    """Credits, debits and rows by account type and hour of posting (ts, type, amount)."""
    hours = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "type")
    return hours.agg(F.sum("amount").alias("total"), F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "type", "total", "n")
