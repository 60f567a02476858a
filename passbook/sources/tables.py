"""Tables that are small as files, dealt out before texts are derived from their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Parts a core, so that slow ones even out; least parts; and most rows of a part, so that a task's memory does not grow with the table.
PARTS, LEAST, ROWS = 4, 32, 250_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` of a table over all cores by ``keys``, in parts of bounded rows (the files' footers tell how many there are).

    A compressed table of short rows is one split of a file: one task would read it,
    derive all texts and search them.
    """
    n = max(LEAST, PARTS * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS))
    return rows.repartition(n, *keys)


def customers(spark, sf_dir) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey")


def items(spark, sf_dir, key: str) -> DataFrame:
    """Line items by ``key``, the document that they are tokens of."""
    return dealt(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), key)
