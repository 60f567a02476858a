"""Connected components of a link table by alternating large and small stars.

Every round is two joins and two aggregates over the links; the number of rounds
is logarithmic in the number of nodes. Nothing is gathered on the driver but a
row count and a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (lo, hi: long); root is the least node of its component."""
    spark = links.sparkSession
    links, path = stash(links.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).where("lo < hi").distinct())
    before = _state(links)
    while before[0]:
        both = links.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(links.select("hi", "lo"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select("m", F.explode(F.array("lo", "hi")).alias("hi")).where("m <> hi").select(F.col("m").alias("lo"), "hi").distinct()
        new, new_path = stash(small)
        after = _state(new)
        discard(spark, path)
        links, path = new, new_path
        if after == before:
            break
        before = after
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(links.select("lo", "lo").distinct())
