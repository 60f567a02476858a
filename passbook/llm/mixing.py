"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source with target ``T`` and size ``S`` is wanted
``r = T / S`` times. ``floor(r)`` copies are certain; the fractional part is an
inclusion probability shared by all documents of the source. The flight phase of
the cube method moves these probabilities through the null space of the
balancing constraints (documents and words of the source) until at most two
documents a block are undecided. Blocks are salted by document hash, so a source
of any size is spread over many tasks; what each block leaves is gathered in
blocks again, each level a few hundred times smaller, until one block a source
is left, whose last two documents are landed by rounding.

Defined cases: null text or no word: size 0, the document takes part in the
document balance only. Null source: a source of its own, after all others.
Source without words: target 0, nothing is taken. Empty table: empty result.
Repeated rows are separate units (``mixed_rows``: one unit, copied together).
Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, quoted, stash, unused

WEIGHTS = (3.0, 1.0, 2.0)
#: Mean number of documents that one flight sees.
BLOCK = 2000

_UNIT = "doc_id long, key long, source string, size long, pi double, rank long, block long"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (hash of the text), size: number of words of the whole text."""
    return docs.select(F.col("doc_id").cast("long"), "source", F.xxhash64("text").alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def numbered(sources: DataFrame) -> DataFrame:
    """Add at: place of the row by source (code points, null last), from 0. No task or driver sees more than a range of them."""
    spark = sources.sparkSession
    # A number written in range order is the partition's number and the place within it.
    placed, _ = stash(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("written", F.monotonically_increasing_id()))
    per_part = sorted((r["part"], r["n"]) for r in placed.groupBy(F.shiftright("written", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    before = [(part, sum(n for _, n in per_part[:i])) for i, (part, _) in enumerate(per_part)]
    offsets = spark.createDataFrame(before, "part long, before long")  # a row a partition
    return placed.join(F.broadcast(offsets), F.shiftright("written", 33) == F.col("part")).select(*sources.columns, (F.col("before") + F.col("written").bitwiseAND(F.lit((1 << 33) - 1))).alias("at"))


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Add target, the words that each source (source, words: long) gives: ``share`` of all words dealt by weight, none above ``most`` times its own.

    What a capped source can't take is dealt again by weight among the others: the
    target is weight times a level, or the cap. Each round raises the level by the
    words that capped sources leave; the driver sees a sum and a count a weight.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    dealt, _ = stash(numbered(sources).withColumn("weight", weight).drop("at"))
    cap, level, capped = F.col("words") * most, 0.0, -1
    while True:
        over = cap < F.col("weight") * level
        sums = dealt.groupBy("weight").agg(F.sum("words").alias("all"), F.sum(F.when(over, F.col("words")).otherwise(0)).alias("capped"), F.count(F.when(over, 1)).alias("n"), F.count(F.when(~over, 1)).alias("open")).orderBy("weight").collect()
        n, open_ = sum(r["n"] for r in sums), sum(r["weight"] * r["open"] for r in sums)
        if n == capped or not open_:
            return dealt.withColumn("target", F.least(cap, F.col("weight") * level) if open_ else cap).drop("weight")
        capped, level = n, (share * sum(r["all"] for r in sums) - most * sum(r["capped"] for r in sums)) / open_


def flight(pi: list[float], size: list[float]) -> list[float]:
    """Cube flight over units with two constraints: sum of pi and sum of pi * size stay what they were.

    Three undecided units always have a direction that keeps both sums; going
    along it as far as a unit allows decides that unit. Which of the two ends is
    taken follows the martingale rule with a fixed low-discrepancy sequence, so
    reruns agree.
    """
    out, live, turn = list(pi), [], 0.5
    for i, p in enumerate(pi):
        if p <= 1e-9 or p >= 1 - 1e-9:
            out[i] = float(round(p))
            continue
        live.append(i)
        while len(live) == 3:
            a, b, c = live
            u = [size[c] - size[b], size[a] - size[c], size[b] - size[a]]
            if not any(u):
                u = [1.0, -1.0, 0.0]
            up = min(((1 - out[k]) / d if d > 0 else -out[k] / d) for k, d in zip(live, u, strict=True) if d)
            down = min((out[k] / d if d > 0 else (out[k] - 1) / d) for k, d in zip(live, u, strict=True) if d)
            turn = (turn + 0.6180339887498949) % 1.0
            step = up if turn * (up + down) < down else -down
            keep = []
            for k, d in zip(live, u, strict=True):
                out[k] = min(1.0, max(0.0, out[k] + step * d))
                if out[k] < 1e-9 or out[k] > 1 - 1e-9:
                    out[k] = float(round(out[k]))
                else:
                    keep.append(k)
            if len(keep) == 3:  # rounding kept all three off their ends: settle the nearest
                near = min(keep, key=lambda k: min(out[k], 1 - out[k]))
                out[near] = float(round(out[near]))
                keep.remove(near)
            live = keep
    return out


def _fly(block: pd.DataFrame) -> pd.DataFrame:
    # Large documents are decided first, so that the few left for the landing are small.
    block = block.sort_values(["size", "rank", "doc_id"], ascending=[False, True, True], kind="stable")
    block["pi"] = flight(block["pi"].tolist(), [float(x) for x in block["size"]])
    return block


def _land(block: pd.DataFrame) -> pd.DataFrame:
    """The last flight of a source; then the undecided two or fewer are rounded to the words they stand for."""
    block = _fly(block)
    live = block.index[(block["pi"] > 0) & (block["pi"] < 1)]
    owed = float((block.loc[live, "pi"] * block.loc[live, "size"]).sum())
    for k in sorted(live, key=lambda k: (-block.at[k, "size"], block.at[k, "doc_id"])):
        take = owed >= block.at[k, "size"] / 2
        block.at[k, "pi"] = float(take)
        owed -= take * block.at[k, "size"]
    return block


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: Sequence[float] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """Return doc_id, key, source, size, source_size, target, copies (how often the mix takes the row) of every row."""
    return mix_units(sizes(docs), share, most, weights, block)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; rows alike in doc_id, source and text are one unit. Columns stay, whatever their names."""
    units = sizes(docs).groupBy("doc_id", "source", "key").agg(F.sum("size").alias("size"))
    own, of_id, of_source, key, copies, copy = unused(docs.columns, "own", "id", "source", "key", "copies", "copy")
    taken = mix_units(units, **options).where("copies > 0").select(F.col("doc_id").alias(of_id), F.col("source").alias(of_source), F.col("key").alias(key), F.col("copies").cast("int").alias(copies))
    found = docs.withColumn(own, F.xxhash64("text")).join(taken, F.col("doc_id").eqNullSafe(F.col(of_id)) & F.col("source").eqNullSafe(F.col(of_source)) & (F.col(own) == F.col(key)))
    return found.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).select(*quoted(docs.columns))


def mix_units(units: DataFrame, share: float = 1.5, most: float = 2.0, weights: Sequence[float] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """``mix`` for units (doc_id, key, source, size)."""
    sized, _ = stash(units)
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")), share, most, weights)
    rate = F.when(F.col("words") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("words"))).otherwise(0.0)
    # A row a source; Spark broadcasts it only if it is small.
    of, _ = stash(goal.select(F.col("source").alias("of"), F.col("words").alias("source_size"), "target", rate.alias("rate"), F.ceil(F.col("n") / block).alias("blocks")))
    rows = sized.join(of, F.col("source").eqNullSafe(F.col("of")))
    units = rows.select("doc_id", "key", "source", "size", (F.col("rate") - F.floor("rate")).alias("pi"), F.xxhash64("doc_id", "key", "size").alias("rank"), "blocks")
    decided = units.where("pi < 1e-9 or pi > 1 - 1e-9").select("doc_id", "key", "source", "size", F.round("pi").alias("pi"))
    live, most_blocks = units.where("pi between 1e-9 and 1 - 1e-9"), of.agg(F.max("blocks")).first()[0] or 1
    live = live.withColumn("block", F.pmod(F.xxhash64("rank", F.lit(7)), F.col("blocks")))
    done = [decided]
    while True:
        last = most_blocks <= 1
        flown, path = stash(live.select("doc_id", "key", "source", "size", "pi", "rank", "block").groupBy("source", "block").applyInPandas(_land if last else _fly, _UNIT))
        done.append(flown.where("pi = 0 or pi = 1").select("doc_id", "key", "source", "size", "pi"))
        if last:
            break
        # Two or fewer a block are left: that many blocks fewer hold them all.
        most_blocks = -(-most_blocks * 2 // block)
        live = flown.where("pi > 0 and pi < 1").withColumn("block", F.pmod(F.xxhash64("rank", F.lit(most_blocks)), F.lit(most_blocks)))
    taken = done[0]
    for d in done[1:]:
        taken = taken.unionByName(d)
    found = taken.join(of, F.col("source").eqNullSafe(F.col("of")))
    return found.select("doc_id", "key", "source", "size", "source_size", "target", (F.floor("rate") + F.col("pi")).cast("long").alias("copies"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the mix of all documents, one row a document."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
