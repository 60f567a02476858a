"""One document of each group of near copies: the SimHash stage of the pipeline.

Five-word shingles; two texts are near copies if their shingle sets have a Jaccard
likeness of 0.8 or more, and groups are the connected components. Every link is
verified on the shingle sets (64-bit hashes); SimHash only proposes pairs.

First, balls: a text gets ``BANDS`` independent 32-bit SimHashes of its shingle set,
and balls of radius 2 are hashed on each: every band value emits its variants within
one bit, and the values that meet at a variant (33 at most) are paired. Texts with
one value in a band are paired with one of them, which stands for the value. Pairs
within the differing bits of likeness 0.8 and two standard errors are verified. Bands
go in two rounds; the second compares no texts that are in one group already.

Then the rest: two sets of likeness 0.8 share one of the rarest shingles of each, a
fifth of the set and one. Texts that share such a shingle with at most ``CROWD``
texts, are of fitting sizes and are not yet in one group are all compared, so there
no pair is lost to the bits, to a text that stands for others or to a ball. Comparing
all pairs of a crowd (a large family of texts that are loosely alike) would cost the
square of its size. Texts that meet in a crowd emit the balls of ``MORE`` more bands
instead, in two rounds: a pair at 0.8 meets in a round of 20 with probability 0.92 and
is within the bits with 0.98, of 10 with 0.70 in all; so all four rounds miss it in 9
of 10,000 cases. With ``crowd=None`` there are no crowds: all texts at a place are
compared, and no text is left out beforehand, so no pair at 0.8 is missed anywhere.

Only texts that can have a near copy are looked at: a near copy shares at least
0.8 of the hashes of the larger text, so a text of which fewer than 19 of the 48 least
hashes recur anywhere is left out. A near copy is left out so with probability
2e-10 or less (19 of 48 draws at 0.8); up to 48 shingles the rule is exact.

Texts alike in words count once. Kept is a row with the least doc_id of a group; all
columns stay, whatever their names. Null texts and texts without words form one
group. Repeated rows are copies. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, kinds, placed, quoted, release, sliced, stash, trimmed, unused
from .components import components
from .simhash import ones, plain, shingle_hashes

WORDS, LIKENESS, BANDS, LEAST, RECUR = 5, 0.8, 20, 48, 19
#: Texts at a place that are all compared; bands whose balls are hashed at a time; bands, and bands at a time, of texts at larger places.
CROWD, ROUND, MORE, MORE_ROUND = 16, 10, 40, 20
#: Counts are compared with products of LIKENESS, which are not exact.
SLACK = 1e-6


def bits(hashes: np.ndarray, first: int, n_bands: int) -> list[int]:
    """``n_bands`` 32-bit SimHashes of shingle hashes (numbers of 8 bytes) from the band ``first`` on, two from each remixed hash."""
    n, out = len(hashes), []
    h = hashes.astype(np.uint64)
    for band in range(0, first + n_bands, 2):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        if band < first:
            continue
        mixed = h ^ (h >> np.uint64(29))
        out += np.packbits(2 * ones(mixed.view(np.uint8).reshape(n, 8)) > n).view(">u4").tolist()
    return out


def most_bits(likeness: float, n: int) -> int:
    """Differing bits of ``n`` that a Jaccard likeness implies, and two standard errors."""
    p = acos(2 * likeness / (1 + likeness)) / pi
    return int(n * p + 2 * sqrt(n * p * (1 - p)))


def _key(raw: bytes) -> bytes:
    return xxhash.xxh3_128_digest(plain(raw))


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(trimmed(batches)):
        keys, least = [], []
        for text in batch.column(2):
            raw = text.as_py() or b""
            keys.append(_key(raw))
            h = shingle_hashes(raw, WORDS)
            least.append(np.unique(h.reshape(-1).view(">u8").astype(np.uint64))[:LEAST].view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(least, pa.list_(pa.int64()))], names=["doc_id", "whole", "key", "least"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(trimmed(batches)):
        sets = [np.unique(shingle_hashes(text.as_py(), WORDS).reshape(-1).view(">u8")).astype(np.uint64).view(np.int64) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "grams"])


def _bands(batches: Iterator[pa.RecordBatch], first: int, n_bands: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(trimmed(batches)):
        bands = [bits(grams.values.to_numpy().view(np.uint64), first, n_bands) for grams in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bands, pa.list_(pa.int64()))], names=["node", "bands"])


def met_in_balls(nodes: DataFrame, roots: DataFrame, n_bands: int) -> DataFrame:
    """Pairs (lo, hi) of ``nodes`` (node, bands: ``n_bands`` of them) of different ``roots`` (node, root) that meet in a ball and have few enough differing bits.

    Texts with one value in a band are proposed with one of them, which alone emits
    that value's ball; so a large group of copies costs a pair a text and band, and
    no place has more than the 33 values within one bit of it.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in (0, *(1 << b for b in range(32)))])
    # All bits of the round travel with a text, so that pairs are judged where they meet.
    packed = [F.shiftleft(F.get("bands", k), 32).bitwiseOR(F.get("bands", k + 1)).alias(f"s{k}") for k in range(0, n_bands, 2)]
    rooted = nodes.join(roots, "node", "left").select(F.struct("node", F.coalesce("root", "node").alias("root"), *packed).alias("t"), F.posexplode("bands").alias("band", "value"))
    values = rooted.select("t", (F.shiftleft(F.col("band").cast("long"), 32) + F.col("value")).alias("spot"))
    heads, path = stash(values.groupBy("spot").agg(F.min(F.struct(F.xxhash64("t.node").alias("r"), "t")).alias("c")).select("spot", F.col("c.t").alias("head")))

    def alike(x: Column, y: Column) -> Column:
        differ = sum((F.bit_count(x[f"s{k}"].bitwiseXOR(y[f"s{k}"])) for k in range(0, n_bands, 2)), F.lit(0))
        return (x["root"] != y["root"]) & (differ <= most_bits(LIKENESS, 32 * n_bands))

    same = values.join(heads, "spot").where(alike(F.col("t"), F.col("head"))).select("t.node", F.col("head.node").alias("centre"))
    places = heads.select("head", F.explode(F.transform(masks, lambda m: F.col("spot").bitwiseXOR(m))).alias("place"))
    balls = places.groupBy("place").agg(F.collect_list("head").alias("at")).where(F.size("at") > 1)
    others = lambda x, i: F.filter(F.slice("at", i + 2, F.size("at")), lambda y: alike(x, y))
    paired = F.flatten(F.transform("at", lambda x, i: F.transform(others(x, i), lambda y: F.struct(x["node"].alias("node"), y["node"].alias("centre")))))
    met, _ = stash(same.union(balls.select(F.inline(paired))).select(F.least("node", "centre").alias("lo"), F.greatest("node", "centre").alias("hi")).distinct())
    discard(nodes.sparkSession, path)
    release(nodes.sparkSession)
    return met


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (lo, hi) whose shingle sets (node, grams) are alike."""
    side = lambda n: nodes.select(F.col("node").alias(n), F.col("grams").alias(f"{n}_grams"))
    both = pairs.join(side("lo"), "lo").join(side("hi"), "hi")
    shared = F.size(F.array_intersect("lo_grams", "hi_grams"))
    return both.where(shared >= LIKENESS * (F.size("lo_grams") + F.size("hi_grams") - shared) - SLACK).select("lo", "hi")


def apart(nodes: DataFrame, roots: DataFrame, crowd: int | None = CROWD) -> tuple[DataFrame, DataFrame]:
    """Pairs (lo, hi) of ``nodes`` (node, grams) of different ``roots`` (node, root) that can be alike, and nodes that meet in a crowd.

    Shingles are ordered by how many texts have them, then by hash; one number holds
    both, so shingles that differ only in what it leaves out are one place, which
    proposes more pairs and loses none. A text meets others at its rarest, as many as
    leave too few others for the likeness.
    """
    spark = nodes.sparkSession
    grams = nodes.select("node", F.explode("grams").alias("h"))
    many, many_path = stash(grams.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    release(spark)
    place = F.shiftleft(F.least("n", F.lit(127)), 56) + F.col("h").bitwiseAND(F.lit((1 << 56) - 1))
    recur, recur_path = stash(grams.join(many, "h").select("node", place.alias("x")).groupBy("node").agg(F.sort_array(F.collect_list("x")).alias("xs")))
    release(spark)
    discard(spark, many_path)
    sized = nodes.select("node", F.size("grams").alias("size"))
    # A text's shingles that no other has come first in the order, and are no meeting places.
    most = F.col("size") - F.ceil(LIKENESS * F.col("size") - SLACK) + 1 - (F.col("size") - F.size("xs"))
    rare = recur.join(sized, "node").join(roots, "node", "left").select("node", "size", F.coalesce("root", "node").alias("root"), F.explode(F.slice("xs", F.lit(1), F.greatest(most, F.lit(0)).cast("int"))).alias("x"))
    rare, _ = stash(rare)
    discard(spark, recur_path)
    mixed = rare.groupBy("x").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n")).where("a < b").select("x", "n")
    at, _ = stash(rare.join(mixed, "x"))
    few = at if crowd is None else at.where(F.col("n") <= crowd)
    side = lambda n: few.select("x", F.col("node").alias(n), F.col("size").alias(f"{n}_size"), F.col("root").alias(f"{n}_root"))
    fits = F.least("lo_size", "hi_size") >= LIKENESS * F.greatest("lo_size", "hi_size") - SLACK
    pairs = side("lo").join(side("hi"), "x").where((F.col("lo") < F.col("hi")) & (F.col("lo_root") != F.col("hi_root")) & fits).select("lo", "hi").distinct()
    return pairs, at.where(F.lit(False) if crowd is None else F.col("n") > crowd).select("node").distinct()


def _by_balls(some: DataFrame, nodes: DataFrame, roots: DataFrame, first: int, n_bands: int) -> DataFrame:
    """Links that the balls of some bands find among ``some`` of ``nodes`` that have different roots."""
    banded, path = stash(some.mapInArrow(lambda batches: _bands(batches, first, n_bands), "node long, bands array<long>"))
    found, _ = stash(verified(met_in_balls(banded, roots, n_bands), nodes))
    discard(nodes.sparkSession, path)
    release(nodes.sparkSession)
    return found


def stars(roots: DataFrame) -> DataFrame:
    """Links (lo, hi) that join the same groups as those ``roots`` (node, root) come from, and need no rounds of components."""
    return roots.where("node <> root").select(F.col("root").alias("lo"), F.col("node").alias("hi"))


def keep_one(docs: DataFrame, crowd: int | None = CROWD) -> DataFrame:
    """The rows of ``docs`` that stay; at places of more than ``crowd`` texts pairs are proposed by balls only, with None nowhere."""
    spark = docs.sparkSession
    bound_batches(spark)
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("binary")).alias("whole"), F.col("text").cast("binary").alias("text"))
    made, made_path = stash(raw.mapInArrow(_least, "doc_id long, whole long, key binary, least array<long>"))
    # One node a word sequence, numbered when written; a text's shingles follow from its words.
    least = made.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "whole")).alias("w"), F.first("least").alias("least"))
    texts, _ = stash(least.select(F.monotonically_increasing_id().alias("node"), "key", F.col("w.doc_id").alias("first"), F.col("w.whole").alias("whole"), "least"))
    discard(spark, made_path)
    hashes = texts.select("node", F.explode("least").alias("h"))
    recur, recur_path = stash(hashes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    enough = hashes.join(recur, "h").groupBy("node").agg(F.count("*").alias("n"))
    able = texts.join(enough, "node").where(F.col("n") * LEAST >= RECUR * F.size("least")) if crowd is not None else texts
    able, _ = stash(able.select("node", "first", F.col("whole").alias("of")))
    discard(spark, recur_path)
    release(spark)
    own = raw.join(able, F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("whole") == F.col("of"))).select("node", "text")
    nodes, nodes_path = stash(own.mapInArrow(_sets, "node long, grams array<long>").dropDuplicates(["node"]))
    release(spark)
    roots = spark.createDataFrame([], "node long, root long")
    for first in range(0, BANDS, ROUND):
        roots = components(stars(roots).union(_by_balls(nodes, nodes, roots, first, ROUND)))
    pairs, crowded = apart(nodes, roots, crowd)
    rest, _ = stash(verified(pairs, nodes))
    links, (crowded, _) = stars(roots).union(rest), stash(crowded)
    if not crowded.isEmpty():
        for first in range(BANDS, BANDS + MORE, MORE_ROUND):
            links = links.union(_by_balls(nodes.join(crowded, "node"), nodes, roots, first, MORE_ROUND))
    discard(spark, nodes_path)
    roots = components(links)
    named = texts.join(roots, "node", "left").select("key", "first", F.coalesce("root", "node").alias("root"))
    chosen = named.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("no_id"), "first", "key")).alias("w")).select("w.first", "w.key")
    chosen, _ = stash(chosen)
    release(spark)
    return _rows(docs, chosen)


def _rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of each of ``chosen`` (first, key: an id and a word sequence); copies of a row differ in blanks and case at most."""
    at = docs.columns.index("text")
    own, spot = unused(docs.columns, "words", "spot")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(trimmed(batches)):
            keys = [_key(t.as_py() or b"") for t in batch.column(at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "words"])

    marked = placed(docs).mapInArrow(mark, f"{kinds(placed(docs))}, words binary").toDF(*docs.columns, own)
    # One key for the join and the copies, so that texts are shuffled once.
    at_key = lambda key, doc_id: F.concat(F.col(key), F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("null")).cast("binary")).alias(spot)
    found = marked.select(*quoted(docs.columns), at_key(own, "doc_id")).join(chosen.select(at_key("key", "first")), spot)
    return found.dropDuplicates([spot]).select(*quoted(docs.columns))
