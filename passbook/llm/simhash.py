"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a value in common within half the
radius of both. Each distinct fingerprint emits all variants within that half,
rows are shuffled on the variant, and the fingerprints that meet at one variant
(a ball of at most 65 values for radius 2, whatever the data) are chained in
order; both ends of each chain link are verified and links are deduplicated.
Chaining keeps every ball connected without making its pairs. Exact copies share
a fingerprint and count once.

Defined cases: null text is the empty text; a text without words has fingerprint
zero and is linked like any other; fewer words than a shingle: the whole
sequence is the one shingle. Repeated rows get the same component. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, kinds, sliced, stash
from .components import components

_BLANKS = re.compile(rb"[\x20\x09-\x0D]{2,}|[\x09-\x0D]")  # runs that are not one space already
#: Shingles that are hashed, and whose bits are counted, at a time.
BLOCK = 1 << 16


def plain(text: bytes) -> bytes:
    """The words of ``text`` with A-Z lower-cased, one space between (ASCII case and white space only)."""
    return _BLANKS.sub(b" ", text.lower()).strip(b" ")


def shingle_hashes(text: bytes, n_words: int, seed: int = 42) -> np.ndarray:
    """XXH64 digests, one row of 8 bytes each, of all shingles of ``text`` with A-Z lower-cased, repeats included.

    Beside the result, numbers of 8 bytes a word and one block of digests are held.
    """
    joined = plain(text)
    if not joined:
        return np.zeros((0, 8), np.uint8)
    at = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n, digest = max(1, len(at) + 2 - n_words), xxhash.xxh64_digest
    starts = np.concatenate([[0], at[: n - 1] + 1])
    ends = np.concatenate([at[n_words - 1 :], [len(joined)]])
    out = np.empty((n, 8), np.uint8)
    for k in range(0, n, BLOCK):
        found = [digest(joined[s:e], seed) for s, e in zip(starts[k : k + BLOCK].tolist(), ends[k : k + BLOCK].tolist(), strict=True)]
        out[k : k + BLOCK] = np.frombuffer(b"".join(found), np.uint8).reshape(-1, 8)
    return out


def ones(hashes: np.ndarray) -> np.ndarray:
    """How many rows (8 bytes each, one at least) have each of the 64 bits."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[k : k + BLOCK], axis=1)
        total += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(hashes: np.ndarray) -> int:
    """The 64 majority bits, as a signed integer; zero if there is no hash."""
    return int(np.packbits(2 * ones(hashes) > len(hashes)).view(">i8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, n_words: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and fp (long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps = [fingerprint(shingle_hashes(t.as_py() or b"", n_words)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps, pa.int64())], names=[*batch.schema.names[1:], "fp"])

    bound_batches(docs.sparkSession)
    frame = docs.select(F.col("text").cast("binary"), *keep)
    return frame.mapInArrow(run, f"{kinds(frame.select(*keep))}, fp long")


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links (lo, hi) between fingerprints (fp, distinct) within ``radius`` bits that connect all that are so linked."""
    if radius % 2 or radius < 0:
        raise ValueError("radius must be even: each side emits the ball of half of it")
    flips = [sum(1 << b for b in bits) for k in range(radius // 2 + 1) for bits in combinations(range(64), k)]
    masks = F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long") for m in flips])
    balls = distinct.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    near = balls.withColumn("before", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")))
    met = near.where("before is not null").select(F.col("before").alias("lo"), F.col("fp").alias("hi")).distinct()
    return met.where(F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= radius)


def classes(docs: DataFrame, n_words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id of every row; component_id is the least doc_id that links reach."""
    fps, _ = stash(fingerprints(docs.select("doc_id", "text"), n_words))
    first, _ = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(first.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = first.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named, _ = stash(rooted.join(least, "root").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: fingerprint and component of every document."""
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
