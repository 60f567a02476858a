"""Document fingerprints: bottom-k sketches of shingle hashes.

The sketch of a text is the k least distinct 64-bit hashes of its word shingles.
Sketches merge: the bottom k of two sketches' union is the sketch of the union
of their shingles, so parts of a document, or of a corpus, can be sketched apart.
From two sketches follow resemblance (Jaccard), containment and, from the k-th
least hash, the number of distinct shingles.

Defined cases: null text is the empty text, whose sketch is empty; two empty
sketches have likeness 1, an empty and a non-empty one 0. Fewer words than a
shingle: the whole sequence is the one shingle. Rows with the same doc_id are
ordered by text. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, partitions, stash

#: Hashes a sketch keeps, words a shingle has, words whose hash a worker remembers.
K, SHINGLE, MEMO = 128, 5, 300_000


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str, memo: WordHashes, n_words: int = SHINGLE) -> np.ndarray:
    """Hash of every shingle: its words' hashes, mixed in their order."""
    words = text.encode().split()
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - n_words + 1) if len(h) else 0
    out = np.zeros(n, np.uint64)
    for j in range(min(n_words, len(h))):
        out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k least distinct hashes, in order."""
    if len(hashes) > 8 * k:  # only about the least are worth sorting
        least = hashes[hashes <= np.partition(hashes, 4 * k)[4 * k]]
        found = np.unique(least)
        if len(found) >= k:
            return found[:k]
    return np.unique(hashes)[:k]


def sketch_text(text: str, memo: WordHashes, n_words: int = SHINGLE, k: int = K, part: int = 1 << 22) -> np.ndarray:
    """The sketch of a whole text; one of over ``part`` characters is sketched in parts that overlap by a shingle less a word, and merged."""
    if len(text) <= part:
        return sketch(shingles(text, memo, n_words), k)
    out, rest, whole = np.zeros(0, np.uint64), "", False
    for start in range(0, len(text), part):
        rest += text[start : start + part]
        last = start + part >= len(text)
        tail = "" if last or not rest or rest[-1].isspace() else rest.rsplit(None, 1)[-1]  # a word may go on in the next part
        words = rest[: len(rest) - len(tail)].encode().split()
        if len(words) >= n_words or (last and not whole):
            out, whole = merge(out, sketch(shingles(b" ".join(words).decode(), memo, n_words), k), k), True
            words = words[len(words) - n_words + 1 :]
        rest = b" ".join(words).decode() + " " + tail
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness of the shingle sets below two sketches; exact if both are smaller than k."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[-1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def text_of(a: np.ndarray) -> str:
    """A sketch as text: 16 hex digits a hash."""
    return a.astype(">u8").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = K, n_words: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, n_shingles (estimated distinct shingles) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            found = [sketch_text(t.as_py() or "", memo, n_words, k) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(text_of, found), pa.string()), pa.array([distinct(a, k) for a in found], pa.float64())], names=["doc_id", "fingerprint", "n_shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string, n_shingles double")


def with_next(docs: DataFrame, run, schema: str) -> DataFrame:
    """Apply ``run`` to partitions of (bucket, ahead, doc_id, text) where rows of a bucket follow by descending doc_id.

    Buckets are ranges of doc_id. Each ends with a row marked ``ahead``: the
    first of the next bucket, so a reader knows the successor of every row of its
    own. Texts are shuffled once.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    n = partitions(spark)
    ids, _ = stash(docs.select("doc_id"))
    # Range ends and each range's greatest id: n numbers, whatever the table's size.
    at = ids.where("doc_id is not null").agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else []
    cuts = sorted(set(at or []))
    # A two-level search: about 2 * sqrt(n) comparisons a row. Bucket 0 has the null ids, which come last.
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    bigints = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    below = lambda xs: F.size(F.filter(xs, lambda c: c < F.col("doc_id")))
    if cuts:
        group = below(bigints(g[-1] for g in groups))
        bucket = group * width + F.coalesce(below(F.get(F.array(*map(bigints, groups)), group)), F.lit(0)) + 1
    else:
        bucket = F.lit(1)
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(bucket).cast("int")
    tops = {r["b"]: r["top"] for r in ids.groupBy(bucket.alias("b")).agg(F.max("doc_id").alias("top")).collect()}
    used = sorted(tops, reverse=True)
    above = {b: used[(i - 1) % len(used)] for i, b in enumerate(used)}
    last = max(used, default=0) + 1
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), bucket.alias("own"))
    is_top = F.col("doc_id").eqNullSafe(F.get(bigints(tops.get(b) for b in range(last)), F.col("own")))
    rows = rows.withColumn("other", F.when(is_top, F.get(F.array(*[F.lit(above.get(b)).cast("int") for b in range(last)]), F.col("own"))))
    copies = F.array_compact(F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("ahead")), F.when(F.col("other").isNotNull(), F.struct(F.col("other").alias("bucket"), F.lit(True).alias("ahead")))))
    dealt = rows.select("doc_id", "text", F.explode(copies).alias("c")).select("c.bucket", "c.ahead", "doc_id", "text")
    placed = dealt.repartitionById(last, F.col("bucket"))
    return placed.sortWithinPartitions("bucket", "ahead", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text")).mapInArrow(run, schema)


def edited_pairs(docs: DataFrame, k: int = K, n_words: int = SHINGLE) -> DataFrame:
    """Fingerprints of each text and of its edited text, and likenesses: see ``query``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "in_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
        held, shown = None, set()

        def row(before, text, own):
            n = len(before[1])
            half = n // 2
            edited = before[1][: n - half] + text[:half]
            e = sketch_text(edited, memo, n_words, k)
            return before[0], n, hashlib.sha256(edited.encode()).hexdigest(), text_of(before[2]), text_of(e), resemblance(before[2], e, k), resemblance(before[2], own, k), distinct(before[2], k), containment(before[2], own, k)

        out: list[tuple] = []
        for batch in batches:
            for bucket, ahead, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ahead and bucket in shown:
                    continue  # a repeat of the look-ahead row
                text = text or ""
                own = sketch_text(text, memo, n_words, k)
                if held is not None:
                    out.append(row(held, text, own))
                held = None if ahead else (doc_id, text, own)
                if ahead:
                    shown.add(bucket)
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return with_next(docs, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, in_next double")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: fingerprints of every text and of the text whose latter half is taken from the next document's start; estimated distinct shingles, and the share of them that the next text has."""
    return edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
