"""Removal of byte strings of 200 bytes that occur elsewhere.

This is not the difference-cover suffix sort: no suffix is sorted, positions are
sampled by content and grouped by hash (README has the reason).

1. Sample. Every string chooses the position whose 64-byte tuple has the least hash
   among its tuples. Equal strings choose the same offset; 1.5 % of positions are chosen.
2. Tuples are counted by name; strings whose tuple is unique are unique.
3. Strings that choose one sampled position form a context, which is named in turn.
   Where a whole context recurs, all its strings do.
4. Contexts that share a tuple but are not equal are compared string by string:
   tuples with few contexts within a task, tuples with more than ``GROUP`` contexts by
   counting every string in a shuffle, so that no key gathers unbounded rows in a task.
5. Strings found equal are repeated; their bytes go.

Defined cases: null text is the empty text; texts below 200 bytes are never
touched; equal texts of 200 bytes or more lose every byte; overlapping repeats
within a text count. Repeated rows are texts like any other. The kept bytes may
end within a character, so they are binary. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, partitions, stash

#: Bytes of a string and of a sampled tuple; contexts of a tuple that one task compares; starts that one pass looks at.
SPAN, TUPLE, GROUP, PIECE = 200, 64, 2048, 1 << 22

_LOW = np.uint64((1 << 24) - 1)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x165667B19E3779F9))
    z *= np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(32))


def sampled(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of each string start: the sampled position its string chooses; and the tuple hash of each position."""
    h = np.frombuffer(buffer, np.uint8).astype(np.uint64)
    size = 1
    while size < TUPLE:
        h = _mix(h[:-size], h[size:])
        size *= 2
    n, wide = len(h), SPAN - TUPLE + 1
    least, size = (h & ~_LOW) | np.arange(n, dtype=np.uint64), 1
    while 2 * size <= wide:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    starts = n - wide + 1
    least = np.minimum(least[:starts], least[wide - size : wide - size + starts])
    return (least & _LOW).astype(np.int64), h.view(np.int64)


def contexts(text_rows: list[tuple[int, bytes]]) -> list[tuple[int, int, int, int, int]]:
    """(row, tuple name, context name, first start, last start) of every context of the texts (row, text)."""
    out, batch, held = [], [], 0

    def flush() -> None:
        nonlocal batch, held
        if not batch:
            return
        buffer = b"".join(x for _, _, x in batch)
        lengths = np.array([len(x) for _, _, x in batch])
        ends = np.cumsum(lengths)
        chosen, name = sampled(buffer)
        valid = np.zeros(len(chosen) + SPAN, np.int64)
        valid[ends - lengths] += 1
        valid[ends - SPAN + 1] -= 1
        at = np.flatnonzero(np.cumsum(valid)[: len(chosen)])
        m = chosen[at]
        first = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1)]))
        a, b, m = at[first], at[np.append(first[1:], len(at)) - 1], m[first]
        of = np.searchsorted(ends, a, side="right")
        shift = np.array([o for _, o, _ in batch]) - (ends - lengths)
        digest = xxhash.xxh3_64_intdigest
        for i, s, e, p, g in zip(of.tolist(), a.tolist(), b.tolist(), m.tolist(), name[m].tolist(), strict=True):
            c = digest(buffer[s : e + SPAN], p - s)
            move = int(shift[i])
            out.append((batch[i][0], g, c - (1 << 64) if c >> 63 else c, s + move, e + move))
        batch, held = [], 0

    for key, text in text_rows:
        for o in range(0, max(0, len(text) - SPAN + 1), PIECE):
            piece = text[o : o + PIECE + SPAN - 1]
            batch.append((key, o, piece))
            held += len(piece)
            if held > 1 << 20:
                flush()
    flush()
    return out


def repeated(group: list[bytes], offsets: list[tuple[int, int]], single: list[bool]) -> list[list[tuple[int, int]]]:
    """For each context of one tuple: runs [first, last] of starts whose string another context has too.

    ``offsets``: first and last start, relative to the text; strings are compared wherever they start.
    """
    counts: Counter = Counter()
    for ctx, (a, b), one in zip(group, offsets, single, strict=True):
        for i in range(b - a + 1):
            counts[ctx[i : i + SPAN]] += 1 if one else 2
    out = []
    for ctx, (a, b), one in zip(group, offsets, single, strict=True):
        runs: list[list[int]] = []
        if one:
            for i in range(b - a + 1):
                if counts[ctx[i : i + SPAN]] > 1:
                    if runs and runs[-1][1] == a + i - 1:
                        runs[-1][1] = a + i
                    else:
                        runs.append([a + i, a + i])
        out.append([(x, y) for x, y in runs])
    return out


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            rows = contexts(list(enumerate(part.column(2).to_pylist())))
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([part.column(0).take(cols[0]), part.column(1).take(cols[0]), *cols[1:]], names=["key", "id", "g", "c", "p0", "p1"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the asked contexts of each text."""
    names = ["g", "key", "p0", "p1", "single", "many", "ctx"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
    for batch in batches:
        cols: list[list] = [[] for _ in names]
        for key, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for x in asked:
                for col, value in zip(cols, (x["g"], key, x["p0"], x["p1"], x["single"], x["many"], text[x["p0"] : x["p1"] + SPAN]), strict=True):
                    col.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated strings; rows come sorted by tuple, at most GROUP of one."""
    held: list[tuple] = []
    out: list[tuple] = []

    def settle() -> None:
        if held:
            runs = repeated([r[5] for r in held], [(r[2], r[3]) for r in held], [r[4] for r in held])
            out.extend((r[1], a, b) for r, found in zip(held, runs, strict=True) for a, b in found)
            held.clear()

    def give() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 3
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["key", "p0", "p1"])
        out.clear()
        return made

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[-1][0] != row[0]:
                settle()
            held.append(row)
        if len(out) > 5000:
            yield give()
    settle()
    yield give()


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    for batch in batches:
        cols: list[list] = [[] for _ in names]
        for doc_id, text, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            kept, done, spans = [], 0, 0
            for a, b in sorted((r["p0"], r["p1"] + SPAN) for r in runs or []):
                if a > done or not spans:
                    kept.append(text[done:a])
                    spans += 1
                done = max(done, b)
            kept = b"".join(kept) + text[done:]
            for col, value in zip(cols, (doc_id, len(text), len(text) - len(kept), spans, kept), strict=True):
                col.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=names)


def remove(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn("key", F.unhex(F.md5("text"))).withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    rows, _ = stash(texts.select("key", "id", "text").mapInArrow(_sample, "key binary, id long, g long, c long, p0 long, p1 long"))
    # A written side lets Spark split the join's large partitions, which it can't below an aggregate.
    twice, _ = stash(rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"))
    shared, _ = stash(rows.join(twice, "g"))
    # Contexts of shared tuples by name, one place of each, and how many contexts their tuple has.
    named = shared.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("key", "id", "p0", "p1")).alias("at"))
    named, _ = stash(named.select("g", "c", "n", "at.*"))
    wide, _ = stash(named.groupBy("g").agg(F.count("*").alias("n_contexts")).where("n_contexts > 1"))
    whole = shared.join(named.where("n > 1").select("g", "c"), ["g", "c"]).select("key", "p0", "p1")
    asked = named.join(wide, "g").select("key", "id", F.struct("g", "p0", "p1", (F.col("n") == 1).alias("single"), (F.col("n_contexts") > group).alias("many")).alias("x"))
    asked = asked.groupBy("key", "id").agg(F.collect_list("x").alias("asked"))
    # Of copied texts only the row with the least id is asked.
    cut = texts.join(asked, ["key", "id"]).select("key", "text", "asked").mapInArrow(_cut, "g long, key binary, p0 long, p1 long, single boolean, many boolean, ctx binary")
    cut, _ = stash(cut.dropDuplicates(["key", "p0"]))
    few = cut.where("not many").select("g", "key", "p0", "p1", "single", "ctx").repartition(partitions(spark), "g").sortWithinPartitions("g").mapInArrow(_compare, "key binary, p0 long, p1 long")
    strings = cut.where("many").select("key", "p0", "single", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("p1") - F.col("p0")), lambda i: F.unhex(F.md5(F.substring("ctx", i.cast("int") + 1, SPAN))))).alias("i", "name"))
    again = strings.groupBy("name").agg(F.sum(F.when(F.col("single"), 1).otherwise(2)).alias("n")).where("n > 1").select("name")
    many = strings.where("single").join(again, "name").select("key", (F.col("p0") + F.col("i")).alias("p0"), (F.col("p0") + F.col("i")).alias("p1"))
    runs = whole.union(few).union(many).distinct().groupBy("key").agg(F.collect_list(F.struct("p0", "p1")).alias("runs"))
    runs, _ = stash(runs)
    return texts.join(runs, "key", "left").select("doc_id", "text", "runs").mapInArrow(_strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: what every document loses to strings found elsewhere, and the digest of the rest."""
    found = remove(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
