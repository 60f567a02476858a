"""Document quality by histogram gradient-boosted trees over document statistics.

Statistics of each whole text are binned into at most 64 quantile bins; trees of
fixed depth are grown by gradient histograms (logistic loss) and stored as flat
arrays (feature, threshold, leaf values), so scoring walks all texts of a batch
down all trees with a few numpy gathers a level.

Trees are fitted on at most ``max_rows`` labelled documents, whose statistics the
executors make. Defined cases: null text is the empty text, scored like any
other. Without labels every score is 0.5. Several labels of one document: the
least is used. Repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import chunks
from .common import bound_batches, fold, sliced

#: Labelled documents that the trees are fitted on.
MAX_ROWS = 12_000
DEPTH, TREES, RATE, BINS = 4, 60, 0.2, 64

_LINE = re.compile(rb"[^\n]+")
NAMES = ("log_bytes", "log_words", "word_length", "long_words", "upper", "digit", "symbol", "punctuation", "space", "non_ascii", "newline", "distinct_words", "top_word", "repeat_bigram", "repeat_line", "line_length", "bare_ends", "short_words", "repeat_next")

_CLASS = np.zeros(256, np.int64)
for _name, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>{}[]\\^~=+@_", b".,;:!?'\"()-", b" \t", bytes(range(128, 256)), b"\n"), 1):
    _CLASS[list(_chars)] = _name


def statistics(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """One row of statistics a text of a binary column."""
    out = np.zeros((batch.num_rows, len(NAMES)))
    for first, _, buffer, starts, ends in chunks(batch, column):
        kinds = _CLASS[buffer]
        for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
            text, n = buffer[s:e].tobytes(), max(1, e - s)
            per = np.bincount(kinds[s:e], minlength=8) / n
            words = text.split()
            n_words = max(1, len(words))
            lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
            counts: dict[bytes, int] = {}
            for w in words:
                counts[w] = counts.get(w, 0) + 1
            lines = _LINE.findall(text)
            pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 0
            row = out[first + i]
            row[0], row[1] = np.log1p(e - s), np.log1p(len(words))
            row[2], row[3] = lengths.mean(), (lengths > 15).mean()
            row[4:11] = per[1:8]
            row[11] = len(counts) / n_words
            row[12] = max(counts.values(), default=0) / n_words
            row[13] = 1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0
            row[14] = 1 - len(set(lines)) / max(1, len(lines)) if lines else 0
            row[15] = np.log1p(n / max(1, len(lines)))
            row[16] = sum(x[-1:] not in b".!?\"'" for x in lines) / max(1, len(lines))
            row[17] = (lengths < 3).mean()
            row[18] = sum(a == b for a, b in zip(words, words[1:])) / n_words
    return out


@dataclass
class Forest:
    """Complete trees of one depth as arrays: tree x inner node, tree x leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - (len(f))]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees; a split needs 20 rows and some gain on both sides, else the node passes all rows left."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    if not len(y) or y.min() == y.max():
        p = 0.5 if not len(y) else min(0.99, max(0.01, float(y.mean())))
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), float(np.log(p / (1 - p))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    total, forest = np.full(len(y), start), ([], [], [])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        node, f, t = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            base, width = 2**level - 1, 2**level
            best = np.zeros(width)
            pick_f, pick_b = np.zeros(width, np.int64), np.full(width, -1)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key, size = (node - base) * BINS + binned[:, j], width * BINS
                g, h, n = (np.bincount(key, w, size).reshape(width, BINS).cumsum(axis=1) for w in (grad, hess, None))
                gl, hl, nl, (ga, ha, na) = g[:, : len(c)], h[:, : len(c)], n[:, : len(c)], (z[:, -1:] for z in (g, h, n))
                gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                gain[(nl < 20) | (na - nl < 20)] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(width), top] > best + 1e-6
                best[better] = gain[np.arange(width), top][better]
                pick_f[better], pick_b[better] = j, top[better]
            for k in np.flatnonzero(pick_b >= 0):
                f[base + k], t[base + k] = pick_f[k], cuts[pick_f[k]][pick_b[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > t[node])
        at = node - inner
        leaf = RATE * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + 1)
        total += leaf[at]
        for store, value in zip(forest, (f, t, leaf), strict=True):
            store.append(value)
    return Forest(*map(np.array, forest), start)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Forest:
    """Fit on at most ``max_rows`` labelled documents, chosen by hash of the id."""
    bound_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("__y"))
    n = known.count()
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(23)), F.lit(1 << 20)) / float(1 << 20)
    known = known.where(share < (max_rows / n if n else 1.0))
    rows = docs.select("doc_id", "text").join(known, "doc_id").select(F.col("doc_id").cast("long"), "__y", F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(statistics(batch, 2)), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = rows.mapInArrow(make, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id").slice(0, max_rows)
    x = np.array(got.column("x").to_pylist()).reshape(-1, len(NAMES))
    return fit(x, np.array(got.column("y").to_pylist(), float))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id and score of every whole text."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((forest.feature, forest.threshold, forest.leaf, forest.start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Forest(*shared.value)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.score(statistics(batch, 1)), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: quality of every document, learned from labels whose fold is not 2."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    forest = train(docs, labels.where(fold("doc_id", 4) != 2))
    scored = score(docs, forest)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
