"""Language identification by hierarchical discrimination.

A first model tells the language family; within the family one-versus-one linear
support vector machines separate the close relatives. Features are hashed byte
n-grams (1 to 4 bytes, letters lower-cased, other ASCII as blanks) of the whole
text as shares of their number. All models are linear, so scoring a text is one
pass that looks up and sums weights, vectorised over a buffer of many texts.

Machines are fitted by dual coordinate descent on a sample of labelled documents:
at most ``per_language`` a language, ``most_rows`` in all and ``most_features``
features in all, but one document of every language whatever their number. The
executors make the features. A machine's weights are 256 KB of the broadcast table.

Defined cases: null text, or one without any letter: ``und`` with score 0. One
learned language: it is predicted for every text with letters. No learned
language (empty table, no labels): ``und``. Repeated rows count each; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import chunks
from .common import bound_batches, fold, kinds, placed, quoted, sliced, stash, trimmed

#: Documents a language, documents in all, and features in all (8 bytes each) that the machines are fitted on.
PER_LANGUAGE, MOST_ROWS, MOST_FEATURES = 800, 12_000, 16_000_000
BITS, ORDERS, SCALE = 16, (1, 2, 3, 4), 40.0

# ISO 639-1 codes by language family; a code not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi fo",
    "romance": "es fr it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "indic": "hi bn ur pa gu mr ne si",
    "semitic": "ar he mt am",
    "turkic": "tr az kk uz ky tk",
    "uralic": "fi et hu",
    "sinitic": "zh yue",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def grams(buffer: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket of the n-gram that starts at each position, for each order; the last 3 positions are left out."""
    b = _FOLD[buffer].astype(np.uint32)
    n, h = len(b) - 3, np.zeros(max(0, len(b) - 3), np.uint32)
    for k in range(max(ORDERS)):
        h |= b[k : k + n] << np.uint32(8 * k)
        yield ((h + np.uint32(k + 1)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "ignore")))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of one text: buckets and their shares, scaled."""
    pad = b"    "
    buffer = np.frombuffer(pad + text + pad, np.uint8)
    seen = np.concatenate([g[1 : 4 + len(text)] for g in grams(buffer)])
    found, counts = np.unique(seen, return_counts=True)
    return found.astype(np.int32), (counts * (SCALE / max(1, len(seen)))).astype(np.float32)


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 10.0, epochs: int = 15, seed: int = 3) -> np.ndarray:
    """Weights (bias last) of a linear machine with hinge loss, by dual coordinate descent; classes weigh alike."""
    w, alpha, rng = np.zeros((1 << BITS) + 1), np.zeros(len(y)), np.random.default_rng(seed)
    squares = np.array([float(v @ v) + 1.0 for _, v in rows])
    bound = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            at, v = rows[i]
            grad = y[i] * (w[at] @ v + w[-1]) - 1
            new = min(max(alpha[i] - grad / squares[i], 0.0), bound[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                w[-1] += step
                moved, alpha[i] = max(moved, abs(new - alpha[i])), new
        if moved < 1e-3:
            break
    return w


@dataclass
class Model:
    """Languages, their families, and one column of weights a machine."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray  # buckets x machines: a machine a family if there are several, then one a pair
    bias: np.ndarray

    def predict(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row of margins."""
        n_fam = len(self.families) if len(self.families) > 1 else 0
        link = lambda m: 1 / (1 + np.exp(-np.clip(2.0 * m, -30, 30)))
        if n_fam:
            top = margins[:, :n_fam].argmax(axis=1)
            best = np.partition(margins[:, :n_fam], n_fam - 2, axis=1)
            sure = link(best[:, -1] - best[:, -2])
        else:
            top, sure = np.zeros(len(margins), int), np.ones(len(margins))
        langs, scores = [], np.empty(len(margins))
        column = {p: n_fam + j for j, p in enumerate(self.pairs)}
        for i, row in enumerate(margins):
            members = self.members[self.families[top[i]]]
            votes = {m: 0.0 for m in members}
            for a, b in combinations(members, 2):
                p = float(link(row[column[a, b]]))
                votes[a] += p
                votes[b] += 1 - p
            best_lang = max(members, key=lambda m: votes[m])
            langs.append(best_lang)
            scores[i] = sure[i] * (votes[best_lang] / (len(members) - 1) if len(members) > 1 else 1.0)
        return langs, scores


def sample(labelled: DataFrame, per_language: int, most_rows: int, most_features: int) -> DataFrame:
    """(doc_id, lang, rank, at, v): features of documents of each language, drawn by hash; the one of least hash in any case."""
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    known = labelled.where("lang is not null").where(F.col("text").rlike(r"\p{L}"))
    known = known.select(F.col("doc_id").cast("long"), "lang", F.col("text").cast("binary").alias("text"), F.struct(share.alias("share"), F.xxhash64("text").alias("own")).alias("draw"))
    counts, _ = stash(known.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least")))
    per_language = min(per_language, max(1, most_rows // max(1, counts.count())))
    rank = F.col("draw.share") * F.col("n") / per_language  # below 1 for as many as are wanted, on average
    first = F.col("draw") == F.col("least")
    drawn = known.join(counts, "lang").where((rank < 1) | first).dropDuplicates(["lang", "doc_id", "draw"]).select("doc_id", "lang", rank.alias("rank"), first.alias("first"), "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(trimmed(batches)):
            made = [features(t) if has_letter(t) else (np.zeros(0, np.int32), np.zeros(0, np.float32)) for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float32()))], names=["doc_id", "lang", "rank", "first", "at", "v"])

    made, _ = stash(drawn.mapInArrow(make, "doc_id long, lang string, rank double, first boolean, at array<int>, v array<float>"))
    total = made.agg(F.sum(F.size("at"))).first()[0] or 0
    return made.where((F.col("rank") * max(1.0, total / most_features) < 1) | F.col("first")).select("doc_id", "lang", "rank", "at", "v")


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS, most_features: int = MOST_FEATURES) -> Model | None:
    """Fit on a bounded sample of ``labelled`` (doc_id, text, lang), chosen by hash of the id."""
    bound_batches(labelled.sparkSession)
    model = fit(sample(labelled, per_language, most_rows, most_features).toArrow().sort_by([("lang", "ascending"), ("rank", "ascending"), ("doc_id", "ascending")]), per_language)
    pa.default_memory_pool().release_unused()  # the sample's memory, which the driver's Python would keep beside its JVM
    return model


def fit(got: pa.Table, per_language: int) -> Model | None:
    """Fit on the sample ``got`` (doc_id, lang, rank, at, v), in order of language and rank."""
    langs = got.column("lang").to_pylist()
    rows = list(zip((x.values.to_numpy() for x in got.column("at")), (x.values.to_numpy() for x in got.column("v")), strict=True))
    seen, keep = {}, []
    for i, lang in enumerate(langs):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= per_language and len(rows[i][0]):
            keep.append(i)
    langs, rows = [langs[i] for i in keep], [rows[i] for i in keep]
    members: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        members.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    families = sorted(members)
    if not families:
        return None
    fam, lang_of = np.array([FAMILY_OF.get(x, x) for x in langs]), np.array(langs)
    machines = [fit_svm(rows, np.where(fam == f, 1.0, -1.0)).astype(np.float32) for f in families] if len(families) > 1 else []
    pairs = [p for f in families for p in combinations(members[f], 2)]
    for a, b in pairs:
        own = np.flatnonzero((lang_of == a) | (lang_of == b))
        machines.append(fit_svm([rows[i] for i in own], np.where(lang_of[own] == a, 1.0, -1.0)).astype(np.float32))
    table = np.stack(machines, axis=1) if machines else np.zeros(((1 << BITS) + 1, 0), np.float32)
    return Model(families, members, pairs, np.asfortranarray(table[:-1]), table[-1].astype(np.float64))


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns, predicted language and score (0 to 1) of every whole text."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.families, model.members, model.pairs, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value and Model(*shared.value)
        for batch in sliced(trimmed(batches)):
            langs: list[str] = []
            scores: list[float] = []
            for _, _, buffer, starts, ends in chunks(batch, text_at):
                if m is None:
                    langs += ["und"] * len(starts)
                    scores += [0.0] * len(starts)
                    continue
                cuts = np.stack([starts - 3, ends], axis=1).ravel()
                sums = np.zeros((len(starts), m.weights.shape[1]))
                for g in grams(buffer):
                    for j in range(m.weights.shape[1]):
                        sums[:, j] += np.add.reduceat(np.append(m.weights[:, j][g], np.float32(0)), cuts, dtype=np.float64)[::2]
                total = np.maximum(1, (ends - starts + 3) * len(ORDERS))[:, None]
                found, sure = m.predict(sums * (SCALE / total) + m.bias)
                ascii_letters = np.add.reduceat(np.append(((buffer | 32) - 97 < 26)[:-1].astype(np.int64), 0), cuts)[::2]
                for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
                    if not ascii_letters[i] and not has_letter(buffer[s:e].tobytes()):
                        found[i], sure[i] = "und", 0.0
                langs += found
                scores += sure.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[: len(keep)], "lang", "score"])

    frame = docs.select(*quoted(keep), *([] if "text" in keep else ["text"]))
    text_at = frame.columns.index("text")
    named = placed(frame).mapInArrow(run, f"{kinds(placed(frame.select(*quoted(keep))))}, lang string, score double")
    return named.toDF(*keep, *names)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: language of every document, learned from those whose fold is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(fold("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
