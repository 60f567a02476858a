"""Toxicity by weak supervision.

Voters are lexicons and patterns: insult words known beforehand, words, and word
stems (4 to 6 letters) of three strengths that labelled documents tie to toxicity,
patterns of abuse (insults addressed to someone, dismissals, threats, insults in
a row), each in a one-hit, a several-hits and a density form, and voters for clean
text. A generative label model estimates by expectation maximisation each voter's
accuracy, and each pair's correlation given the class: every round, voters that agree
beyond what the class explains share their say. The model's posteriors, not the
labels, train a linear (logistic) classifier over hit counts and densities, which
scores every whole text.

Lexicons are mined from at most ``max_rows`` labelled documents, all their terms;
so what the driver holds is bounded by that sample. Defined cases: null text is the
empty text, scored like any other. Without toxic labels only the fixed lexicon and
the patterns vote, and a few made-up rows (no hit: clean; several insults: toxic)
stand for the missing cases. Several labels of one document: the greatest is used.
Repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fold

#: Labelled documents that lexicons are mined from and posteriors are made for.
MAX_ROWS = 12_000
STEMS = (4, 5, 6)
#: Log-odds from which a term belongs to the weak, medium and strong lexicon, and documents that must have it.
TIERS, LEAST = (2.5, 3.5, 4.5), 3

# Insults in common use.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown imbecile fool jerk bastard bitch asshole".split())

_WORD = re.compile(r"[^\W\d_]+")
_ABUSE = "|".join(sorted(INSULTS))
#: Patterns that vote, on the lower-cased text; each looks a bounded way ahead.
PATTERNS = {
    "addressed": re.compile(rf"\b(?:you|your|you're|ur|he|she|they)\b[^.!?\n]{{0,40}}\b(?:{_ABUSE})\b"),
    "dismissal": re.compile(r"\b(?:shut up|get lost|drop dead|go to hell|screw you|hate you|nobody (?:likes|wants|asked) you|you (?:people|lot) (?:are|should))\b"),
    "threat": re.compile(r"\b(?:kill|hurt|beat|hunt|destroy|punish)\s+(?:you|him|her|them|yourself)\b"),
    "stacked": re.compile(rf"\b(?:{_ABUSE})\b\W{{1,4}}(?:\w{{1,20}}\W{{1,4}}){{0,3}}(?:{_ABUSE})\b"),
}
#: One of these words stands in every match of a pattern: texts without any of them need no search.
NEEDED = {
    "addressed": INSULTS,
    "dismissal": frozenset("shut lost drop hell screw hate nobody people lot".split()),
    "threat": frozenset("kill hurt beat hunt destroy punish".split()),
    "stacked": INSULTS,
}


def terms(word: str) -> Iterator[str]:
    """What lexicons may hold of a word: itself, and its stems with a mark."""
    yield word
    for k in STEMS:
        if len(word) > k:
            yield f"{word[:k]}*{k}"


N_FEATURES = 2 + 2 * len(TIERS) + len(PATTERNS)


#: Words without a feature that a task remembers at once, and the longest of them in characters.
MEMO, LONGEST = 200_000, 64


class Voters:
    """Term lexicons by tier, and the features that they give a text."""

    def __init__(self, lexicon: dict[str, int]) -> None:
        self.tier = {t: k for t, k in lexicon.items() if "*" not in t}
        self.stems = [(n, {t.split("*")[0]: k for t, k in lexicon.items() if t.endswith(f"*{n}")}) for n in STEMS]
        self.plain: set[str] = set()

    def hits(self, word: str) -> list[int]:
        """Features that ``word`` counts for: insult, its tier, the tier of its shortest known stem."""
        out = [0] if word in INSULTS else []
        if word in self.tier:
            out.append(1 + self.tier[word])
        stem = next((known[word[:n]] for n, known in self.stems if len(word) > n and word[:n] in known), None)
        return out if stem is None else [*out, 1 + len(TIERS) + stem]

    def features(self, text: str) -> list[float]:
        """Hits of insults, words by tier, stems by tier and patterns, and the number of words."""
        low, out = text.lower(), [0.0] * N_FEATURES
        words = _WORD.findall(low)
        counts = Counter(words)
        out[-1] = float(len(words))
        for word in counts.keys() - self.plain:
            found = self.hits(word)
            for k in found:
                out[k] += counts[word]
            if not found and len(word) <= LONGEST:
                self.plain.add(word)
        if len(self.plain) > MEMO:
            self.plain.clear()
        for k, (name, pattern) in enumerate(PATTERNS.items(), 1 + 2 * len(TIERS)):
            if not NEEDED[name].isdisjoint(counts):
                out[k] = float(sum(1 for _ in pattern.finditer(low)))
        return out


def votes(x: np.ndarray) -> np.ndarray:
    """1 toxic, -1 clean, 0 abstains: a column a voter."""
    hits, words = x[:, :-1], np.maximum(x[:, -1:], 1)
    once, often, dense = hits >= 1, hits >= 2, hits / words > 0.01
    n_tiers = len(TIERS)
    strong = hits[:, 0] + hits[:, n_tiers] + hits[:, 2 * n_tiers]
    none = strong == 0
    nothing = hits.sum(axis=1) == 0
    sparse = (hits.sum(axis=1) / words[:, 0]) < 0.002
    return np.concatenate([once.astype(int), often.astype(int), dense.astype(int), -np.stack([none, nothing, sparse], axis=1).astype(int)], axis=1)


def label_model(v: np.ndarray, prior: float, rounds: int = 50) -> np.ndarray:
    """Posterior of the toxic class of each row of votes."""
    kinds = np.stack([v == 1, v == 0, v == -1])
    fired = np.abs(v).sum(axis=0) > 0
    kinds = kinds[:, :, fired].astype(float)
    score = (v == 1).sum(axis=1) - 2.0 * (v == -1).sum(axis=1)
    post = np.where(score > 0, 0.9, 0.05)
    discount = np.ones(kinds.shape[2])
    for _ in range(rounds):
        tables = [(np.tensordot(kinds, q, axes=([1], [0])) + 0.5) / (q.sum() + 1.5) for q in (post, 1 - post)]
        weight = np.log(tables[0]) - np.log(tables[1])
        # Correlation of each pair of voters given the class; those that agree beyond it share their say.
        mean = post[:, None] * (tables[0][0] - tables[0][2]) + (1 - post[:, None]) * (tables[1][0] - tables[1][2])
        rest = v[:, fired] - mean
        scale = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        tie = np.abs(rest.T @ rest / len(v) / np.outer(scale, scale))
        discount = (discount + 1 / np.where(tie > 0.3, tie, 0).sum(axis=1).clip(1)) / 2
        logit = np.log(prior / (1 - prior)) + np.tensordot(kinds * discount, weight, axes=([0, 2], [0, 1]))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post


def design(x: np.ndarray) -> np.ndarray:
    """Classifier inputs: hit counts (log), densities and indicators."""
    hits, words = x[:, :-1], np.maximum(x[:, -1:], 1)
    return np.concatenate([np.log1p(hits), np.minimum(hits / words * 50, 5), hits >= 1, np.ones((len(x), 1))], axis=1)


def fit_linear(d: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression on probabilities, by Newton steps."""
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (target - p) - ridge * w
        step = np.linalg.solve((d * (p * (1 - p) + 1e-6)[:, None]).T @ d + ridge * np.eye(len(w)), grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def mine(rows: DataFrame, n_toxic: int, n_clean: int) -> dict[str, int]:
    """Tier of each term that toxic documents of ``rows`` (text, __y) have far more often than clean ones.

    Texts count once however often they are copied. Terms are counted inside
    tasks and summed by Spark; only the kept ones reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def give():
            keys = list(seen[0].keys() | seen[1].keys())
            made = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["term", "toxic", "clean"])
            seen[0].clear()
            seen[1].clear()
            return made

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update({t for w in set(_WORD.findall(text.lower())) for t in terms(w)})
                if len(seen[0]) + len(seen[1]) > 200_000:
                    yield give()
        yield give()

    counted = rows.groupBy("text").agg(F.max("__y").alias("__y")).mapInArrow(count, "term string, toxic long, clean long")
    sums = counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= LEAST)
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    best = sums.withColumn("odds", odds).where(F.col("odds") >= TIERS[0]).select("term", "odds").collect()
    return {r["term"]: sum(r["odds"] >= t for t in TIERS) - 1 for r in best}


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> tuple[dict[str, int], np.ndarray]:
    """Lexicon and classifier weights from at most ``max_rows`` labelled documents, chosen by hash of the id."""
    bound_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("__y"))
    known = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(31)), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(known, "doc_id").select("doc_id", "text", "__y")
    per = {r["__y"]: r["n"] for r in rows.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = per.get(1, 0), per.get(0, 0)
    lexicon = mine(rows.select("text", "__y"), n_toxic, n_clean) if n_toxic else {}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([voters.features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=["doc_id", "x"])

    got = rows.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, "doc_id long, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(got.column("x").to_pylist()).reshape(-1, N_FEATURES)
    prior = min(0.5, max(0.01, n_toxic / max(1, n_toxic + n_clean)))
    target = label_model(votes(x), prior) if len(x) else np.zeros(0)
    if not n_toxic:  # nothing to learn the toxic side from
        made = np.zeros((20, N_FEATURES))
        made[:, -1] = np.arange(20) * 40
        made[10:, 0] = 4
        x, target = np.concatenate([x, made]), np.concatenate([target, np.repeat([0.0, 1.0], 10)])
    return lexicon, fit_linear(design(x), target)


def score(docs: DataFrame, lexicon: dict[str, int], weights: np.ndarray) -> DataFrame:
    """doc_id and score of every whole text."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, w = Voters(shared.value[0]), shared.value[1]
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                x = np.array([voters.features(t or "") for t in part.column(1).to_pylist()]).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(design(x) @ w, -30, 30))), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: toxicity of every document, learned from labels whose fold is not 1."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    lexicon, weights = train(docs, labels.where(fold("doc_id", 3) != 1))
    scored = score(docs, lexicon, weights)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
