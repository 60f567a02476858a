import random

import pytest

#: Nulls, empty and very long texts, ties, repeated rows, and columns with names that operators use inside.
EDGE = [(1, None, None, None), (2, "", "en", "a"), (3, "  \n\t ", "en", "a"), (4, "word", "en", "b"), (4, "word", "en", "b"), (5, "one two", None, "b"), (6, "x " * 60_000, "en", "a"), (7, "é" * 5000, "fr", None), (8, "the same text of many words that goes on for a while, " * 9, "en", "a"), (9, "the same text of many words that goes on for a while, " * 9, "en", "c"), (None, "no id at all here", "en", "c")]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge cases with clashing extra columns."""
    names = ["fp", "__k", "__kept", "__out", "__bad", "__id", "__key", "__W", "__first", "__lang", "__score", "__row", "__rest", "__copies", "__words", "__spot", "__y", "a.b"]
    rows = [(i, t, lang, s, len(t or ""), 0.5, 7, *names) for i, t, lang, s in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, block int, " + ", ".join(f"`{n}` string" for n in names))


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture
def rng():
    return random.Random(5)
