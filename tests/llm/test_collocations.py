import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from passbook.llm import collocations as C

from ..oracle import differences


def slow(rows, least, longest=3, inside=50, top=2000):
    """From (text, lang): the same result in plain Python."""
    out = []
    for lang in sorted({"und" if lang is None else lang for _, lang in rows}):
        f = Counter()
        for text, where in rows:
            if ("und" if where is None else where) == lang:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
                for piece in re.split("[.,;:!?\n-\r]", low):
                    w = re.findall("[^ \t]+", piece)
                    f.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        n = sum(v for p, v in f.items() if len(p) == 1)
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        scored = []
        for p, a in cand.items():
            if p not in longer or 100 * longer[p] < inside * a:
                score, k = min((Fraction(1000000 * a * a, f[p[:k]] * f[p[k:]]).__floor__(), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return out


def got(frame):
    return sorted(map(tuple, frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize(("least", "longest", "inside"), [(10, 3, 50), (2, 3, 50), (2, 4, 80), (3, 2, 10)])
def test_against_plain_python(docs, texts, least, longest, inside):
    rows = [tuple(r) for r in docs.select("text", "lang").collect()]
    assert got(C.collocations(docs, least, longest, inside)) == slow(rows, least, longest, inside)


def test_ranks_stop_at_the_top(docs):
    rows = [tuple(r) for r in docs.select("text", "lang").collect()]
    assert got(C.collocations(docs, 2, top=7)) == slow(rows, 2, top=7)


def test_edges(edge, empty):
    rows = [tuple(r) for r in edge.select("text", "lang").collect()]
    assert got(C.collocations(edge, 2)) == slow(rows, 2)
    assert C.collocations(empty).count() == 0


def test_odd_characters_and_ties(spark, rng):
    words = ["a", "B", "b", "É", "é", "\x00", " ", "\x85x", "😀", "a'b", "-", "日本"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ". ", "\n", "\x0b", "!"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", None, "und", ""])) for _ in range(300)]
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    assert got(C.collocations(frame, 3)) == slow(rows, 3)


def test_buckets_that_spill(spark, docs, monkeypatch):
    """The same counts whatever the chunks and buckets."""
    whole = sorted(map(tuple, C.counts(docs, 2).where("gram is not null").collect()))
    monkeypatch.setattr(C, "CHUNK", 50)
    monkeypatch.setattr(C, "BUCKETS", 7)
    assert sorted(map(tuple, C.counts(docs.unionByName(docs.limit(0)).repartition(13), 2).where("gram is not null").collect())) == whole


def test_blocks_and_long_pieces(spark, docs, edge, monkeypatch):
    """The same counts whatever the blocks of a task; pieces longer than a block keep the phrases across its ends."""
    every = docs.select("text", "lang").unionByName(edge.select("text", "lang"))
    whole = sorted(map(tuple, C.counts(every, 2).where("gram is not null").collect()))
    monkeypatch.setattr(C, "WORDS", 997)
    monkeypatch.setattr(C, "BYTES", 9000)
    assert sorted(map(tuple, C.counts(every.coalesce(1), 2).where("gram is not null").collect())) == whole


def test_a_large_task_of_different_words(spark):
    """A task with a million long words, all different: more than duckdb could sort in its memory."""
    word = lambda k: F.repeat(F.hex(F.xxhash64("id", F.lit(k))), 4)
    parts = spark.range(100_000, numPartitions=1).select(F.lit("en").alias("lang"), F.concat_ws(" ", *map(word, range(10))).alias("piece"), F.lit(3).cast("long").alias("m"))
    chunks = C.phrases(parts, 3, 16).repartition(8, "bucket").sortWithinPartitions("bucket")
    found = C.summed(chunks, 1).where("gram is not null").groupBy(F.size(F.split("gram", " "))).agg(F.count("*"), F.min("f"), F.max("f"))
    assert sorted(map(tuple, found.collect())) == [(1, 1_000_000, 3, 3), (2, 900_000, 3, 3), (3, 800_000, 3, 3)]


def test_exact_beyond_64_bits(spark):
    """1000000 * a * a passes 64 bits; the quotient is exact."""
    a, l, r = 987_654_321_012, 987_654_321_013, 987_654_321_099
    frame = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    whole = lambda c: f"cast({c} as decimal(15,0))"
    score = F.expr(f"cast(1000000 as decimal(7,0)) * {whole('a')} * {whole('a')} div ({whole('l')} * {whole('r')})")
    assert frame.select(score).first()[0] == 1000000 * a * a // (l * r)


def test_sql(spark):
    assert differences(spark, "/root/testdata/sf0.01", C.query, C.SQL) == []
