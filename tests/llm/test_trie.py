import hashlib
import zlib
from collections import defaultdict

import pytest

from passbook.llm import trie as T

from ..oracle import differences

KINDS = "conv_id long, turn long, role string, text string"


def slow(rows):
    """The same nodes by walking every conversation in plain Python."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v, key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))] for c, v in own.items()}
    members, finished = defaultdict(set), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].add(c)
        finished[whole].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in kids[p]]
        own_saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        sums[p] = (sum(b[0] for b in below) if below else 1, own_saved + sum(b[1] for b in below))
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *sums[p], sha(finished[p])) for p, m in members.items())


def check(frame, rows):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = T.prefix_trie(frame)
    assert got.columns == names and all(t == "bigint" for c, t in got.dtypes if c != "ends_sha256")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == slow(rows)


def test_sql(spark):
    assert differences(spark, "/root/testdata/sf0.01", T.query, T.SQL) == []


def test_random_conversations(spark, rng):
    """Shared beginnings at every depth, ties and gaps in turns, negative ids and ids far apart."""
    rows = []
    for c in [*range(-7, 150), *(rng.randrange(10**12) for _ in range(40)), 300, 301, 399]:
        for turn in range(rng.choice((1, 2, 3, 6, 12))):
            rows.append((c, rng.choice((turn, turn, None, 3)), rng.choice(("user", "assistant", None)), rng.choice(("a", "b", "é😀", "", None))))
    check(spark.createDataFrame(rows, KINDS).repartition(5), rows)


def test_one_long_conversation_and_a_crowd(spark, rng):
    """A conversation over all ranges; one beginning and one whole conversation that many share; digests of many blocks."""
    rows = [(12345, t, "user", f"turn {t}") for t in range(1500)] + [(c, 0, "user", "hello") for c in range(5000, 9600)]
    rows += [(12399, t, "user", f"turn {t}") for t in range(800)] + [(12300, t, "user", f"turn {t}") for t in range(3)]
    rows += [(c, 6 + k, "user", str((c + k) % 3)) for c in range(5000, 5200) for k in range(9)]
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, KINDS), rows)


def test_blocks_of_ends(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 4)
    rows = [(c, 0, "user", "x") for c in range(200)] + [(c, t, "user", "y") for c in range(300, 330) for t in range(9)]
    check(spark.createDataFrame(rows, KINDS), rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(7, None, None, None)], [(150, 0, "user", "x")], [(101, 0, "u", "x"), (102, 0, "u", "x")], [(4, 1, "u", "same")] * 9, [(5, 0, "u", "x" * 200_000), (5, 1, "a", "é" * 100_000)]])
def test_edges(spark, rows):
    frame = spark.createDataFrame(rows, KINDS)
    check(frame.selectExpr("*", "1 as depth", "'x' as part", "2 as g1", "3 as path"), rows)
