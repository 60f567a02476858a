import hashlib
from collections import Counter

import pytest

from passbook.llm import repeats


def brute(texts, span=200):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    counts = Counter(t[p : p + span] for t in raw.values() for p in range(len(t) - span + 1))
    out = {}
    for i, t in raw.items():
        gone = bytearray(len(t))
        for p in range(len(t) - span + 1):
            if counts[t[p : p + span]] > 1:
                gone[p : p + span] = b"\1" * span
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(frame, texts, group):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in repeats.remove(frame, group).collect()}
    want = brute(texts)
    assert {i for i in want if want[i] != got[i]} == set() and len(got) == len(want)


@pytest.mark.parametrize("group", [1, 2048])
def test_matches_brute_force(spark, docs, texts, group):
    check(docs, texts, group)


@pytest.mark.parametrize("group", [2, 2048])
def test_planted_passages(spark, rng, group):
    word = lambda n: "".join(rng.choice("abcdefgé ") for _ in range(n))
    passages = [word(n) for n in (150, 199, 200, 201, 230, 400, 900)]
    texts = {}
    for i in range(120):
        parts = [word(rng.randrange(0, 300))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 40)
            parts += [p[cut:] if rng.random() < 0.5 else p[: len(p) - cut], word(rng.randrange(0, 200))]
        texts[i] = "".join(parts)
    texts |= {200: "x" * 700, 201: "ab" * 300, 202: texts[5], 203: "", 204: word(199), 205: "ab" * 120}
    check(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts, group)


def test_long_text_in_pieces(spark, rng, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 300)
    base = "".join(rng.choice("abcdef ") for _ in range(4000))
    rows = repeats.contexts([(0, base.encode())])
    assert sorted(p for *_, a, b in rows for p in range(a, b + 1)) == list(range(4000 - 199))


def test_edges(edge, empty):
    got = repeats.remove(edge).toPandas()
    assert len(got) == 11 and repeats.remove(empty).count() == 0
    assert got[got["doc_id"] == 6]["n_removed"].iloc[0] == 120_000
    assert got[got["doc_id"].isin([8, 9])]["kept"].tolist() == [b"", b""]
