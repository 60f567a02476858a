import hashlib

import numpy as np
import pytest

from passbook.llm import sketches as S


def true_likeness(a, b, n=5):
    sets = []
    for t in (a, b):
        w = t.split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    x, y = sets
    return len(x & y) / len(x | y) if x | y else 1.0


def test_query_matches_brute_force(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in S.query(spark, sf_dir).collect()}
    ids = sorted(texts, reverse=True)
    assert sorted(got, reverse=True) == ids
    errors = []
    for i, j in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, half = texts[i], len(texts[i]) // 2
        edited = t[: len(t) - half] + texts[j][:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [abs(got[i]["near_edited"] - true_likeness(t, edited)), abs(got[i]["near_next"] - true_likeness(t, texts[j]))]
    assert max(errors) < 0.2 and np.mean(errors) < 0.03
    by_text = {}
    for i in ids:
        assert by_text.setdefault(texts[i], got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_merge_and_estimates(rng):
    memo = S.WordHashes()
    words = [f"w{rng.randrange(3000)}" for _ in range(9000)]
    a, b = S.shingles(" ".join(words), memo, 1), S.shingles(" ".join(words[:5000]), memo, 1)
    assert (S.merge(S.sketch(a[:4000]), S.sketch(a[4000:])) == S.sketch(a)).all()
    assert S.distinct(S.sketch(a)) == pytest.approx(len(set(words)), rel=0.3)
    assert S.containment(S.sketch(b), S.sketch(a)) == pytest.approx(1, abs=0.25)
    assert (S.from_text(S.text_of(S.sketch(a))) == S.sketch(a)).all()


def test_long_texts_are_sketched_in_parts(rng):
    memo = S.WordHashes()
    for n in (0, 1, 4, 5, 6, 400):
        text = " \n ".join(f"wörd{rng.randrange(200)}" + "x" * rng.randrange(30) for _ in range(n))
        for part in (7, 50, 333):
            assert (S.sketch_text(text, memo, part=part) == S.sketch(S.shingles(text, memo))).all()
    assert (S.sketch_text("a" * 100, memo, part=9) == S.sketch(S.shingles("a" * 100, memo))).all()


def test_edges(spark, edge, empty, tmp_path):
    got = S.edited_pairs(edge).toPandas()
    assert len(got) == 11 and S.edited_pairs(empty).count() == 0
    assert got[got["doc_id"] == 9]["near_next"].iloc[0] == 1.0
    assert S.edited_pairs(edge.where("doc_id = 8")).first()["near_next"] == 1.0
    assert S.fingerprints(edge).count() == 11
