import corpus_pipeline
import numpy as np
import pytest

from passbook.llm import bpe, components, nearcopies
from passbook.llm.common import stash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies(spark, rng):
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(n)]
    rows = {}
    for base in range(30):
        text = words(rng.randrange(60, 400))
        for copy in range(6):
            edited = list(text)
            for _ in range(copy // 2 * len(text) // 120):
                edited[rng.randrange(len(text))] = "edited"
            rows[10 * base + copy] = " ".join(edited)
    rows |= {1000 + k: " ".join(words(80)) for k in range(60)}
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in nearcopies.keep_one(frame).collect()}
    sets = {i: shingles(t) for i, t in rows.items()}
    assert set(range(1000, 1060)) <= kept and {10 * b for b in range(30)} <= kept
    for i in set(rows) - kept:
        assert max(likeness(sets[i], sets[j]) for j in rows if j != i) >= 0.7
    left = [(i, j) for i in kept for j in kept if i < j < 1000 and i // 10 == j // 10 and likeness(sets[i], sets[j]) >= 0.87]
    assert left == []


def test_stage_edges(spark, edge, empty):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, edge, None)
        assert out.columns == edge.columns, name
        out.collect()
        assert stage(spark, empty, None).count() == 0
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, edge, None).collect()]
    assert sorted(i for i in kept if i) == [1, 4, 5, 6, 7, 8]


@pytest.fixture(scope="module")
def stages(spark, docs):
    out, frame = [docs], docs
    for _, stage in corpus_pipeline.STAGES:
        frame, _ = stash(stage(spark, frame, None))
        out.append(frame)
    return out


def test_stages_against_brute_force(spark, sf_dir, stages):
    raw, named, lined, single, mixed, coded = stages
    count = [f.count() for f in stages]
    assert count[0] >= count[1] == count[2] >= count[3]
    sets = [shingles(r["text"]) for r in single.collect()]
    assert all(likeness(a, b) < 0.9 for k, a in enumerate(sets) for b in sets[:k])
    whole = {r["doc_id"]: r["text"].split() for r in single.collect()}
    taken = {}
    for r in mixed.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(whole[r["doc_id"]])
    assert sum(taken.values()) == pytest.approx(1.5 * sum(map(len, whole.values())), rel=0.1)
    import public_tokenizers as P

    codec = bpe.Codec(bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    rows = coded.collect()
    assert len(rows) == count[4]
    for r in rows:
        ids = np.frombuffer(r["ids"], "<i4").tolist()
        assert len(ids) == r["n_tokens"] and codec.decode(ids).decode() == texts[r["doc_id"]]
    again = corpus_pipeline.run(spark, sf_dir).select("doc_id", "ids_sha256").collect()
    assert sorted(map(tuple, again)) == sorted((r["doc_id"], r["ids_sha256"]) for r in rows)


def groups(rows):
    """Least id of each component of pairs at 0.8 or more, by brute force."""
    sets = {i: shingles(t) for i, t in rows.items()}
    root = {i: i for i in rows}
    for i in rows:
        for j in rows:
            if i < j and root[i] != root[j] and likeness(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return set(root.values())


def kept_ids(spark, rows, **options):
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    return {r["doc_id"] for r in nearcopies.keep_one(frame, **options).collect()}


def changed(rng, text, share):
    """A copy with words replaced at its end, so that about ``share`` of the shingles of both are in both."""
    own = round(len(text) * (1 - share) / (1 + share))
    return text[: len(text) - own] + [f"new{rng.randrange(10**9)}" for _ in range(own)]


def test_links_are_verified_on_the_shingle_sets(spark, rng):
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(n)]
    line = words(12)
    rows = {k: " ".join(line * 12 + words(40)) for k in range(20)}  # alike by count of shingles, not by sets
    for k in range(60):
        text = words(200)
        rows[100 + 2 * k], rows[101 + 2 * k] = " ".join(text), " ".join(changed(rng, text, (0.7, 0.74, 0.77)[k % 3]))
    assert kept_ids(spark, rows) == groups(rows) == set(rows)


def test_near_copies_are_those_of_brute_force(spark, rng):
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(n)]
    rows = {}
    for k in range(150):
        text = words(rng.randrange(60, 300))
        rows[2 * k], rows[2 * k + 1] = " ".join(text), " ".join(changed(rng, text, 0.81))
    common = words(200)
    for k in range(60):  # pairs inside a family of loosely alike texts
        text = common + words(50)
        rows[1000 + 2 * k], rows[1001 + 2 * k] = " ".join(text), " ".join(words(8) + text[8:-14] + words(14))
    for k in range(8):  # a chain: each is like the next only
        common = changed(rng, common[20:] + common[:20], 0.85)
        rows[2000 + k] = " ".join(common)
    assert kept_ids(spark, rows) == groups(rows)


def test_without_crowds_no_pair_is_missed(spark, rng):
    """A family of 120 loosely alike texts, all of which meet at its shingles, with pairs at 0.8 exactly; and texts without words."""
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(n)]
    common, rows = words(150), {900: "", 901: " ", 902: "one two"}
    for k in range(60):
        text = common + words(50)
        rows[2 * k], rows[2 * k + 1] = " ".join(text), " ".join(changed(rng, text, 0.8 + 0.01 * (k % 3)))
    plain = {i: t.strip() for i, t in rows.items()}
    alone = groups({i: t for i, t in plain.items() if t})
    assert kept_ids(spark, rows, crowd=None) == alone | {900}


def test_later_rounds_start_from_the_groups_found(spark, rng, monkeypatch):
    """Groups are found once: with no new link, components ends after one round, not after as many as a long chain takes."""
    rounds, state, common = [], components._state, [f"w{rng.randrange(10**6)}" for _ in range(200)]

    def counted(links):
        rounds[-1] += 1
        return state(links)

    def begun(links):
        rounds.append(-1)  # the state before the first round is no round
        return components.components(links)

    monkeypatch.setattr(components, "_state", counted)
    monkeypatch.setattr(nearcopies, "components", begun)
    rows = {}
    for k in range(12):  # each is like the next only
        common = changed(rng, common[12:] + common[:12], 0.92)
        rows[k] = " ".join(common)
    assert kept_ids(spark, rows) == groups(rows) == {0}
    assert rounds[0] > 1 and rounds[-1] == 1
