import re

import pytest
import xxhash

from passbook.llm import components, simhash


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids, root = list(fps), {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query_matches_brute_force(spark, sf_dir, texts):
    want = {i: brute_fp(t) for i, t in texts.items()}
    roots = brute_components(want)
    got = simhash.query(spark, sf_dir).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{f:016x}" for i, f in want.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == roots


def test_links_connect_planted_neighbours(spark, rng):
    seeds = [rng.getrandbits(64) for _ in range(40)]
    fps = {f for s in seeds for f in [s, *(s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(30))]}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    roots = {r["node"]: r["root"] for r in components.components(links).collect()}
    want = brute_components({f: f % (1 << 64) for f in signed})
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert groups({f: roots.get(f, f) for f in signed}) == groups(want)
    with pytest.raises(ValueError):
        simhash.links(links, 3)


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "lo long, hi long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}


def test_edges(edge, empty):
    got = {r["doc_id"]: r for r in simhash.classes(edge).collect()}
    assert got[1]["fp"] == got[2]["fp"] == 0 and got[3]["component_id"] == 1 and got[9]["component_id"] == 8
    assert simhash.classes(empty).count() == 0
