import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from passbook.llm import bpe

FILE = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(FILE)


@pytest.fixture(scope="module")
def known(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_strings_match_the_library(ranks, known, rng):
    codec = bpe.Codec(ranks, P.PATTERN)
    for _ in range(1500):
        s = "".join(rng.choice("aaabtheing éñß \u0085\x1c\n\t漢字😀1２½_'sS.,!") for _ in range(rng.randint(0, 150)))
        assert codec.encode(s) == known.encode_ordinary(s)
        assert codec.decode(codec.encode(s)) == s.encode()


@pytest.mark.parametrize("s", ["a" * 50_000, "ab" * 30_000, "<|endoftext|>", "﻿ x", "1234567890" * 500])
def test_long_pretokens(ranks, known, s):
    assert bpe.Codec(ranks, P.PATTERN).encode(s) == known.encode_ordinary(s)


def test_rank_queue_pops_the_lowest_rank(rng):
    queue, held = bpe.RankQueue(), {}
    for _ in range(3000):
        if held and rng.random() < 0.4:
            rank = min(held)
            assert queue.pop() == (rank, sorted(held.pop(rank)))
        else:
            rank, at = rng.randrange(60_000), rng.randrange(9)
            held.setdefault(rank, []).append(at)
            queue.push(rank, at)
    while held:
        rank = min(held)
        assert queue.pop() == (rank, sorted(held.pop(rank)))
    assert queue.pop() == (-1, [])


def test_query_and_edges(docs, texts, known, edge, empty):
    for r in bpe.encode(docs, FILE, P.PATTERN).collect():
        ids = known.encode_ordinary(texts[r["doc_id"]])
        assert (r["ids"], r["n_tokens"]) == (ids, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    got = bpe.encode(edge, FILE, P.PATTERN, keep_ids=None)
    assert got.count() == 11
    assert got.where("doc_id = 1").first()["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    packed = bpe.encode(edge, FILE, P.PATTERN, keep_ids="packed").where("doc_id = 5").first()["ids"]
    assert np.frombuffer(packed, "<i4").tolist() == known.encode_ordinary("one two")
    assert bpe.encode(empty, FILE, P.PATTERN).count() == 0
