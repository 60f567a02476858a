import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from passbook.llm import wordbpe

FILE = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def known():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def codec():
    return wordbpe.Codec(FILE)


def same(codec, known, text):
    want = known.encode(text, add_special_tokens=False).ids
    ids, decimal = codec.encode_all([text])[0]
    assert ids.tolist() == want and decimal == " ".join(map(str, want))
    assert codec.decode(ids).decode() == known.decode(want, skip_special_tokens=False)


def test_random_strings_match_the_library(codec, known, rng):
    for letters in ("aaabtheing éñßÀÞ\x00\x85\xa0\x1c\n\t_'sS.,!019", "aeΣσςİıſK漢字かﾞ😀👍🏽éö́ģ１２½Ⅷ̘᫅́   'T", "th"):
        for _ in range(1500):
            same(codec, known, "".join(rng.choice(letters) for _ in range(rng.randint(0, 150))))


def test_random_code_points_match_the_library(codec, known, rng):
    for _ in range(3000):
        points = [rng.choice((rng.randrange(0x3000), rng.randrange(0x110000), rng.randrange(0x100))) for _ in range(rng.randint(0, 20))]
        same(codec, known, "".join(chr(c) for c in points if not 0xD800 <= c < 0xE000))


@pytest.mark.parametrize("s", ["a" * 50_000, "ab" * 30_000, "x<|endoftext|>Y <|startoftext|><|endoftext|", "<|EndOfText|>", "\0<|endoftext|>", "the" * 9_999, "!?" * 20_000, "1234567890" * 500, "İ" * 3000])
def test_long_words_and_special_tokens(codec, known, s):
    same(codec, known, s)


def test_tokens_beside_each_other_agree_with_plain_merging(codec, rng):
    """Compatibility of two tokens, against merging their symbols by rank."""
    m = codec.merges

    def merged(symbols):
        tokens = list(symbols)
        while True:
            best = min(((m.pair[p], i) for i, p in enumerate(zip(tokens, tokens[1:])) if p in m.pair), default=None)
            if best is None:
                return tokens
            tokens[best[1] : best[1] + 2] = [best[0]]

    for _ in range(4000):
        a, b = rng.randrange(len(m.names)), rng.randrange(rng.choice((600, 3000, len(m.names))))
        if ord(m.spelled[a][-1]) < 256 and all(merged(map(ord, m.spelled[t])) == [t] for t in (a, b)):
            assert m.compatible(a, b) == (merged(map(ord, m.spelled[a] + m.spelled[b])) == [a, b])


def test_query_and_edges(docs, texts, known, edge, empty):
    for r in wordbpe.encode(docs, FILE).collect():
        ids = known.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["ids"], r["n_tokens"]) == (ids, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(known.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    got = wordbpe.encode(edge, FILE, keep_ids=None)
    assert got.count() == 11
    assert got.where("doc_id = 1").first()["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    packed = wordbpe.encode(edge, FILE, keep_ids="packed").where("doc_id = 5").first()["ids"]
    assert np.frombuffer(packed, "<i4").tolist() == known.encode("one two", add_special_tokens=False).ids
    assert wordbpe.encode(empty, FILE).count() == 0
