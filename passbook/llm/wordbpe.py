"""BPE with word ends: a backtracking encoder over longest matches, and decoding by an offset table.

A token sequence is the result of the merges exactly if every two neighbours are
compatible, that is if no merge across their border would have gone first. So the
encoder takes the longest token at each place (one Aho-Corasick pass finds them
all), steps down to the next shorter one while it is not compatible with the token
before, and goes back a token where none is left. Places found dead are not tried
again, so the time is linear in the text, whatever the length of a word. Tokens
that the merges never make of their own text are left out.

The last byte of a word is another symbol than the same byte elsewhere, so that no
token crosses a word's end and new words of many texts are searched in one pass.
Decoding gathers the tokens' bytes from one string by their offsets.

Python's Unicode tables differ from the library's for characters that are newer;
texts outside the first 256 code points take normal forms and lower case from the
library's normalizers, and are split by its pattern engine if they have a
character that Python does not know.

Defined cases: null text is encoded as the empty text (no ids). Special tokens
that stand in a text are taken as such, as the library does. Other columns are
ignored; repeated rows are encoded each.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import sys
import types
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import latin_pattern
from .common import bound_batches

#: Memo entries a worker keeps, the longest word (characters) among them, and the pairs whose compatibility it keeps.
MEMO, MEMO_CHARS, PAIRS = 200_000, 64, 1_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabularies: itself where it is printable, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Merges:
    """Tokens numbered by rank: 512 symbols (a byte, or a byte that ends a word), then one token a merge."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str) -> None:
        letters = byte_letters()
        names = letters + [c + suffix for c in letters]
        number = {name: k for k, name in enumerate(names)}
        spelled, parts = [chr(k) for k in range(512)], [(k, k) for k in range(512)]
        self.pair: dict[tuple[int, int], int] = {}
        for a, b in merges:
            if a + b in number:
                raise ValueError(f"two merges give {a + b}")
            t = number[a + b] = len(names)
            names.append(a + b)
            parts.append((number[a], number[b]))
            spelled.append(spelled[number[a]] + spelled[number[b]])
            self.pair[parts[t]] = t
        self.names, self.parts, self.spelled = names, parts, spelled
        made = [True] * 512
        for t in range(512, len(names)):
            a, b = parts[t]
            made.append(made[a] and made[b] and self.compatible(a, b, t))
        self.length = list(map(len, spelled))
        self.machine = ahocorasick.Automaton()
        at = {s: t for t, s in enumerate(spelled) if made[t]}
        for s, t in at.items():
            self.machine.add_word(s, t)
        self.machine.make_automaton()
        #: The longest token that a token begins with, itself excluded; -1 for symbols.
        self.shorter = [next((at[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in at), -1) for s in spelled]
        self.known: dict[int, bool] = {}

    def compatible(self, a: int, b: int, limit: int = sys.maxsize) -> bool:
        """Whether the merges leave the border between ``a`` and ``b`` alone; only merges below ``limit`` count.

        The merges that made both are undone from the latest on. Just before each,
        the tokens at the border must not have had a merge that goes first; of equal
        ones the left goes first.
        """
        parts, pair = self.parts, self.pair
        while True:
            if pair.get((a, b), limit) < limit:
                return False
            left_last = a > b
            inner_a, inner_b = parts[a][1], parts[b][0]
            if inner_a == a and inner_b == b:
                return True
            if inner_b == b or (left_last and inner_a != a):
                a, limit = inner_a, a
            else:
                b, limit = inner_b, b + 1

    def encode(self, words: list[str]) -> list[list[int]]:
        """Tokens of each word, given in symbols."""
        text = "".join(words)
        longest = [0] * len(text)
        length, shorter, known = self.length, self.shorter, self.known
        for end, t in self.machine.iter(text):  # of tokens that begin at one place the longest ends last
            longest[end - length[t] + 1] = t
        if len(known) > PAIRS:
            known.clear()
        out, start = [], 0
        for word in words:
            stop, at = start + len(word), start
            stack: list[int] = []
            dead: set[int] = set()
            t = longest[at]
            while True:
                while t >= 0:
                    if at + length[t] not in dead:
                        if not stack:
                            break
                        key = stack[-1] << 32 | t
                        fits = known.get(key)
                        if fits is None:
                            fits = known[key] = self.compatible(stack[-1], t)
                        if fits:
                            break
                    t = shorter[t]
                if t < 0:  # nothing fits here: the token before was wrong
                    dead.add(at)
                    t = stack.pop()
                    at -= length[t]
                    t = shorter[t]
                    continue
                stack.append(t)
                at += length[t]
                if at == stop:
                    break
                t = longest[at]
            out.append(stack)
            start = stop
        return out


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Regex, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, added = spec["model"], spec["added_tokens"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only word vocabularies in lower case are known here")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges(pairs, model["end_of_word_suffix"])
        self.id_of = np.array([model["vocab"][n] for n in self.merges.names], "<i4")
        self.special = {t["content"]: t["id"] for t in added}
        self.find_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        name = {i: n for n, i in (*model["vocab"].items(), *self.special.items())}
        pieces = [f"{name[i]} ".encode() if i in name else b"" for i in range(max(name) + 1)]
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.size = np.array(list(map(len, pieces)))
        self.offset = np.cumsum(self.size) - self.size
        self.wide, self.narrow = regex.compile(pattern).findall, re.compile(latin_pattern(pattern)).findall
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self.newest = pre_tokenizers.Split(Regex(pattern), behavior="removed", invert=True).pre_tokenize_str
        self.symbols = [chr(b) for b in range(256)]
        self.ids: dict[str, bytes] = {}
        self.decimal: dict[str, str] = {}

    def _words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            text = self.normal(text)
            if any(unicodedata.category(c) == "Cn" for c in set(text)):
                return [w for w, _ in self.newest(text)]
            return self.wide(text)
        return self.narrow(text.lower())

    def split(self, text: str) -> list[str]:
        """Words of ``text`` in lower case; special tokens are words of their own, led by a zero character."""
        if self.find_special is None or not self.find_special.search(text):
            return self._words(text)
        out: list[str] = []
        for k, part in enumerate(self.find_special.split(text)):
            out += [f"\0{part}"] if k % 2 else self._words(part)
        return out

    def learn(self, words: list[str]) -> None:
        """Ids of words that the memo lacks."""
        plain = []
        for w in words:
            if w[0] == "\0" and w[1:] in self.special:
                i = self.special[w[1:]]
                self.ids[w], self.decimal[w] = np.array([i], "<i4").tobytes(), str(i)
            else:
                plain.append(w)
        spelled = []
        for w in plain:
            raw = w.encode().decode("latin-1")
            spelled.append(raw[:-1] + chr(ord(raw[-1]) + 256))
        for w, tokens in zip(plain, self.merges.encode(spelled), strict=True):
            ids = self.id_of[tokens]
            self.ids[w], self.decimal[w] = ids.tobytes(), " ".join(map(str, ids.tolist()))

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """Ids of each text, as numbers and in decimal with a space between."""
        split = list(map(self.split, texts))
        if len(self.ids) > MEMO:
            self.ids.clear(), self.decimal.clear()
        new = [w for w in set().union(*split) if w not in self.ids]
        self.learn(new)
        ids, decimal = self.ids.__getitem__, self.decimal.__getitem__
        out = [(np.frombuffer(b"".join(map(ids, words)), "<i4"), " ".join(map(decimal, words))) for words in split]
        for w in new:
            if len(w) > MEMO_CHARS:
                del self.ids[w], self.decimal[w]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0][0].tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """Tokens' names in UTF-8 with a space between: the vocabulary has no other decoder."""
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        at = np.arange(ends[-1]) + np.repeat(self.offset[ids] - (ends - size), size)
        return self.blob[at[:-1]].tobytes()


def worker_codec(path: str) -> Codec:
    """The codec of this worker process; later tasks in it find the memo filled."""
    kept = sys.modules.setdefault("_passbook_worker", types.ModuleType("_passbook_worker")).__dict__
    if path not in kept:
        kept[path] = Codec(path)
    return kept[path]


def encode(docs: DataFrame, path: str, keep_ids: str | None = "array") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids themselves of every text: ``keep_ids`` is array, packed (32-bit little-endian binary) or None.

    The file at ``path`` is read once a worker; it must be there on every machine, as the tokenizer package is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(path)
        gc.disable()  # nothing here is cyclic, and the memo is large to scan
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, 300):
                    part = batch.slice(start, 300)
                    out: list[list] = [[], [], [], []]
                    for ids, decimal in codec.encode_all([t or "" for t in part.column(1).to_pylist()]):
                        out[0].append(len(ids))
                        out[1].append(hashlib.sha256(decimal.encode()).hexdigest())
                        out[2].append(hashlib.sha256(codec.decode(ids)).hexdigest())
                        out[3].append(ids.tobytes() if keep_ids == "packed" else ids if keep_ids else None)
                    arrays = [part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    if keep_ids:
                        arrays, names = [*arrays, pa.array(out[3], pa.binary() if keep_ids == "packed" else pa.list_(pa.int32()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)
        finally:
            gc.enable()  # the worker serves other tasks next

    bound_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + {"array": ", ids array<int>", "packed": ", ids binary", None: ""}[keep_ids]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op13: every whole text encoded by the 49k word vocabulary, decoded again, with digests of both."""
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=None)
