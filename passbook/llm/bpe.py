"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of byte positions. Every adjacent pair whose
joined bytes have a merge rank is filed in that rank's bucket; a two-level
bitmap of 256-bit words has a bit for each non-empty bucket, so find-first-set
from the top yields the lowest rank in two steps whatever the length of the
pre-token. Entries whose pair has changed since they were filed are stale and
skipped. The cost is O(n) bucket operations, where rescanning all pairs after
each merge is O(n^2); this matters for pre-tokens of many thousand bytes. Many
pre-tokens share one list and queue, with barriers that no pair crosses.

Results of short pre-tokens are kept in a bounded memo in each Python worker.

Defined cases: null text is encoded as the empty text (no ids). Lone surrogates
can't occur in Spark strings. Other columns are ignored; repeated rows are
encoded each.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches


#: Memo entries a worker keeps, and the longest pre-token (bytes) among them.
MEMO, MEMO_BYTES = 200_000, 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks of a rank file: base64 of a token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class RankQueue:
    """Buckets of positions by rank below a two-level bitmap of 256-bit words."""

    __slots__ = ("buckets", "top", "low")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.top, self.low = 0, {}

    def file(self, rank: int, bucket: list[int]) -> None:
        """Add a bucket for a rank that has none."""
        self.buckets[rank] = bucket
        word = rank >> 8
        if word in self.low:
            self.low[word] |= 1 << (rank & 255)
        else:
            self.low[word] = 1 << (rank & 255)
            self.top |= 1 << word

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.file(rank, [at])
        else:
            bucket.append(at)

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its positions from left to right; (-1, []) if nothing is left."""
        top = self.top
        if not top:
            return -1, []
        word = (top & -top).bit_length() - 1
        bits = self.low[word]
        first = bits & -bits
        rank = word << 8 | first.bit_length() - 1
        if bits == first:
            del self.low[word]
            self.top = top ^ 1 << word
        else:
            self.low[word] = bits ^ first
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


class Merger:
    """Merges pre-tokens; many are laid out in one linked list with barriers between, so that they share the queue."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.ids = list(range(max(ranks.values(), default=-1) + 1))  # one object an id, however often it is kept
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)])
        self.pair = np.full(1 << 16, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pair[token[0] << 8 | token[1]] = rank

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of each pre-token; no pre-token is empty."""
        buffer = b"".join(pieces)
        n = len(buffer)
        if not n:
            return []
        raw = np.frombuffer(buffer, np.uint8).astype(np.int64)
        starts = np.cumsum([0, *map(len, pieces)])
        barrier = np.zeros(n + 1, bool)
        barrier[starts] = True
        pairs = np.append(self.pair[raw[:-1] << 8 | raw[1:]], -1)
        pairs[:-1][barrier[1:n]] = -1
        filed = np.flatnonzero(pairs >= 0)
        filed = filed[np.argsort(pairs[filed], kind="stable")]
        keys, first = np.unique(pairs[filed], return_index=True)
        queue = RankQueue()
        for rank, at in zip(keys.tolist(), np.split(filed, first[1:]) if len(keys) else [], strict=True):
            queue.file(rank, at.tolist())
        # The token that starts at i: its id, its end, and the rank of its pair with the next one.
        token, end, pair = self.byte[raw].tolist(), list(range(1, n + 1)), pairs.tolist()
        before, barrier = list(range(-1, n)), barrier.tolist()
        rank_of, push, pop, shared = self.ranks.get, queue.push, queue.pop, self.ids
        while True:
            rank, bucket = pop()
            if rank < 0:
                break
            for k, i in enumerate(bucket):
                if pair[i] != rank:
                    continue  # stale: this pair was merged or changed
                j = end[i]
                e = end[i] = end[j]
                before[e] = i
                token[i] = shared[rank]
                pair[j] = pair[i] = -1
                lower = False
                if not barrier[e]:
                    r = rank_of(buffer[i : end[e]])
                    if r is not None:
                        pair[i] = r
                        push(r, i)
                        lower = r < rank
                if not barrier[i]:
                    h = before[i]
                    r = rank_of(buffer[h:e])
                    if r is None:
                        pair[h] = -1
                    else:
                        pair[h] = r
                        push(r, h)
                        lower = lower or r < rank
                if lower:  # a lower rank goes first; the rest of this bucket waits
                    if k + 1 < len(bucket):
                        queue.file(rank, bucket[k + 1 :])
                    break
        out = []
        for i, stop in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            ids = []
            while i < stop:
                ids.append(token[i])
                i = end[i]
            out.append(tuple(ids))
        return out


#: Letters, numbers and white space among the first 256 code points.
LATIN = {"L": r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "N": r"0-9\xb2\xb3\xb9\xbc-\xbe", "s": r"\t-\r \x85\xa0"}


def latin_pattern(pattern: str) -> str | None:
    """``pattern`` for texts of the first 256 code points in terms of plain character sets; None if it uses other classes."""
    out, inside = [], False
    for part in re.split(r"(\\p\{\w+\}|\\.|[\[\]])", pattern):
        if part in ("[", "]"):
            inside = part == "["
        elif part in (r"\p{L}", r"\p{N}", r"\s"):
            part = LATIN[part[-2] if "{" in part else "s"]
            part = part if inside else f"[{part}]"
        elif part == r"\S" and not inside:
            part = f"[^{LATIN['s']}]"
        elif part.startswith("\\"):
            return None
        out.append(part)
    return "".join(out)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.wide = regex.compile(pattern).findall
        narrow = latin_pattern(pattern)
        self.narrow = re.compile(narrow).findall if narrow else self.wide
        self.ranks, self.merger = ranks, Merger(ranks)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide(text)
        return self.narrow(text)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. Pre-tokens that the memo lacks are merged together."""
        split, memo = list(map(self.split, texts)), self.memo
        if len(memo) > MEMO:
            memo.clear()
        new = [p for p in set().union(*split) if p not in memo]
        raw = [p.encode() for p in new]
        rest = []
        for p, r in zip(new, raw, strict=True):
            if r in self.ranks:
                memo[p] = (self.merger.ids[self.ranks[r]],)
            else:
                rest.append((p, r))
        memo.update(zip((p for p, _ in rest), self.merger.merge([r for _, r in rest]), strict=True))
        out = [[i for p in pieces for i in memo[p]] for pieces in split]
        for p, r in zip(new, raw, strict=True):
            if len(r) > MEMO_BYTES:
                del memo[p]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def worker_codec(rank_file: str, pattern: str) -> Codec:
    """The codec of this worker process; later tasks in it find the memo filled."""
    kept = sys.modules.setdefault("_passbook_worker", types.ModuleType("_passbook_worker")).__dict__
    if (rank_file, pattern) not in kept:
        kept[rank_file, pattern] = Codec(load_ranks(rank_file), pattern)
    return kept[rank_file, pattern]


def encode(docs: DataFrame, rank_file: str, pattern: str, keep_ids: str | None = "array") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids themselves of every text: ``keep_ids`` is array, packed (32-bit little-endian binary) or None.

    ``rank_file`` is read once a worker; it must be there on every machine, as the tokenizer package is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(rank_file, pattern)
        gc.disable()  # nothing here is cyclic, and the memo is large to scan
        try:
            decimal = [str(i) for i in range(len(codec.bytes_of))]
            for batch in batches:
                for start in range(0, batch.num_rows, 300):
                    part = batch.slice(start, 300)
                    out: list[list] = [[], [], [], []]
                    for ids in codec.encode_all([t or "" for t in part.column(1).to_pylist()]):
                        out[0].append(len(ids))
                        out[1].append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                        out[2].append(hashlib.sha256(codec.decode(ids)).hexdigest())
                        out[3].append(np.array(ids, "<i4").tobytes() if keep_ids == "packed" else ids if keep_ids else None)
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
    """op6: every whole text encoded by the multilingual 50k ranks, decoded again, with digests of both."""
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=None)
