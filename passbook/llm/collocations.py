"""Phrase collocations: frequent phrases whose words stand together more often than apart.

Texts are cut into pieces (at punctuation and line ends), and equal pieces of a
language become one with a multiplicity, so that copies are counted once. Tasks
count their phrases in blocks of bounded size, by sorting numbers of words, and send
the counts, packed, to the hash bucket of each phrase: a phrase reaches its bucket at
most once a block, however often it stands there, and a task of any size holds one
block at a time. A bucket is summed in duckdb, which goes to disk beyond its memory,
and phrases below the least count go. The parts of a phrase lie in other buckets:
each phrase sends a request for either part of each cut, the requests are joined with
the counts, and the answers are gathered by phrase.

Every phrase of ``longest`` words or less is counted over all documents. Scores are
whole numbers, computed in decimals of 38 digits: exact below 10^15 words.

Defined cases: null text is empty, null lang is ``und``; repeated rows count each;
white space at the ends of a piece and the length of gaps don't matter. Of an empty
table nothing comes. Other columns are ignored, whatever their names.

duckdb's spill files lie in the task's own folder, as Spark's do, and go with the
task; nothing else reads them.
"""

from __future__ import annotations

import shutil
import string
import tempfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, partitions, sliced, stash, table

#: Memory of a task's duckdb, rows of a packed chunk, and hash buckets for each shuffle partition.
MEMORY, CHUNK, BUCKETS = "256MB", 200_000, 2
#: Words and bytes of the pieces that a task counts at once.
WORDS, BYTES = 2_500_000, 24 << 20
#: Shares of a language that are ranked apart before the language is.
SHARES = 16
#: Ends of pieces, and gaps between words.
PIECE_END, GAP = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"

PIECES = pa.schema([("lang", pa.string()), ("piece", pa.string()), ("m", pa.int64())])
GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("f", pa.int64())])
PACKED = pa.schema([("lang", pa.dictionary(pa.int32(), pa.string())), ("gram", pa.string()), ("f", pa.int64())])


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, m): distinct pieces, words in lower case (A-Z) with one space between, and how often each stands."""
    low = F.translate(F.col("text").cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    one = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(low, PIECE_END)).alias("piece"))
    return one.select("lang", F.trim(F.regexp_replace("piece", GAP, " ")).alias("piece")).where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("m"))


@contextmanager
def database():
    """A duckdb of one thread and bounded memory, with a folder to spill to."""
    import duckdb

    folder = tempfile.mkdtemp(prefix="counts-")
    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": False})
    try:
        yield con
    finally:
        con.close()
        shutil.rmtree(folder, ignore_errors=True)


def packed(rows: pa.RecordBatch) -> bytes:
    """Sorted counts as a compressed stream; languages as numbers, since offsets of short words would take more room than the words."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, PACKED, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        out.write_batch(pa.RecordBatch.from_arrays([rows.column(0).dictionary_encode(), rows.column(1), rows.column(2)], schema=PACKED))
    return sink.getvalue().to_pybytes()


def unpacked(grams: pa.Buffer) -> Iterator[pa.RecordBatch]:
    for b in pa.ipc.open_stream(grams):
        yield pa.RecordBatch.from_arrays([b.column(0).dictionary_decode(), b.column(1), b.column(2)], schema=GRAMS)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The pieces in blocks of at most WORDS words and BYTES bytes; a slice that is larger by itself is one block."""
    held, words, size = [], 0, 0
    for b in sliced(b.cast(PIECES) for b in batches):
        w = b.num_rows + (pc.sum(pc.count_substring(b.column(1), " ")).as_py() or 0)
        if held and (words + w > WORDS or size + b.nbytes > BYTES):
            yield pa.Table.from_batches(held)
            held, words, size = [], 0, 0
        held, words, size = [*held, b], words + w, size + b.nbytes
    if held:
        yield pa.Table.from_batches(held)


def numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Numbers of ``values`` from 1, in byte order; the values by number (0: null), and a hash of each."""
    coded = values.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    names = coded.dictionary.take(order)
    rank = np.empty(len(order), np.int32)
    rank[order.to_numpy()] = np.arange(1, len(order) + 1, dtype=np.int32)
    hashes = np.zeros(len(names) + 1, np.uint64)
    for a in range(0, len(names), CHUNK):
        some = names.slice(a, CHUNK).cast(pa.binary()).to_pylist()
        hashes[a + 1 : a + 1 + len(some)] = list(map(zlib.crc32, some))
    return rank[coded.indices.to_numpy()], pa.concat_arrays([pa.nulls(1, pa.string()), names]), hashes


def spread(rows: np.ndarray, columns: list[np.ndarray], hashes: list[np.ndarray], buckets: int) -> np.ndarray:
    """Hash buckets of phrases; the same in every block, as they come from the words alone."""
    x = np.zeros(len(rows), np.uint64)
    for c, h in zip(columns, hashes, strict=True):
        x = (x ^ h[c[rows]]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
    return (x % np.uint64(buckets)).astype(np.int64)


def sorted_rows(columns: list[np.ndarray], limits: list[int]) -> np.ndarray:
    """Order of rows by all columns, whose numbers are below ``limits``; columns that fit share a key of 63 bits."""
    keys, room = [columns[0].astype(np.int64)], limits[0]
    for c, limit in zip(columns[1:], limits[1:], strict=True):
        if room * limit < 2**63:
            keys[-1] = keys[-1] * limit + c
            room *= limit
        else:
            keys.append(c.astype(np.int64))
            room = limit
    return np.lexsort(keys[::-1])


def counted(block: pa.Table, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Counts of a block's phrases by bucket, CHUNK rows at a time: buckets, and rows of GRAMS. A piece longer than a block is counted in stretches of WORDS first words."""
    lists = pc.split_pattern(block["piece"].combine_chunks(), " ")
    ends = lists.offsets.to_numpy()[1:]
    word, words, word_hash = numbered(lists.values)
    del lists
    lang, langs, lang_hash = numbered(block["lang"].combine_chunks())
    m = block["m"].to_numpy()
    for start in range(0, len(word), WORDS):
        place = np.arange(start, min(start + WORDS, len(word)))
        row = np.searchsorted(ends, place, side="right")
        columns = [lang[row]]
        for k in range(longest):  # the words that follow in the piece; 0 after its end
            columns.append(np.where(place + k < ends[row], word[np.minimum(place + k, len(word) - 1)], np.int32(0)))
        order = sorted_rows(columns, [len(langs)] + [len(words)] * longest)
        columns, times = [c[order] for c in columns], m[row][order]
        del place, row, order
        # In this order phrases with the same first words stand together, so each length is cut from one sort.
        new, keys, sums = np.zeros(len(times), bool), [], []
        new[0] = True
        new[1:] = columns[0][1:] != columns[0][:-1]
        for k in range(1, longest + 1):
            new[1:] |= columns[k][1:] != columns[k][:-1]
            at = np.flatnonzero(new)
            f, there = np.add.reduceat(times, at), columns[k][at] > 0
            at, f = at[there], f[there]
            keys.append((spread(at, columns[: k + 1], [lang_hash] + [word_hash] * k, buckets) * len(times) + at) * longest + k - 1)
            sums.append(f)
        del new, times, at, f, there
        key = np.concatenate(keys)
        del keys
        f = np.concatenate(sums)
        del sums
        order = np.argsort(key)
        for a in range(0, len(order), CHUNK):
            some = order[a : a + CHUNK]
            rest, k = np.divmod(key[some], longest)
            bucket, at = np.divmod(rest, len(columns[0]))
            taken = [words.take(pa.array(np.where(k >= j, columns[j + 1][at], np.int32(0)))) for j in range(longest)]
            gram = pc.binary_join_element_wise(*taken, " ", null_handling="skip")
            yield bucket, pa.RecordBatch.from_arrays([langs.take(pa.array(columns[0][at])), gram, pa.array(f[some])], schema=GRAMS)


def phrases(parts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(bucket, grams): counts of each block's phrases, sorted and packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            for bucket, rows in counted(block, longest, buckets):
                starts = [0, *((bucket[1:] != bucket[:-1]).nonzero()[0] + 1).tolist()]
                for a, b in zip(starts, [*starts[1:], len(bucket)], strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a])], pa.int32()), pa.array([packed(rows.slice(a, b - a))], pa.binary())], names=["bucket", "grams"])
            pa.default_memory_pool().release_unused()

    return parts.mapInArrow(run, "bucket int, grams binary")


def summed(chunks: DataFrame, least: int) -> DataFrame:
    """(lang, gram, f) of phrases counted ``least`` times or more; all words of a language under the null gram. Chunks of a bucket come one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((bucket, grams) for batch in batches for bucket, grams in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        row = next(rows, None)
        with database() as con:
            while row is not None:
                current = row[0]

                def chunk(current=current) -> Iterator[pa.RecordBatch]:
                    nonlocal row
                    while row is not None and row[0] == current:
                        yield from unpacked(row[1].as_buffer())
                        row = next(rows, None)

                con.register("chunks", pa.RecordBatchReader.from_batches(GRAMS, chunk()))
                con.execute("CREATE OR REPLACE TABLE sums AS SELECT lang, gram, sum(f)::BIGINT AS f FROM chunks GROUP BY ALL")
                con.unregister("chunks")
                for b in con.sql(f"SELECT lang, gram, f FROM sums WHERE f >= {least} UNION ALL SELECT lang, NULL, sum(f)::BIGINT FROM sums WHERE NOT contains(gram, ' ') GROUP BY lang").to_arrow_reader(CHUNK):
                    yield b.cast(GRAMS)

    return chunks.mapInArrow(run, "lang string, gram string, f long")


def counts(docs: DataFrame, least: int = 10, longest: int = 3) -> DataFrame:
    """(lang, gram, f) of all phrases of at most ``longest`` words and at least ``least`` occurrences; null grams have parts of each language's count of words."""
    spark = docs.sparkSession
    bound_batches(spark)
    n = partitions(spark)
    chunks = phrases(pieces(docs), longest, BUCKETS * n)
    return summed(chunks.repartition(n, "bucket").sortWithinPartitions("bucket"), least)


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, inside: int = 50, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``inside``: a phrase goes if a longer one that holds it has this share of its count, in hundredths.
    """
    found, _ = stash(counts(docs, least, longest))
    grams = found.where("gram is not null").withColumn("words", F.split("gram", " ", -1))
    several = grams.where(F.size("words") > 1)
    join = lambda a, b: F.array_join(F.slice("words", a, b), " ")
    cuts = F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(k.alias("k"), join(F.lit(1), k).alias("left"), join(k + 1, F.size("words") - k).alias("right"))))
    asked = several.select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), cuts.alias("cut"))
    requests = asked.select("lang", "phrase", "a", "cut.k", F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col("cut.left").alias("gram")), F.struct(F.lit(False).alias("first"), F.col("cut.right").alias("gram")))).alias("r")).select("lang", "phrase", "a", "k", "r.first", "r.gram")
    answers = requests.join(grams.select("lang", "gram", "f"), ["lang", "gram"]).groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    whole = lambda c: f"cast({c} as decimal(15,0))"
    score = F.expr(f"cast(1000000 as decimal(7,0)) * {whole('a')} * {whole('a')} div ({whole('l')} * {whole('r')})")
    best = answers.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))

    # Phrases inside each longer phrase, with the count of the most frequent one.
    size = F.size("words")
    held = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: join(i, n))))
    within = several.where(size > 2).select("lang", F.explode(held).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    alone = best.join(within, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {inside} * a")

    # The first of each language are among the first of its shares, so that no task sorts all of a language.
    order = [F.col("b.score").desc(), F.col("a").desc(), F.col("phrase")]
    shared = alone.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    for keys in (["lang", "share"], ["lang"]):
        shared = shared.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    first = shared
    totals = found.where("gram is null").groupBy("lang").agg(F.sum("f").alias("n"))
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the first 2000 collocations of two or three words of each language."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, string_split(trim(regexp_replace(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+', ' ', 'g'), ' '), ' ') AS w FROM documents
), o AS MATERIALIZED (SELECT lang, unnest(w) AS a, unnest(w[2:]) AS b, unnest(w[3:]) AS c FROM p WHERE w <> ['']
), g AS MATERIALIZED (SELECT lang, a AS gram, count(*) AS f FROM o GROUP BY ALL UNION ALL SELECT lang, a || ' ' || b, count(*) FROM o WHERE b IS NOT NULL GROUP BY ALL UNION ALL SELECT lang, a || ' ' || b || ' ' || c, count(*) FROM o WHERE c IS NOT NULL GROUP BY ALL
), n AS (SELECT lang, count(*) AS n FROM o GROUP BY lang
), cand AS MATERIALIZED (SELECT lang, gram AS phrase, string_split(gram, ' ') AS w, f AS a FROM g WHERE f >= 10 AND contains(gram, ' ')
), cut AS (SELECT *, unnest(range(1, len(w))) AS k FROM cand
), s AS MATERIALIZED (SELECT c.lang, c.phrase, c.w, c.a, c.k, x.f AS l, y.f AS r, CAST(1000000 * CAST(c.a AS HUGEINT) * c.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score FROM cut c JOIN g x ON x.lang = c.lang AND x.gram = array_to_string(c.w[:c.k], ' ') JOIN g y ON y.lang = c.lang AND y.gram = array_to_string(c.w[c.k + 1:], ' ')
), low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), held AS (SELECT lang, array_to_string(w[:2], ' ') AS phrase, a FROM cand WHERE len(w) = 3 UNION ALL SELECT lang, array_to_string(w[2:], ' '), a FROM cand WHERE len(w) = 3
), kept AS (SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.lang = low.lang AND h.phrase = low.phrase AND 100 * h.a >= 50 * low.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""
