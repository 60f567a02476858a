"""Where positioned tokens come from: engines over uploaded files, stored token files, fixed tokens.

An engine is a function from a file's bytes to (page, text, conf, x0, y0, x1, y1)
tuples; reading PDFs or scans needs a library that the caller brings. Files are
spread over the cluster and an engine sees one at a time, so a job holds no more
than one file a task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id string, page long, tok long, text string, conf double, x0 double, y0 double, x1 double, y1 double"
Engine = Callable[[bytes], Iterable[tuple]]


def extract(files: DataFrame, engine: Engine) -> DataFrame:
    """Tokens of files (doc_id, content). A file the engine fails on gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(doc_id, int(t[0]), k, t[1], *map(float, t[2:])) for k, t in enumerate(engine(content or b""))]
                except (ValueError, KeyError, IndexError):
                    continue
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.float64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "page", "tok", "text", "conf", "x0", "y0", "x1", "y1"])

    return files.select(F.col("doc_id").cast("string"), "content").mapInArrow(run, SCHEMA)


def rescanned(pages: DataFrame, first: DataFrame, again: Callable[[DataFrame], DataFrame], least: int = 10, sure: float = 0.45) -> DataFrame:
    """Tokens of scanned ``pages`` (doc_id, page and what ``again`` needs): of the first scan, or of a second one where that has more.

    Only pages without tokens, or with fewer than ``least`` that are less than ``sure``
    on average, are scanned again.
    """
    key = ["doc_id", "page"]
    seen = pages.join(first.groupBy(*key).agg(F.count("*").alias("__n"), F.coalesce(F.avg(F.when(F.col("conf") > 0, F.col("conf"))), F.lit(0.0)).alias("__sure")), key, "left")
    weak = F.coalesce("__n", F.lit(0)).alias("__n")
    poor = seen.where(F.col("__n").isNull() | ((F.col("__sure") < sure) & (F.col("__n") < least)))
    second = again(poor.select(*pages.columns))
    better = second.groupBy(*key).agg(F.count("*").alias("__m")).join(poor.select(*key, weak), key).where(F.col("__m") > F.col("__n")).select(*key)
    return first.join(better, key, "left_anti").unionByName(second.join(better, key, "left_semi"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Token files as JSON lines."""
    return spark.read.schema(SCHEMA).json(path)


def synthetic(spark: SparkSession) -> DataFrame:
    """A fixed page for tests and demonstrations: a header and one row."""
    words = [("Date", 40.0, 185.0), ("Description", 130.0, 185.0), ("Debit", 340.0, 185.0), ("Balance", 500.0, 185.0), ("2026-08-10", 40.0, 210.0), ("UPI/P2M/Swiggy", 130.0, 210.0), ("650.00", 340.0, 210.0), ("59350.00", 500.0, 210.0)]
    rows = [("synthetic", 1, k, t, 1.0, x, y, x + 5.5 * len(t), y + 10) for k, (t, x, y) in enumerate(words)]
    return spark.createDataFrame(rows, SCHEMA)


def _shown(body: bytes) -> list[str]:
    """Text that a content stream shows: literals before Tj, ' and ", and the literals of TJ arrays."""
    out = []
    for item in re.finditer(rb"\[((?:[^\[\]\\]|\\.)*)\]\s*TJ|\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")", body):
        found = re.findall(rb"\(((?:[^()\\]|\\.)*)\)|<([0-9A-Fa-f\s]+)>", item[1]) if item[1] is not None else [(item[2], b"")]
        text = b"".join(bytes.fromhex(h.decode().replace(" ", "")) if h else re.sub(rb"\\(.)", rb"\1", s) for s, h in found)
        out.append(text.decode("latin-1"))
    return out


def stream_text(files: DataFrame) -> DataFrame:
    """doc_id and the text that files' content streams show, inflated where packed; a fallback without any PDF library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for content in batch.column(1).to_pylist():
                lines: list[str] = []
                for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content or b"", re.DOTALL):
                    try:
                        body = zlib.decompress(m[1])
                    except zlib.error:
                        body = m[1]
                    lines += _shown(body)
                texts.append("\n".join(lines))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "raw_text"])

    return files.select(F.col("doc_id").cast("string"), "content").mapInArrow(run, "doc_id string, raw_text string")
