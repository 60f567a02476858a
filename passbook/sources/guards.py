"""Uploaded files as a table, what is refused, and what users are told."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .streams import File

# User messages by error code.
MESSAGES = {"EMPTY_FILE": "The file is empty.", "FILE_TOO_LARGE": "The file is too large.", "INVALID_FILE_TYPE": "Only PDF files are accepted.", "INVALID_PDF": "The file is not a readable PDF.", "ENCRYPTED_PDF": "The file is protected by a password.", "CORRUPTED_PDF": "The file is damaged or has no pages.", "PAGE_LIMIT_EXCEEDED": "The file has too many pages."}


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` (path, length, content) with a content-derived doc_id; Spark's reader passes over empty files."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("doc_id"), "path", "length", "content")


def readable(files: DataFrame, most: int = 100) -> DataFrame:
    """Each file (doc_id, content) with its pages and why it can't be read, or null: encrypted, damaged or without pages, or more than ``most`` pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, locked = [], []
            for content in batch.column(1).to_pylist():
                file = File(content or b"")
                locked.append(bool(re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content or b"")))
                pages.append(sum(1 for _ in file.pages()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.int64()), pa.array(locked, pa.bool_())], names=["doc_id", "pages", "locked"])

    seen = files.select(F.col("doc_id").cast("string"), "content").mapInArrow(run, "doc_id string, pages long, locked boolean")
    code = F.when(F.col("locked"), "ENCRYPTED_PDF").when(F.col("pages") == 0, "CORRUPTED_PDF").when(F.col("pages") > most, "PAGE_LIMIT_EXCEEDED")
    return seen.select("doc_id", F.when(F.col("locked"), 0).otherwise(F.col("pages")).alias("pages"), code.alias("error_code"))


def messages(guarded: DataFrame) -> DataFrame:
    """Refused files by error code with the message shown; unknown codes show themselves."""
    known = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    return guarded.where("error_code is not null").groupBy("error_code").agg(F.count("*").alias("files")).select("error_code", F.coalesce(F.try_element_at(known, F.col("error_code")), F.col("error_code")).alias("message"), "files")
