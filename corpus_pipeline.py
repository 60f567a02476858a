"""From raw documents to token ids: five stages of the corpus operators.

Defined cases: null texts and texts without a letter leave in the first stage;
without any lang to learn from, all do. Rows alike in doc_id, source and text are
mixed as one. An empty table gives an empty result; extra columns are kept up to
the last stage, whatever their names.

Each stage takes (spark, docs, sf_dir) and returns rows for the next; ``run``
writes each stage's rows as Parquet in the cluster's shared folder and reads them
again, so no stage recomputes another. All stages but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.llm import bpe, langid, linededup, mixing, nearcopies
from passbook.llm.common import discard, quoted, scratch, stash, unused

#: Documents whose predicted language is less sure than this are rejected.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from ``docs``; texts without letters and unsure ones go."""
    lang, score = unused(docs.columns, "lang", "score")
    named = langid.identify(docs, langid.train(docs), tuple(docs.columns), (lang, score))
    return named.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*quoted(docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; ``n_chars`` follows the text."""
    out = linededup.remove(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return nearcopies.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, packed, with digests of ids and decoded bytes."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids="packed")


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("mixing", mix_sources), ("byte-level BPE", encode)]

#: SQL has no trained classifier, SimHash or BPE; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        with scratch(spark) as made:  # what a stage wrote on its way goes with it
            docs, path = stash(stage(spark, docs, sf_dir))
            made.remove(path)
        discard(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
