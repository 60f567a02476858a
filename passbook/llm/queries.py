"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, langid, linededup, mixing, quality, repeats, rules, simhash, sketches, toxicity, trie, wordbpe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": langid.query,
    "op2_simhash": simhash.query,
    "op3_quality": quality.query,
    "op4_toxicity": toxicity.query,
    "op5_line_dedup": linededup.query,
    "op6_byte_bpe": bpe.query,
    "op7_rules": rules.query,
    "op8_repeats": repeats.query,
    "op9_fingerprints": sketches.query,
    "op10_mixing": mixing.query,
    "op11_prefix_trie": trie.query,
    "op12_collocations": collocations.query,
    "op13_word_bpe": wordbpe.query,
}

ORACLE_SQL: dict[str, str] = {"op5_line_dedup": linededup.SQL, "op11_prefix_trie": trie.SQL, "op12_collocations": collocations.SQL}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
