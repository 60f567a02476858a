"""Quality rules with thresholds that adapt to language and source.

Counts of each whole text are made by array expressions. Mergeable quantile
sketches of the counts' ratios are aggregated by (lang, source); a document fails
if a ratio is far outside its group's quartiles: beyond the upper (or below the
lower) quartile by ``reach`` times the distance between them and a slack that
keeps groups without spread whole. Fences are joined to the counts, and what base
rules or fences reject isn't kept.

Defined cases: null text has no words and fails the base rules. Null lang or
source is a group like any other. A group whose documents all fail the base rules
has no fences. Repeated rows count each; other columns are ignored. Everything
here is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, stash

#: Quartile distances, and slack of each ratio, that a document may be outside its group's quartiles.
REACH = 4.0
SLACK = {"word_length": 1.5, "symbols": 0.1, "dup_lines": 0.4, "repeats": 0.3}
ACCURACY = 2000

_SPACE = r"[\x20\x09-\x0D]+"


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text."""
    split = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    split = split.withColumn("words", F.array_remove(F.split("text", _SPACE, -1), ""))
    split = split.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)))
    n = F.size("words")
    word = lambda i: F.get(F.col("words"), i)
    split = split.withColumn("h", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))).otherwise(F.array().cast("array<long>")))
    # Windows found twice: neighbours in hash order. Only texts that have some are sorted with positions.
    split = split.withColumn("sorted", F.sort_array("h"))
    split = split.withColumn("twice", F.exists(F.sequence(F.lit(1), F.greatest(F.size("h"), F.lit(1))), lambda i: F.get("sorted", i) == F.get("sorted", i - 1)))
    split = split.withColumn("runs", F.when(F.col("twice"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    split = split.withColumn("at", F.transform(F.filter("runs", lambda x, k: F.coalesce(x["h"] == F.get("runs", k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("runs", k + 1)["h"], F.lit(False))), lambda x: x["i"]))
    covered = F.size(F.array_distinct(F.concat("at", F.transform("at", lambda i: i + 1), F.transform("at", lambda i: i + 2))))
    return split.select(
        "doc_id", "lang", "source",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("twice"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def judge(counted: DataFrame, reach: float = REACH) -> DataFrame:
    """Add base_failed and kept to what ``counts`` made."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    ratios = {"word_length": F.col("word_chars") / F.greatest("n_words", F.lit(1)), "symbols": F.col("n_symbols") / F.greatest("n_words", F.lit(1)), "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), "repeats": F.col("n_repeat_words") / F.greatest("n_words", F.lit(1))}
    rated, _ = stash(counted.withColumn("base_failed", base).withColumns({f"__{k}": r for k, r in ratios.items()}))
    quartiles = [F.percentile_approx(f"__{k}", [0.25, 0.75], ACCURACY).alias(f"__q_{k}") for k in ratios]
    groups = rated.where("not base_failed").groupBy(F.col("lang").alias("__lang"), F.col("source").alias("__source")).agg(*quartiles)
    joined = rated.join(groups, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    outside = F.lit(False)
    for k in ratios:
        low, high = F.col(f"__q_{k}")[0], F.col(f"__q_{k}")[1]
        room = reach * (high - low) + SLACK[k]
        outside = outside | (F.col(f"__{k}") > high + room)
        if k == "word_length":
            outside = outside | (F.col(f"__{k}") < low - room)
    return joined.select(*counted.columns, "base_failed", (~F.col("base_failed") & ~F.coalesce(outside, F.lit(False))).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: counts and verdict of every document."""
    judged = judge(counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
