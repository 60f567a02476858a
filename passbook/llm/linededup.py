"""Cross-site boilerplate lines, by distinct-site spread.

A HyperLogLog sketch of sites is kept for each line hash; sketches merge in map-side
and final aggregation, so a line that a third of all documents have costs no more
than another. Lines estimated clearly above the threshold are boilerplate; lines
near it are counted exactly. Then boilerplate lines leave the documents.

A site is a value of ``source``; null is a site of its own. Blank lines are never
boilerplate. Boilerplate lines go whatever their share of a document. Only a
document without any worded line of its own is a copy rather than a page with
boilerplate: it stays whole, for near-duplicate search to judge.

Defined cases: null text stays null and has no lines; the empty text has one
blank line. Rows that share a doc_id are judged each by its own lines. Extra
columns are kept, whatever their names. Everything here is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, stash, unused

#: Sites from which on a line is boilerplate; relative width of the band that is counted exactly; log2 of a sketch's registers.
MIN_SITES, BAND, LG_K = 10, 0.25, 10


def _lines(text: str = "text") -> Column:
    return F.split(F.col(text), "\n", -1)


def _worded(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes (h) of lines (h, site) that at least ``min_sites`` sites have."""
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    spread, _ = stash(spread.where(F.col("sites") >= min_sites * (1 - BAND)))
    near = spread.where(F.col("sites") <= min_sites * (1 + BAND)).select("h")
    exact = lines.join(near, "h").select("h", "site").distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    return spread.where(F.col("sites") > min_sites * (1 + BAND)).select("h").union(exact.select("h"))


def remove(docs: DataFrame, min_sites: int = MIN_SITES, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with boilerplate lines taken out of text; ``counts`` names two more columns: lines of the text, and lines removed (long)."""
    if counts and {c.lower() for c in counts} & {c.lower() for c in docs.columns}:
        raise ValueError(f"a column has the name of a count: {counts}")
    row, bad_of, rest, out = unused(docs.columns, "row", "bad", "rest", "out")
    # Rows alike in id and text have the same lines; no id, not even null, gathers the lines of unlike texts.
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    hashed = keyed.select(F.col(row).alias("row"), F.concat(F.lit("="), "source").alias("site"), F.explode(F.array_distinct(F.transform(F.filter(_lines(), _worded), lambda line: F.xxhash64(line)))).alias("h"))
    hashed, _ = stash(hashed.withColumn("site", F.coalesce("site", F.lit(""))))
    bad, _ = stash(boilerplate(hashed.select("h", "site"), min_sites))
    of_row = hashed.select("row", "h").join(bad, "h").groupBy(F.col("row").alias(row)).agg(F.collect_set("h").alias(bad_of))
    joined = keyed.join(of_row, row, "left")
    hit = lambda line: F.array_contains(F.col(bad_of), F.xxhash64(line)) & _worded(line)
    kept = joined.withColumn(rest, F.when(F.col(bad_of).isNotNull(), F.filter(_lines(), lambda line: ~hit(line))))
    kept = kept.withColumn(out, F.coalesce(F.exists(rest, _worded), F.lit(False)))
    text = F.when(F.col(out), F.array_join(rest, "\n")).otherwise(F.col("text"))
    shown = [text.alias("text") if c == "text" else col for c, col in zip(docs.columns, quoted(docs.columns), strict=True)]
    if counts:
        n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines())).cast("long")
        shown += [n_lines.alias(counts[0]), F.when(F.col(out), F.size(_lines()) - F.size(rest)).otherwise(0).cast("long").alias(counts[1])]
    return kept.select(*shown)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: lines of every document, how many left it, and the digest of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return remove(docs, counts=("n_lines", "n_removed")).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
WITH l AS (
  SELECT doc_id, coalesce('=' || source, '') AS site,
         unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT *, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS worded FROM l
), bad AS (
  SELECT line AS bad_line FROM w WHERE worded GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}
), m AS (
  SELECT w.*, bad_line IS NOT NULL AS hit FROM w LEFT JOIN bad ON worded AND line = bad_line
), d AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hit) AS n_hit, bool_or(worded AND NOT hit) AS own,
         string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT hit) AS rest
  FROM m GROUP BY doc_id
)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines,
       CASE WHEN own THEN n_hit ELSE 0 END AS n_removed,
       sha256(CASE WHEN own AND n_hit > 0 THEN rest ELSE coalesce(text, '') END) AS kept_sha256
FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id
"""
