"""Table headers of pages: phrases of headings, the best line of each page, one schema for the document.

tokens as in ``layout``. A header is (doc_id, page, y0, y1, columns, raw_text,
confidence); columns are array<struct<name, x0, x1>> in order of x0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import let
from ..functions.narration import HEADING_ENDS, NOTICES, WHOLE_HEADINGS, heading
from ..functions.text import first_match
from .layout import bucketed, schema_score

COLUMNS = "array<struct<name:string,x0:double,x1:double>>"


def phrases(words: Column) -> Column:
    """Heading phrases (name, x0, x1) of a line's words (x0, x1, own: heading of the word, pair: of it and the next one, ends: goes on any heading).

    The fold keeps the heading of the open phrase. A word without a heading of its
    own goes on the open phrase if it is such an ending or makes that heading
    together with the word before; one of the same heading does too; any other word
    begins anew. A word that has a heading only with the next one takes that along.
    """
    state = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("pair"), F.lit(False).alias("takes"), F.array().cast(COLUMNS).alias("out"))

    def step(acc: Column, w: Column) -> Column:
        same = F.when(w["own"].isNotNull(), w["own"] == acc["name"]).otherwise(w["ends"] | (acc["pair"] == acc["name"]))
        goes_on = acc["takes"] | F.coalesce(acc["name"].isNotNull() & same, F.lit(False))
        begun = F.coalesce(w["own"], w["pair"])
        n = F.size(acc["out"])
        longer = F.transform(acc["out"], lambda p, k: F.struct(p["name"].alias("name"), p["x0"].alias("x0"), F.when(k == n - 1, w["x1"]).otherwise(p["x1"]).alias("x1")))
        more = F.when(begun.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], F.struct(begun.alias("name"), w["x0"].alias("x0"), w["x1"].alias("x1"))))
        return let(goes_on, lambda on: F.struct(F.when(on, acc["name"]).otherwise(begun).alias("name"), w["pair"].alias("pair"), (~on & w["own"].isNull() & w["pair"].isNotNull()).alias("takes"), F.when(on, longer).otherwise(more).alias("out")))

    return F.aggregate(words, state, step)["out"]


def once(columns: Column) -> Column:
    """The first phrase of each name."""
    return let(F.transform(columns, lambda c: c["name"]), lambda names: F.filter(columns, lambda c, k: F.array_position(names, c["name"]) == k + 1))


def widened(columns: Column) -> Column:
    """Ranges stretched to the midpoints between neighbours, 0 and 10000 at the ends."""
    last = F.size(columns) - 1
    return F.transform(
        columns,
        lambda c, k: F.struct(
            c["name"].alias("name"),
            F.when(k == 0, 0.0).otherwise((F.get(columns, k - 1)["x1"] + c["x0"]) / 2).alias("x0"),
            F.when(k == last, 10_000.0).otherwise((c["x1"] + F.get(columns, k + 1)["x0"]) / 2).alias("x1"),
        ),
    )


def line_headings(tokens: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """Each line with its heading phrases: doc_id, page, anchor, y0, y1, raw_text, columns."""
    lines = bucketed(tokens, tolerance)
    order = Window.partitionBy("doc_id", "page", "anchor").orderBy("x0", "y0", "tok")
    following = F.lead("text").over(order)
    words = lines.select("*", heading(F.col("text")).alias("own"), F.when(following.isNotNull(), heading(F.concat_ws(" ", "text", following))).alias("pair"), F.lower("text").isin(HEADING_ENDS).alias("ends"))
    line = F.array_sort(F.collect_list(F.struct("x0", "y0", "tok", "x1", "text", "own", "pair", "ends")))
    grouped = words.groupBy("doc_id", "page", "anchor").agg(line.alias("w"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count("own").alias("known"), F.count("pair").alias("pairs"))
    found = F.when(F.col("known") + F.col("pairs") > 0, let(phrases(F.col("w")), once)).otherwise(F.array().cast(COLUMNS))
    return grouped.select("doc_id", "page", "anchor", "y0", "y1", F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("raw_text"), found.alias("columns"))


def page_headers(tokens: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """The best header line of each page that has one; among equals the upper one."""
    names = F.transform("columns", lambda c: c["name"])
    has = lambda *any_of: reduce(lambda a, b: a | b, (F.array_contains(F.col("names"), n) for n in any_of))
    known = line_headings(tokens, tolerance).withColumn("names", names).withColumn("n", F.size("columns"))
    told = has("DESCRIPTION", "REFERENCE")
    fit = known.where((has("DATE") & told) | (has("DATE") & has("DEBIT", "CREDIT", "AMOUNT", "BALANCE")) | (told & (F.col("n") >= 3)))
    score = F.col("n") * 10 + F.when(has("DEBIT") & has("CREDIT"), 15).otherwise(0) + F.when(has("BALANCE"), 10).otherwise(0) + F.when(has("DATE"), 10).otherwise(0)
    best = fit.withColumn("score", score.cast("long")).groupBy("doc_id", "page").agg(F.max_by(F.struct("y0", "y1", "columns", "raw_text", "score", "n"), F.struct("score", -F.col("anchor"))).alias("b"))
    sure = F.least(F.lit(1.0), F.round(F.col("b.n") * 0.15 + 0.4, 2))
    return best.select("doc_id", "page", "b.y0", "b.y1", widened(F.col("b.columns")).alias("columns"), "b.raw_text", "b.score", sure.alias("confidence"))


def band_headers(tokens: DataFrame, band: float = 15.0, least: int = 3) -> DataFrame:
    """Headers of the second dialect: whole words within ``band`` points of the page's first date heading, the first of each column, by centre.

    Pages need a date and a money heading anywhere, and ``least`` columns; range is up to the midpoints between centres.
    """
    named = tokens.withColumn("name", first_match([(F.col("text").rlike(p), n) for n, p in WHOLE_HEADINGS], None)).where("name is not null")
    words = F.array_sort(F.collect_list(F.struct("tok", "name", "text", "x0", "x1", "y0", "y1", ((F.col("x0") + F.col("x1")) / 2).alias("centre"))))
    pages = named.groupBy("doc_id", "page").agg(words.alias("w"), F.min_by("y0", F.when(F.col("name") == "DATE", F.col("tok"))).alias("at"), F.bool_or(F.col("name").isin("DEBIT", "CREDIT", "BALANCE")).alias("money"))
    near = F.filter("w", lambda w: F.abs(w["y0"] - F.col("at")) <= band)
    of = lambda name: F.get(F.filter(F.col("near"), lambda w: w["name"] == name), 0)
    firsts = F.array_compact(F.array(*[of(name) for name, _ in WHOLE_HEADINGS]))
    ordered = F.transform(F.array_sort(F.transform(firsts, lambda w, k: F.struct(w["centre"].alias("centre"), k.alias("k"), w.alias("w")))), lambda o: o["w"])
    found = pages.where("at is not null and money").withColumn("near", near).withColumn("cols", ordered).where(F.size("cols") >= least)
    last = F.size("cols") - 1
    mid = lambda a, b: (a["centre"] + b["centre"]) / 2
    columns = F.transform("cols", lambda c, k: F.struct(c["name"].alias("name"), F.when(k == 0, 0.0).otherwise(mid(F.get("cols", k - 1), c)).alias("x0"), F.when(k == last, 10_000.0).otherwise(mid(c, F.get("cols", k + 1))).alias("x1")))
    return found.select("doc_id", "page", F.array_max(F.transform("cols", lambda c: c["y1"])).alias("bottom"), F.transform("cols", lambda c: c["text"]).alias("headings"), columns.alias("columns"))


def non_table(text: Column, columns: Column) -> Column:
    """Whether a page is a summary or a notice: one of its phrases, and no date heading."""
    low = F.lower(text)
    said = reduce(lambda a, b: a | b, (low.contains(p) for p in NOTICES))
    return F.coalesce(said, F.lit(False)) & ~F.coalesce(F.exists(columns, lambda c: c["name"] == "DATE"), F.lit(False))


def page_schemas(headers: DataFrame, pages: DataFrame) -> DataFrame:
    """Schema of every page (doc_id, page, raw_text) of documents with a header: its own, its own place with the document's best columns, or the last one before.

    The best header of a document is the one with most columns and money columns, the
    first among equals. A page with fewer columns than that, and other ones, keeps the
    place of its header and takes the best columns. Pages without a header go on with
    the last schema; notices have none.
    """
    names = F.transform("columns", lambda c: c["name"])
    both = pages.select("doc_id", "page", F.col("raw_text").alias("page_text")).join(headers.select("doc_id", "page", "y0", "y1", "columns", "raw_text", "confidence"), ["doc_id", "page"], "left")
    rank = F.when(F.size("columns") > 0, F.struct(schema_score(names).alias("rank"), (-F.col("page")).alias("first")))
    both = both.withColumn("best", F.max_by(F.struct("columns", "raw_text", "confidence"), rank).over(Window.partitionBy("doc_id"))).where("best is not null")
    own = F.coalesce(F.size("columns") > 0, F.lit(False))
    same = F.array_sort(names) == F.array_sort(F.transform("best.columns", lambda c: c["name"]))
    whole = (F.size("columns") >= F.size("best.columns")) | same
    schema = lambda kind, y0, y1, columns, text, sure: F.struct(F.lit(kind).alias("kind"), y0.alias("y0"), y1.alias("y1"), columns.alias("columns"), text.alias("raw_text"), sure.alias("confidence"))
    c = F.col
    kept = schema("OWN", c("y0"), c("y1"), c("columns"), c("raw_text"), c("confidence"))
    mended = schema("RECONCILED", c("y0"), c("y1"), c("best.columns"), F.coalesce(F.nullif(c("raw_text"), F.lit("")), c("best.raw_text")), F.greatest(c("confidence"), c("best.confidence") * 0.9))
    placed = both.withColumn("notice", non_table(c("page_text"), c("columns"))).withColumn("own", F.when(~c("notice") & own, F.when(whole, kept).otherwise(mended)))
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("last", F.coalesce(F.last(F.when(c("own").isNotNull(), F.struct("own.columns", "own.raw_text", "own.confidence")), ignorenulls=True).over(before), c("best")))
    carried = schema("INHERITED", F.lit(40.0), F.lit(60.0), c("last.columns"), c("last.raw_text"), c("last.confidence") * 0.9)
    out = placed.where(~c("notice")).select("doc_id", "page", F.when(c("own").isNotNull(), c("own")).otherwise(carried).alias("s"))
    return out.select("doc_id", "page", "s.kind", "s.y0", "s.y1", "s.columns", "s.raw_text", F.round("s.confidence", 4).alias("confidence"))
