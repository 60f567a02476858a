"""Fields of an account by labels on a page, and by the order of places where they are sought."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields
from ..functions.money import MONEY, clean_amount, let
from ..functions.narration import customer, holder, holder_candidate, titled
from ..functions.text import _found
from .layout import bucketed, near_right

# Labels of fields on a page, how many words right of them are read, and the zone where they stand.
LABELS = {
    "account_number": (r"(?i)(?:account\s*(?:number|no|#|\.)|a/c\s*(?:no|number|\.)|acct\s*no|iban|account\s*id)\b", 4, "HEAD"),
    "ifsc": (r"(?i)\b(?:ifsc(?:\s*code)?|rtgs\s*/\s*neft\s*ifsc)\b", 2, "HEAD"),
    "holder": (r"(?i)(?:customer\s*name|account\s*holder|account\s*title|name\s*of\s*account\s*holder|name\s*of\s*customer|holder\s*name)\b", 4, "HEAD"),
    "opening_balance": (r"(?i)(?:opening\s+balance|beginning\s+balance|previous\s+balance|brought\s+forward|b/f|open\s+bal)\b", 3, "HEAD"),
    "closing_balance": (r"(?i)(?:closing\s+balance|ending\s+balance|balance\s+at\s+end|carried\s+forward|c/f|close\s+bal)\b", 3, "FOOT"),
}
# A summary line with the opening and the closing balance.
PAIR = r"(?i)(?:savings\s*account|current\s*account|account\s*summary|particulars)[\s:.\-_#=(A-Za-z)]*:\s*([₹$€\d,.\-]+)\s+([₹$€\d,.\-]+)"
#: Kinds of pages that are read for fields beside the first one.
FIELD_PAGES = ["ACCOUNT_INFO_PAGE", "SUMMARY_PAGE"]


def loose_amount(text: Column) -> Column:
    """The number that a text begins with once commas, blanks, currency signs and the letters of currency codes are gone; else 0."""
    clean = F.regexp_replace(text, r"(?i)[,\s₹RsINR$€£AEDCADAUD]", "")
    return F.coalesce(F.round(F.regexp_extract(clean, r"^[+-]?(?:\d+\.?\d*|\.\d+)", 0).try_cast("decimal(38,6)"), 2).try_cast(MONEY), F.lit(0).cast(MONEY))


def field_pages(pages: DataFrame) -> DataFrame:
    """The first page of each document, and its pages of account information and summaries (doc_id, page, raw_text)."""
    first = F.min("page").over(Window.partitionBy("doc_id"))
    return pages.withColumn("first", first).where((F.col("page") == F.col("first")) | fields.page_kind(F.col("raw_text")).isin(FIELD_PAGES)).drop("first")


def _value(kind: Column, words: Column) -> Column:
    """Value of a field from the words right of its label; null if they aren't one."""
    marks = lambda c: F.trim(F.regexp_replace(c, r"[:\-]", ""))
    tight, wide, plain = marks(F.array_join(words, "")), marks(F.array_join(words, " ")), F.array_join(words, " ")
    account = let(F.nullif(F.regexp_extract(tight, r"(?i)([A-Z0-9]{6,34})", 1), F.lit("")), lambda c: F.when(~c.rlike(r"(?i)statement|account|customer|period"), c))
    code = F.nullif(F.upper(F.regexp_extract(wide, r"(?i)\b([A-Z]{4}0[A-Z0-9]{6})\b", 1)), F.lit(""))
    amount = let(loose_amount(plain), lambda a: F.when(a > 0, a.cast("string")))
    return F.when(kind == "account_number", account).when(kind == "ifsc", code).when(kind == "holder", F.when((F.length(wide) >= 3) & customer(wide), wide)).otherwise(amount)


def label_fields(tokens: DataFrame) -> DataFrame:
    """Fields of each document by the first label, page by page from the top, that has a value right of it; ``tokens`` have the page's height.

    Labels stand in the upper four tenths of a page, of the closing balance in the lower
    three (anywhere on pages with nothing there).
    """
    empty = ~F.bool_or(F.col("y0") >= F.col("height") * 0.7).over(Window.partitionBy("doc_id", "page"))
    zones = F.array_compact(F.array(F.when(F.col("y0") <= F.col("height") * 0.4, "HEAD"), F.when((F.col("y0") >= F.col("height") * 0.7) | F.col("empty"), "FOOT")))
    zoned = tokens.withColumn("empty", empty).select("doc_id", "page", "tok", "text", "x0", "y0", "x1", "y1", F.explode(zones).alias("zone"))
    # The upper zone is read by height, the lower one in reading order.
    by_top = lambda c: F.when(F.col("zone") == "HEAD", F.col(c)).otherwise(0.0)
    zoned = zoned.withColumn("o1", by_top("y0")).withColumn("o2", by_top("x0"))
    kinds = F.array_compact(F.array(*[F.when((F.col("zone") == zone) & F.col("text").rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(n).alias("most"))) for k, (p, n, zone) in LABELS.items()]))
    labels = zoned.withColumn("k", F.explode(kinds))
    spots = labels.select("doc_id", "page", "zone", F.col("tok").alias("label"), F.struct("page", "o1", "o2", "tok").alias("place"), "k.kind", "k.most")
    near = near_right(zoned, labels.dropDuplicates(["doc_id", "page", "zone", "tok"]), ("zone",)).join(spots, ["doc_id", "page", "zone", "label"])
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "page", "zone", "label", "kind").orderBy("o1", "o2", "tok"))).where(F.col("r") <= F.col("most"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("x0", "r", "text"))), lambda t: t["text"])
    read = ranked.groupBy("doc_id", "page", "zone", "label", "kind").agg(F.first("place").alias("place"), words.alias("words")).select("doc_id", "kind", "place", _value(F.col("kind"), F.col("words")).alias("value")).where("value is not null")
    first = lambda k: F.min_by("value", F.when(F.col("kind") == k, F.col("place")))
    return read.groupBy("doc_id").agg(*[(first(k).cast(MONEY) if k.endswith("balance") else first(k)).alias(k) for k in LABELS])


def holder_names(pages: DataFrame, tokens: DataFrame) -> DataFrame:
    """Holder's name of each document and where it was found: doc_id, holder, level.

    LABEL: behind a label in the account region (``info``, if pages have it), then on
    page one. RUNNING_HEADER: the topmost line of a later page. CUSTOMER_BLOCK: the first
    line at the left of page one, below the letterhead, that is a name.
    """
    info = F.coalesce("info", F.lit("")) if "info" in pages.columns else F.lit("")
    numbered = pages.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")))
    said = F.when(F.col("nth") == 1, holder(info, F.coalesce("raw_text", F.lit(""))))
    docs = numbered.select("doc_id", "page", "nth", said.alias("said"))
    labelled = docs.where("said is not null").select("doc_id", F.lit(0).alias("rank"), F.col("said").alias("holder"))
    # Pages of all documents are too many to be sent to every task, whatever the file's size promises.
    left = docs.withColumn("known", F.max("said").over(Window.partitionBy("doc_id"))).where("known is null").select("doc_id", "page", "nth")
    by_x = lambda: F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "y0", "tok", "text"))), lambda t: t["text"]), " "))
    top, side = (F.col("nth") > 1) & (F.col("y0") < 25), (F.col("nth") == 1) & F.col("y0").between(140, 220) & (F.col("x0") < 300)
    near = tokens.where((F.col("y0") < 25) | (F.col("y0").between(140, 220) & (F.col("x0") < 300))).join(left.hint("merge"), ["doc_id", "page"])

    def best(lines: DataFrame, rank: int, order: str) -> DataFrame:
        return lines.where(holder_candidate(F.col("line"))).groupBy("doc_id").agg(titled(F.min_by("line", order)).alias("holder")).select("doc_id", F.lit(rank).alias("rank"), "holder")

    running = best(near.where(top).groupBy("doc_id", "page").agg(by_x().alias("line")), 1, "page")
    lines = bucketed(near.where(side), 4.0).groupBy("doc_id", "anchor").agg(by_x().alias("line"))
    block = best(lines.withColumn("line", F.trim(F.regexp_replace("line", r"[H;:.\-_#0-9]", ""))), 2, "anchor")
    first = labelled.unionByName(running).unionByName(block).groupBy("doc_id").agg(F.min_by("holder", "rank").alias("holder"), F.min("rank").alias("rank"))
    return first.select("doc_id", "holder", F.get(F.array(*map(F.lit, ("LABEL", "RUNNING_HEADER", "CUSTOMER_BLOCK"))), F.col("rank")).alias("level"))


def _amount(patterns: list[str], *texts: Column) -> Column:
    """Amount behind the first label of which the first text that has it shows a number."""
    return F.coalesce(*[clean_amount(F.coalesce(*[_found(t, p) for t in texts])) for p in patterns])


def stated_balances(pages: DataFrame) -> DataFrame:
    """Stated balances and totals of each document's pages (doc_id, page, raw_text; summary: text of the summary region), and the level that had each.

    Opening: the summary region, then page one (PAGE_ONE); a summary line with both
    balances (PAIR); all pages (ALL). Closing: PAIR, then the last page (LAST), then ALL.
    Totals: PAGE_ONE, LAST, ALL. Texts of all pages are only joined for what is left. One grouping by document; nothing is joined or read again.
    """
    region = F.coalesce("summary", F.lit("")) if "summary" in pages.columns else F.lit("")
    both = lambda g: clean_amount(F.get(F.array(F.regexp_extract("raw_text", PAIR, 1), F.regexp_extract("raw_text", PAIR, 2)), g))
    docs = pages.select("doc_id", "page", F.coalesce("raw_text", F.lit("")).alias("raw_text"), region.alias("region"))
    docs = docs.withColumn("pair", F.when(F.col("raw_text").rlike(PAIR), F.struct(both(0).alias("p0"), both(1).alias("p1"))))
    known = lambda p: F.min_by(f"pair.{p}", F.when(F.col(f"pair.{p}").isNotNull(), F.col("page"))).alias(p)
    own = F.struct("region", "raw_text")
    texts = F.array_sort(F.collect_list(F.struct("page", "raw_text"))).alias("texts")
    g = docs.groupBy("doc_id").agg(F.min_by(own, "page").alias("one"), F.max_by("raw_text", "page").alias("last"), known("p0"), known("p1"), texts)
    one = (F.nullif(F.col("one.region"), F.lit("")), F.col("one.raw_text"))
    whole = F.array_join(F.transform("texts", lambda p: p["raw_text"]), " ")

    def either(first: tuple[Column, ...], second: tuple[Column, ...], patterns: list[str]) -> Column:
        """struct(value, level) of the first of: two sources (level, value), and the text of all pages."""
        found = lambda level, value: let(value, lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(level).alias("level"))))
        return F.coalesce(found(*first), found(*second), found("ALL", _amount(patterns, whole)))

    plans = {
        "opening_balance": either(("PAGE_ONE", _amount(fields.OPENING, *one)), ("PAIR", F.col("p0")), fields.OPENING),
        "closing_balance": either(("PAIR", F.col("p1")), ("LAST", _amount(fields.CLOSING, F.col("last"))), fields.CLOSING),
        "stated_credits": either(("PAGE_ONE", _amount(fields.CREDITS, *one)), ("LAST", _amount(fields.CREDITS, F.col("last"))), fields.CREDITS),
        "stated_debits": either(("PAGE_ONE", _amount(fields.DEBITS, *one)), ("LAST", _amount(fields.DEBITS, F.col("last"))), fields.DEBITS),
    }
    told = g.select("doc_id", *[c.alias(n) for n, c in plans.items()])
    level = lambda n: f"{n.split('_')[0] if n.endswith('balance') else n}_level"
    return told.select("doc_id", *[x for n in plans for x in (F.col(f"{n}.value").alias(n), F.col(f"{n}.level").alias(level(n)))])
