"""Printed statement lines to transactions: amounts of a line, and an automaton over a document's lines.

lines: doc_id, seq (place in the document, over all pages), page, line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.money import MONEY, let
from ..functions.narration import merged, nearest_column
from .blocks import transducer
from .layout import resolve_line_amounts

# Printed money, totals that are no transactions, and what a line of a statement begins with or says.
MONEY_TEXT = r"(?<![\d.])\d+(?:,\d+)*\.\d{2}(?![\d.])"
TOTALS = r"(?i)\b(transaction\s+total|grand\s+total|total\s+debit|total\s+credit|closing\s+balance)\b"
CHEQUE = r"^\s*(\d{5,8})\s+"
BRANCH = r"\s(\d{1,6})\s*$"
_SIGN = r"\s*[:=\-]?\s*(?:USD|\$|EUR|€|GBP|£|CAD|AUD|SGD|AED|INR|Rs\.?|₹)?\s*([0-9,]+(?:\.\d{2})?)"
OPENING = r"(?i)(?:opening\s+balance|beginning\s+balance|previous\s+balance|brought\s+forward|b/f|open\s+bal|balance\s+b/f)" + _SIGN
CLOSING = r"(?i)(?:closing\s+balance|ending\s+balance|balance\s+at\s+end|carried\s+forward|c/f|close\s+bal|balance\s+c/f|effective\s+available\s+balance)" + _SIGN
_NAMES = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
DATED = rf"(?i)^(?:\s*(?:#\s*)?\d{{1,4}}\s+)?(\d{{1,4}}[/\-.\s]{_NAMES}[/\-.\s]\d{{2,4}}|{_NAMES}\s+\d{{1,2}},?\s+\d{{2,4}}|(?:\d{{1,2}}[/\-.]\d{{1,2}}[/\-.]\d{{2,4}}|\d{{4}}[/\-.]\d{{1,2}}[/\-.]\d{{1,2}}))"
BANNERS = r"(?i)^(?:statement\s+of\s+axis\s+account|axis\s+bank\s+(?:ltd|limited)|tran\s*date\s+(?:chq\s*no\s+)?particulars|date\s+(?:particulars|description|narration)|page\s*\d+\s*(?:of|/)\s*\d+|page\s*no\.?\s*:\s*\d+|branch\s+name\s*:|branch\s+address\s*:|customer\s+id\s*:|account\s+no\s*:\s*\d+|ifsc\s+code\s*:|micr\s+code\s*:|nomination\s*:|joint\s+holder\s*:|clearing\s+charges\s*:|legend\s*:|\s*[-=_]{5,}\s*$)"
# Headings of a printed table by column; the first match of each gives its place.
HEADING_DATE, HEADING_ANY = r"\b(tran\s*date|value\s*date|date|post\s*date)\b", r"\b(particulars|narration|description|details|debit|withdrawal|credit|deposit|amount|balance|bal|closing\s*bal)\b"
PLACES = [
    ("date", r"\b(tran\s*date|value\s*date|date)\b"), ("chq", r"\b(chq\s*no|cheque\s*no|ref\s*no|chq)\b"), ("particulars", r"\b(particulars|narration|description|transaction\s*details)\b"), ("debit", r"\b(debit|dr|withdrawal|withdrawals)\b"),
    ("credit", r"\b(credit|cr|deposit|deposits)\b"), ("balance", r"\b(balance|running\s*balance|bal)\b"), ("initBr", r"\b(init\.\s*br|init\s*br|branch|br\s*code)\b"),
]

#: What a line does. READING: a transaction without amounts is open.
WAITING, READING = 0, 1


def printed(amount: Column) -> Column:
    """Printed money with commas to a number."""
    return F.translate(amount, ",", "").try_cast(MONEY)


def line_amounts(line: Column) -> Column:
    """struct(amounts, cheque, branch, dedicated) of a line: money in it, a number before it, a short number after it, and whether the line is for amounts.

    It is if it has two amounts, or one and nothing else, a number before or after it,
    or the amount last. Lines of totals have no amounts.
    """

    def of(text: Column) -> Column:
        cheque = F.nullif(F.regexp_extract(text, CHEQUE, 1), F.lit(""))
        rest = F.trim(F.regexp_replace(text, CHEQUE, ""))
        tail = F.nullif(F.regexp_extract(rest, BRANCH, 1), F.lit(""))
        # Not the decimals of the last amount: something stands between its point and the number.
        after = F.length(F.regexp_extract(rest, r"\.([^.]*)$", 1)) - F.length(F.regexp_extract(rest, r"(\d{1,6}\s*)$", 1))
        branch = F.when(~rest.contains(".") | (after > 1), tail)
        body = let(F.struct(rest.alias("rest"), branch.alias("branch")), lambda s: F.when(s["branch"].isNull(), s["rest"]).otherwise(F.trim(F.regexp_replace(s["rest"], r"\d{1,6}\s*$", ""))))
        return F.struct(body.alias("body"), cheque.alias("cheque"), branch.alias("branch"))

    def told(s: Column) -> Column:
        found = F.when(s["body"].rlike(TOTALS), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(s["body"], F.lit(f"({MONEY_TEXT})"), 1))
        alone = (F.trim(F.regexp_replace(s["body"], MONEY_TEXT, "")) == "") | s["branch"].isNotNull() | s["cheque"].isNotNull() | s["body"].rlike(r"(?i)\d+(?:,\d+)*\.\d{2}\s*(?:cr|dr)?$")
        return let(found, lambda a: F.struct(F.transform(a, printed).alias("amounts"), F.when(F.size(a) > 0, s["cheque"]).alias("cheque"), F.when(F.size(a) > 0, s["branch"]).alias("branch"), ((F.size(a) >= 2) | ((F.size(a) == 1) & alone)).alias("dedicated")))

    text = F.trim(line)
    return F.when(text.rlike(TOTALS), told(F.struct(text.alias("body"), F.lit(None).cast("string").alias("cheque"), F.lit(None).cast("string").alias("branch")))).otherwise(let(let(text, of), told))


def heading_places(line: Column) -> Column:
    """struct of places (start and end of each heading, from 0) of a printed table header; null if the line is none."""

    def of(low: Column) -> Column:
        def place(pattern: str) -> Column:
            found = F.regexp_extract(low, pattern, 1)
            at = F.regexp_instr(low, F.lit(pattern))
            return F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.length(found)).alias("end")))

        return F.when(low.rlike(HEADING_DATE) & low.rlike(HEADING_ANY), F.struct(*[place(p).alias(n) for n, p in PLACES]))

    return let(F.lower(line), of)


def sliced(line: Column, header: Column, name: str) -> Column:
    """Text of a line under one heading of a header (heading_places): from the midpoint to the heading before up to that to the next one."""
    starts = F.array_sort(F.array_compact(F.array(*[F.when(header[n].isNotNull(), F.struct(((header[n]["start"] + header[n]["end"]) / 2).alias("centre"), F.lit(n).alias("name"))) for n, _ in PLACES])))

    def cut(cols: Column) -> Column:
        at = F.array_position(F.transform(cols, lambda c: c["name"]), name)
        mid = lambda a, b: F.floor((F.get(cols, a)["centre"] + F.get(cols, b)["centre"]) / 2)
        first, last = F.when(at == 1, 0).otherwise(mid(at - 2, at - 1)), F.when(at == F.size(cols), F.length(line)).otherwise(mid(at - 1, at))
        return F.when(at > 0, F.trim(F.substring(line, (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int"))))

    return let(starts, cut)


def classified(lines: DataFrame) -> DataFrame:
    """Each line with what it holds, whether it may state the opening balance, and its kind: BLANK, HEADER, BANNER, DATED, DATED_AMOUNTS, AMOUNTS or TEXT."""
    date = F.regexp_extract("text", DATED, 0)
    rows = lines.withColumn("text", F.coalesce(F.trim("line"), F.lit(""))).withColumn("opens", F.col("text").rlike(OPENING))
    told = rows.withColumn("date_text", F.nullif(F.regexp_extract("text", DATED, 1), F.lit(""))).withColumn("rest", F.trim(F.substring(F.col("text"), F.length(date) + 1, F.length("text")))).withColumn("places", heading_places(F.col("text")))
    told = told.withColumn("money", line_amounts(F.col("rest")))
    kind = (
        F.when(F.col("text") == "", "BLANK").when(F.col("places").isNotNull(), "HEADER").when(F.col("text").rlike(BANNERS), "BANNER")
        .when(F.col("date_text").isNotNull(), F.when(F.col("money.dedicated"), "DATED_AMOUNTS").otherwise("DATED")).when(F.col("money.dedicated"), "AMOUNTS").otherwise("TEXT")
    )
    return told.select("doc_id", "seq", "page", "text", "date_text", "rest", "places", "money", "opens", kind.alias("kind"))


def without_amounts(text: Column, money: Column) -> Column:
    """A line's narration: its text without its amounts and its branch."""
    bare = F.regexp_replace(text, MONEY_TEXT, "")
    return F.trim(F.when(money["branch"].isNull(), bare).otherwise(F.regexp_replace(bare, F.concat(F.lit(r"^(.*?)\b"), money["branch"], F.lit(r"\b")), F.lit("$1"))))


def read_lines(lines: DataFrame) -> DataFrame:
    """``classified`` lines with the number of their transaction (0 before the first), the opening balance and the table header so far, and their action: OPENED, NARRATION, CLOSED, or IGNORED.

    A dated line opens a transaction, and closes it too if it holds its amounts. While
    one without amounts is open, a line for amounts closes it and any other extends it;
    while none is, lines are ignored. The first line of a document that states an
    opening balance (kind OPENING) does nothing else.
    States: whether a transaction without amounts is open, and 2 more once an opening balance is stated.
    """
    rows = classified(lines)
    centre = lambda n: (F.col(f"places.{n}.start") + F.col(f"places.{n}.end")) / 2
    here = F.when(F.col("kind") == "HEADER", F.struct(centre("debit").alias("debit"), centre("credit").alias("credit"), centre("balance").alias("balance")))
    move = F.when(F.col("kind") == "DATED", READING).when(F.col("kind").isin("DATED_AMOUNTS", "AMOUNTS"), WAITING)
    rows = rows.withColumn("move", move).withColumn("dated", F.col("kind").isin("DATED", "DATED_AMOUNTS")).withColumn("here", here).withColumn("states", F.when(F.col("opens"), printed(F.regexp_extract("text", OPENING, 1))))
    opening = lambda s, opens: opens & (s < 2)

    def step(s: Column, r: Column) -> Column:
        return F.when(opening(s, r["opens"]), s + 2).when(r["move"].isNull(), s).otherwise(s - s % 2 + r["move"])

    known = transducer(
        rows.drop("places"), "doc_id", "seq", 4, step, {"segment": lambda s, r: F.when(r["dated"] & ~opening(s, r["opens"]), 1).otherwise(0)},
        {"opening": (MONEY, lambda s, r: F.when(opening(s, r["opens"]), r["states"])), "header": ("struct<debit:double,credit:double,balance:double>", lambda s, r: F.when(~opening(s, r["opens"]), r["here"]))},
    )
    known = known.withColumn("kind", F.when(opening(F.col("before"), F.col("opens")), "OPENING").otherwise(F.col("kind")))
    reading, kind = F.col("before") % 2 == READING, F.col("kind")
    action = F.when(kind == "DATED", "OPENED").when(kind == "DATED_AMOUNTS", "CLOSED").when(reading & (kind == "AMOUNTS"), "CLOSED").when(reading & (kind == "TEXT"), "NARRATION").otherwise("IGNORED")
    return known.select("doc_id", "seq", "page", "text", "date_text", "rest", "money", "kind", action.alias("action"), "segment", "opening", "header")


def drafts(read: DataFrame) -> DataFrame:
    """One row a transaction of ``read_lines``, closed or not, and one (seq 0) for the lines before the first."""
    own, closing = F.col("action") != "IGNORED", F.col("action") == "CLOSED"
    narration = F.when(closing, without_amounts(F.when(F.col("date_text").isNull(), F.col("text")).otherwise(F.col("rest")), F.col("money"))).when(F.col("date_text").isNotNull(), F.col("rest")).otherwise(F.col("text"))
    said = F.filter(F.transform(F.array_sort(F.collect_list(F.when(own, F.struct("seq", narration.alias("n"))))), lambda r: r["n"]), lambda x: x != "")
    last = lambda c: F.max_by(c, F.when(closing, F.col("seq"))).alias(c)
    stated = F.min_by(printed(F.regexp_extract("text", CLOSING, 1)), F.when((F.col("kind") != "OPENING") & F.col("text").rlike(CLOSING), F.col("seq")))
    return read.groupBy("doc_id", F.col("segment").alias("seq")).agg(F.min_by("page", "seq").alias("page"), F.min_by("date_text", F.when(own, F.col("seq"))).alias("date_text"), said.alias("said"), last("money"), last("header"), last("opening"), F.max("opening").alias("known"), stated.alias("closing"), (F.count_if(closing) > 0).alias("closed"))


def _resolved(made: DataFrame, by: tuple[str, ...] = ("doc_id",), keep: tuple[str, ...] = ()) -> DataFrame:
    """``made`` as transactions, with ``again``: equal to the one before it. Rows alike in ``by`` follow one another; columns of ``keep`` stay."""
    t = made.withColumn("description", merged(F.col("said")))
    at = F.nullif(F.instr(F.array_join("said", " "), F.get("money.amounts", 0).cast("string")), F.lit(0)) - 1
    near = nearest_column(at, F.col("header.debit"), F.col("header.credit"), F.col("header.balance"))
    order = Window.partitionBy(*by).orderBy("seq")
    first = F.when(F.lag("opening").over(order).isNull(), F.col("opening"))
    t = t.select("doc_id", "seq", "page", "date_text", "description", F.when(near.isin("DEBIT", "CREDIT"), near).alias("hint"), F.col("money.amounts").alias("amounts"), first.alias("reset"), F.col("money.branch").alias("branch"), F.col("money.cheque").alias("cheque"), *keep)
    money = resolve_line_amounts(t, keep=("page", "date_text", "description", "branch", "cheque", *keep), by=by)
    bare = F.regexp_replace("date_text", r"^\d{1,2}(?=\d{2}[/\-.\s][A-Za-z])", "")  # of a day merged with a row's number its last two digits stay
    out = money.withColumn("d", dates.parse(bare)).drop("date_text")
    same = F.struct("d", "amount", "balance", "description", "type")
    before = F.lag(same).over(order)
    return out.withColumn("again", F.coalesce(before.eqNullSafe(same), F.lit(False)))


def transactions(made: DataFrame) -> DataFrame:
    """Transactions of ``drafts``: doc_id, seq, page, d, description, type, amount, balance, continuous, ambiguous, branch, cheque.

    Those never closed are left out. Of equal ones that follow each other one stays.
    """
    return _resolved(made.where("closed")).where("not again").drop("again")


def fragments(made: DataFrame) -> DataFrame:
    """Transactions dropped without amounts (doc_id, seq, page, date_text): a later one opened, and they had some narration."""
    return made.withColumn("later", F.lead("seq").over(Window.partitionBy("doc_id").orderBy("seq"))).where("seq > 0 and not closed and size(said) > 0 and later is not null").select("doc_id", "seq", "page", "date_text")


def report(made: DataFrame) -> DataFrame:
    """Each document's opening and closing balance, totals, counts, and whether the totals explain the closing balance; from ``drafts``.

    Drafts never closed, which may hold what a document states, pass beside its
    transactions as a ledger of their own: all is one grouping, and drafts are made once.
    """
    lost = (F.col("seq") > 0) & ~F.col("closed") & (F.size("said") > 0)
    rows = _resolved(made.withColumn("lost", lost), ("doc_id", "closed"), ("closed", "known", "closing", "lost")).withColumn("own", F.col("closed") & ~F.col("again"))
    at, own = F.when(F.col("own"), F.col("seq")), F.col("own")
    side = lambda s: F.coalesce(F.sum(F.when(own & (F.col("type") == s), F.col("amount"))), F.lit(0)).cast(MONEY)
    signed = F.when(F.col("type") == "CREDIT", F.col("amount")).otherwise(-F.col("amount"))
    docs = rows.groupBy("doc_id").agg(
        side("CREDIT").alias("credits"), side("DEBIT").alias("debits"), F.count_if(own).alias("n"), F.count_if(own & ~F.col("continuous")).alias("broken"), F.count_if(own & F.col("ambiguous")).alias("ambiguous"), F.min_by((F.col("balance") - signed).cast(MONEY), at).alias("implied"), F.max_by("balance", at).alias("ended"),
        F.max("known").alias("opening"), F.min_by("closing", F.when(F.col("closing").isNotNull(), F.col("seq"))).alias("closing"), F.count_if("lost").alias("lost"), F.max_by("lost", "seq").alias("last_lost"),
    )
    out = docs.withColumn("dropped", F.col("lost") - F.when(F.col("last_lost"), 1).otherwise(0))
    zero = F.lit(0)
    opening = F.coalesce("opening", "implied", zero).cast(MONEY)
    moved = (opening + F.coalesce("credits", zero) - F.coalesce("debits", zero)).cast(MONEY)
    stated = F.coalesce("closing", "ended", moved).cast(MONEY)
    gap = F.abs(moved - stated).cast(MONEY)
    whole = lambda c: F.coalesce(c, zero).cast("long").alias(c)
    return out.select("doc_id", opening.alias("opening_balance"), stated.alias("closing_balance"), F.coalesce("credits", zero).cast(MONEY).alias("credits"), F.coalesce("debits", zero).cast(MONEY).alias("debits"), *map(whole, ("n", "broken", "ambiguous", "dropped")), gap.alias("difference"), (gap <= 0.01).alias("verified"))
