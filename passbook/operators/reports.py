"""Reports over pages and ledgers: extraction counts, page order, ledger report, accounts with their profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import BANK_LETTERS
from ..functions.narration import native_sufficient
from . import layout, lines
from .accounts import summary
from .chain import staged
from .sequence import continuity_flags


def extraction(pages: DataFrame) -> DataFrame:
    """Pages by method, mean confidence, words enough for geometry, and whether page numbers are 1..n, by document."""
    numbered = pages.withColumn("__k", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")))
    return numbered.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.count_if(F.col("method") == "OCR").alias("scanned"), F.count_if(F.col("method") == "NATIVE").alias("native"), F.round(F.avg("confidence"), 4).alias("confidence"), F.bool_and(F.col("page") == F.col("__k")).alias("page_sequence_valid"), (F.count_if(F.col("words") >= 10) >= 1).alias("has_geometry"),
    )


def to_scan(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages whose own text suffices, and those to scan: two filters over one input, so only the latter pay."""
    enough = F.coalesce(native_sufficient(F.col("raw_text")), F.lit(False))
    return pages.where(enough), pages.where(~enough)


def ledger_report(ledger: DataFrame) -> DataFrame:
    """Reconciliation report of each account: totals, counts, balances, continuity, repeated rows."""
    what = F.struct("d", "amount", "balance", "description", "type")
    flags = continuity_flags(ledger).withColumn("repeat", F.coalesce(F.lag(what).over(Window.partitionBy("acct").orderBy("seq")).eqNullSafe(what), F.lit(False)))
    extra = flags.groupBy("acct").agg(F.count_if("continuous").alias("continuity_passed"), F.count_if(~F.col("continuous")).alias("continuity_failed"), F.count_if((F.col("credit") == 0) & (F.col("debit") == 0)).alias("neither_side"), F.count_if((F.col("credit") > 0) & (F.col("debit") > 0)).alias("both_sides"), F.count_if("repeat").alias("duplicates"))
    s = summary(ledger)
    gap = F.abs(F.col("calculated_closing") - F.col("closing_balance"))
    return s.join(extra, "acct").select("acct", "opening_balance", "total_credits", "total_debits", "calculated_closing", "closing_balance", gap.cast("decimal(18,2)").alias("difference"), (gap <= 0.01).alias("verified"), "transaction_count", "credit_count", "debit_count", "continuity_passed", "continuity_failed", "neither_side", "both_sides", "duplicates", F.col("continuity_failed").alias("suspicious"), F.col("total_credits").alias("calculated_credits"), F.col("total_debits").alias("calculated_debits"), F.col("closing_balance").alias("stated_closing"))


def account_profiles(accounts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each account (doc_id, acct, pos, connection) with the first profile (doc_id, ord, bank, holder) of its document whose bank has the connection's name; else the profile at its place."""
    profiles, keys = profiles.withColumnRenamed("doc_id", "__doc"), ["doc_id", "acct"]
    same = F.col("doc_id") == F.col("__doc")
    by_name = accounts.join(profiles, same & F.contains(F.lower("bank"), F.lower("connection"))).groupBy(keys).agg(F.min_by(F.struct("bank", "holder"), "ord").alias("named"))
    placed = accounts.join(profiles, same & (F.col("pos") == F.col("ord")), "left").select(*keys, "connection", F.struct("bank", "holder").alias("placed"))
    chosen = placed.join(by_name, keys, "left").withColumn("p", F.coalesce("named", "placed"))
    return chosen.select(*keys, "connection", F.coalesce("p.bank", F.lit("")).alias("bank"), F.coalesce("p.holder", F.lit("")).alias("holder"))


def backfill(ledger: DataFrame, stated: DataFrame) -> DataFrame:
    """Period and balances of each account as stated (acct, from_date, to_date, opening, closing), else from its first and last rows, else from the other balance and the totals."""
    s = summary(ledger).select("acct", "opening_balance", "closing_balance", "net_cash_flow")
    ends = ledger.groupBy("acct").agg(F.min_by("d", "seq").alias("first_d"), F.max_by("d", "seq").alias("last_d"))
    all_of = s.join(ends, "acct").join(stated, "acct", "left")
    opening = F.coalesce("opening", F.col("closing") - F.col("net_cash_flow"), "opening_balance").cast("decimal(18,2)")
    closing = F.coalesce("closing", F.col("opening") + F.col("net_cash_flow"), "closing_balance").cast("decimal(18,2)")
    return all_of.select("acct", F.coalesce("from_date", "first_d").alias("from_date"), F.coalesce("to_date", "last_d").alias("to_date"), opening.alias("opening_balance"), closing.alias("closing_balance"))


def routes(pages: DataFrame) -> DataFrame:
    """How each document (doc_id, raw_text, words) is to be read: by the bank's own line parser, by coordinates where a page has ten words or more, else by lines."""
    low = F.lower("raw_text")
    axis = F.substring(low, 1, BANK_LETTERS).rlike(r"\b(axis\s+bank|uti\s+bank|axis\b)") | low.rlike(r"\butib[0-9]{7}\b|statement\s+of\s+axis\s+account")
    g = pages.groupBy("doc_id").agg(F.bool_or(axis).alias("axis"), (F.max("words") >= 10).alias("placed"))
    return g.select("doc_id", F.when(F.col("axis"), "BANK_LINES").when(F.col("placed"), "COORDINATES").otherwise("LINES").alias("route"))


def parsed(rows: DataFrame, printed: DataFrame) -> DataFrame:
    """Transactions of each document by coordinates (``layout.reconstruct`` rows), or, where that gives none, by its printed lines (``lines``): with ``level``, the parser that gave them."""
    columns = ["doc_id", "seq", "page", "d", "description", "type", "amount", "balance"]

    def by_rows(_: DataFrame) -> DataFrame:
        """All rows: the first parser has every document to itself, printed or not."""
        return layout.finalize(layout.reconstruct(rows.where("doc_id is not null"))).withColumnRenamed("segment", "seq").select(*columns)

    def by_lines(left: DataFrame) -> DataFrame:
        return lines.transactions(lines.drafts(lines.read_lines(left))).select(*columns)

    return staged(printed.where("doc_id is not null"), [("COORDINATES", by_rows), ("LINES", by_lines)])


def latest(ledger: DataFrame, most: int = 100) -> DataFrame:
    """The first ``most`` rows of each account in ledger order."""
    return ledger.withColumn("__k", F.row_number().over(Window.partitionBy("acct").orderBy("seq"))).where(F.col("__k") <= most).drop("__k")


def masked_map(frame: DataFrame, column: str, keys: tuple[str, ...] = ("account", "pan", "phone", "email", "name")) -> DataFrame:
    """Values of the keys that are personal become stars; others stay."""
    return frame.withColumn(column, F.transform_values(column, lambda k, v: F.when(F.lower(k).isin(*keys), "***").otherwise(v)))
