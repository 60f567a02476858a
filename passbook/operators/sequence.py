"""Row-to-row operators of a ledger, as windows by account in ``seq`` order.

Accounts are the partition key of every window here, so one exchange serves them
all. An account is as long as its statements; no window crosses accounts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import MONEY


def _order() -> Window:
    return Window.partitionBy("acct").orderBy("seq")


def _before() -> Window:
    return _order().rowsBetween(Window.unboundedPreceding, -1)


def previous_balance() -> Column:
    """The last balance there was before the row."""
    return F.last("balance", ignorenulls=True).over(_before())


def continuity(ledger: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Each row against the one before: expected balance, difference, and whether it holds; null where a balance lacks."""
    rows = ledger.withColumn("prev", F.lag("balance").over(_order()))
    expected = (F.col("prev") + F.col("credit") - F.col("debit")).cast(MONEY)
    gap = F.abs(expected - F.col("balance")).cast(MONEY)
    return rows.select("*", expected.alias("expected"), gap.alias("difference"), (gap <= tolerance).alias("holds"))


def gaps(ledger: DataFrame, most: int = 10) -> DataFrame:
    """Accounts' continuity counts and rate, failed ids, and their first gaps."""
    c = continuity(ledger)
    ranked = c.where(~F.col("holds")).withColumn("k", F.row_number().over(_order()))
    failed = ranked.groupBy("acct").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda r: r["id"].cast("string")), ",").alias("failed_ids"), F.sum(F.when(F.col("k") <= most, F.col("difference"))).cast(MONEY).alias("first_gaps_total"))
    counts = c.groupBy("acct").agg(F.count_if("holds").alias("passed"), F.count_if(~F.col("holds")).alias("failed"))
    return counts.join(failed, "acct", "left")


def fill_previous(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("prev_balance", previous_balance())


def inherit_date(ledger: DataFrame, default: str = "2026-01-01") -> DataFrame:
    """Undated rows take the date seen last, or the default."""
    return ledger.withColumn("d", F.coalesce("d", F.last("d", ignorenulls=True).over(_before()), F.lit(default).cast("date")))


def drop_consecutive(ledger: DataFrame) -> DataFrame:
    """Without rows that equal their raw predecessor in date, amount, balance, narration and type."""
    what = F.struct("d", "amount", "balance", "description", "type")
    return ledger.withColumn("__before", F.lag(what).over(_order())).where(~F.coalesce(F.col("__before").eqNullSafe(what), F.lit(False)) | F.col("__before").isNull()).drop("__before")


def repair_glyphs(ledger: DataFrame) -> DataFrame:
    """Amounts that differ in one printed character from what the balances imply take the implied value."""
    rows = fill_previous(ledger)
    change = (F.col("balance") - F.col("prev_balance")).cast(MONEY)
    implied = F.abs(change).cast(MONEY)
    a, b = F.col("amount").cast("string"), implied.cast("string")
    differing = F.size(F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    right_way = ((F.col("type") == "DEBIT") & (change < 0)) | ((F.col("type") == "CREDIT") & (change > 0))
    fix = F.coalesce(right_way & (F.length(a) == F.length(b)) & (differing == 1), F.lit(False))
    return rows.withColumn("repaired", fix).withColumn("amount", F.when(fix, implied).otherwise(F.col("amount")))


def bridge_gaps(ledger: DataFrame, serial: str = "serial") -> DataFrame:
    """Insert a debit where printed serial numbers skip and the balance fell by more than the row explains."""
    rows = fill_previous(ledger).withColumn("prev_serial", F.lag(serial).over(_order()))
    missing = (F.col("prev_balance") + F.col("credit") - F.col("debit") - F.col("balance")).cast(MONEY)
    skipped = F.coalesce((F.col(serial) - F.col("prev_serial") > 1) & (missing > 0), F.lit(False))
    row = lambda bridge: F.struct(F.lit(bridge).alias("bridge"), (F.lit("DEBIT") if bridge else F.col("type")).alias("type"), (missing if bridge else F.col("amount")).alias("amount"))
    both = F.when(skipped, F.array(row(True), row(False))).otherwise(F.array(row(False)))
    return rows.withColumn("__r", F.explode(both)).select("acct", "id", "seq", "d", F.col("__r.bridge").alias("bridge"), F.col("__r.type").alias("type"), F.col("__r.amount").cast(MONEY).alias("amount"), "balance")


def type_by_balance(ledger: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Side of each row from the change of balance where it explains the amount; otherwise the side stated."""
    rows = fill_previous(ledger)
    change = F.col("balance") - F.col("prev_balance")
    explains = F.abs(F.abs(change) - F.col("amount")) <= tolerance
    kind = F.when(explains & (change > 0), "CREDIT").when(explains & (change < 0), "DEBIT").otherwise(F.col("type"))
    return rows.withColumn("derived_type", kind)


def continuity_flags(ledger: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Whether the last known balance plus the signed amount is the row's balance; true where unknown."""
    rows = fill_previous(ledger)
    gap = F.abs(F.col("prev_balance") + F.col("credit") - F.col("debit") - F.col("balance"))
    return rows.withColumn("continuous", F.coalesce(gap <= tolerance, F.lit(True)))


def rapid_in_out(ledger: DataFrame, least: int = 25_000, share: float = 0.8) -> DataFrame:
    """Credits above ``least`` whose next row is a debit of at least ``share`` of them."""
    rows = ledger.withColumn("next", F.lead(F.struct("type", "amount")).over(_order()))
    return rows.where((F.col("type") == "CREDIT") & (F.col("amount") > least) & (F.col("next.type") == "DEBIT") & (F.col("next.amount") >= F.col("amount") * F.lit(share).cast("decimal(3,2)"))).select("acct", "id", "amount", F.col("next.amount").alias("next_amount"))


def segments(rows: DataFrame) -> DataFrame:
    """Rows (acct, seq, d, amount, balance, description) to transactions: a dated row starts one, others fill its blanks and extend its narration."""
    numbered = rows.withColumn("segment", F.sum(F.when(F.col("d").isNotNull(), 1).otherwise(0)).over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "description"))), lambda r: r["description"]), " ")
    return numbered.where("segment > 0").groupBy("acct", "segment").agg(F.min("d").alias("d"), first("amount"), first("balance"), words.alias("description"), F.count("*").alias("rows"))
