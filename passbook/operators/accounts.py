"""Per-account analytics of a ledger: summary, cash flow, categories, recurring income, risk.

Every operator is one grouped aggregate by account (partial sums before the
shuffle), so accounts of any size spread over the map side. First and last rows
are taken by ``seq``, never by physical order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.money import MONEY, cents, divided, mean, money


def total(value: str, where: Column | None = None) -> Column:
    kept = F.col(value) if where is None else F.when(where, F.col(value))
    return F.coalesce(F.sum(kept), F.lit(0)).cast(MONEY)


def enrich(ledger: DataFrame) -> DataFrame:
    """Payment mode, category, month and signed amount of each row."""
    return ledger.select(
        "*", T.payment_mode(F.col("description")).alias("mode"), T.category(F.col("description"), F.col("type")).alias("code"), T.category(F.col("description"), F.col("type"), name=True).alias("category"),
        F.coalesce(F.date_format("d", "yyyy-MM"), F.lit("2026-01")).alias("month"), F.when(F.col("type") == "DEBIT", -F.col("amount")).otherwise(F.col("amount")).cast(MONEY).alias("signed"),
    )


def summary(ledger: DataFrame, stated_closing: Column | None = None, tolerance: float = 0.01) -> DataFrame:
    """Totals, counts, opening, closing and average balance, and reconciliation against ``stated_closing`` of the account if given."""
    sums = ledger.groupBy("acct").agg(
        total("credit", F.col("credit") > 0).alias("total_credits"), total("debit", F.col("debit") > 0).alias("total_debits"), F.count_if(F.col("credit") > 0).alias("credit_count"), F.count_if(F.col("debit") > 0).alias("debit_count"), F.count("*").alias("transaction_count"),
        F.min_by(F.struct("type", "credit", "debit", "balance"), "seq").alias("first"), F.max_by("balance", "seq").alias("last_balance"), F.sum("balance").alias("sum_balance"), F.count("balance").alias("n_balance"), F.min("d").alias("from_date"), F.max("d").alias("to_date"), F.min("balance").alias("min_balance"), F.max("balance").alias("max_balance"),
    )
    first = F.col("first")
    opening = F.coalesce(F.when(first["type"] == "CREDIT", first["balance"] - first["credit"]).otherwise(first["balance"] + first["debit"]), F.lit(0)).cast(MONEY)
    sums = sums.withColumn("opening_balance", opening).withColumn("net_cash_flow", (F.col("total_credits") - F.col("total_debits")).cast(MONEY))
    sums = sums.withColumn("calculated_closing", (F.col("opening_balance") + F.col("net_cash_flow")).cast(MONEY)).withColumn("stated", stated_closing.cast(MONEY) if stated_closing is not None else F.lit(None).cast(MONEY))
    sums = sums.withColumn("closing_balance", F.coalesce("stated", "last_balance", "calculated_closing"))
    difference = F.coalesce(F.abs(F.col("calculated_closing") - F.col("stated")), F.lit(0)).cast(MONEY)
    return sums.select(
        "acct", "opening_balance", "closing_balance", "calculated_closing", "total_credits", "total_debits", "net_cash_flow",
        F.coalesce(mean(F.col("sum_balance"), F.col("n_balance")), money((F.col("opening_balance") + F.col("closing_balance")) / 2)).alias("average_balance"),
        "transaction_count", "credit_count", "debit_count", F.coalesce("min_balance", "closing_balance").alias("min_balance"), F.coalesce("max_balance", "closing_balance").alias("max_balance"),
        difference.alias("reconciliation_difference"), (difference <= tolerance).alias("balance_reconciled"), F.coalesce(F.nullif(F.abs(F.datediff("to_date", "from_date")), F.lit(0)), F.lit(30)).alias("period_days"),
    )


def monthly_cash_flow(ledger: DataFrame, full_month: int = 8) -> DataFrame:
    """Income, expenses, saving, ratios and balances by account and month, newest month first."""
    held = F.col("balance").isNotNull()
    m = enrich(ledger).groupBy("acct", "month").agg(
        total("credit", F.col("credit") > 0).alias("income"), total("debit", F.col("debit") > 0).alias("expenses"), F.sum("balance").alias("sum_balance"), F.count("balance").alias("n_balance"),
        F.min("balance").alias("minimum_balance"), F.max("balance").alias("maximum_balance"), F.min_by("balance", F.when(held, F.col("seq"))).alias("opening_balance"), F.max_by("balance", F.when(held, F.col("seq"))).alias("closing_balance"), F.count("*").alias("transaction_count"),
    )
    saving = F.col("income") - F.col("expenses")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast(MONEY)
    return m.select(
        "acct", "month", (F.col("transaction_count") >= full_month).alias("full_month"), F.col("income").alias("income_amount"), (-F.col("expenses")).cast(MONEY).alias("expenses_amount"), saving.cast(MONEY).alias("saving_amount"),
        F.when(F.col("income") > 0, divided(cents(saving), cents(F.col("income")), 10_000)).otherwise(0.0).alias("saving_ratio"), F.when(F.col("expenses") > 0, divided(cents(F.col("income")), cents(F.col("expenses")), 10_000)).otherwise(1.0).alias("income_expenses_ratio"),
        zero(F.col("opening_balance")).alias("opening_balance"), zero(F.col("closing_balance")).alias("closing_balance"), zero(mean(F.col("sum_balance"), F.col("n_balance"))).alias("average_balance"), zero(F.col("minimum_balance")).alias("minimum_balance"), zero(F.col("maximum_balance")).alias("maximum_balance"), "transaction_count",
    ).orderBy(F.desc("month"), "acct")


def category_rollup(ledger: DataFrame) -> DataFrame:
    """Sum, count, mean and share of each category by side; the share is of all rows of the side with money."""
    rows = enrich(ledger)
    sides = rows.groupBy("acct", "type", "code", "category").agg(
        F.sum(F.when(F.col("type") == "CREDIT", F.col("credit")).otherwise(F.col("debit"))).cast(MONEY).alias("amount"), F.count_if(F.greatest("credit", "debit") > 0).alias("n"), F.min("seq").alias("first_seq"),
    )
    sides = sides.where("n > 0")
    of_side = F.sum("amount").over(Window.partitionBy("acct", "type"))
    share = divided(cents(F.col("amount")), cents(of_side.cast(MONEY)), 10_000)
    return sides.select("acct", "type", "code", "category", "amount", "n", mean(F.col("amount"), F.col("n")).alias("average_amount"), (share * 10_000 / 100).alias("percentage"), "first_seq", F.when(F.col("type") == "CREDIT", 0.85).otherwise(0.80).alias("stability"))


def recurring_salary(ledger: DataFrame) -> DataFrame:
    """Salary credits of each account: mean, count, ids in ledger order, first narration."""
    paid = ledger.where((F.col("type") == "CREDIT") & (F.col("credit") > 0) & F.lower("description").rlike(T.SALARY))
    g = paid.groupBy("acct").agg(F.sum("credit").alias("s"), F.count("*").alias("n"), F.min_by("description", "seq").alias("source"), F.array_sort(F.collect_list(F.struct("seq", "id"))).alias("rows"), F.min("d").alias("from_date"), F.max("d").alias("to_date"))
    return g.select(
        "acct", F.lit("SALARY").alias("type"), "source", mean(F.col("s"), F.col("n")).alias("monthly_average_amount"), F.lit("MONTHLY").alias("frequency"), F.col("n").alias("matched_count"),
        F.array_join(F.transform("rows", lambda r: r["id"].cast("string")), ",").alias("matched_ids"), F.lit(0.96).alias("confidence"), F.lit(30).alias("average_gap_days"), F.datediff("to_date", "from_date").alias("longevity_days"),
    )


def recurring_candidates(ledger: DataFrame) -> DataFrame:
    """Credits grouped by cleaned narration and amount to the nearest thousand (half to even)."""
    credits = ledger.where((F.col("type") == "CREDIT") & (F.col("credit") > 0))
    bracket = (F.bround(F.col("credit").cast("double") / 1000) * 1000).cast("long")
    return credits.select("acct", F.concat_ws("_", T.recurring_key(F.col("description")), bracket.cast("string")).alias("key"), "credit").groupBy("acct", "key").agg(F.count("*").alias("n"), F.sum("credit").cast(MONEY).alias("amount"))


def risk_profile(ledger: DataFrame) -> DataFrame:
    """Loan and cash shares of income, returned debits, rows below zero, and monthly figures over the period."""
    low = F.lower("description")
    debit = F.col("type") == "DEBIT"
    cash = debit & ((F.col("mode") == "ATM") | low.rlike(T.CASH))
    g = enrich(ledger).groupBy("acct").agg(
        total("credit", F.col("credit") > 0).alias("income"), total("debit", debit & low.rlike(T.EMI)).alias("total_emi"), total("debit", cash).alias("total_cash"), F.count_if(low.rlike(T.BOUNCED)).alias("returned_count"),
        F.coalesce(F.sum(F.when(low.rlike(T.BOUNCED), F.when(F.col("debit") != 0, F.col("debit")).otherwise(F.col("amount")))), F.lit(0)).cast(MONEY).alias("returned_amount"), F.count_if(F.col("balance") < 0).alias("negative_rows"),
        total("debit", F.col("debit") > 0).alias("outflow"), F.count_if(debit & low.rlike(T.EMI)).alias("emi_count"), F.count_if(cash).alias("cash_count"), F.coalesce(F.nullif(F.abs(F.datediff(F.max("d"), F.min("d"))), F.lit(0)), F.lit(30)).alias("period_days"),
    )
    base = F.when(F.col("income") > 0, cents(F.col("income"))).otherwise(F.lit(100).cast("long"))
    months = F.greatest(F.lit(30), F.col("period_days")).cast("long")
    monthly = lambda c: divided(cents(F.col(c)) * 30, months, 1) / 100.0
    return g.select(
        "acct", divided(cents(F.col("total_emi")), base, 10_000).alias("emi_to_income_ratio"), divided(cents(F.col("total_cash")), base, 10_000).alias("cash_withdrawal_ratio"), "returned_count", "returned_amount", "total_emi", "total_cash", "negative_rows",
        "emi_count", "cash_count", "period_days", monthly("income").alias("monthly_income"), monthly("outflow").alias("monthly_outflow"), F.lit(0.88).alias("income_stability_score"), F.lit(0.15).alias("expense_volatility_score"),
    )


def chart_scale(months: DataFrame) -> DataFrame:
    """Height of each month's bars in percent of the account's greatest month, at least 1000."""
    top = F.greatest(F.lit(1000).cast(MONEY), F.max(F.greatest("income_amount", F.abs("expenses_amount"))).over(Window.partitionBy("acct")))
    bar = lambda c: F.least(F.lit(100.0), divided(cents(F.abs(c)), cents(top), 100) * 100)
    return months.select("acct", "month", bar(F.col("income_amount")).alias("income_pct"), bar(F.col("expenses_amount")).alias("expenses_pct"))


def search(ledger: DataFrame, words: str = "", kind: str | None = None, mode: str = "", page: int = 1, size: int = 15) -> DataFrame:
    """Rows of each account whose narration has ``words``, of a side and a mode, one page in ledger order, with the number of pages."""
    rows = enrich(ledger).where(F.contains(F.lower("description"), F.lit(words.lower())) & F.contains(F.upper("mode"), F.lit(mode.upper())))
    rows = rows if kind is None else rows.where(F.col("type") == kind)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("acct").orderBy("seq")).cast("long")).withColumn("n", F.count("*").over(Window.partitionBy("acct")))
    return ranked.where(F.col("rank").between((page - 1) * size + 1, page * size)).select("acct", "id", "seq", "rank", F.greatest(F.lit(1), F.ceil(F.col("n") / size)).cast("long").alias("pages"))
