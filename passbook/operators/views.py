"""What the second dialect and its readers show of a ledger: months, subjects, profile, recurring income, status, responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY
from ..functions.text import payment_mode_alt
from .accounts import summary


def half_up(value: Column, scale: int = 2) -> Column:
    """Rounded with ties towards plus infinity."""
    return F.floor(value * 10**scale + F.lit(0.5).cast("decimal(2,1)")) / 10**scale


def percent(share: Column) -> Column:
    """A share as whole percents, ties up."""
    return F.floor(F.coalesce(share, F.lit(0.0)) * 100 + 0.5).cast("long")


def months(ledger: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """Months of each account, oldest first: income, expenses, saving, its ratio, and balances (unknown ones as zero).

    ``accounts`` (acct, start, credits, debits, opening, closing) adds one month for
    accounts without rows, from what their statement says.
    """
    at = lambda f: f(F.struct(F.col("seq"), "b"))["b"]
    income, spent = F.sum(F.when(F.col("type") == "CREDIT", F.col("amount")).otherwise(0)), F.sum(F.when(F.col("type") == "CREDIT", 0).otherwise(F.col("amount")))
    rows = ledger.withColumn("month", F.coalesce(F.date_format("d", "yyyy-MM"), F.lit("2025-01"))).withColumn("b", F.coalesce("balance", F.lit(0)).cast(MONEY))
    m = rows.groupBy("acct", "month").agg(income.cast(MONEY).alias("income"), spent.cast(MONEY).alias("expenses"), at(F.min).alias("opening"), at(F.max).alias("closing"), F.sum("b").alias("held"), F.count("*").alias("n"), F.min("b").alias("minimum"))
    out = m.select("acct", "month", "income", "expenses", (F.col("income") - F.col("expenses")).cast(MONEY).alias("saving"), "opening", "closing", half_up((F.col("held") / F.col("n")).cast("decimal(28,8)")).cast(MONEY).alias("average"), "minimum")
    if accounts is not None:
        bare = accounts.join(ledger.select("acct").distinct(), "acct", "left_anti")
        mean = half_up(((F.col("opening") + F.col("closing")) / 2).cast("decimal(28,8)")).cast(MONEY)
        out = out.unionByName(bare.select("acct", F.coalesce(F.date_format("start", "yyyy-MM"), F.lit("2025-01")).alias("month"), F.col("credits").alias("income"), F.col("debits").alias("expenses"), (F.col("credits") - F.col("debits")).cast(MONEY).alias("saving"), "opening", "closing", mean.alias("average"), F.least("opening", "closing").alias("minimum")))
    ratio = F.when(F.col("income") > 0, half_up((F.col("saving") / F.col("income")).cast("decimal(28,8)"))).otherwise(0)
    return out.withColumn("saving_ratio", ratio.cast("double"))


# Words of instalments, of cash and of returned debits.
INSTALMENT, CASH, RETURNED = r"\b(emi|loan|repayment|instalment)\b", r"\b(atm|cash|wdl)\b", r"\b(bounce|return|chg\s*ret|dishonour|ecs\s*ret|nach\s*ret)\b"


def risk(ledger: DataFrame) -> DataFrame:
    """Instalments, cash and returned debits of each account: totals, counts, monthly averages; the share of income that instalments take; how often cash is drawn a month."""
    low, debit = F.lower(F.coalesce("description", F.lit(""))), F.col("type") == "DEBIT"
    kinds = {"emi": debit & low.rlike(INSTALMENT), "cash": debit & (payment_mode_alt(F.col("description")).eqNullSafe("ATM") | low.rlike(CASH)), "returned": low.rlike(RETURNED)}
    days = F.coalesce(F.nullif(F.abs(F.datediff(F.max("d"), F.min("d"))), F.lit(0)), F.lit(30))
    sums = [F.coalesce(F.sum(F.when(t, F.col("amount"))), F.lit(0)).cast(MONEY).alias(f"{k}_total") for k, t in kinds.items()] + [F.count_if(t).alias(f"{k}_count") for k, t in kinds.items()]
    g = ledger.groupBy("acct").agg(F.coalesce(F.sum("credit"), F.lit(0)).cast(MONEY).alias("income"), F.greatest(F.lit(30), days).alias("days"), *sums)
    monthly = lambda c: half_up((c.cast("decimal(24,2)") * 30 / F.col("days")).cast("decimal(28,8)"))
    ratio = F.when(F.col("income") > 0, half_up((F.col("emi_total") / F.col("income")).cast("decimal(28,8)"))).otherwise(0)
    averages = [monthly(F.col(f"{k}_total")).cast(MONEY).alias(f"{k}_monthly") for k in kinds]
    return g.select("acct", ratio.cast("double").alias("income_ratio"), monthly(F.col("cash_count")).cast("double").alias("cash_regularity"), *averages, *[F.col(f"{k}_{c}") for k in kinds for c in ("total", "count")])


def account_type(text: Column) -> Column:
    """Kind of account by the first that its bank's statement names: current, overdraft, salary; else savings."""
    low = F.lower(text)
    return F.when(low.rlike(r"\b(current\s+account|current\s+a/c)\b"), "CURRENT").when(low.rlike(r"\b(overdraft|od\s+account|cash\s+credit|cc\s+account)\b"), "OVERDRAFT").when(low.rlike(r"\b(salary\s+account)\b"), "SALARY").otherwise("SAVINGS")


def account_type_by_header(text: Column) -> Column:
    """Kind of account by the first that a page's upper lines name: savings, current, checking, overdraft; else null."""
    low = F.lower(text)
    return F.when(low.rlike(r"\b(savings|saving\s+account|sb\s+a/c)\b"), "SAVINGS").when(low.rlike(r"\b(current\s+account|ca\s+a/c)\b"), "CURRENT").when(low.rlike(r"\b(checking|checking\s+account)\b"), "CHECKING").when(low.rlike(r"\b(overdraft|od\s+a/c)\b"), "OVERDRAFT")


def subjects(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Each account (acct, masked, kind) with its subject and account ids, and whether its narrations are a sole trader's (by either dialect)."""
    low = F.lower(F.coalesce("description", F.lit("")))
    trade = ledger.groupBy("acct").agg(F.bool_or(low.contains("gst")).alias("sole_trader"), F.bool_or(low.rlike(r"\b(gst|trader|vendor|sales|invoice)\b")).alias("sole_trader_alt"))
    no = F.lit(False)
    return accounts.join(trade, "acct", "left").select("acct", F.concat("masked", F.lit("@finvu")).alias("subject_id"), F.concat_ws("-", "masked", F.lower("kind")).alias("account_id"), F.coalesce("sole_trader", no).alias("sole_trader"), F.coalesce("sole_trader_alt", no).alias("sole_trader_alt"))


def profile(documents: DataFrame) -> DataFrame:
    """What a profile page shows: the document's own fields, else the profile's (columns p_*), else a word for what is unknown; empty texts are unknown."""
    shown = {"name": "Not detected", "account": "—", "bank": "Bank Statement", "ifsc": "—", "type": "SAVINGS"}
    known = lambda c: F.nullif(F.col(c), F.lit(""))
    return documents.select("doc_id", *[F.coalesce(known(c), known(f"p_{c}"), F.lit(word)).alias(c) for c, word in shown.items()])


def recurring_view(streams: DataFrame) -> DataFrame:
    """Recurring streams (acct, category, matched_count, matched: ids) with their label and count: as counted, else of the list; zero counts as unknown."""
    n = F.coalesce(F.nullif("matched_count", F.lit(0)), F.nullif(F.size(F.coalesce("matched", F.array().cast("array<bigint>"))), F.lit(0)), F.lit(0)).cast("long")
    return streams.select("acct", (F.col("category") == "RE_05").alias("is_salary"), n.alias("credits"))


def overview(statements: DataFrame) -> DataFrame:
    """What an overview shows of statements (acct, status, continuous, confidence, difference): status, else by continuity; confidence in percent; the difference where it is above a cent."""
    status = F.coalesce("status", F.when(F.col("continuous"), "GREEN").otherwise("RED"))
    return statements.select("acct", status.alias("status"), F.when(status == "GREEN", "emerald").otherwise("amber").alias("colour"), percent(F.col("confidence")).alias("confidence_pct"), F.when(F.col("difference") > 0.01, F.col("difference")).alias("difference"))


def two_places(amount: Column) -> Column:
    """Money as text with two decimals; unknown stays unknown."""
    return amount.cast(MONEY).cast("string")


def response(ledger: DataFrame, stated: DataFrame | None = None) -> DataFrame:
    """Each account's summary as a response has it: names in either spelling, money as text; stated figures (acct, closing, credits, debits) where there are any."""
    s = summary(ledger)
    none = F.lit(None).cast(MONEY)
    s = s.join(stated.select("acct", *[F.col(c).alias(f"stated_{c}") for c in ("closing", "credits", "debits")]), "acct", "left") if stated is not None else s.select("*", *[none.alias(f"stated_{c}") for c in ("closing", "credits", "debits")])
    text = {
        "openingBalance": "opening_balance", "closingBalance": "closing_balance", "calculatedClosingBalance": "calculated_closing", "totalCredits": "total_credits", "totalDebits": "total_debits", "netCashFlow": "net_cash_flow", "averageBalance": "average_balance",
        "reconciliationDifference": "reconciliation_difference", "statementStatedCredits": "stated_credits", "statementStatedDebits": "stated_debits", "averageMonthlyInflow": "total_credits", "averageMonthlyOutflow": "total_debits",
    }
    plain = {"totalTransactions": "transaction_count", "periodDays": "period_days", "balanceReconciled": "balance_reconciled"}
    snake = ["opening_balance", "closing_balance", "total_credits", "total_debits", "net_cash_flow", "average_balance"]
    fields = [two_places(F.col(c)).alias(n) for n, c in text.items()] + [F.coalesce(two_places(F.col("stated_closing")), two_places(F.col("closing_balance"))).alias("statedClosingBalance")]
    fields += [F.col(c).alias(n) for n, c in plain.items()] + [two_places(F.col(c)).alias(c) for c in snake] + [F.col(c) for c in ("transaction_count", "period_days", "balance_reconciled")]
    return s.select("acct", F.struct(F.lit(True).alias("success"), F.lit("Bank statement analyzed successfully").alias("message"), F.struct(F.struct(*fields).alias("summary")).alias("data")).alias("response"))
