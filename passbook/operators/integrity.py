"""Integrity of a ledger: four checks, a status, and a blended confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY, divided
from .accounts import summary
from .sequence import continuity


# Messages by status, and reasons of a failure.
MESSAGES = {
    "verified": "Mathematical integrity verified: ledger arithmetic, running balance continuity, and statement totals reconcile within tolerance.",
    "plain": "Transactions extracted and validated without internal contradictions.",
    "minor": "Minor discrepancy detected in intermediate row continuity, but document totals reconcile.",
    "failed": "Mathematical integrity verification failed: %s.",
    "a": "transaction ledger arithmetic mismatch", "b": "statement summary reconciliation difference", "c": " running balance gap(s)", "d": "completeness ratio %s%% below threshold",
}


def _status(applies: Column, passes: Column) -> Column:
    return F.when(~applies, "NOT_APPLICABLE").when(passes, "PASS").otherwise("FAIL")


def figures(ledger: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """What the checks compare, one row an account; stated figures are columns of the ledger if it has them."""
    s = summary(ledger)
    last = ledger.groupBy("acct").agg(F.max_by("balance", "seq").alias("last_balance"), F.count("balance").alias("n_balances"), *[F.max(c).cast(MONEY).alias(c) if c in ledger.columns else F.lit(None).cast(MONEY).alias(c) for c in ("stated_closing", "stated_credits", "stated_debits")])
    c = continuity(ledger).groupBy("acct").agg(F.count_if("holds").alias("passed"), F.count_if(~F.col("holds")).alias("failed"))
    return s.join(last, "acct").join(c, "acct")


def accounting(audit: DataFrame) -> DataFrame:
    """Rows of each account that are accounted for, from ``layout.audit`` by acct and, if it has them, header_removed, other_removed and suspicious; other columns stay."""
    named = ("accepted_date_row", "accepted_same_day_row", "merged_amount_row", "merged_continuation_row", "header_removed", "other_removed")
    accounted = sum((F.coalesce(c, F.lit(0)) for c in named if c in audit.columns), F.lit(0))
    suspicious = F.coalesce("suspicious", F.lit(0)) if "suspicious" in audit.columns else F.lit(0)
    return audit.withColumns({"accounted": accounted.cast("long"), "suspicious": suspicious.cast("long")})


def checks(ledger: DataFrame, tolerance: float = 0.01, least_ratio: float = 0.98, audit: DataFrame | None = None, most_suspicious: int = 2) -> DataFrame:
    """Status and difference of checks A (arithmetic), B (stated figures), C (continuity) and D (completeness).

    ``audit`` (acct, candidates, accounted, suspicious) adds completeness_ratio. Without
    it, or for an account that it lacks, all candidate rows are the ledger's.
    """
    f = figures(ledger)
    complete, ratio = F.lit(True), []
    if audit is not None:
        f = f.join(audit.select("acct", "candidates", "accounted", "suspicious"), "acct", "left")
        share = F.when(F.col("candidates") > 0, divided(F.col("accounted"), F.greatest("candidates", F.lit(1)).cast("long"), 10_000)).otherwise(1.0)
        complete, ratio = (share >= least_ratio) & (F.coalesce("suspicious", F.lit(0)) <= most_suspicious), [share.alias("completeness_ratio"), F.coalesce("suspicious", F.lit(0)).alias("suspicious")]
    close = lambda a, b: F.coalesce(F.abs(a - b), F.lit(0)) <= tolerance
    a_diff = F.abs(F.col("calculated_closing") - F.col("last_balance")).cast(MONEY)
    b_diff = F.abs(F.col("calculated_closing") - F.col("stated_closing")).cast(MONEY)
    n = F.col("passed") + F.col("failed")
    return f.select(
        "acct", "passed", "failed", "total_credits", "total_debits", "transaction_count", "stated_closing",
        _status(F.col("last_balance").isNotNull(), a_diff <= tolerance).alias("check_a"), F.coalesce(a_diff, F.lit(0)).cast(MONEY).alias("a_difference"),
        _status(F.col("stated_closing").isNotNull(), (b_diff <= tolerance) & close(F.col("total_credits"), F.col("stated_credits")) & close(F.col("total_debits"), F.col("stated_debits"))).alias("check_b"), F.coalesce(b_diff, F.lit(0)).cast(MONEY).alias("b_difference"),
        _status(n > 0, F.col("failed") == 0).alias("check_c"), F.when(n > 0, divided(F.col("passed"), F.greatest(n, F.lit(1)).cast("long"), 10_000)).otherwise(1.0).alias("continuity_rate"),
        F.when((F.col("failed") == 0) & complete, "PASS").otherwise("FAIL").alias("check_d"), *ratio,
    )


def status(ledger: DataFrame, audit: DataFrame | None = None) -> DataFrame:
    """GREEN, YELLOW or RED with short reasons and the message shown, and the blended confidence.

    Confidences of an account's document are columns of ``audit`` if it has them:
    classification_confidence (else .95), spatial_confidence (.96), page_confidence (1).
    """
    c = checks(ledger, audit=audit)
    parts = {"classification_confidence": (2000, 1900), "spatial_confidence": (2500, 2400), "page_confidence": (1500, 1500)}
    given = [n for n in parts if audit is not None and n in audit.columns]
    if given:
        c = c.join(audit.select("acct", *given), "acct", "left")
    part = lambda n: F.coalesce(F.round(parts[n][0] * F.col(n)).cast("int"), F.lit(parts[n][1])) if n in given else F.lit(parts[n][1])
    abc = F.array("check_a", "check_b", "check_c")
    applicable = F.size(F.filter(abc, lambda x: x != "NOT_APPLICABLE"))
    failing = F.array_contains(abc, "FAIL")
    green = (F.col("check_d") == "PASS") & ~failing & ((applicable == 0) | (F.col("failed") == 0))
    counted = "suspicious" in c.columns
    yellow = (F.col("check_a") != "FAIL") & (F.col("check_b") != "FAIL") & (F.col("failed") <= 1) & ((F.col("suspicious") <= 2) if counted else F.lit(True))
    share = F.format_number((F.col("completeness_ratio") if counted else F.lit(1.0)) * 100, 1)
    said = F.concat_ws(", ", F.array_compact(F.array(F.when(F.col("check_a") == "FAIL", MESSAGES["a"]), F.when(F.col("check_b") == "FAIL", MESSAGES["b"]), F.when(F.col("check_c") == "FAIL", F.concat(F.col("failed").cast("string"), F.lit(MESSAGES["c"]))), F.when(F.col("check_d") == "FAIL", F.format_string(MESSAGES["d"], share)))))
    message = F.when(green, F.when(applicable > 0, MESSAGES["verified"]).otherwise(MESSAGES["plain"])).when(yellow, MESSAGES["minor"]).otherwise(F.format_string(MESSAGES["failed"], said))
    reasons = F.concat_ws(", ", F.array_compact(F.array(F.when(F.col("check_a") == "FAIL", "arithmetic"), F.when(F.col("check_b") == "FAIL", "statement"), F.when(F.col("check_c") == "FAIL", F.concat(F.col("failed").cast("string"), F.lit(" gap(s)"))))))
    present = sum((F.when(x, 1).otherwise(0) for x in (F.col("stated_closing").isNotNull(), F.col("total_credits") > 0, F.col("total_debits") > 0, F.col("transaction_count") > 0)), F.lit(1))
    s = c.withColumn("message", message).withColumn("status", F.when(green, "GREEN").when(yellow, "YELLOW").otherwise("RED")).withColumn("fields_present", present.cast("long"))
    pct = F.when(F.col("status") == "GREEN", 100).when(F.col("status") == "YELLOW", 70).otherwise(30)
    # In units of 1e-4: .20 classification, .25 spatial, .15 page confidence, .15 fields / 5, .25 reconciliation.
    blend = (part("classification_confidence") + part("spatial_confidence") + part("page_confidence") + 300 * F.col("fields_present") + 25 * pct) / 10_000.0
    return s.select("acct", "status", F.when(F.col("status") == "RED", reasons).otherwise("").alias("reasons"), "message", "fields_present", blend.alias("confidence"))
