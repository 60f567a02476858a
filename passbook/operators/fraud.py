"""Anomaly rules: 34 rows an account from one aggregate of signals and a dimension of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

from .accounts import enrich, summary, total

# Rules with name, kind, severity and description; the rest of the engine decides which are computed.
RULES = [
    ("FA_01", "High Debit Velocity", "transactional", "HIGH", "Frequent high-frequency debit bursts within a short timeframe"),
    ("FA_02", "Round Figure Structuring", "transactional", "MEDIUM", "Repetitive round-figure transactions indicating cash structuring"),
    ("FA_03", "Negative Balance Breach", "accounting", "HIGH", "Account balance dipped into negative or unarranged overdraft"),
    ("FA_04", "Excessive Cash Withdrawal", "behavioural", "MEDIUM", "Cash withdrawals exceed 35% of total outflow volume"),
    ("FA_05", "Pass-Through Funds Flow", "transactional", "HIGH", "Inflow funds immediately withdrawn with near-zero retention"),
    ("FA_06", "Bounced / Returned Debits", "accounting", "HIGH", "Unpaid direct debits, cheque bounces, or ECS mandate failures"),
    ("FA_07", "Rapid In-Out Turnover", "transactional", "HIGH", "Large credit amounts debited within 24 hours of arrival"),
    ("FA_08", "Dormant Account Awakening", "behavioural", "LOW", "Sudden high-value transaction after a long period of inactivity"),
    ("FA_09", "Split Transactions Below KYC", "transactional", "MEDIUM", "Multiple payments just under mandatory reporting thresholds"),
    ("FA_10", "Balance Continuity Discrepancy", "accounting", "HIGH", "Discrepancy between stated balance and computed transaction sum"),
    ("FA_11", "Off-Hours High Value Transfers", "behavioural", "LOW", "High-value transfers initiated during irregular midnight hours"),
    ("FA_12", "Foreign Inward Remittance Spike", "transactional", "LOW", "Unusual spike in international cross-border transfers"),
    ("FA_13", "High Frequency Micro Deposits", "behavioural", "LOW", "Excessive micro-deposits indicating account testing/probing"),
    ("FA_14", "Frequent Minimum Balance Charges", "accounting", "LOW", "Multiple penal charges for failing to maintain required AMB"),
    ("FA_15", "Circular Transfer Patterns", "transactional", "HIGH", "Funds looping between associated accounts and counterparties"),
    ("FA_16", "Abnormal Merchant Refunds", "behavioural", "MEDIUM", "High frequency of merchant chargebacks and refund claims"),
    ("FA_17", "Unusual Salary Reductions", "accounting", "LOW", "Discontinuous employment salary deposits across consecutive months"),
    ("FA_18", "Gambling / Betting Outflows", "transactional", "MEDIUM", "Frequent transactions to known wagering or gaming gateways"),
    ("FA_19", "Crypto Exchange Transfers", "behavioural", "MEDIUM", "High outflow volume directed towards virtual digital asset exchanges"),
    ("FA_20", "Cheque Stop Payment Frequency", "accounting", "LOW", "Repeated instructions issued to stop payment on issued cheques"),
    ("FA_21", "High Value P2P Aggregation", "transactional", "MEDIUM", "Aggregating funds from multiple diverse individuals into one party"),
    ("FA_22", "Sudden Surge in UPI Outflows", "behavioural", "LOW", "UPI velocity significantly exceeding the trailing 90-day baseline"),
    ("FA_23", "Loan Stacking / Multiple EMIs", "accounting", "MEDIUM", "More than 4 concurrent active loan EMI deductions running simultaneously"),
    ("FA_24", "Duplicate Narration Anomaly", "transactional", "LOW", "Identical transaction amounts and timestamps posted multiple times"),
    ("FA_25", "High Turnover / Low Balance", "behavioural", "MEDIUM", "Monthly turnover exceeds 20x the average maintained balance"),
    ("FA_26", "Statutory Tax Payment Defaults", "accounting", "LOW", "Absence of statutory tax payments (TDS/Advance Tax) for business entity"),
    ("FA_27", "Unregistered Gateway Outflows", "transactional", "LOW", "Outflows routed to high-risk unclassified merchant aggregators"),
    ("FA_28", "Frequent Single Location ATM", "behavioural", "LOW", "Multiple consecutive ATM withdrawals at the same terminal within hours"),
    ("FA_29", "Interest Penalty Incurred", "accounting", "LOW", "Penal interest charged on overdue overdraft or credit line"),
    ("FA_30", "Single Counterparty Inflow Dominance", "transactional", "LOW", "Over 80% of monthly income sourced from a single non-salary entity"),
    ("FA_31", "Discrepant Counterparty KYC Name", "behavioural", "LOW", "Name mismatch between declared beneficiary and bank clearing record"),
    ("FA_32", "Zero Balance Day Frequency", "accounting", "LOW", "Account maintained zero or near-zero balance for more than 15 days in period"),
    ("FA_33", "High Volume Reversals", "transactional", "LOW", "High ratio of payment failures immediately followed by reversals"),
    ("FA_34", "Overall Forensic Risk Synthesis", "behavioural", "MEDIUM", "Holistic risk synthesis based on multi-dimensional transaction integrity"),
]


def signals(ledger: DataFrame) -> DataFrame:
    """Flags of the computed rules by account."""
    low = F.lower("description")
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    g = enrich(ledger).groupBy("acct").agg(
        F.count("*").alias("n"), any_of((F.col("amount") >= 50_000) & (F.col("amount") % 10_000 == 0)).alias("round"), any_of(F.col("balance") < 0).alias("negative"),
        total("debit", (F.col("mode") == "ATM") | low.contains("atm")).alias("atm"), any_of(low.rlike(T.FRAUD_BOUNCE)).alias("bounced"), any_of(low.contains("amb charge")).alias("amb"),
        any_of(low.rlike(T.GAMBLING)).alias("gambling"), any_of(low.rlike(T.CRYPTO)).alias("crypto"), F.count_if(low.rlike(T.FRAUD_EMI)).alias("emi"),
    )
    s = summary(ledger).select("acct", F.col("total_credits").alias("cr"), F.col("total_debits").alias("dr"), "average_balance")
    g = g.join(s, "acct")
    through = (F.col("n") >= 4) & (F.abs(F.col("cr") - F.col("dr")) * 20 < F.col("cr")) & (F.col("cr") > 50_000)
    flags = {
        "FA_01": F.col("n") > 50, "FA_02": F.col("round"), "FA_03": F.col("negative"), "FA_04": (F.col("dr") > 0) & (F.col("atm") * 100 > F.col("dr") * 35), "FA_05": through, "FA_06": F.col("bounced"), "FA_07": through, "FA_14": F.col("amb"),
        "FA_18": F.col("gambling"), "FA_19": F.col("crypto"), "FA_23": F.col("emi") > 4, "FA_25": (F.col("average_balance") > 0) & (F.col("dr") > F.col("average_balance") * 20), "FA_34": F.col("round") | F.col("negative"),
    }
    return g.select("acct", F.create_map(*[x for k, v in flags.items() for x in (F.lit(k), v)]).alias("flags"))


def evaluate(ledger: DataFrame) -> DataFrame:
    """34 rows an account: rule, whether it triggered, severity and evidence."""
    rules = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("rule_id", "name", "category", "severity", "description"), r, strict=True)]) for r in RULES])
    rows = signals(ledger).select("acct", "flags", F.explode(rules).alias("r")).select("acct", "flags", "r.*")
    hit = F.coalesce(F.try_element_at("flags", F.col("rule_id")), F.lit(False))
    return rows.select(
        "acct", "rule_id", "name", "category", hit.alias("triggered"), F.when(hit, "YES").otherwise("NO").alias("identified"), "severity", F.lit(0.95).alias("confidence"), "description",
        F.when(hit, F.concat(F.lit("Triggered by transaction condition: "), "name")).alias("evidence"),
    )


def counts(ledger: DataFrame, category: str | None = None, flagged: bool | None = None) -> DataFrame:
    """Rules of a category, flagged or passed, counted by account."""
    rows = evaluate(ledger)
    rows = rows if category is None else rows.where(F.col("category") == category)
    rows = rows if flagged is None else rows.where(F.col("triggered") == flagged)
    return rows.groupBy("acct").agg(F.count("*").alias("rules"), F.count_if("triggered").alias("flagged"), F.count_if(~F.col("triggered")).alias("passed"), F.count_if(F.col("triggered") & (F.col("severity") == "HIGH")).alias("high"))
