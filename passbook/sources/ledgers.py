"""Ledgers: from transaction tables, and those derived from the driver's tables.

A ledger has acct, id, seq (document order), d (date), description, type (CREDIT
or DEBIT), amount, credit, debit and balance (decimal(18,2); balance may be null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import MONEY

#: Narrations of the derived ledger by event id, credits and debits.
CREDIT_TEXTS = ["NEFT salary credit ACME", "UPI inward refund", "IMPS/P2A/607717366683/client payment", "Dividend payout", "UPI/P2A/644329448132/VIKRAM"]
DEBIT_TEXTS = ["UPI/P2M/Swiggy food order", "ATM cash wdl Connaught Place", "ACH loan emi return", "POS amazon retail store", "Electricity bescom bill desk", "NEFT/YESIG60970213984/rent", "casino crypto wallet", "Uber ride", "AMB charge", "cheque clearing 004512", "lic insurance premium"]


def narration_sql(of: str, texts: list[str]) -> str:
    return f"CASE {of} % {len(texts)} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(texts)) + " END"


def complete(rows: DataFrame) -> DataFrame:
    """Fill in credit, debit and a running balance from 1000.00 where rows (acct, id, seq, d, description, type, amount) have none; each 97th id breaks it by 1.00."""
    rows = rows.withColumn("credit", F.when(F.col("type") == "CREDIT", F.col("amount")).otherwise(0).cast(MONEY)).withColumn("debit", F.when(F.col("type") == "DEBIT", F.col("amount")).otherwise(0).cast(MONEY))
    so_far = Window.partitionBy("acct").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("balance", (1000 + F.sum(F.col("credit") - F.col("debit")).over(so_far) + F.when(F.col("id") % 97 == 0, 1).otherwise(0)).cast(MONEY))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts of users, dense, one month."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("acct"), F.col("event_id").alias("id"), "ts", "event_type", "value")
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "CREDIT").otherwise("DEBIT")
    rows = e.select("acct", "id", F.row_number().over(Window.partitionBy("acct").orderBy("ts", "id")).cast("long").alias("seq"), F.to_date("ts").alias("d"), kind.alias("type"), F.coalesce("value", F.lit(0)).cast(MONEY).alias("amount"))
    text = F.when(F.col("type") == "CREDIT", F.expr(narration_sql("id", CREDIT_TEXTS))).otherwise(F.expr(narration_sql("id", DEBIT_TEXTS)))
    return complete(rows.withColumn("description", text))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts of customers, many months, large amounts."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select(
        F.col("o_custkey").alias("acct"), F.col("o_orderkey").alias("id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("seq"),
        F.to_date("o_orderdate").alias("d"), F.concat(F.lit("order "), "o_orderpriority").alias("description"), F.when(F.col("o_orderstatus") == "F", "CREDIT").otherwise("DEBIT").alias("type"), F.col("o_totalprice").cast(MONEY).alias("amount"),
    )
    return complete(rows)


def history(spark: SparkSession, path: str, limit: int = 30) -> DataFrame:
    """Newest stored results first; a top-n, not a full sort."""
    return spark.read.parquet(path).orderBy(F.desc("created_at"), "request_id").limit(limit)


def result(spark: SparkSession, path: str, request_id: str) -> DataFrame:
    """One stored result: its partition only is read."""
    return spark.read.parquet(path).where(F.col("request_id") == request_id)


def save(results: DataFrame, path: str) -> None:
    """Results by request id; a rerun replaces the partitions it writes."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("request_id").parquet(path)
