"""The second dialect: documents, months without rows, rounding, views."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from passbook.operators import signals, views

STATEMENT = """HDFC BANK LTD
Account Number: 50100234567890  IFSC: HDFC0000123
Statement Period: 01/07/2026 to 31/07/2026
Opening Balance: 25000.00
Date Narration Withdrawal Deposit Balance
01/07/2026 NEFT Inward Company Payout 30000.00 55000.00
12/07/2026 UPI Electricity Bill 2500.00 52500.00
25/07/2026 ACH Mutual Fund 10000.00 42500.00"""


def test_kinds_of_documents(spark):
    cases = [
        (1, STATEMENT, "BANK_STATEMENT"), (2, STATEMENT + "\nsalary slip of July\ntax invoice", "BANK_STATEMENT"), (3, "Unique Identification Authority of India\nYour Aadhaar Number", "NOT_BANK_STATEMENT"),
        (4, "tax invoice\nbill to: x\namount 5.00", "NOT_BANK_STATEMENT"), (5, "short", "UNREADABLE"), (6, None, "UNREADABLE"), (7, "Savings Account of Kotak Bank, branch code 5", "UNCERTAIN"), (8, "a letter about nothing at all", "NOT_BANK_STATEMENT"),
    ]
    got = {r["doc_id"]: r for r in signals.score(spark.createDataFrame([c[:2] for c in cases], "doc_id long, raw_text string")).collect()}
    assert {k: r["decision"] for k, r in got.items()} == {c[0]: c[2] for c in cases}
    one = got[1]
    assert (one["bank"], one["bank_identity"], one["account_info"], one["statement_period"], one["transaction_table"], one["financial_columns"], one["banking_keywords"]) == ("HDFC Bank", 20, 20, 15, 25, 15, 5)
    assert one["confidence"] == 1.0 and got[2]["penalty"] == 0 and got[3]["penalty"] == 70


def test_the_first_bank_counts(spark):
    rows = spark.createDataFrame([("paid to icici by axis",), ("UTI Bank, then SBI",), ("Bank of India",), ("none",)], "t string")
    assert [r[0] for r in rows.select(signals.first_bank(F.col("t"))).collect()] == ["ICICI Bank", "Axis Bank", "Bank of India", None]


@pytest.mark.parametrize(("x", "want"), [("1.005", 1.01), ("-1.005", -1.0), ("2.344", 2.34), ("-2.346", -2.35)])
def test_ties_go_up(spark, x, want):
    assert float(spark.createDataFrame([(Decimal(x),)], "x decimal(18,3)").select(views.half_up(F.col("x"))).first()[0]) == want


def test_months(spark):
    d = datetime.date
    rows = [(1, 1, d(2026, 2, 1), "CREDIT", 10, 110), (1, 2, None, "DEBIT", 4, None), (1, 3, d(2026, 1, 5), "DEBIT", 5, 101)]
    led = spark.createDataFrame([(a, s, day, t, Decimal(m), None if b is None else Decimal(b)) for a, s, day, t, m, b in rows], "acct long, seq long, d date, type string, amount decimal(18,2), balance decimal(18,2)")
    stated = spark.createDataFrame([(2, None, Decimal(9), Decimal(3), Decimal(1), Decimal(8)), (1, None, Decimal(0), Decimal(0), Decimal(0), Decimal(0))], "acct long, start date, credits decimal(18,2), debits decimal(18,2), opening decimal(18,2), closing decimal(18,2)")
    got = [(r["acct"], r["month"], float(r["saving"]), float(r["average"]), r["saving_ratio"]) for r in views.months(led, stated).orderBy("acct", "month").collect()]
    assert got == [(1, "2025-01", -4, 0, 0), (1, "2026-01", -5, 101, 0), (1, "2026-02", 10, 110, 1), (2, "2025-01", 6, 4.5, 0.67)]
