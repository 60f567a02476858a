import datetime
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passbook.functions import dates, fields, masking, money, narration, text
from passbook.operators import accounts, documents, fraud, integrity, layout, sequence


def one(spark, column, *values):
    """Value of a column expression over one row whose only column is v."""
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(column(F.col("v"))).collect()]


def test_amounts(spark):
    cases = {"1,234.56": "1234.56", "₹50,000.00": "50000.00", "$1,234.56": "1234.56", "-1,234.56": "-1234.56", "(1,234.56)": "-1234.56", "1.234,56": "1234.56", "1,23,456.78": "123456.78", "12,34": "12.34", "1,234": "1234.00", "12.345": "12.35", "abc": None, "": None}
    assert one(spark, money.clean_amount, *cases) == [None if v is None else Decimal(v) for v in cases.values()]
    assert one(spark, money.clean_amount, None) == [None]
    assert one(spark, money.indicator, "1,234.56 Cr", "500.00 Dr", "-5", "5") == ["CREDIT", "DEBIT", "DEBIT", None]


def test_dates(spark):
    forms = ["2026-08-15", "15/08/2026", "15-08-2026", "15-Aug-2026", "15 Aug 2026", "Aug 15, 2026", "15Aug 2026", "15.8.26"]
    assert one(spark, dates.parse, *forms) == [datetime.date(2026, 8, 15)] * len(forms)
    assert one(spark, dates.parse, "invalid_date", "31/02/2026", "2026-13-01", None) == [None] * 4
    assert one(spark, dates.parse, "O1-Aug-2026")[0] == datetime.date(2026, 8, 1)
    whole = (datetime.date(2026, 8, 1), datetime.date(2026, 8, 31))
    assert [tuple(x) for x in one(spark, dates.period, "Period: 01/08/2026 to 31/08/2026", "From 01-Aug-2026 - 31-Aug-2026", "x 2026-08-31 y 2026-08-01")][1:] == [whole, whole]
    assert one(spark, dates.period, "none here") == [None]


def test_rules(spark):
    n = ["Salary Credit", "UPI/P2M/Swiggy Order Food", "ATM Cash WDL Connaught Place", "HDFC Home Loan EMI AutoDebit", "paid upi", "x"]
    assert one(spark, text.payment_mode, *n) == ["OTHER", "UPI", "ATM", "OTHER", "UPI", "OTHER"]
    assert one(spark, lambda c: text.category(c, F.lit("DEBIT")), *n) == ["ZZ_99", "FD_00", "OO_02", "LO_03", "OO_03", "ZZ_99"]
    assert one(spark, lambda c: text.category(c, F.lit("CREDIT")), *n)[0] == "RE_05"
    assert one(spark, text.reference_number, "UPI/P2M/644329448132/x", "IMPS/P2A/AB607717366/x", "NEFT/YESIG60970213984/", "BNA/DPRH487201/6809/x", "none") == ["644329448132", "AB607717366", "YESIG60970213984", "DPRH487201/6809", None]
    assert one(spark, text.safe_filename, "../../a b?.pdf", "", None, "../") == ["a b_.pdf", "unnamed.pdf", "unnamed.pdf", "document.pdf"]


def test_narrations_and_fields(spark):
    lines = spark.createDataFrame([(["UPI/Pa", "ymentd/x"],), ([],), (["a", "B"],)], "v array<string>")
    assert [r[0] for r in lines.select(narration.merged(F.col("v"))).collect()] == ["UPI/Paymentd/x", "Bank Transaction", "a B"]
    page = "Axis Bank\nAccount No: 912010045675012 IFSC: UTIB0000123\nOpening Balance: 1,200.50 Closing balance 99.00"
    assert one(spark, fields.account_number, page) == ["912010045675012"] and one(spark, fields.bank, page) == ["Axis Bank"]
    assert one(spark, lambda c: fields.labelled_amount(c, fields.OPENING), page) == [Decimal("1200.50")]
    assert one(spark, masking.account, "9120 1004 5012", None, "123") == ["XXXXXXXX5012", "X" * 12, "123"]
    assert one(spark, masking.text, "pan ABCDE1234F phone 9876543210") == ["pan ABCDE****F phone 98******3210"]


def ledger(spark, rows):
    frame = spark.createDataFrame([(1, i, i, datetime.date(2026, 8, 1 + i % 28), d, t, Decimal(a), Decimal(b)) for i, (d, t, a, b) in enumerate(rows)], "acct long, id long, seq long, d date, description string, type string, amount decimal(18,2), balance decimal(18,2)")
    side = lambda k: F.when(F.col("type") == k, F.col("amount")).otherwise(0).cast("decimal(18,2)")
    return frame.withColumn("credit", side("CREDIT")).withColumn("debit", side("DEBIT"))


AXIS = [("Salary Credit from Sprinklr", "CREDIT", "50000", "60000"), ("UPI/P2M/Swiggy Order Food", "DEBIT", "650", "59350"), ("ATM Cash WDL Connaught Place", "DEBIT", "5000", "54350"), ("HDFC Home Loan EMI AutoDebit", "DEBIT", "20000", "34350")]


@pytest.fixture(scope="module")
def axis(spark):
    return ledger(spark, AXIS)


def test_golden_statement(spark, axis):
    s = accounts.summary(axis, F.lit(34350)).first()
    assert (s["opening_balance"], s["closing_balance"], s["total_credits"], s["total_debits"], s["transaction_count"], s["balance_reconciled"]) == (10000, 34350, 50000, 25650, 4, True)
    off = accounts.summary(axis, F.lit(31350)).first()
    assert off["reconciliation_difference"] == 3000 and not off["balance_reconciled"]
    assert integrity.status(axis).first()["status"] == "GREEN"
    r = accounts.recurring_salary(axis).first()
    assert (r["monthly_average_amount"], r["matched_count"], r["source"]) == (50000, 1, AXIS[0][0])
    risk = accounts.risk_profile(axis).first()
    assert (risk["total_emi"], risk["total_cash"], risk["emi_to_income_ratio"]) == (20000, 5000, 0.4)


def test_continuity_break(spark):
    broken = ledger(spark, [*AXIS[:2], ("x", "DEBIT", "100", "5000")])
    row = sequence.continuity(broken).where("holds = false").first()
    assert (row["expected"], row["balance"]) == (59250, 5000)
    assert integrity.status(broken).first()["status"] in ("YELLOW", "RED")


def test_anomaly_rules(spark, axis):
    hits = {r["rule_id"] for r in fraud.evaluate(ledger(spark, [("betway transfer", "DEBIT", "100000", "-500"), ("binance buy", "DEBIT", "700", "-1200"), ("cheque return", "DEBIT", "1", "-1201")])).where("triggered").collect()}
    assert {"FA_02", "FA_03", "FA_06", "FA_18", "FA_19", "FA_34"} <= hits
    assert fraud.evaluate(axis).count() == 34


def test_state_machine(spark):
    day = datetime.date(2026, 8, 1)
    rows = [(1, 1, None, "noise", "", "", ""), (1, 2, day, "first", "1,000.00", "", "59,000.00"), (1, 3, None, "wrapped", "", "", ""), (1, 4, None, "second", "450.00", "", "58,550.00"), (1, 5, None, "third", "800.00", "", ""), (1, 6, None, "rest", "", "", "57,750.00")]
    made = layout.reconstruct(spark.createDataFrame(rows, "doc_id long, seq long, d date, description string, debit_raw string, credit_raw string, balance_raw string"))
    a = layout.audit(made).first()
    assert (a["accepted_date_row"], a["accepted_same_day_row"], a["merged_continuation_row"], a["merged_amount_row"], a["rejected_unattached_text"]) == (1, 2, 1, 1, 1)
    t = sorted(layout.finalize(made).collect(), key=lambda r: r["segment"])
    assert [r["balance"] for r in t] == [59000, 58550, 57750] and t[0]["description"] == "first wrapped" and {r["d"] for r in t} == {day}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(-10**9, 10**9), st.integers(1, 10**9)), min_size=1, max_size=20))
def test_ratios_round_half_away(spark, pairs):
    got = [r[0] for r in spark.createDataFrame(pairs, "a long, b long").select(money.divided(F.col("a"), F.col("b"), 10_000)).collect()]
    want = [float((Decimal(abs(a)) / b).quantize(Decimal("0.0001"), rounding="ROUND_HALF_UP")) * (1 if a >= 0 else -1) for a, b in pairs]
    assert got == pytest.approx(want, abs=1e-9)


def test_line_amounts(spark):
    rows = [(1, 1, "x", [49.13]), (1, 2, "x", [16758.0, 16807.13]), (1, 3, "x", [25.0, 16782.13]), (1, 4, "x", [3.0, 9.0, 40.0, 16791.13]), (1, 5, "salary", [100.0]), (1, 6, "x", []), (1, 7, "x", [5.0, 20000.0]), (1, 8, "x", [1.0, 2.0, 19000.0]), (2, 1, "refund", [0.0, 8.0, 50.0]), (2, 2, "x", [7.0, 50.0])]
    got = {(r["doc_id"], r["seq"]): (r["type"], float(r["amount"]), r["balance"] and float(r["balance"]), r["continuous"], r["ambiguous"]) for r in layout.resolve_line_amounts(spark.createDataFrame(rows, "doc_id long, seq long, description string, amounts array<double>"), 98.26).collect()}
    assert [got[1, k] for k in range(1, 9)] == [
        ("DEBIT", 49.13, 49.13, True, False), ("CREDIT", 16758, 16807.13, True, False), ("DEBIT", 25, 16782.13, True, False), ("CREDIT", 9, 16791.13, True, False),
        ("CREDIT", 100, 16891.13, True, False), ("DEBIT", 0, 16891.13, False, True), ("CREDIT", 5, 20000, False, False), ("DEBIT", 2, 19000, False, False),
    ]
    assert got[2, 2] == ("DEBIT", 7, 50, False, True)
    unknown = layout.resolve_line_amounts(spark.createDataFrame([(1, 1, "x", [5.0]), (1, 2, "refund", [0.0, 8.0, 50.0])], "doc_id long, seq long, description string, amounts array<double>")).orderBy("seq").collect()
    assert [(r["type"], r["balance"], r["continuous"]) for r in unknown] == [("DEBIT", None, True), ("CREDIT", 50, True)]


def test_kinds_of_documents(spark):
    pages = [
        (1, 1, "Axis Bank\nAccount No: 912010045675012 IFSC UTIB0000123\nDate Particulars Debit Credit Balance\n05/08/2026 loan agreement 5.00 9.00", "Axis Bank"),
        (2, 1, "Curriculum Vitae\nwork experience at a bank", "Curriculum Vitae"),
        (3, 1, "Loan Agreement\nborrower lender whereas", "Loan Agreement"), (3, 2, "in witness whereof", None),
        (4, 1, "nothing", ""),
    ]
    got = {r["doc_id"]: (r["decision"], r["positive"], r["negative"]) for r in documents.decide(spark.createDataFrame(pages, "doc_id long, page int, raw_text string, header string")).collect()}
    assert got == {1: ("BANK_STATEMENT", 155, 0), 2: ("NOT_BANK_STATEMENT", 20, 80), 3: ("NOT_BANK_STATEMENT", 0, 70), 4: ("UNCERTAIN", 0, 0)}
