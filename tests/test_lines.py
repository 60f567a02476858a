"""Statement lines and long documents: examples, and blocks against plain folds."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from passbook.operators import blocks, layout, lines


def test_amounts_of_lines(spark):
    cases = {
        "16758.00 16807.13 4378": (["16758.00", "16807.13"], None, "4378", True),
        "/UPI/YES BANK LIMITED YBS 25.00 16782.13 4378": (["25.00", "16782.13"], None, "4378", True),
        "004512 1,00,000.00": (["100000.00"], "004512", None, True),
        "paid 12.50 to shop": (["12.50"], None, None, False),
        "paid 12.50 Dr": (["12.50"], None, None, True),
        "12.50": (["12.50"], None, None, True),
        "v1.2.30 and 3.456": ([], None, None, False),
        "GRAND TOTAL 5.00 6.00": ([], None, None, False),
        "UPI 4378": ([], None, None, False),
        "": ([], None, None, False),
    }
    got = spark.createDataFrame([(c,) for c in cases], "v string").select(lines.line_amounts(F.col("v")).alias("m")).select("m.*").collect()
    assert [([str(a) for a in r["amounts"]], r["cheque"], r["branch"], r["dedicated"]) for r in got] == list(cases.values())


def statement(spark, *pages):
    rows, seq = [], 0
    for page, text in enumerate(pages, 1):
        for line in text.split("\n"):
            seq += 1
            rows.append((1, seq, page, line.strip()))
    return lines.read_lines(spark.createDataFrame(rows, "doc_id long, seq long, page long, line string"))


AXIS = """Statement of Axis Account No: 925010049111575
OPENING BALANCE: 49.13
Tran Date Chq No Particulars Debit Credit Balance Init. Br

18-03-2026
IMPS/P2A/607717366683/IdfFinan/IDFCBank/Pa
ymentd/9198452472199751001

16758.00 16807.13 4378

18-03-2026
UPI/P2M/644329448132/REKHA SHAW
/UPI/YES BANK LIMITED YBS 25.00 16782.13 4378"""
MORE = """Page 2 of 2
27-03-2026
SELF CASH DEP
BNA/DPRH487201/6809/270326/NARAYAN
15500.00 32282.13 4378
a line that belongs to nothing
28-03-2026 left without money
07-04-2026
NEFT/YESIG60970213984/KALIMATA
40007.00 72289.13 248
TRANSACTION TOTAL 25.00 72265.00
Closing Balance: 72,289.13"""


def test_several_lines_over_pages(spark):
    read = statement(spark, AXIS, MORE)
    t = lines.transactions(lines.drafts(read))
    got = [(r["type"], float(r["amount"]), float(r["balance"]), r["page"], r["branch"], r["continuous"]) for r in t.orderBy("seq").collect()]
    assert got == [("CREDIT", 16758, 16807.13, 1, "4378", True), ("DEBIT", 25, 16782.13, 1, "4378", True), ("CREDIT", 15500, 32282.13, 2, "4378", True), ("CREDIT", 40007, 72289.13, 2, "248", True)]
    first = t.orderBy("seq").first()
    assert first["description"] == "IMPS/P2A/607717366683/IdfFinan/IDFCBank/Paymentd/9198452472199751001" and first["d"] == datetime.date(2026, 3, 18)
    assert [(r["page"], r["date_text"]) for r in lines.fragments(lines.drafts(read)).collect()] == [(2, "28-03-2026")]
    r = lines.report(lines.drafts(read)).first()
    assert (float(r["opening_balance"]), float(r["closing_balance"]), r["n"], r["dropped"], r["verified"]) == (49.13, 72289.13, 4, 1, True)


def test_whole_rows_in_one_line(spark):
    usd = """Beginning Balance: $5,000.00
Date | Transaction Details | Debit | Credit | Balance
02 Aug 2026 Direct Deposit Payroll $3,200.00 $8,200.00
105 Aug 2026 Online Wire Transfer $1,500.00 $6,700.00
3 12 Aug 2026 Merchant Purchase Coffee $15.50 $6,684.50
3 12 Aug 2026 Merchant Purchase Coffee $15.50 $6,684.50
Ending Balance: $6,684.50"""
    read = statement(spark, usd)
    t = lines.transactions(lines.drafts(read))
    assert [(r["d"].day, r["type"], float(r["amount"])) for r in t.orderBy("seq").collect()][:3] == [(2, "CREDIT", 3200), (5, "DEBIT", 1500), (12, "DEBIT", 15.5)]
    r = lines.report(lines.drafts(read)).first()
    assert (float(r["opening_balance"]), float(r["closing_balance"])) == (5000, 6684.5)


def test_headings_by_place(spark):
    header = "Date      Narration      Withdrawal  Deposit   Closing Bal"
    row = spark.createDataFrame([(header, "01/02/26  shop 12        5.00                      95.00"), ("Description only", "x")], "h string, v string").withColumn("p", lines.heading_places(F.col("h")))
    got = row.select(*[lines.sliced(F.col("v"), F.col("p"), n).alias(n) for n in ("date", "particulars", "debit", "credit", "balance")], "p").collect()
    assert tuple(got[0])[:5] == ("01/02/26", "shop 12", "5.00", "", "95.00") and got[1]["p"] is None
    assert got[0]["p"]["debit"].asDict() == {"start": 25, "end": 35}


@pytest.mark.parametrize("size", [1, 3, 64, 10_000])
def test_blocks_give_what_one_pass_gives(spark, size):
    rng = random.Random(size)
    rows = [(doc, place, rng.choice([None, rng.randrange(9)]), rng.randrange(4)) for doc in range(6) for place in sorted(rng.sample(range(300), 120 * (doc > 0) + 1))]
    table = [[rng.randrange(5) for _ in range(5)] for _ in range(4)]
    want, state = {}, {}
    for doc, place, v, move in rows:
        total, last, s = state.get(doc, (0, None, 0))
        total, last = total + (v or 0), v if v is not None else last
        want[doc, place] = (total, last, s)
        state[doc] = (total, last, table[move][s])
    frame = spark.createDataFrame(rows, "doc long, place long, v long, move int").repartition(4)
    steps = F.array(*[F.array(*map(F.lit, t)) for t in table])
    got = blocks.transducer(frame, "doc", "place", 5, lambda s, r: F.get(F.get(steps, r["move"]), s), {"total": lambda s, r: F.coalesce(r["v"], F.lit(0))}, {"last": ("long", lambda s, r: r["v"])}, size=size).collect()
    assert {(r["doc"], r["place"]): (r["total"], r["last"], r["before"]) for r in got} == want


def test_amounts_of_drafts(spark):
    """A general amount typed by the balance before, one inside the narration, and a misread digit; a draft without money goes."""
    day = datetime.date(2026, 8, 1)
    raw = [(day, "salary", "", "100.00", "", "1,100.00"), (day, "shop", "", "", "30.00", "1,070.00"), (day, "wire 20.00 sent", "", "", "", "1,090.00"), (day, "nothing", "", "", "", ""), (day, "fee", "18.00", "", "", "1,080.00"), (day, "x", "19.00", "", "", "1,070.00")]
    rows = [(1, i, d, t, dr, cr, am, bal) for i, (d, t, dr, cr, am, bal) in enumerate(raw)]
    made = layout.reconstruct(spark.createDataFrame(rows, "doc_id long, seq long, d date, description string, debit_raw string, credit_raw string, amount_raw string, balance_raw string"))
    t = layout.finalize(made).orderBy("segment").collect()
    assert [(r["type"], r["amount"], r["corrected"]) for r in t] == [("CREDIT", 100, False), ("DEBIT", 30, False), ("CREDIT", 20, False), ("DEBIT", 10, True), ("DEBIT", 10, True)]
    pages = layout.audit_pages(made, layout.finalize(made)).first()
    assert (pages["candidates"], pages["accepted_date_row"], pages["transactions"]) == (6, 6, 5)
