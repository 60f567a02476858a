"""Plans that hold at size: nothing whole goes to every task, and small files are dealt out before their rows become texts."""

import re

import pytest
from pyspark.sql import functions as F

from passbook.operators import headers, labels, layout, lines, reports, signals
from passbook.plans import catalogue
from passbook.sources import tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_holders_send_no_pages_to_all_tasks(spark):
    pages = spark.createDataFrame([(1, 1, "Account holder: asha rao, x"), (2, 1, "nothing"), (2, 2, "more"), (3, 1, "nothing")], "doc_id long, page long, raw_text string")
    tokens = spark.createDataFrame([(1, 1, 1, "no", 20.0, 150.0), (2, 2, 1, "ravi", 50.0, 10.0), (2, 1, 2, "anil", 20.0, 150.0), (3, 1, 1, "kumar", 60.0, 152.0), (3, 1, 2, "meera", 20.0, 150.0)], "doc_id long, page long, tok long, text string, x0 double, y0 double")
    out = labels.holder_names(pages, tokens)
    assert "Broadcast" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, "Asha Rao", "LABEL"), (2, "Ravi", "RUNNING_HEADER"), (3, "Meera Kumar", "CUSTOMER_BLOCK")]


@pytest.mark.parametrize("name", ["document_signals", "account_fields", "stated_balances"])
def test_customers_are_dealt_out(spark, sf_dir, name):
    assert "REPARTITION_BY_NUM" in plan(catalogue.QUERIES[name](spark, sf_dir))


def test_first_bank_by_one_search(spark):
    texts = ["paid to chase bank, bob", "Punjab & Sind Bank", "South Indian Bank", "indian bank", "union bank of india", "bank of  india", "psbx hdfcbank SBI", "uco", "none", "", "the sbi card of axis", "city union bank; citi bank", "J&K Bank", "State Bank of Indiana, rbl", None]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(signals.first_bank(F.col("t")).alias("b"))
    slow = lambda t: min(((m.start(), k, n) for k, (n, p) in enumerate(signals.BANKS) if (m := re.search(p, t))), default=(0, 0, None))[2] if t else None
    assert [r["b"] for r in found.collect()] == [slow(t) for t in texts]
    assert len(re.findall("regexp_extract", plan(found))) == 1 and "regexp_instr" not in plan(found)


def test_balances_by_one_grouping(spark):
    rows = [(1, 1, "opening balance 5.00", ""), (1, 2, "x", ""), (1, 3, "closing balance: 7.00", ""), (2, 1, "a", "opening balance 9.00"), (2, 2, "Savings Account: 1.00 2.00", ""), (2, 3, "b", ""), (3, 1, "a", ""), (3, 2, "b/f 4.00 closing balance 3.00 total credits 6.00", ""), (3, 3, None, "")]
    out = labels.stated_balances(spark.createDataFrame(rows, "doc_id long, page long, raw_text string, summary string"))
    assert "Join" not in plan(out)
    told = {r["doc_id"]: tuple(str(r[c]) for c in ("opening_balance", "opening_level", "closing_balance", "closing_level", "stated_credits", "stated_credits_level", "stated_debits")) for r in out.collect()}
    assert told == {1: ("5.00", "PAGE_ONE", "7.00", "LAST", "None", "None", "None"), 2: ("9.00", "PAGE_ONE", "2.00", "PAIR", "None", "None", "None"), 3: ("4.00", "ALL", "3.00", "ALL", "6.00", "ALL", "None")}


def test_columns_travel_as_rows(spark):
    tokens = spark.createDataFrame([(1, 1, 1, 0.0, 10.0), (1, 1, 2, 40.0, 60.0), (1, 1, 3, 90.0, 99.0), (2, 1, 4, 0.0, 10.0), (None, 1, 5, 0.0, 10.0)], "doc_id long, page long, tok long, x0 double, x1 double")
    columns = spark.createDataFrame([(1, 1, 1, "B", 0.0, 50.0), (1, 1, 0, "A", 0.0, 5.0), (1, 1, 2, "C", 50.0, 80.0), (3, 1, 0, "Z", 0.0, 99.0), (None, 1, 0, "Z", 0.0, 99.0)], "doc_id long, page long, ord int, name string, x0 double, x1 double")
    out, bare = layout.assign_columns(tokens, columns), layout.assign_columns(tokens, columns, default=None)
    assert "Join" not in plan(out) and out.columns == [*tokens.columns, "column"]
    assert sorted((r["tok"], r["column"]) for r in out.collect()) == [(1, "A"), (2, "B"), (3, "DESCRIPTION"), (4, "DESCRIPTION"), (5, "DESCRIPTION")]
    assert sorted((r["tok"], r["column"]) for r in bare.collect()) == [(1, "A"), (2, "B")]


@pytest.mark.parametrize("name", ["column_bin", "column_assign"])
def test_items_are_dealt_out_in_bounded_parts(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(tables, "ROWS", 100)
    n = -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 100)
    assert f", {n})" in re.search(r"hashpartitioning\(l_orderkey#\d+L, \d+\), REPARTITION_BY_NUM", plan(catalogue.QUERIES[name](spark, sf_dir))).group().replace("), REPARTITION_BY_NUM", ")")


def test_headers_without_a_self_join(spark):
    rows = [(1, 1, 1, "Date", 0.0, 10.0, 40.0, 19.0), (1, 1, 2, "Particulars", 60.0, 12.0, 100.0, 21.0), (1, 1, 3, "Balance", 120.0, 10.0, 160.0, 19.0), (1, 1, 4, "shop", 0.0, 30.0, 40.0, 39.0)]
    tokens = spark.createDataFrame(rows, "doc_id long, page long, tok long, text string, x0 double, y0 double, x1 double, y1 double")
    out = headers.page_headers(tokens)
    assert "Join" not in plan(out)
    found = out.first()
    assert [c["name"] for c in found["columns"]] == ["DATE", "DESCRIPTION", "BALANCE"] and found["raw_text"] == "Date Particulars Balance"


@pytest.fixture
def settled(spark):
    """Plans as they are run, with reused shuffles."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("name", ["ledger_drafts", "line_actions", "line_report", "parser_chain"])
def test_rows_of_an_automaton_are_made_once(spark, sf_dir, settled, name):
    """The tables of blocks and the walk through them share one shuffle; what a first parser found is read back, not found again."""
    p = plan(catalogue.QUERIES[name](spark, sf_dir))
    assert len(re.findall(r"Window \[row_number\(\) windowspecdefinition\(acct", p)) == 1 and "ReusedExchange" in p


def test_first_parser_reads_documents_without_print(spark):
    """Documents need not be in both sources; those without id are in no result."""
    rows = spark.createDataFrame([(1, 1, "a", "5.00"), (3, 1, "b", ""), (None, 1, "c", "6.00")], "doc_id long, seq long, description string, debit_raw string").selectExpr("*", "date'2024-01-02' as d", "'' as credit_raw", "'' as balance_raw")
    printed = spark.createDataFrame([(2, 1, "01-02-2024 shop 5.00 95.00"), (3, 1, "01-02-2024 shop 7.00 93.00"), (None, 1, "01-02-2024 shop 8.00 92.00")], "doc_id long, seq long, line string").selectExpr("*", "1L as page")
    out = reports.parsed(rows, printed)
    assert sorted((r["doc_id"], str(r["amount"]), r["level"]) for r in out.collect()) == [(1, "5.00", "COORDINATES"), (2, "5.00", "LINES"), (3, "7.00", "LINES")]


def test_open_drafts_pass_beside_the_report(spark):
    """Transactions never closed change no balance and are no repeat, but what their lines state counts, also where nothing was closed."""
    said = ["Opening Balance: 100.00", "01-02-2024 lost one", "02-02-2024 shop 5.00 95.00", "02-02-2024 shop 5.00 95.00", "03-02-2024 rent", "Closing Balance: 90.00"]
    rows = [(1, i, s) for i, s in enumerate(said, 1)] + [(2, 1, "03-02-2024 rent"), (2, 2, "Closing Balance: 7.00"), (3, 1, "nothing")]
    r = lines.report(lines.drafts(lines.read_lines(spark.createDataFrame(rows, "doc_id long, seq long, line string").selectExpr("*", "1L as page"))))
    assert "Join" not in plan(r).split("__told")[0]
    names = ("doc_id", "opening_balance", "closing_balance", "debits", "n", "dropped", "verified")
    assert sorted(tuple(float(x[c]) for c in names) for x in r.collect()) == [(1, 100, 90, 5, 1, 1, 0), (2, 0, 7, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0, 1)]
