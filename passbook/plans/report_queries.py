"""Queries over narrations, pages and reports, and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import narration as N
from ..functions import text as T
from ..operators import reports
from ..sources import ledgers
from ..sources.tables import customers
from . import sql as S
from .document_queries import PAGE_SQL
from .ledger_queries import shown
from .sql import dbl


def _merged(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_custkey").cast("string")
    forms = [F.array(F.lit("UPI/P2M/Pa"), F.lit("ymentd/"), k), F.array(F.lit("ref "), F.lit("/x/"), F.lit("/y")), F.array(F.lit("KVPL-"), k), F.array(F.lit(" a  b "), F.lit(""), F.lit("C")), F.array(F.lit(" "))]
    return o.select("o_orderkey", N.merged(F.get(F.array(*forms), (F.col("o_orderkey") % 5).cast("int"))).alias("narration"))


def _words(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", N.payment_words(F.concat_ws(" ", "text", F.when(F.col("turn") % 2 == 0, "upi transfer"), F.when(F.col("turn") % 3 == 0, "Rev-UPI"))).alias("payment_words"), N.native_sufficient(F.col("text")).alias("native_sufficient"))


def _headings(spark, sf_dir):
    h = F.array(*[F.lit(x) for x in ("Tran Date", "Particulars", "Chq / Ref No", "Withdrawal (Dr)", "Paid in", "Closing Balance", "Amount (INR)", "C/D", "foo")])
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    near = N.nearest_column((k % 100).cast("double"), F.lit(20.0), F.when(k % 7 != 0, F.lit(50.0)), F.when(k % 5 != 0, F.lit(80.0)))
    return p.select("p_partkey", N.heading(F.get(h, (k % 9).cast("int"))).alias("heading"), near.alias("nearest"))


def _names(spark, sf_dir):
    e = ledgers.events(spark, sf_dir).select(T.category(F.col("description"), F.col("type")).alias("code"))
    both = e.unionByName(spark.range(1).select(F.lit("XX_01").alias("code")))
    return both.groupBy("code").agg(F.count("*").alias("n")).select("code", N.category_name(F.col("code")).alias("name"), "n")


def _holders(spark, sf_dir):
    c = customers(spark, sf_dir)
    k = F.col("c_custkey") % 5
    seg = F.lower("c_mktsegment")
    t = F.when(k == 0, F.concat(F.lit("Account holder: "), seg, F.lit(" KUMAR, address"))).when(k == 1, F.concat(F.lit("Mr. ravi "), seg, F.lit(", x"))).when(k == 2, "Customer name: Savings Account").when(k == 3, F.concat(F.lit("Customer Name - "), F.lit("A"), F.lit(","))).otherwise("nothing")
    return c.select("c_custkey", N.holder(t).alias("holder"))


def _pages(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    p = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("page"), F.when(F.col("q") % 3 == 0, "OCR").otherwise("NATIVE").alias("method"), (F.floor(F.col("q")) / 64).alias("confidence"), F.col("q").cast("long").alias("words"))
    return reports.extraction(p)


def _profiles(spark, sf_dir):
    """Documents of seven customers, each with all their profiles."""
    c = customers(spark, sf_dir).withColumn("doc_id", F.floor(F.col("c_custkey") / 7))
    a = c.select("doc_id", F.col("c_custkey").alias("acct"), (F.col("c_custkey") % 8).alias("pos"), F.substring("c_mktsegment", 1, 4).alias("connection"))
    return reports.account_profiles(a, c.select("doc_id", (F.col("c_custkey") % 7).alias("ord"), F.concat(F.lit("Bank of "), F.lower("c_mktsegment")).alias("bank"), F.col("c_name").alias("holder")))


def _document_profiles(spark, sf_dir):
    c = customers(spark, sf_dir).withColumn("doc_id", F.floor(F.col("c_custkey") / 10))
    a = c.select("doc_id", F.col("c_custkey").alias("acct"), (F.col("c_custkey") % 10).alias("pos"), F.substring("c_mktsegment", 1, 4).alias("connection"))
    p = c.select("doc_id", (F.lit(9) - F.col("c_custkey") % 10).alias("ord"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("Bank of "), F.lower("c_mktsegment"))).otherwise("Bank").alias("bank"), F.col("c_name").alias("holder"))
    return reports.account_profiles(a, p)


def _backfill(spark, sf_dir):
    led = ledgers.events(spark, sf_dir)
    k = F.col("acct") % 3
    money = lambda test, v: F.when(test, F.lit(v)).cast("decimal(18,2)")
    stated = led.select("acct").distinct().select("acct", F.when(k == 0, F.lit("2024-02-01").cast("date")).alias("from_date"), F.lit(None).cast("date").alias("to_date"), money(k == 1, 500).alias("opening"), money(k == 2, 900).alias("closing"))
    return shown(reports.backfill(led, stated))


def _routes(spark, sf_dir):
    c = customers(spark, sf_dir).select(F.col("c_custkey").alias("doc_id"), F.expr(PAGE_SQL).alias("raw_text"), (F.col("c_custkey") % 20).alias("words"))
    return reports.routes(c)


def _masked_map(spark, sf_dir):
    c = customers(spark, sf_dir)
    m = c.select("c_custkey", F.create_map(F.lit("Name"), "c_name", F.lit("segment"), "c_mktsegment").alias("m"))
    return reports.masked_map(m, "m").select("c_custkey", F.col("m")["Name"].alias("name"), F.col("m")["segment"].alias("segment"))


QUERIES = {
    "metadata_backfill": _backfill, "parser_route": _routes, "sensitive_map": _masked_map, "first_rows": lambda spark, sf_dir: reports.latest(ledgers.events(spark, sf_dir), 20).select("acct", "id", "seq"),
    "narration_merge": _merged, "payment_words": _words, "column_headings": _headings, "category_names": _names, "holder_names": _holders, "extraction_counts": _pages, "account_profiles": _profiles, "document_profiles": _document_profiles,
    "ledger_report": lambda spark, sf_dir: shown(reports.ledger_report(ledgers.events(spark, sf_dir))),
}

_NAMES = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.CATEGORY_NAMES.items()) + " ELSE 'Category (' || code || ')' END"
_HIT = " + ".join(rf"CAST(regexp_matches(x, '(^|[^\pL\pN_]){w}([^\pL\pN_]|$)', 'i') AS BIGINT)" for w in N.PAYMENT_WORDS)

ORACLE_SQL = {
    "metadata_backfill": f"""{S.EVENTS}, g AS (SELECT acct, acct % 3 AS k, arg_min(d, seq) AS d1, arg_max(d, seq) AS d2, arg_min(CASE WHEN type = 'CREDIT' THEN balance - credit ELSE balance + debit END, seq) AS ob, arg_max(balance, seq) AS cb, sum(credit - debit) AS net FROM led GROUP BY acct)
SELECT acct, CASE WHEN k = 0 THEN '2024-02-01' ELSE strftime(d1, '%Y-%m-%d') END AS from_date, strftime(d2, '%Y-%m-%d') AS to_date, {dbl('CASE k WHEN 1 THEN 500 WHEN 2 THEN 900 - net ELSE ob END')} AS opening_balance, {dbl('CASE k WHEN 1 THEN 500 + net WHEN 2 THEN 900 ELSE cb END')} AS closing_balance FROM g""",
    "parser_route": "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 8 = 0 THEN 'BANK_LINES' WHEN c_custkey % 20 >= 10 THEN 'COORDINATES' ELSE 'LINES' END AS route FROM customer",
    "sensitive_map": "SELECT c_custkey, '***' AS name, c_mktsegment AS segment FROM customer",
    "first_rows": f"{S.EVENTS} SELECT acct, id, seq FROM led WHERE seq <= 20",
    "narration_merge": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'UPI/P2M/Paymentd/' || o_custkey WHEN 1 THEN 'ref/x/y' WHEN 2 THEN 'KVPL-' || o_custkey WHEN 3 THEN 'a b C' ELSE 'Bank Transaction' END AS narration FROM orders",
    "payment_words": rf"WITH c AS (SELECT conv_id, turn, text, concat_ws(' ', text, CASE WHEN turn % 2 = 0 THEN 'upi transfer' END, CASE WHEN turn % 3 = 0 THEN 'Rev-UPI' END) AS x FROM conversations) SELECT conv_id, turn, {_HIT} AS payment_words, length(text) >= 50 AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: length(w) > 1)) >= 6 AS native_sufficient FROM c",
    "column_headings": """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'DATE' WHEN 1 THEN 'DESCRIPTION' WHEN 2 THEN 'REFERENCE' WHEN 3 THEN 'DEBIT' WHEN 4 THEN 'CREDIT' WHEN 5 THEN 'BALANCE' WHEN 6 THEN 'AMOUNT' WHEN 7 THEN 'DR_CR' END AS heading,
  CASE WHEN p_partkey % 7 = 0 THEN 'UNKNOWN' WHEN p_partkey % 5 <> 0 AND abs(p_partkey % 100 - 80) < abs(p_partkey % 100 - 20) AND abs(p_partkey % 100 - 80) < abs(p_partkey % 100 - 50) THEN 'BALANCE' WHEN abs(p_partkey % 100 - 20) < abs(p_partkey % 100 - 50) THEN 'DEBIT' ELSE 'CREDIT' END AS nearest FROM part""",
    "category_names": f"{S.EVENTS}, c AS (SELECT {S.CODE} AS code FROM led UNION ALL SELECT 'XX_01') SELECT code, {_NAMES} AS name, count(*) AS n FROM c GROUP BY code",
    "holder_names": "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN upper(left(c_mktsegment, 1)) || lower(substring(c_mktsegment, 2)) || ' Kumar' WHEN 1 THEN 'Ravi ' || upper(left(c_mktsegment, 1)) || lower(substring(c_mktsegment, 2)) END AS holder FROM customer",
    "extraction_counts": "WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k FROM p) SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE q % 3 = 0) AS scanned, count(*) FILTER (WHERE q % 3 <> 0) AS native, round(avg(floor(q) / 64), 4) AS confidence, bool_and(page = k) AS page_sequence_valid, count(*) FILTER (WHERE CAST(q AS BIGINT) >= 10) >= 1 AS has_geometry FROM k GROUP BY doc_id",
    "account_profiles": """WITH c AS (SELECT *, c_custkey // 7 AS doc_id FROM customer), n AS (SELECT doc_id, c_custkey % 7 AS ord, 'Bank of ' || lower(c_mktsegment) AS bank, c_name AS holder FROM c), a AS (SELECT doc_id, c_custkey AS acct, c_custkey % 8 AS pos, substring(c_mktsegment, 1, 4) AS connection FROM c
), m AS (SELECT doc_id, acct, arg_min(bank, ord) AS bank, arg_min(holder, ord) AS holder FROM a JOIN n USING (doc_id) WHERE contains(bank, lower(connection)) GROUP BY ALL) SELECT a.doc_id, a.acct, connection, coalesce(m.bank, n.bank, '') AS bank, coalesce(m.holder, n.holder, '') AS holder FROM a LEFT JOIN m ON a.doc_id = m.doc_id AND a.acct = m.acct LEFT JOIN n ON a.doc_id = n.doc_id AND pos = ord""",
    "document_profiles": """WITH c AS (SELECT *, c_custkey // 10 AS doc_id FROM customer), n AS (SELECT doc_id, 9 - c_custkey % 10 AS ord, CASE WHEN c_custkey % 3 > 0 THEN 'Bank of ' || lower(c_mktsegment) ELSE 'Bank' END AS bank, c_name AS holder FROM c), a AS (SELECT doc_id, c_custkey AS acct, c_custkey % 10 AS pos, substring(c_mktsegment, 1, 4) AS connection FROM c
), m AS (SELECT doc_id, acct, arg_min(bank, ord) AS bank, arg_min(holder, ord) AS holder FROM a JOIN n USING (doc_id) WHERE contains(bank, lower(connection)) GROUP BY ALL) SELECT a.doc_id, a.acct, connection, coalesce(m.bank, n.bank, '') AS bank, coalesce(m.holder, n.holder, '') AS holder FROM a LEFT JOIN m ON a.doc_id = m.doc_id AND a.acct = m.acct LEFT JOIN n ON a.doc_id = n.doc_id AND pos = ord""",
    "ledger_report": f"""{S.EVENTS}, w AS (SELECT *, abs(last_value(balance IGNORE NULLS) OVER (PARTITION BY acct ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + credit - debit - balance) AS gap, lag(row(d, amount, balance, description, type)) OVER (PARTITION BY acct ORDER BY seq) = row(d, amount, balance, description, type) AS rep FROM led
), g AS (SELECT acct, arg_min(CASE WHEN type = 'CREDIT' THEN balance - credit ELSE balance + debit END, seq) AS ob, sum(credit) AS cr, sum(debit) AS dr, arg_max(balance, seq) AS bn, count(*) AS n, count(*) FILTER (WHERE credit > 0) AS nc, count(*) FILTER (WHERE debit > 0) AS nd, count(*) FILTER (WHERE coalesce(gap <= 0.01, true)) AS cp, count(*) FILTER (WHERE gap > 0.01) AS cf, count(*) FILTER (WHERE credit = 0 AND debit = 0) AS nn, count(*) FILTER (WHERE rep) AS du FROM w GROUP BY acct)
SELECT acct, {dbl('ob')} AS opening_balance, {dbl('cr')} AS total_credits, {dbl('dr')} AS total_debits, {dbl('ob + cr - dr')} AS calculated_closing, {dbl('bn')} AS closing_balance, {dbl('abs(ob + cr - dr - bn)')} AS difference, abs(ob + cr - dr - bn) <= 0.01 AS verified, n AS transaction_count, nc AS credit_count, nd AS debit_count, cp AS continuity_passed, cf AS continuity_failed, nn AS neither_side, CAST(0 AS BIGINT) AS both_sides, du AS duplicates, cf AS suspicious, {dbl('cr')} AS calculated_credits, {dbl('dr')} AS calculated_debits, {dbl('bn')} AS stated_closing FROM g""",
}
