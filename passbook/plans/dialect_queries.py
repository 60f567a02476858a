"""Queries of the second dialect and of what readers are shown, and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.narration import PAYMENT_WORDS
from ..operators import signals, views
from ..sources import ledgers
from ..sources.tables import customers
from . import sql as S
from .ledger_queries import shown
from .sql import dbl, hit

#: Texts that both engines put together, by customer: heads, fields, rows and other kinds of documents in many combinations.
_C = "CAST(c_custkey AS VARCHAR(20))"
_BANK = "CASE c_custkey % 7 WHEN 0 THEN 'HDFC Bank and later SBI' WHEN 1 THEN 'statement with Axis' WHEN 2 THEN 'Gramin Bank' WHEN 3 THEN 'e-statement' WHEN 4 THEN 'paid to chase bank, bob' WHEN 5 THEN 'Tax Invoice' ELSE 'hello' END"
_FIELDS = f"CASE c_custkey % 5 WHEN 0 THEN concat('IFSC UTIB0', lpad({_C}, 6, '0')) WHEN 1 THEN concat('A/C No: XXXX', lpad({_C}, 6, '7'), ' swift') WHEN 2 THEN 'savings account, customer id' WHEN 3 THEN 'period from 01/08/2026 to 31-Aug-2026' ELSE 'summary of 3 Aug 2026' END"
_TABLE = "CASE c_custkey % 4 WHEN 0 THEN 'Date Particulars Debit Credit Balance' WHEN 1 THEN 'value date bal' WHEN 2 THEN 'opening balance' ELSE '' END"
_ROWS = "repeat(concat('05-08-2026 UPI/NEFT shop 12.50 99.00', chr(10)), CAST(c_custkey % 6 AS INT))"
_OTHER = "CASE c_custkey % 11 WHEN 0 THEN 'payslip' WHEN 1 THEN 'UIDAI and mera aadhaar' WHEN 2 THEN 'electricity bill, policy schedule' WHEN 3 THEN 'income tax department' ELSE '' END"
TEXT = f"CASE WHEN c_custkey % 13 = 0 THEN '  short ' ELSE concat({_BANK}, chr(10), {_FIELDS}, chr(10), {_TABLE}, chr(10), {_ROWS}, {_OTHER}) END"


def texts(spark, sf_dir) -> DataFrame:
    return customers(spark, sf_dir).select(F.col("c_custkey").alias("doc_id"), F.expr(TEXT.replace("VARCHAR(20)", "STRING")).alias("raw_text"))


def _signals(spark, sf_dir):
    return shown(signals.score(texts(spark, sf_dir)))


def _months(spark, sf_dir):
    """Orders by month; customers without orders by what their statement says."""
    c = customers(spark, sf_dir)
    m = lambda c: c.cast("decimal(18,2)")
    stated = c.select(F.col("c_custkey").alias("acct"), F.when(F.col("c_custkey") % 2 == 0, F.lit("2026-03-04").cast("date")).alias("start"), m(F.col("c_custkey")).alias("credits"), m(F.lit(7.5)).alias("debits"), m(F.col("c_acctbal")).alias("opening"), m(F.lit(100)).alias("closing"))
    return shown(views.months(ledgers.orders(spark, sf_dir), stated))


def _kinds(spark, sf_dir):
    words = ["salary account", "current a/c and overdraft", "OD account", "Savings", "CA a/c", "checking", "overdraft of a saving account", "none"]
    t = F.get(F.array(*map(F.lit, words)), (F.col("c_custkey") % len(words)).cast("int"))
    c = customers(spark, sf_dir).select("c_custkey", F.concat_ws(" ", t, "c_mktsegment").alias("text"))
    return c.select("c_custkey", views.account_type(F.col("text")).alias("by_bank"), views.account_type_by_header(F.col("text")).alias("by_header"))


def _subjects(spark, sf_dir):
    led = ledgers.events(spark, sf_dir).withColumn("description", F.when(F.col("id") % 500 == 0, F.lit("paid GSTIN 5")).when(F.col("id") % 700 == 0, F.lit("invoice 7")).otherwise(F.col("description")))
    a = led.select("acct").distinct().select("acct", F.concat(F.lit("XXXX"), F.col("acct").cast("string")).alias("masked"), F.when(F.col("acct") % 2 == 0, "Savings").otherwise("Current").alias("kind"))
    return views.subjects(led, a)


def _profiles(spark, sf_dir):
    c = customers(spark, sf_dir)
    some = lambda m, v: F.when(F.col("c_custkey") % m == 0, v).when(F.col("c_custkey") % m == 1, F.lit(""))
    named = [some(2 + k, F.concat(F.lit(n), F.col("c_name"))).alias(n) for k, n in enumerate(("name", "account", "bank", "ifsc", "type"))] + [some(5 + k, F.concat(F.lit(f"p_{n}"), F.col("c_name"))).alias(f"p_{n}") for k, n in enumerate(("name", "account", "bank", "ifsc", "type"))]
    return views.profile(c.select(F.col("c_custkey").alias("doc_id"), *named))


def _recurring(spark, sf_dir):
    led = ledgers.events(spark, sf_dir).where("type = 'CREDIT'")
    s = led.groupBy("acct").agg(F.max("seq").alias("top"), F.sort_array(F.collect_list("id")).alias("matched")).select("acct", F.when(F.col("acct") % 2 == 0, "RE_05").otherwise("RE_07").alias("category"), F.when(F.col("acct") % 3 == 0, F.col("top")).when(F.col("acct") % 3 == 1, F.lit(0).cast("long")).alias("matched_count"), F.when(F.col("acct") % 5 != 0, F.col("matched")).alias("matched"))
    return views.recurring_view(s)


def _overview(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    return shown(views.overview(o.select(k.alias("acct"), F.when(k % 3 == 0, "YELLOW").when(k % 3 == 1, "GREEN").alias("status"), (k % 5 == 0).alias("continuous"), F.when(k % 7 > 0, (k % 1000) / 1000.0).alias("confidence"), (F.col("o_totalprice") % 0.04).cast("decimal(18,2)").alias("difference"))))


def _responses(spark, sf_dir):
    led = ledgers.events(spark, sf_dir)
    stated = led.where("acct % 2 = 0").groupBy("acct").agg(F.max("balance").alias("closing"), F.max("credit").alias("credits"), F.lit(None).cast("decimal(18,2)").alias("debits"))
    return views.response(led, stated).select("acct", "response.success", "response.data.summary.openingBalance", "response.data.summary.statedClosingBalance", "response.data.summary.statementStatedCredits", "response.data.summary.statementStatedDebits", "response.data.summary.totalTransactions", "response.data.summary.netCashFlow", F.col("response.data.summary.total_debits").alias("total_debits"))


QUERIES = {"risk_alt": lambda spark, sf_dir: shown(views.risk(ledgers.orders(spark, sf_dir).unionByName(ledgers.events(spark, sf_dir).withColumn("acct", F.col("acct") + 1_000_000)))), "document_signals": _signals, "monthly_cash_flow_alt": _months, "account_kinds": _kinds, "subjects": _subjects, "profile_view": _profiles, "recurring_view": _recurring, "overview": _overview, "response_summary": _responses}

_has = lambda k: hit("t", signals.SIGNALS[k])
_at = lambda p: "length(regexp_extract(t, '(?is)^(.*?)" + p.removeprefix("(?i)") + "', 1))"
_FIRST = "list_sort(list_filter([" + ", ".join(f"{{'at': CASE WHEN {hit('t', p)} THEN {_at(p)} END, 'k': {k}, 'name': '{n}'}}" for k, (n, p) in enumerate(signals.BANKS)) + "], lambda b: b.at IS NOT NULL))[1].name"
_WORDS = " + ".join(rf"CAST(regexp_matches(t, '(?i)\b{w}\b') AS INT)" for w in PAYMENT_WORDS)
_SEEN = "list_filter([" + ", ".join(f"CASE WHEN {hit('t', p)}{' AND NOT ledger' if any(w in n for w in signals.IN_LEDGERS) else ''} THEN {{'n': '{n}', 'w': {w}}} END" for n, p, w in signals.AGAINST) + "], lambda a: a IS NOT NULL)"


def _js(x: str, scale: int = 100) -> str:
    return f"floor(({x}) * {scale} + 0.5) / {scale}"


def _mean(total: str, n: str) -> str:
    """Mean of money in whole cents, ties up: floor((2 total + n) / 2 n) in whole numbers."""
    a, b = f"(2 * CAST(({total}) * 100 AS BIGINT) + {n})", f"(2 * {n})"
    return f"(({a} - ({a} % {b} + {b}) % {b}) // {b}) / 100.0::DOUBLE"


_some = lambda m, v: f"CASE c_custkey % {m} WHEN 0 THEN {v} WHEN 1 THEN '' END"
_profile = lambda k, n, word: f"coalesce(nullif({_some(2 + k, chr(39) + n + chr(39) + ' || c_name')}, ''), nullif({_some(5 + k, chr(39) + 'p_' + n + chr(39) + ' || c_name')}, ''), '{word}') AS {n}"
def _risk(base: str, shift: int) -> str:
    """Figures of one ledger; shares of a month in whole cents, ties up."""
    test = {"emi": f"type = 'DEBIT' AND {hit('lower(description)', views.INSTALMENT)}", "cash": f"type = 'DEBIT' AND ({S.MODE_ALT} = 'ATM' OR {hit('lower(description)', views.CASH)})", "returned": hit("lower(description)", views.RETURNED)}
    sums = ", ".join(f"coalesce(sum(amount) FILTER ({t}), 0) AS {k}_t, count(*) FILTER ({t}) AS {k}_n" for k, t in test.items())
    monthly = lambda c: f"((2 * {c} * 30 + m) // (2 * m)) / 100.0::DOUBLE"
    shown_ = ", ".join(f"{monthly(f'CAST({k}_t * 100 AS BIGINT)')} AS {k}_monthly, {dbl(f'{k}_t')} AS {k}_total, {k}_n AS {k}_count" for k in test)
    return f"""SELECT acct + {shift} AS acct, CASE WHEN inc > 0 THEN ((2 * CAST(emi_t * 100 AS HUGEINT) * 100 + CAST(inc * 100 AS HUGEINT)) // (2 * CAST(inc * 100 AS HUGEINT))) / 100.0::DOUBLE ELSE 0.0 END AS income_ratio, {monthly('cash_n * 100')} AS cash_regularity, {shown_}
FROM ({base} SELECT acct, sum(credit) AS inc, greatest(30, coalesce(nullif(abs(max(d) - min(d)), 0), 30)) AS m, {sums} FROM led GROUP BY acct)"""


ORACLE_SQL = {
    "risk_alt": f"{_risk(S.ORDERS, 0)} UNION ALL {_risk(S.EVENTS, 1_000_000)}",
    "document_signals": f"""WITH x AS (SELECT c_custkey AS doc_id, trim({TEXT}) AS t FROM customer
), y AS (SELECT *, {_FIRST} AS bank, {_WORDS} AS words, len(regexp_extract_all(t, '{signals.SIGNALS['row']}')) AS rows, {_has('date_column')} AND {_has('text_column')} AND ({_has('amount_column')} OR {_has('balance_column')}) AS cols FROM x
), z AS (SELECT *, CASE WHEN bank IS NOT NULL THEN 20 WHEN {_has('bank_word')} THEN 12 WHEN {_has('statement_word')} THEN 10 ELSE 0 END AS b, CASE WHEN {_has('ifsc')} THEN 10 WHEN {_has('routing')} THEN 6 ELSE 0 END + CASE WHEN {_has('account')} THEN 10 WHEN {_has('account_word')} THEN 7 ELSE 0 END AS a, CASE WHEN {_has('period')} THEN 15 WHEN {_has('period_word')} AND {_has('day')} THEN 12 ELSE 0 END AS p,
  CASE WHEN cols AND rows >= 3 THEN 25 WHEN cols OR rows >= 4 THEN 20 WHEN rows >= 1 OR ({_has('date_column')} AND {_has('balance_column')}) THEN 12 ELSE 0 END AS tb, CASE WHEN {_has('stated')} THEN 6 ELSE 0 END + CASE WHEN {_has('sides')} THEN 6 ELSE 0 END + CASE WHEN {_has('balance')} THEN 3 ELSE 0 END AS f, CASE WHEN words >= 2 THEN 5 WHEN words = 1 THEN 3 ELSE 0 END AS w FROM y
), l AS (SELECT *, tb >= 15 AND f >= 9 AND (b >= 10 OR a >= 7 OR words >= 2) AS ledger FROM z
), n AS (SELECT *, {_SEEN} AS seen FROM l
), s AS (SELECT *, coalesce(list_sum(list_transform(seen, lambda v: v.w)), 0) AS pen FROM n
), r AS (SELECT *, greatest(0, least(100, b + a + p + tb + f + w - pen)) AS total, length(t) >= 10 AS ok FROM s)
SELECT doc_id, CASE WHEN ok THEN bank END AS bank, """
    + ", ".join(f"CAST(CASE WHEN ok THEN {v} ELSE 0 END AS BIGINT) AS {k}" for k, v in [*zip(signals.WEIGHTS, ("b", "a", "p", "tb", "f", "w"), strict=True), ("penalty", "pen"), ("total", "total")])
    + """, CASE WHEN ok THEN array_to_string(list_transform(seen, lambda v: v.n), ', ') ELSE '' END AS against, CASE WHEN ok THEN total ELSE 0 END / 100.0::DOUBLE AS confidence,
  CASE WHEN NOT ok THEN 'UNREADABLE' WHEN pen >= 50 OR (pen > 0 AND total < 25) THEN 'NOT_BANK_STATEMENT' WHEN total >= 50 OR (pen = 0 AND tb >= 15 AND (f >= 6 OR b >= 10 OR a >= 7)) THEN 'BANK_STATEMENT' WHEN total >= 25 THEN 'UNCERTAIN' ELSE 'NOT_BANK_STATEMENT' END AS decision FROM r""",
    "monthly_cash_flow_alt": f"""{S.ORDERS}, m AS (SELECT acct, strftime(d, '%Y-%m') AS month, sum(credit) AS i, sum(debit) AS e, arg_min(balance, seq) AS o, arg_max(balance, seq) AS c, sum(balance) AS h, count(*) AS n, min(balance) AS lo FROM led GROUP BY ALL
), a AS (SELECT acct, month, i, e, o, c, {_mean('h', 'n')} AS avg_, lo FROM m UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '2026-03' ELSE '2025-01' END, c_custkey, 7.5, CAST(c_acctbal AS DECIMAL(18,2)), 100, {_mean('CAST(c_acctbal AS DECIMAL(18,2)) + 100', '2')}, least(CAST(c_acctbal AS DECIMAL(18,2)), 100) FROM customer WHERE c_custkey NOT IN (SELECT acct FROM led))
SELECT acct, month, {dbl('i')} AS income, {dbl('e')} AS expenses, {dbl('i - e')} AS saving, {dbl('o')} AS opening, {dbl('c')} AS closing, {dbl('avg_')} AS average, {dbl('lo')} AS minimum, CASE WHEN i > 0 THEN {_js('CAST(i - e AS DOUBLE) / CAST(i AS DOUBLE)')} ELSE 0.0 END AS saving_ratio FROM a""",
    "account_kinds": """WITH x AS (SELECT c_custkey, lower(list_extract(['salary account', 'current a/c and overdraft', 'OD account', 'Savings', 'CA a/c', 'checking', 'overdraft of a saving account', 'none'], CAST(1 + c_custkey % 8 AS BIGINT)) || ' ' || c_mktsegment) AS t FROM customer)
SELECT c_custkey, CASE WHEN regexp_matches(t, '\\b(current\\s+account|current\\s+a/c)\\b') THEN 'CURRENT' WHEN regexp_matches(t, '\\b(overdraft|od\\s+account|cash\\s+credit|cc\\s+account)\\b') THEN 'OVERDRAFT' WHEN regexp_matches(t, '\\b(salary\\s+account)\\b') THEN 'SALARY' ELSE 'SAVINGS' END AS by_bank,
  CASE WHEN regexp_matches(t, '\\b(savings|saving\\s+account|sb\\s+a/c)\\b') THEN 'SAVINGS' WHEN regexp_matches(t, '\\b(current\\s+account|ca\\s+a/c)\\b') THEN 'CURRENT' WHEN regexp_matches(t, '\\b(checking|checking\\s+account)\\b') THEN 'CHECKING' WHEN regexp_matches(t, '\\b(overdraft|od\\s+a/c)\\b') THEN 'OVERDRAFT' END AS by_header FROM x""",
    "subjects": f"""{S.EVENTS}, x AS (SELECT acct, lower(CASE WHEN id % 500 = 0 THEN 'paid GSTIN 5' WHEN id % 700 = 0 THEN 'invoice 7' ELSE description END) AS t FROM led)
SELECT acct, 'XXXX' || acct || '@finvu' AS subject_id, 'XXXX' || acct || '-' || CASE WHEN acct % 2 = 0 THEN 'savings' ELSE 'current' END AS account_id, bool_or(contains(t, 'gst')) AS sole_trader, bool_or(regexp_matches(t, '\\b(gst|trader|vendor|sales|invoice)\\b')) AS sole_trader_alt FROM x GROUP BY acct""",
    "profile_view": "SELECT c_custkey AS doc_id, " + ", ".join(_profile(k, n, w) for k, (n, w) in enumerate({"name": "Not detected", "account": "—", "bank": "Bank Statement", "ifsc": "—", "type": "SAVINGS"}.items())) + " FROM customer",
    "recurring_view": f"{S.EVENTS} SELECT acct, acct % 2 = 0 AS is_salary, CASE WHEN acct % 3 = 0 THEN max(seq) WHEN acct % 5 <> 0 THEN count(*) ELSE 0 END AS credits FROM led WHERE type = 'CREDIT' GROUP BY acct",
    "overview": f"""WITH x AS (SELECT o_orderkey AS k, CAST(o_totalprice % 0.04 AS DECIMAL(18,2)) AS df FROM orders), y AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'YELLOW' WHEN k % 3 = 1 THEN 'GREEN' WHEN k % 5 = 0 THEN 'GREEN' ELSE 'RED' END AS status FROM x)
SELECT k AS acct, status, CASE WHEN status = 'GREEN' THEN 'emerald' ELSE 'amber' END AS colour, CASE WHEN k % 7 > 0 THEN CAST(floor((k % 1000) / 1000.0::DOUBLE * 100 + 0.5) AS BIGINT) ELSE 0 END AS confidence_pct, CASE WHEN df > 0.01 THEN {dbl('df')} END AS difference FROM y""",
    "response_summary": f"""{S.EVENTS}, g AS (SELECT acct, arg_min(CASE WHEN type = 'CREDIT' THEN balance - credit ELSE balance + debit END, seq) AS ob, sum(credit) AS cr, sum(debit) AS dr, arg_max(balance, seq) AS bn, count(*) AS n, max(balance) AS mb, max(credit) AS mc FROM led GROUP BY acct), t AS (SELECT *, CAST(cr - dr AS DECIMAL(18,2)) AS net FROM g)
SELECT acct, true AS success, CAST(CAST(ob AS DECIMAL(18,2)) AS VARCHAR) AS openingBalance, CAST(CAST(CASE WHEN acct % 2 = 0 THEN mb ELSE bn END AS DECIMAL(18,2)) AS VARCHAR) AS statedClosingBalance, CASE WHEN acct % 2 = 0 THEN CAST(mc AS VARCHAR) END AS statementStatedCredits, CAST(NULL AS VARCHAR) AS statementStatedDebits, n AS totalTransactions, CAST(net AS VARCHAR) AS netCashFlow, CAST(CAST(dr AS DECIMAL(18,2)) AS VARCHAR) AS total_debits FROM t""",
}
