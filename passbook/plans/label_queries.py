"""Queries for account fields by labels and places, and parsers with fallback; and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields
from ..functions import narration as N
from ..operators import labels, reports
from ..sources.tables import customers, items
from . import layout_queries, line_queries
from .ledger_queries import shown
from .sql import dbl

WORDS = ["IFSC Code", "UTIB0001234", "A/C No", "912010045675012", "Account Holder", "Ravi", "Kumar", "Opening Balance", "Rs. 1,200.50", "B/F", "Closing Balance", "99.00", ":", "Branch", "c/f", "x"]
HEIGHT = 50.0


def tokens(spark, sf_dir) -> DataFrame:
    """A word a line item: a document a part, pages of four lines of three words."""
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    li = items(spark, sf_dir, "l_partkey").withColumn("tok", F.row_number().over(order).cast("long"))
    spot = (F.col("tok") - 1) % 12
    x, y = (spot % 3) * 130 + F.col("l_quantity") % 10, F.floor(spot / 3) * 12 + (F.col("l_suppkey") % 3) * 1.0
    text = F.get(F.array(*map(F.lit, WORDS)), ((F.col("l_suppkey") * 7 + F.col("l_linenumber") * 5 + F.col("tok")) % len(WORDS)).cast("int"))
    return li.select(F.col("l_partkey").alias("doc_id"), F.floor((F.col("tok") + 11) / 12).cast("long").alias("page"), "tok", text.alias("text"), x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 8 + (F.col("l_suppkey") % 2) * 2).alias("y1"), F.lit(HEIGHT).alias("height"))


def _fields(spark, sf_dir):
    return shown(labels.label_fields(tokens(spark, sf_dir)))


def _customers(spark, sf_dir):
    """Names of customers, some of which are none."""
    c = customers(spark, sf_dir)
    words, phrases = (F.array(*map(F.lit, x)) for x in (N.NOT_CUSTOMER_WORDS, N.NOT_CUSTOMERS))
    k = F.col("c_custkey")
    word, phrase = F.get(words, (k % len(N.NOT_CUSTOMER_WORDS)).cast("int")), F.get(phrases, (k % len(N.NOT_CUSTOMERS)).cast("int"))
    name = F.when(k % 7 == 0, F.concat(F.lit("Ravi"), word)).when(k % 7 == 1, F.concat(F.lit("Ravi, "), F.upper(word))).when(k % 7 == 2, F.concat(F.lit("the"), phrase, F.lit("s"))).when(k % 7 == 3, F.col("c_name")).when(k % 7 == 4, F.lower("c_mktsegment")).when(k % 7 == 5, F.lit(" ab ")).otherwise(F.concat(word, F.lit("-sharma")))
    return c.select("c_custkey", name.alias("name"), N.customer(name).alias("customer"), N.holder_candidate(name).alias("holder"))


def balance_pages(spark, sf_dir) -> DataFrame:
    """Statements of three pages with balances and totals at different places."""
    c = customers(spark, sf_dir)
    k, amount = F.col("c_custkey"), F.format_number(F.abs("c_acctbal"), 2)
    said = lambda test, label: F.when(test, F.concat(F.lit(label), amount)).otherwise("")
    one = F.concat_ws(" ", F.lit("Account"), said(k % 5 == 0, "Opening Balance: "), said(k % 5 == 1, "B/F "), said(k % 4 == 0, "Total Credits: "))
    two = F.concat_ws(" ", said(k % 5 == 2, "Opening balance "), said(k % 3 == 0, "Closing balance: "), F.when(k % 7 == 0, F.concat(F.lit("Savings Account (SA): "), amount, F.lit(" 10.64"))).otherwise(""), said(k % 4 == 1, "total dr. amount "))
    three = F.concat_ws(" ", said(k % 3 == 1, "Ending Balance = "), said(k % 11 == 0, "c/f: "), said(k % 4 < 2, "total debits "), F.lit("end"))
    region = said(k % 10 == 0, "opening balance 7")
    p = F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("page"), t.alias("raw_text"), (region if n == 1 else F.lit("")).alias("summary")) for n, t in enumerate((one, two, three), 1)]))
    return c.select(k.alias("doc_id"), p.alias("p")).select("doc_id", "p.*")


def _balances(spark, sf_dir):
    return shown(labels.stated_balances(balance_pages(spark, sf_dir)))


def holder_pages(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Pages and tokens of documents whose holder stands behind a label, in a running header, in the customer block, or nowhere."""
    c = customers(spark, sf_dir)
    k, seg = F.col("c_custkey") % 6, F.lower("c_mktsegment")
    text = F.when(k == 0, F.concat(F.lit("Account holder: "), seg, F.lit(" KUMAR, address"))).when(k == 1, F.concat(F.lit("Customer name: Savings Account\nMr. ravi "), seg, F.lit(", x"))).when(k == 5, "Name: joint").otherwise("nothing")
    info = F.when(k == 5, F.concat(F.lit("Account name asha "), seg, F.lit(" address"))).otherwise("")
    page = lambda n, t, i: F.struct(F.lit(n).cast("long").alias("page"), t.alias("raw_text"), i.alias("info"))
    pages = c.select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(page(1, text, info), page(2, F.lit("more"), F.lit("")), page(3, F.lit("more"), F.lit("")))).alias("p")).select("doc_id", "p.*")
    t = lambda page, tok, word, x, y: F.struct(F.lit(page).cast("long").alias("page"), F.lit(tok).cast("long").alias("tok"), word.alias("text"), F.lit(x).alias("x0"), F.lit(y).alias("y0"))
    some = F.array(
        t(2, 1, F.when(k == 2, "Page").otherwise("Page 2"), 50.0, 10.0), t(2, 2, F.when(k == 2, "of 3").otherwise(seg), 90.0, 10.0), t(3, 1, seg, 90.0, 12.0), t(3, 2, F.when(k == 2, "asha").otherwise("7"), 50.0, 14.0),
        t(1, 1, F.lit("H1"), 20.0, 150.0), t(1, 2, F.when(k == 3, "anil:").otherwise("12"), 40.0, 152.0), t(1, 3, F.when(k == 3, seg).otherwise("9"), 80.0, 151.0), t(1, 4, F.when(k == 4, seg).otherwise("-"), 60.0, 170.0), t(1, 5, F.when(k == 4, "sharma").otherwise("."), 30.0, 171.0),
    )
    return pages, c.select(F.col("c_custkey").alias("doc_id"), F.explode(some).alias("t")).select("doc_id", "t.*")


def _spatial(spark, sf_dir):
    return labels.holder_names(*holder_pages(spark, sf_dir))


def _parsed(spark, sf_dir):
    """Ledger rows by coordinates; accounts without any transaction there are read line by line."""
    rows = layout_queries.raw_rows(spark, sf_dir)
    blank = [F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col(c)).alias(c) for c in ("debit_raw", "credit_raw", "amount_raw", "description")]
    rows = rows.select(*[c for c in rows.columns if c not in ("debit_raw", "credit_raw", "amount_raw", "description")], *blank)
    printed = line_queries.printed(spark, sf_dir)
    return shown(reports.parsed(rows, printed))


QUERIES = {"label_fields": _fields, "customer_names": _customers, "stated_balances": _balances, "spatial_holder_names": _spatial, "parser_chain": _parsed}

_T = f"""n AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS tok FROM lineitem
), t AS (SELECT l_partkey AS doc_id, (tok + 11) // 12 AS page, tok, list_extract({WORDS}, CAST(1 + (l_suppkey * 7 + l_linenumber * 5 + tok) % {len(WORDS)} AS BIGINT)) AS text, ((tok - 1) % 3) * 130 + l_quantity % 10 AS x0, ((tok - 1) % 12 // 3) * 12 + (l_suppkey % 3) * 1.0::DOUBLE AS y0, ((tok - 1) % 3) * 130 + l_quantity % 10 + 60 AS x1, ((tok - 1) % 12 // 3) * 12 + (l_suppkey % 3) * 1.0::DOUBLE + 8 + (l_suppkey % 2) * 2 AS y1 FROM n)"""


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _customer(x: str) -> str:
    low = f"lower(trim({x}))"
    return rf"length({low}) >= 3 AND NOT regexp_matches({low}, '\d') AND len(list_filter({_quoted(N.NOT_CUSTOMERS)}, lambda p: contains({low}, p))) = 0 AND len(list_intersect(regexp_split_to_array({low}, '[\s,.\-_/\\()]+'), {_quoted(N.NOT_CUSTOMER_WORDS)})) = 0"


def _bare(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[\s:.\-_#]+', ''), '[\s:.\-_#]+$', '')"


def _candidate(x: str) -> str:
    b = _bare(x)
    ends = " OR ".join(f"lower({b}) = '{e}' OR starts_with(lower({b}), '{e} ') OR ends_with(lower({b}), ' {e}')" for e in N.NOT_NAME_ENDS)
    words = rf"list_filter(regexp_split_to_array({b}, '\s+'), lambda w: regexp_matches(w, '^\pL{{2,}}$'))"
    return rf"(length({b}) >= 3 AND NOT regexp_matches({b}, '\d') AND NOT list_contains({_quoted(N.NOT_NAMES)}, lower({b})) AND NOT ({ends}) AND len({words}) > 0 AND NOT (len({words}) = 1 AND list_contains({_quoted(N.NOT_NAMES)}, lower({words}[1]))))"


def _title(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(left(w, 1)) || lower(substring(w, 2))), ' ')"


_KIND = " UNION ALL ".join(f"SELECT *, '{k}' AS kind, {n} AS most FROM z WHERE zone = '{zone}' AND regexp_matches(text, '{p}')" for k, (p, n, zone) in labels.LABELS.items())
_LOOSE = r"TRY_CAST(nullif(regexp_extract(regexp_replace(wide, '(?i)[,\s₹RsINR$€£AEDCADAUD]', '', 'g'), '^[+-]?(\d+\.?\d*|\.\d+)'), '') AS DECIMAL(18,2))"
_FIRST = ", ".join(f"{'CAST(' if k.endswith('balance') else ''}arg_min(value, (page, o1, o2, label)) FILTER (kind = '{k}'){' AS DOUBLE)' if k.endswith('balance') else ''} AS {k}" for k in labels.LABELS)


def _num(x: str, patterns: list[str]) -> str:
    """Amount behind the first pattern of which the first text that has it shows a number."""
    texts = x.split(" | ")
    found = lambda p: "coalesce(" + ", ".join(f"nullif(regexp_extract({t}, '{p}', 1), '')" for t in texts) + ")"
    return "coalesce(" + ", ".join(f"TRY_CAST(replace({found(p)}, ',', '') AS DECIMAL(18,2))" for p in patterns) + ")"


_AMT = "format('{:,.2f}', abs(c_acctbal))"
_said = lambda test, label: f"CASE WHEN {test} THEN '{label}' || {_AMT} ELSE '' END"
_PAGES = f"""WITH p AS (SELECT c_custkey AS doc_id, 'Account ' || {_said('c_custkey % 5 = 0', 'Opening Balance: ')} || ' ' || {_said('c_custkey % 5 = 1', 'B/F ')} || ' ' || {_said('c_custkey % 4 = 0', 'Total Credits: ')} AS a,
  {_said('c_custkey % 5 = 2', 'Opening balance ')} || ' ' || {_said('c_custkey % 3 = 0', 'Closing balance: ')} || ' ' || CASE WHEN c_custkey % 7 = 0 THEN 'Savings Account (SA): ' || {_AMT} || ' 10.64' ELSE '' END || ' ' || {_said('c_custkey % 4 = 1', 'total dr. amount ')} AS b,
  {_said('c_custkey % 3 = 1', 'Ending Balance = ')} || ' ' || {_said('c_custkey % 11 = 0', 'c/f: ')} || ' ' || {_said('c_custkey % 4 < 2', 'total debits ')} || ' end' AS c, {_said('c_custkey % 10 = 0', 'opening balance 7')} AS region FROM customer
), q AS (SELECT *, a || ' ' || b || ' ' || c AS al, TRY_CAST(replace(regexp_extract(b, '{labels.PAIR}', 1), ',', '') AS DECIMAL(18,2)) AS p1, TRY_CAST(replace(regexp_extract(b, '{labels.PAIR}', 2), ',', '') AS DECIMAL(18,2)) AS p2 FROM p
), v AS (SELECT *, {_num('region | a', fields.OPENING)} AS o1, {_num('al', fields.OPENING)} AS o3, {_num('c', fields.CLOSING)} AS c2, {_num('al', fields.CLOSING)} AS c3, {_num('a', fields.CREDITS)} AS r1, {_num('c', fields.CREDITS)} AS r2, {_num('al', fields.CREDITS)} AS r3, {_num('a', fields.DEBITS)} AS d1, {_num('c', fields.DEBITS)} AS d2, {_num('al', fields.DEBITS)} AS d3 FROM q)"""
_level = lambda *pairs: "CASE " + " ".join(f"WHEN {c} IS NOT NULL THEN '{n}'" for c, n in pairs) + " END"

ORACLE_SQL = {
    "label_fields": rf"""WITH {_T}, u AS (SELECT *, bool_or(y0 >= {HEIGHT * 0.7}) OVER (PARTITION BY doc_id, page) AS foot FROM t
), z AS MATERIALIZED (SELECT *, 'HEAD' AS zone, y0 AS o1, x0 AS o2 FROM u WHERE y0 <= {HEIGHT * 0.4} UNION ALL SELECT *, 'FOOT', 0.0, 0.0 FROM u WHERE y0 >= {HEIGHT * 0.7} OR NOT foot
), lab AS ({_KIND}), j AS (SELECT b.doc_id, b.page, b.kind, b.tok AS label, b.o1, b.o2, a.text, a.x0, row_number() OVER (PARTITION BY b.doc_id, b.page, b.kind, b.tok ORDER BY a.o1, a.o2, a.tok) AS r, b.most FROM z a JOIN lab b ON a.doc_id = b.doc_id AND a.page = b.page AND a.zone = b.zone AND a.tok <> b.tok
  WHERE a.x0 BETWEEN b.x1 - 2 AND b.x1 + 350 AND abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) <= greatest(8, b.y1 - b.y0) * 0.85
), s AS (SELECT doc_id, page, kind, label, o1, o2, trim(regexp_replace(string_agg(text, '' ORDER BY x0, r), '[:\-]', '', 'g')) AS tight, string_agg(text, ' ' ORDER BY x0, r) AS wide FROM j WHERE r <= most GROUP BY ALL
), f AS (SELECT *, regexp_extract(tight, '(?i)([A-Z0-9]{{6,34}})', 1) AS acc, upper(regexp_extract(regexp_replace(wide, '[:\-]', '', 'g'), '(?i)\b([A-Z]{{4}}0[A-Z0-9]{{6}})\b', 1)) AS code, trim(regexp_replace(wide, '[:\-]', '', 'g')) AS name, {_LOOSE} AS amt FROM s
), w AS (SELECT *, CASE kind WHEN 'account_number' THEN CASE WHEN NOT regexp_matches(acc, '(?i)statement|account|customer|period') THEN nullif(acc, '') END WHEN 'ifsc' THEN nullif(code, '') WHEN 'holder' THEN CASE WHEN {_customer('name')} THEN name END ELSE CASE WHEN amt > 0 THEN CAST(amt AS VARCHAR) END END AS value FROM f)
SELECT doc_id, {_FIRST} FROM w WHERE value IS NOT NULL GROUP BY doc_id""",
    "customer_names": f"""WITH x AS (SELECT c_custkey, list_extract({_quoted(N.NOT_CUSTOMER_WORDS)}, CAST(1 + c_custkey % {len(N.NOT_CUSTOMER_WORDS)} AS BIGINT)) AS w, list_extract({_quoted(N.NOT_CUSTOMERS)}, CAST(1 + c_custkey % {len(N.NOT_CUSTOMERS)} AS BIGINT)) AS p, c_name, lower(c_mktsegment) AS seg FROM customer
), y AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'Ravi' || w WHEN 1 THEN 'Ravi, ' || upper(w) WHEN 2 THEN 'the' || p || 's' WHEN 3 THEN c_name WHEN 4 THEN seg WHEN 5 THEN ' ab ' ELSE w || '-sharma' END AS name FROM x) SELECT c_custkey, name, {_customer('name')} AS customer, {_candidate('name')} AS holder FROM y""",
    "stated_balances": f"""{_PAGES} SELECT doc_id, {dbl('coalesce(o1, p1, o3)')} AS opening_balance, {_level(('o1', 'PAGE_ONE'), ('p1', 'PAIR'), ('o3', 'ALL'))} AS opening_level, {dbl('coalesce(p2, c2, c3)')} AS closing_balance, {_level(('p2', 'PAIR'), ('c2', 'LAST'), ('c3', 'ALL'))} AS closing_level,
  {dbl('coalesce(r1, r2, r3)')} AS stated_credits, {_level(('r1', 'PAGE_ONE'), ('r2', 'LAST'), ('r3', 'ALL'))} AS stated_credits_level, {dbl('coalesce(d1, d2, d3)')} AS stated_debits, {_level(('d1', 'PAGE_ONE'), ('d2', 'LAST'), ('d3', 'ALL'))} AS stated_debits_level FROM v""",
    "spatial_holder_names": rf"""WITH c AS (SELECT c_custkey AS doc_id, c_custkey % 6 AS k, lower(c_mktsegment) AS seg FROM customer
), p AS (SELECT *, CASE k WHEN 0 THEN 'Account holder: ' || seg || ' KUMAR, address' WHEN 1 THEN 'Customer name: Savings Account' || chr(10) || 'Mr. ravi ' || seg || ', x' WHEN 5 THEN 'Name: joint' ELSE 'nothing' END AS txt, CASE k WHEN 5 THEN 'Account name asha ' || seg || ' address' ELSE '' END AS info FROM c
), l AS (SELECT *, list_filter({' || '.join(f"regexp_extract_all({t}, '{x}', 1)" for x in (N.HOLDER, N.TITLED, N.NAMED) for t in ('info', 'txt'))}, lambda x: {_candidate('x')})[1] AS lab,
  CASE WHEN k = 2 THEN 'Page of 3' ELSE 'Page 2 ' || seg END AS h2, CASE WHEN k = 2 THEN 'asha ' ELSE '7 ' END || seg AS h3, trim(regexp_replace('H1 ' || CASE WHEN k = 3 THEN 'anil: ' || seg ELSE '12 9' END, '[H;:.\-_#0-9]', '', 'g')) AS b1, trim(regexp_replace(CASE WHEN k = 4 THEN 'sharma ' || seg ELSE '. -' END, '[H;:.\-_#0-9]', '', 'g')) AS b2 FROM p
), s AS (SELECT *, CASE WHEN {_candidate('h2')} THEN h2 WHEN {_candidate('h3')} THEN h3 END AS run, CASE WHEN {_candidate('b1')} THEN b1 WHEN {_candidate('b2')} THEN b2 END AS block FROM l)
SELECT doc_id, CASE WHEN lab IS NOT NULL THEN {_title(_bare('lab'))} WHEN run IS NOT NULL THEN {_title('run')} ELSE {_title('block')} END AS holder, CASE WHEN lab IS NOT NULL THEN 'LABEL' WHEN run IS NOT NULL THEN 'RUNNING_HEADER' ELSE 'CUSTOMER_BLOCK' END AS level FROM s WHERE coalesce(lab, run, block) IS NOT NULL""",
    "parser_chain": f"""SELECT doc_id, seq, page, d, description, type, amount, balance, 'COORDINATES' AS level FROM ({layout_queries.RAW} SELECT doc_id, CAST(seg AS BIGINT) AS seq, page, strftime(d, '%Y-%m-%d') AS d, description, type, CAST(CASE WHEN fix THEN abs(bal - prev) ELSE amt END AS DOUBLE) AS amount, CAST(bal AS DOUBLE) AS balance FROM fin WHERE doc_id % 3 <> 0)
UNION ALL SELECT doc_id, seq, page, d, description, type, amount, balance, 'LINES' FROM ({line_queries.ORACLE_SQL['line_transactions']}) l WHERE doc_id NOT IN (SELECT doc_id FROM ({layout_queries.RAW} SELECT doc_id FROM fin WHERE doc_id % 3 <> 0))""",
}
