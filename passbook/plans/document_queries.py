"""Queries over printed amounts, dates, identifiers and statement text, and the same rows in SQL.

Statement text is composed from the driver's tables by one expression that both
engines read; what is parsed from it is then known from the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, fields, masking, money, text
from ..operators import documents
from ..sources import guards
from ..sources.tables import customers
from .ledger_queries import shown
from .sql import case, dbl, hit

KEY = "o_orderkey"


def orders(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _amounts(spark, sf_dir):
    p = F.col("o_totalprice").cast(money.MONEY)
    grouped = F.format_number(p, 2)
    eu = F.translate(grouped, ",.", ".,")
    forms = [p.cast("string"), F.concat(F.lit("₹"), grouped), F.concat(F.lit("("), grouped, F.lit(")")), F.concat(F.lit("-"), grouped), F.concat(grouped, F.lit(" Cr")), F.concat(F.lit("€"), eu), F.concat(grouped, F.lit(" Dr")), F.lit("n/a"), F.format_number(F.floor(p), 0)]
    printed = F.get(F.array(*forms), (F.col(KEY) % len(forms)).cast("int"))
    return shown(orders(spark, sf_dir).select(KEY, money.clean_amount(printed).alias("amount"), money.indicator(printed).alias("side")))


def _dates(spark, sf_dir):
    d = F.to_date("o_orderdate")
    forms = [F.date_format(d, f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MMM-yyyy", "MMM dd, yyyy", "d.M.yy", "yyyy/M/d", "ddMMM yyyy")] + [F.lit("31/02/2020"), F.concat(F.lit("12 "), F.date_format(d, "dd-MM-yyyy"))]
    printed = F.get(F.array(*forms), (F.col(KEY) % len(forms)).cast("int"))
    return shown(orders(spark, sf_dir).select(KEY, dates.parse(printed).alias("d")))


def _periods(spark, sf_dir):
    a, b = F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), (F.col(KEY) % 40).cast("int"))
    forms = [F.concat(F.lit("Statement period: "), F.date_format(a, "dd/MM/yyyy"), F.lit(" to "), F.date_format(b, "dd/MM/yyyy")), F.concat(F.lit("between "), F.date_format(a, "dd MMM yyyy"), F.lit(" and "), F.date_format(b, "dd MMM yyyy")), F.concat(F.lit("seen "), F.date_format(b, "yyyy-MM-dd"), F.lit(" then "), F.date_format(a, "yyyy-MM-dd"))]
    found = orders(spark, sf_dir).select(KEY, dates.period(F.get(F.array(*forms), (F.col(KEY) % 3).cast("int"))).alias("p"))
    p = F.col("p")
    return shown(found.select(KEY, p["start"].alias("from_date"), p["end"].alias("to_date"), dates.period_days(p["start"], p["end"]).alias("days")))


# The same text in both engines.
ACCOUNT_SQL = "lpad(CAST(o_orderkey * 7919 AS STRING), CAST(3 + o_orderkey % 14 AS INT), '4')"
PAN_SQL = "concat('abcde', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0'), 'z')"
PHONE_SQL = "concat('+91 ', lpad(CAST(o_orderkey % 100000 AS STRING), 5, '9'), '-', lpad(CAST(o_custkey % 100000 AS STRING), 5, '8'))"
EMAIL_SQL = "concat(CASE o_orderkey % 3 WHEN 0 THEN 'jo' WHEN 1 THEN 'anna.k' ELSE concat('user', CAST(o_custkey AS STRING)) END, '@example.org')"
NARRATION_SQL = """CASE o_orderkey % 8 WHEN 0 THEN concat('UPI/P2M/', lpad(CAST(o_orderkey * 97 AS STRING), 12, '6'), '/shop') WHEN 1 THEN concat('paid  ref ', lpad(CAST(o_orderkey AS STRING), 12, '1'))
 WHEN 2 THEN concat('IMPS/MOB/AB', CAST(o_custkey + 10000000 AS STRING), '/x') WHEN 3 THEN concat('NEFT/YESIG', CAST(o_orderkey + 100000 AS STRING), '/rent USD') WHEN 4 THEN concat('BNA/DPRH', CAST(o_custkey AS STRING), '/6809/cash Rs. 5 USD')
 WHEN 5 THEN concat('Transfer', chr(9), 'EUR  ', o_orderpriority) WHEN 6 THEN concat('fee £3 ', chr(10), ' SGD') ELSE concat('../..', '/state ment?', o_orderstatus, '.pdf') END"""
ERROR_SQL = "CASE o_orderkey % 3 WHEN 0 THEN concat('[FILE_', CAST(o_orderkey % 7 AS STRING), '] too large') WHEN 1 THEN 'plain message' ELSE '[lower] no' END"


def _identifiers(spark, sf_dir):
    a, p, t, e = (F.expr(x) for x in (ACCOUNT_SQL, PAN_SQL, PHONE_SQL, EMAIL_SQL))
    return orders(spark, sf_dir).select(KEY, masking.account(a).alias("account"), masking.account_alt(a).alias("account_alt"), masking.pan(p).alias("pan"), masking.pan_alt(p).alias("pan_alt"), masking.phone(t).alias("phone"), masking.aadhaar(t).alias("aadhaar"), masking.email(e).alias("email"))


def _narrations(spark, sf_dir):
    n, e = F.expr(NARRATION_SQL), F.expr(ERROR_SQL)
    return orders(spark, sf_dir).select(KEY, text.reference_number(n).alias("reference"), text.currency(n).alias("currency"), text.clean_narration(n).alias("clean"), text.safe_filename(n).alias("filename"), text.error_code(e).alias("error_code"), text.recurring_key(n).alias("recurring_key"))


def _masked(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(masking.text(F.col("text")), 256).alias("masked"))


BAL, CUST = "CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING)", "CAST(c_custkey AS STRING)"
STATEMENTS = [
    f"concat('Axis Bank statement', chr(10), 'Account No: 91', lpad({CUST}, 10, '0'), ' IFSC UTIB0', lpad({CUST}, 6, '0'), ' MICR code: 400', lpad({CUST}, 6, '0'), chr(10), 'Savings account. Customer ID ', {CUST}, ' Statement period: 01/08/2026 to 31/08/2026', chr(10), 'Opening balance: ', {BAL}, ' Closing balance: 99.50 Total credits: 120.00 Total debits: 20.50', chr(10), 'date particulars debit credit balance')",
    f"concat('Kotak Mahindra Bank. a/c ', lpad({CUST}, 11, '7'), ' opening balance ', {BAL}, ' period 01-Jul-2026 to 31-Jul-2026. Total withdrawals 5.00')",
    f"concat('Tax invoice. Invoice no 12 invoice date 3. Sold by ', c_name, ' bill to you. qty 2 unit price 3 cgst 9. hdfc bank ', {CUST})",
    "concat('Curriculum vitae of ', c_name, ' work experience and education skills')",
    f"concat('Your rewards program: apply now for more. ', c_mktsegment, ' ', {CUST})",
    "concat('Important information: terms & conditions apply. banking ombudsman ', c_mktsegment)",
    "concat('Account summary. Total deposits 12 summary of accounts of ', c_name, ' in icici then hsbc')",
    f"concat('Tran date value date narration withdrawal deposit balance SBI yono ', {CUST}, ' swift code ABCDEF12')",
]
PAGE_SQL = f"CASE c_custkey % {len(STATEMENTS)} " + " ".join(f"WHEN {k} THEN {s}" for k, s in enumerate(STATEMENTS)) + " END"


def pages(spark, sf_dir) -> DataFrame:
    return customers(spark, sf_dir).select(F.col("c_custkey").alias("doc_id"), "c_acctbal", F.expr(PAGE_SQL).alias("raw_text"))


# Documents of every kind; the first line is the header region, the next two the account region. Some customers' documents have two pages.
EVIDENCE_TEXTS = [
    f"concat('Axis Bank', chr(10), 'Account No: 91', lpad({CUST}, 10, '0'), ' IFSC UTIB0', lpad({CUST}, 6, '0'), chr(10), 'Customer ID ', lpad({CUST}, 6, '1'), ' savings account. Statement period: 01/08/2026 to 31/08/2026', chr(10), 'Tran date particulars debit credit balance', chr(10), '05/08/2026 shop 120.00 ', {BAL}, chr(10), '06 Aug 2026 cash 20.00 ', {BAL}, chr(10), 'closing balance ', {BAL})",
    f"concat('Kotak Mahindra', chr(10), 'a/c ', lpad({CUST}, 11, '7'), chr(10), 'account holder Asha Rao', chr(10), 'date details amount', chr(10), repeat(concat('15-07-2026 order ', {CUST}, ' 12.50', chr(10)), CAST(c_custkey % 13 AS INT)))",
    f"concat('Tax invoice', chr(10), 'Invoice no 12 invoice date 3', chr(10), 'Sold by ', c_name, ' bill to you', chr(10), 'qty 2 unit price 3 cgst 9 ', {CUST})",
    "concat('Curriculum vitae', chr(10), c_name, chr(10), 'experience and education')",
    "concat('Loan agreement', chr(10), 'the borrower and the lender', chr(10), 'whereas ', c_mktsegment, ' in witness whereof')",
    "concat('Payslip', chr(10), 'employee code 7', chr(10), 'basic 100 net pay 90 ', c_mktsegment)",
    "concat('', chr(10), 'Unique Identification Authority of India', chr(10), c_name)",
    "concat('', chr(10), 'permanent account number card', chr(10), c_name)",
    f"concat('Village cooperative bank', chr(10), 'micr code: 400', lpad({CUST}, 6, '0'), chr(10), 'brought forward ', {BAL})",
    f"concat('Notice', chr(10), 'from the city bank', chr(10), 'swift code ABCDEF12 ', {CUST})",
    "concat('Tax invoice of the bank', chr(10), 'invoice no 1 due date 2 seller buyer', chr(10), 'date narration debit balance units rate hsn')",
    "concat('Letter', chr(10), c_mktsegment, chr(10), 'nothing to see')",
]
EVIDENCE_SQL = f"CASE c_custkey % {len(EVIDENCE_TEXTS)} " + " ".join(f"WHEN {k} THEN {s}" for k, s in enumerate(EVIDENCE_TEXTS)) + " END"
SECOND_SQL = f"CASE WHEN c_custkey % 5 = 0 THEN concat('page two', chr(10), '09/08/2026 fee 1.00 ', {BAL}, chr(10), 'date description withdrawal balance', chr(10), 'carried forward') END"


def evidence_pages(spark, sf_dir) -> DataFrame:
    c = customers(spark, sf_dir)
    first = c.select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), F.expr(EVIDENCE_SQL).alias("raw_text"))
    second = c.select(F.col("c_custkey").alias("doc_id"), F.lit(2).alias("page"), F.expr(SECOND_SQL).alias("raw_text")).where("raw_text is not null")
    lines = F.split("raw_text", "\n")
    return first.union(second).withColumn("header", F.when(F.col("page") == 1, F.get(lines, 0))).withColumn("info", F.when(F.col("page") == 1, F.array_join(F.slice(lines, 2, 2), " ")))


def _kinds(spark, sf_dir):
    t = F.col("raw_text")
    return pages(spark, sf_dir).select("doc_id", fields.page_kind(t).alias("page_kind"), fields.bank(t).alias("bank"), fields.earliest_bank(t).alias("earliest_bank"), fields.account_type(t).alias("account_type"), F.initcap(F.trim(F.regexp_replace(F.lit("RAVI  kumar."), r"[.\s]+", " "))).alias("holder"))


def _corpus_kinds(spark, sf_dir):
    """Page kinds and bank names over the web pages and documents as they are."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.lit("document").alias("origin"), "text")
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), F.lit("page").alias("origin"), F.col("html").alias("text"))
    both = d.unionByName(p)
    return both.groupBy("origin", fields.bank(F.col("text")).alias("bank")).agg(F.count("*").alias("n"))


def _files(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey") % 6
    content = F.when(k == 0, F.lit("")).when(k == 1, F.lit("%PDF-1.7 body")).when(k == 2, F.concat(F.lit("junk "), F.lit("%PDF-1.4"))).when(k == 3, F.lit("no header")).otherwise(F.lit("%PDF-")).cast("binary")
    files = p.select(F.concat("p_name", F.col("p_partkey").cast("string"), F.when(k == 4, ".txt").otherwise(".PDF")).alias("path"), F.when(k == 5, 30_000_000).otherwise(F.length(content)).cast("long").alias("length"), content.alias("content"))
    return documents.guard(files)


def _gate(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    words = F.array(*[F.lit(w) for w in ("Balance:", "hello", "DEBIT", "12", "credit", "x", "Branch")])
    tokens = li.select((F.col("l_orderkey") % 200).alias("doc_id"), (F.col("l_orderkey") % 3).alias("page"), F.get(words, (F.col("l_partkey") % 7).cast("int")).alias("text"), ((F.col("l_suppkey") % 5) * 25).alias("c"))
    return documents.scan_gate(tokens.select("doc_id", "page", "text", (F.col("c") / 100.0).alias("conf")))


def _validate(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    v = F.when(F.col("event_id") % 101 == 0, F.lit(float("nan"))).when(F.col("event_id") % 103 == 0, -F.col("value")).otherwise(F.col("value"))
    b = F.when(F.col("event_id") % 97 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return documents.validate(e.select(F.col("user_id").alias("acct"), F.coalesce(v, F.lit(0.0)).alias("amount"), F.coalesce(b, F.lit(0.0)).alias("balance")))


QUERIES = {
    "amount_parse": _amounts,
    "date_parse": _dates,
    "period_dates": _periods,
    "mask_identifiers": _identifiers,
    "mask_text": _masked,
    "narration_scalars": _narrations,
    "page_kind_and_bank": _kinds,
    "corpus_banks": _corpus_kinds,
    "account_fields": lambda spark, sf_dir: shown(documents.account_fields(pages(spark, sf_dir))),
    "doc_evidence": lambda spark, sf_dir: documents.evidence(evidence_pages(spark, sf_dir)),
    "doc_decision": lambda spark, sf_dir: documents.decide(evidence_pages(spark, sf_dir)),
    "file_guard": _files,
    "file_guard_error": lambda spark, sf_dir: guards.messages(_files(spark, sf_dir)),
    "ocr_quality_gate": _gate,
    "extraction_validate": _validate,
}

V = "CAST(o_totalprice AS DECIMAL(18,2))"
BANK_SQL = case([(" OR ".join(f"contains(lower({{t}}), '{a}')" for a in aliases), f"'{n}'") for n, aliases in fields.BANKS], "NULL")
FIRST = "least(" + ", ".join(f"coalesce(nullif(instr(lower(t), '{a}'), 0), 1000000)" for _, al in fields.BANKS for a in al) + ")"
EARLIEST = case([(" OR ".join(f"instr(lower(t), '{a}') = found_at" for a in al), f"'{n}'") for n, al in fields.BANKS], "NULL")
KIND_SQL = case([(" AND ".join([hit("lower(t)", p) for p in need] + ([f"NOT {hit('lower(t)', no)}"] if no else [])), f"'{k}'") for k, need, no in fields.PAGES], "'UNKNOWN'")
PAGES_SQL = f"WITH p AS (SELECT c_custkey AS doc_id, {PAGE_SQL} AS t, c_acctbal, c_custkey % 8 AS k FROM customer)"
IN = {"info": "({t}(info, '{p}') OR {t}(one, '{p}'))", "one": "{t}(one, '{p}')", "head": "{t}(head, '{p}')", "all": "{t}(al, '{p}')"}


def seen(place: str, pattern: str) -> str:
    return IN[place].format(t="regexp_matches", p=pattern)


def pillars(groups) -> str:
    return " + ".join("CAST(" + " AND ".join(seen(*x) for x in g) + " AS INT)" for g in groups)


TITLE = "CASE WHEN head = '' THEN one ELSE head END"
KNOWN = BANK_SQL.format(t="al") + " IS NOT NULL"
COLUMNS = " + ".join(f"CAST({hit('lower(line)', p)} AS INT)" for p in fields.LEDGER_HEADER)
FOUND_SQL = rf"""WITH pg AS (SELECT c_custkey AS doc_id, 1 AS page, {EVIDENCE_SQL} AS t FROM customer UNION ALL SELECT c_custkey, 2, {SECOND_SQL} FROM customer WHERE c_custkey % 5 = 0
), ln AS (SELECT doc_id, page, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM pg
), lc AS (SELECT *, {COLUMNS} AS cols, regexp_matches(line, '^(\d{{2}}[-/]\d{{2}}[-/]\d{{4}}|\d{{2}} Aug \d{{4}}) .*\d') AS is_row FROM ln
), ld AS (SELECT doc_id, coalesce(arg_min(cols, page * 1000 + pos) FILTER (WHERE cols >= 3), 0) AS cols, count(*) FILTER (WHERE is_row) AS n FROM lc GROUP BY doc_id
), tx AS (SELECT doc_id, lower(split_part(any_value(t) FILTER (WHERE page = 1), chr(10), 1)) AS head, lower(any_value(t) FILTER (WHERE page = 1)) AS one, lower(string_agg(t, ' ' ORDER BY page)) AS al FROM pg GROUP BY doc_id
), d0 AS (SELECT *, split_part(one, chr(10), 2) || ' ' || split_part(one, chr(10), 3) || ' ' || head AS info, {KNOWN} AS known, {hit('head', fields.HEADER_BANK)} AS hb, cols >= 3 OR n >= 3 AS ledger FROM tx JOIN ld USING (doc_id)
), dd AS (SELECT *, NOT known AND NOT hb AND {hit('left(al, 1000)', fields.GENERIC_BANK)} AS gb FROM d0
), f AS (""" + " UNION ALL ".join(
    f"SELECT doc_id, '{s}' AS signal, '{k}' AS kind, {w} AS weight, {sign} AS sign FROM dd WHERE {test}"
    for s, k, w, sign, test in [
        ("KNOWN_BANK", "BANK_IDENTITY", 35, 1, "known"), ("HEADER_BANK", "BANK_IDENTITY", 25, 1, "hb"), ("GENERIC_BANK", "BANK_IDENTITY", 20, 1, "gb"),
        *((s, k, w, 1, seen(place, p)) for s, k, w, place, p in fields.EVIDENCE), ("SWIFT", "ROUTING_CODES", 20, 1, f"{seen('all', fields.SWIFT)} AND NOT {seen('all', fields.EVIDENCE[4][4])}"),
        ("TABLE_HEADER", "LEDGER", "CASE cols WHEN 4 THEN 35 ELSE 25 END", 1, "cols >= 3"), ("LEDGER_ROWS", "LEDGER", "CASE WHEN n >= 10 THEN 35 WHEN n >= 4 THEN 25 ELSE 15 END", 1, "n > 0"),
        *((k, k, "CASE WHEN ledger THEN 30 ELSE 70 END", -1, f"NOT (ledger AND (known OR hb OR gb)) AND {pillars(g)} >= 3") for k, g in (("INVOICE", fields.INVOICE), ("LOAN_AGREEMENT", fields.LOAN))),
        ("PAYSLIP", "PAYSLIP", 75, -1, f"NOT ledger AND {hit(TITLE, fields.PAYSLIP['title'])} AND {seen('one', fields.PAYSLIP['employee'])} AND ({seen('one', fields.PAYSLIP['earnings'])} OR {seen('one', fields.PAYSLIP['deductions'])})"),
        ("AADHAAR", "AADHAAR", 80, -1, f"NOT ledger AND {seen('all', fields.AADHAAR)}"), ("PAN_CARD", "PAN_CARD", 80, -1, f"NOT ledger AND NOT (known OR hb OR gb) AND {seen('all', fields.PAN_CARD)}"),
        ("RESUME", "RESUME", 80, -1, f"NOT ledger AND {hit(TITLE, fields.RESUME[0])} AND {seen('one', fields.RESUME[1])}"),
    ]
) + ")"

ORACLE_SQL = {
    "amount_parse": f"SELECT {KEY}, {dbl(f'CASE {KEY} % 9 WHEN 2 THEN -{V} WHEN 3 THEN -{V} WHEN 7 THEN NULL WHEN 8 THEN floor({V}) ELSE {V} END')} AS amount, CASE {KEY} % 9 WHEN 2 THEN 'DEBIT' WHEN 3 THEN 'DEBIT' WHEN 4 THEN 'CREDIT' WHEN 6 THEN 'DEBIT' END AS side FROM orders",
    "date_parse": f"SELECT {KEY}, CASE {KEY} % 9 WHEN 7 THEN NULL WHEN 4 THEN '20' || strftime(o_orderdate, '%y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders",
    "period_dates": f"SELECT {KEY}, strftime(o_orderdate, '%Y-%m-%d') AS from_date, strftime(CAST(o_orderdate AS DATE) + CAST({KEY} % 40 AS INTEGER), '%Y-%m-%d') AS to_date, coalesce(nullif({KEY} % 40, 0), 30) AS days FROM orders",
    "mask_identifiers": f"""WITH x AS (SELECT {KEY}, {ACCOUNT_SQL} AS a, upper({PAN_SQL}) AS p, regexp_replace({PHONE_SQL}, '[^0-9]', '', 'g') AS t, split_part({EMAIL_SQL}, '@', 1) AS u FROM orders)
SELECT {KEY}, CASE WHEN length(a) <= 4 THEN a ELSE repeat('X', greatest(4, length(a) - 4)) || right(a, 4) END AS account, CASE WHEN length(a) <= 4 THEN 'XXXX' ELSE repeat('X', length(a) - 4) || right(a, 4) END AS account_alt, left(p, 5) || '****' || right(p, 1) AS pan, 'XXXXX' || substring(p, 6, 5) AS pan_alt,
  'XXXXXX' || right(t, 4) AS phone, 'XXXX-XXXX-' || right(t, 4) AS aadhaar, CASE WHEN length(u) <= 2 THEN '**' ELSE left(u, 1) || '***' || right(u, 1) END || '@example.org' AS email FROM x""",
    "mask_text": r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b(\d{2,4})\d{4,10}(\d{4})\b', '\1******\2', 'g'), '\b([A-Z]{5})\d{4}([A-Z])\b', '\1****\2', 'gi'), '\b\d{4}\s?\d{4}\s?(\d{4})\b', 'XXXX-XXXX-\1', 'g'), '\b[6-9]\d{5}(\d{4})\b', 'XXXXXX\1', 'g')) AS masked FROM documents""",
    "narration_scalars": rf"""WITH x AS (SELECT {KEY}, {KEY} % 8 AS k, {NARRATION_SQL} AS n, o_custkey, o_orderstatus, {ERROR_SQL} AS e FROM orders)
SELECT {KEY}, CASE k WHEN 0 THEN lpad(CAST({KEY} * 97 AS VARCHAR), 12, '6') WHEN 1 THEN lpad(CAST({KEY} AS VARCHAR), 12, '1') WHEN 2 THEN 'AB' || (o_custkey + 10000000) WHEN 3 THEN 'YESIG' || ({KEY} + 100000) WHEN 4 THEN 'DPRH' || o_custkey || '/6809' END AS reference,
  CASE k WHEN 3 THEN 'USD' WHEN 5 THEN 'EUR' WHEN 6 THEN 'GBP' ELSE 'INR' END AS currency, trim(regexp_replace(regexp_replace(n, '[\r\n\t]+', ' ', 'g'), '\s\s+', ' ', 'g')) AS clean,
  trim(regexp_replace(regexp_replace(n, '(\.\.[/\\])+', '', 'g'), '[^a-zA-Z0-9._\s-]', '_', 'g')) AS filename, nullif(regexp_extract(e, '^\[([A-Z0-9_]+)\]', 1), '') AS error_code, substring(trim(regexp_replace(lower(n), '[\d/\-_]', '', 'g'), ' '), 1, 20) AS recurring_key FROM x""",
    "page_kind_and_bank": f"{PAGES_SQL}, q AS (SELECT *, {FIRST} AS found_at FROM p) SELECT doc_id, {KIND_SQL} AS page_kind, {BANK_SQL.format(t='t')} AS bank, {EARLIEST} AS earliest_bank, CASE WHEN contains(lower(t), 'saving') THEN 'Savings' ELSE 'Current' END AS account_type, 'Ravi Kumar' AS holder FROM q",
    "corpus_banks": f"WITH b AS (SELECT 'document' AS origin, {BANK_SQL.format(t='text')} AS bank FROM documents UNION ALL SELECT 'page', {BANK_SQL.format(t='html')} FROM pages) SELECT origin, bank, count(*) AS n FROM b GROUP BY ALL",
    "account_fields": f"""{PAGES_SQL}, q AS (SELECT *, CASE k WHEN 0 THEN '91' || lpad(CAST(doc_id AS VARCHAR), 10, '0') WHEN 1 THEN lpad(CAST(doc_id AS VARCHAR), 11, '7') WHEN 2 THEN NULL END AS a FROM p)
SELECT doc_id, {BANK_SQL.format(t='t')} AS bank, coalesce(a, CASE WHEN k IN (2, 3, 6) THEN nullif(regexp_extract(t, '\\b(\\d{{9,18}})\\b', 1), '') END) AS account_number, CASE WHEN coalesce(a, CASE WHEN k IN (2, 3, 6) THEN nullif(regexp_extract(t, '\\b(\\d{{9,18}})\\b', 1), '') END) IS NULL THEN repeat('X', 12) ELSE repeat('X', greatest(4, length(coalesce(a, regexp_extract(t, '\\b(\\d{{9,18}})\\b', 1))) - 4)) || right(coalesce(a, regexp_extract(t, '\\b(\\d{{9,18}})\\b', 1)), 4) END AS account_masked,
  CASE WHEN k = 0 THEN 'Savings' ELSE 'Current' END AS account_type, CASE WHEN k = 0 THEN 'UTIB0' || lpad(CAST(doc_id AS VARCHAR), 6, '0') END AS ifsc, CASE WHEN k = 0 THEN '400' || lpad(CAST(doc_id AS VARCHAR), 6, '0') WHEN k IN (2, 3, 6) THEN nullif(regexp_extract(t, '\\b(\\d{{9}})\\b', 1), '') END AS micr,
  CASE WHEN k <= 1 THEN {dbl('abs(CAST(c_acctbal AS DECIMAL(18,2)))')} END AS opening_balance, CASE WHEN k = 0 THEN CAST(99.5 AS DOUBLE) END AS closing_balance, CASE k WHEN 0 THEN CAST(120 AS DOUBLE) WHEN 6 THEN CAST(12 AS DOUBLE) END AS stated_credits, CASE k WHEN 0 THEN CAST(20.5 AS DOUBLE) WHEN 1 THEN CAST(5 AS DOUBLE) END AS stated_debits,
  CASE k WHEN 0 THEN '2026-08-01' WHEN 1 THEN '2026-07-01' END AS from_date, CASE k WHEN 0 THEN '2026-08-31' WHEN 1 THEN '2026-07-31' END AS to_date, 'INR' AS currency FROM q""",
    "doc_evidence": f"{FOUND_SQL} SELECT doc_id, signal, kind, CAST(weight AS BIGINT) AS weight, CAST(sign AS BIGINT) AS sign FROM f",
    "doc_decision": f"""{FOUND_SQL}, s AS (SELECT dd.doc_id, CAST(coalesce(sum(weight) FILTER (WHERE sign = 1), 0) AS BIGINT) AS positive, CAST(coalesce(sum(weight) FILTER (WHERE sign = -1), 0) AS BIGINT) AS negative, CAST(coalesce(sum(weight) FILTER (WHERE kind = 'LEDGER'), 0) AS BIGINT) AS table_score, count(weight) AS signals FROM dd LEFT JOIN f USING (doc_id) GROUP BY dd.doc_id
), d AS (SELECT *, CASE WHEN negative >= 60 AND negative > positive + 25 THEN 'NOT_BANK_STATEMENT' WHEN positive >= 50 OR (table_score >= 35 AND positive >= 35) THEN 'BANK_STATEMENT' ELSE 'UNCERTAIN' END AS decision FROM s)
SELECT *, CASE decision WHEN 'NOT_BANK_STATEMENT' THEN CAST(0 AS DOUBLE) WHEN 'BANK_STATEMENT' THEN least(99, (1050000 + positive * 2800 + 7500) // 15000) / 100.0 ELSE positive / 100.0 END AS confidence FROM d""",
    "file_guard": "SELECT p_name || p_partkey || CASE WHEN p_partkey % 6 = 4 THEN '.txt' ELSE '.PDF' END AS path, CAST(CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 13 WHEN 2 THEN 13 WHEN 3 THEN 9 WHEN 4 THEN 5 ELSE 30000000 END AS BIGINT) AS length, CASE p_partkey % 6 WHEN 0 THEN 'EMPTY_FILE' WHEN 3 THEN 'INVALID_PDF' WHEN 4 THEN 'INVALID_FILE_TYPE' WHEN 5 THEN 'FILE_TOO_LARGE' END AS error_code FROM part",
    "file_guard_error": "SELECT CASE p_partkey % 6 WHEN 0 THEN 'EMPTY_FILE' WHEN 3 THEN 'INVALID_PDF' WHEN 4 THEN 'INVALID_FILE_TYPE' WHEN 5 THEN 'FILE_TOO_LARGE' END AS error_code, CASE p_partkey % 6 WHEN 0 THEN 'The file is empty.' WHEN 3 THEN 'The file is not a readable PDF.' WHEN 4 THEN 'Only PDF files are accepted.' WHEN 5 THEN 'The file is too large.' END AS message, count(*) AS files FROM part WHERE p_partkey % 6 IN (0, 3, 4, 5) GROUP BY ALL",
    "ocr_quality_gate": """WITH t AS (SELECT l_orderkey % 200 AS doc_id, l_orderkey % 3 AS page, l_partkey % 7 IN (0, 2, 4, 6) AS kw, l_suppkey % 5 * 25 AS c FROM lineitem
), g AS (SELECT doc_id, page, count(*) AS n, count(*) FILTER (WHERE kw) AS keywords, coalesce(avg(c / 100.0) FILTER (WHERE c > 0), 0.0) AS conf FROM t GROUP BY ALL) SELECT doc_id, page, n, keywords, round(conf, 4) AS confidence, (n >= 15 AND conf >= 0.6 AND keywords >= 2) OR (n >= 30 AND conf >= 0.5) AS passed FROM g""",
    "extraction_validate": """WITH v AS (SELECT user_id AS acct, event_id % 101 = 0 OR (event_id % 103 = 0 AND value > 0) OR (event_id % 103 <> 0 AND value < 0) AS ba, event_id % 97 = 0 AS bb FROM events), g AS (SELECT acct, count(*) AS n, count(*) FILTER (WHERE ba) AS bad_amounts, count(*) FILTER (WHERE bb) AS bad_balances FROM v GROUP BY acct)
SELECT *, concat_ws(',', CASE WHEN bad_amounts > 0 THEN 'amount' END, CASE WHEN bad_balances > 0 THEN 'balance' END) AS errors, bad_amounts + bad_balances = 0 AS valid FROM g""",
}
