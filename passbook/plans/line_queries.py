"""Queries over printed statement lines derived from the event ledger, and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import layout, lines
from ..sources import ledgers
from .ledger_queries import shown
from .sql import EVENTS, dbl, hit

HEADER = "Tran Date   Particulars              Debit        Credit       Balance"


def printed(spark, sf_dir) -> DataFrame:
    """A statement an account: an opening balance, then one to three lines an event in seven forms, with headers, banners, totals and notes between."""
    e = ledgers.events(spark, sf_dir)
    day, name = F.date_format("d", "dd-MM-yyyy"), F.concat(F.lpad(F.day("d").cast("string"), 2, "0"), F.lit(" Jan "), F.year("d").cast("string"))
    a, b = F.format_number("amount", 2), F.format_number("balance", 2)
    said, text = F.col("description"), lambda *parts: F.concat_ws(" ", *parts)
    forms = [
        F.array(text(day, said, a, b)), F.array(day, said, text(a, b, F.lit("4378"))), F.array(text(day, said), text(F.lit("0045123"), a, b)), F.array(text(day, said)),
        F.array(text(name, said), F.lit("Branch Delhi"), text(a, b)), F.array(text(day, said, a, F.lit("Cr"))), F.array(text(a, b)),
    ]
    k = F.col("id")
    extra = F.when(k % 20 == 0, F.array(F.lit(HEADER))).when(k % 23 == 0, F.array(F.lit("Page 2 of 9"), F.lit(""))).when(k % 29 == 0, F.array(text(F.lit("TRANSACTION TOTAL"), a, b))).when(k % 31 == 0, F.array(text(F.lit("Closing Balance:"), b))).otherwise(F.array().cast("array<string>"))
    first = F.when(F.col("seq") == 1, F.array(F.lit("OPENING BALANCE: 1,000.00"))).otherwise(F.array().cast("array<string>"))
    own = F.get(F.array(*forms), (k % 7).cast("int"))
    made = e.where("balance is not null").select(F.col("acct").alias("doc_id"), F.col("seq").alias("e"), F.posexplode(F.concat(first, extra, own)).alias("i", "line"))
    return made.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("e", "i")).cast("long").alias("seq"), F.floor(F.col("e") / 25).cast("long").alias("page"), "line")


def _read(spark, sf_dir):
    return lines.read_lines(printed(spark, sf_dir))


def _actions(spark, sf_dir):
    return shown(_read(spark, sf_dir).select("doc_id", "seq", "page", "kind", "action", "segment", F.size("money.amounts").cast("long").alias("amounts")))


def _transactions(spark, sf_dir):
    return shown(lines.transactions(lines.drafts(_read(spark, sf_dir))))


def _report(spark, sf_dir):
    return shown(lines.report(lines.drafts(_read(spark, sf_dir))))


def fixed_width(spark, sf_dir) -> DataFrame:
    """Lines of fixed width under a header that stands at another place in each account."""
    e = ledgers.events(spark, sf_dir)
    pad = F.repeat(F.lit(" "), (F.col("acct") % 5).cast("int"))
    side = lambda c: F.lpad(F.when(F.col(c) > 0, F.col(c).cast("string")).otherwise(""), 10, " ")
    line = F.concat(pad, F.date_format("d", "dd-MM-yyyy"), F.lit("  "), F.rpad("description", 22, " "), side("debit"), F.lit("   "), side("credit"), F.lit("   "), F.lpad(F.col("balance").cast("string"), 10, " "))
    return e.select("acct", "seq", F.concat(pad, F.lit(HEADER)).alias("header"), line.alias("line"))


def _sliced(spark, sf_dir):
    rows = fixed_width(spark, sf_dir).withColumn("p", lines.heading_places(F.col("header")))
    return rows.select("acct", "seq", F.col("p.debit.start").cast("long").alias("debit_at"), *[lines.sliced(F.col("line"), F.col("p"), n).alias(n) for n in ("date", "particulars", "debit", "credit", "balance", "chq")])


def _nearest(spark, sf_dir):
    """The column of the first money of each line by its place."""
    rows = fixed_width(spark, sf_dir).withColumn("p", lines.heading_places(F.col("header"))).withColumn("at", F.regexp_instr("line", F.lit(r"\d+\.\d{2}")) - 1)
    centre = lambda n: (F.col(f"p.{n}.start") + F.col(f"p.{n}.end")) / 2
    return rows.select("acct", "seq", lines.nearest_column(F.col("at"), centre("debit"), centre("credit"), centre("balance")).alias("side"))


QUERIES = {"line_actions": _actions, "line_transactions": _transactions, "line_report": _report, "column_slices": _sliced, "column_of_amount": _nearest}

_A, _B = "format('{:,.2f}', amount::DOUBLE)", "format('{:,.2f}', balance::DOUBLE)"
_DAY, _NAME = "strftime(d, '%d-%m-%Y')", "lpad(CAST(day(d) AS VARCHAR), 2, '0') || ' Jan ' || CAST(year(d) AS VARCHAR)"
_FORMS = f"""CASE id % 7 WHEN 0 THEN [{_DAY} || ' ' || description || ' ' || {_A} || ' ' || {_B}] WHEN 1 THEN [{_DAY}, description, {_A} || ' ' || {_B} || ' 4378'] WHEN 2 THEN [{_DAY} || ' ' || description, '0045123 ' || {_A} || ' ' || {_B}] WHEN 3 THEN [{_DAY} || ' ' || description]
  WHEN 4 THEN [{_NAME} || ' ' || description, 'Branch Delhi', {_A} || ' ' || {_B}] WHEN 5 THEN [{_DAY} || ' ' || description || ' ' || {_A} || ' Cr'] ELSE [{_A} || ' ' || {_B}] END"""
_EXTRA = f"CASE WHEN id % 20 = 0 THEN ['{HEADER}'] WHEN id % 23 = 0 THEN ['Page 2 of 9', ''] WHEN id % 29 = 0 THEN ['TRANSACTION TOTAL ' || {_A} || ' ' || {_B}] WHEN id % 31 = 0 THEN ['Closing Balance: ' || {_B}] ELSE [] END"
_MONEY = r"'[^0-9.]([0-9]+(?:,[0-9]+)*\.[0-9]{2})[^0-9.]'"
_CLOSES = r"regexp_matches(rest, '[0-9]+(?:,[0-9]+)*\.[0-9]{2}\s*([cC][rR]|[dD][rR])?$')"
#: Lines are read one after another; a transaction is open or not.
READ = f"""WITH RECURSIVE {EVENTS[5:]}, ev AS (SELECT acct AS doc_id, seq AS e, unnest(CASE WHEN seq = 1 THEN ['OPENING BALANCE: 1,000.00'] ELSE [] END || {_EXTRA} || {_FORMS}) AS line, generate_subscripts(CASE WHEN seq = 1 THEN ['OPENING BALANCE: 1,000.00'] ELSE [] END || {_EXTRA} || {_FORMS}, 1) AS i FROM led
), l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY e, i) AS seq, e // 25 AS page, trim(line) AS line FROM ev
), c AS (SELECT *, regexp_extract(line, '{lines.DATED}') AS date, {hit('line', lines.TOTALS)} AS total, {hit('line', lines.OPENING)} AS opens, {hit('line', lines.CLOSING)} AS closing FROM l
), m AS (SELECT *, trim(line[length(date) + 1:]) AS rest, min(CASE WHEN opens THEN seq END) OVER (PARTITION BY doc_id) AS first FROM c
), n AS (SELECT *, CASE WHEN total THEN [] ELSE regexp_extract_all(replace(' ' || regexp_replace(rest, '^\\d{{5,8}}\\s+', '') || ' ', ' ', '  '), {_MONEY}, 1) END AS am FROM m
), k AS MATERIALIZED (SELECT *, CASE WHEN line = '' THEN 'BLANK' WHEN seq = first THEN 'OPENING' WHEN {hit('lower(line)', lines.HEADING_DATE)} AND {hit('lower(line)', lines.HEADING_ANY)} THEN 'HEADER' WHEN {hit('line', lines.BANNERS)} THEN 'BANNER'
    WHEN date <> '' THEN CASE WHEN full_ THEN 'DATED_AMOUNTS' ELSE 'DATED' END WHEN full_ THEN 'AMOUNTS' ELSE 'TEXT' END AS kind FROM (SELECT *, len(am) >= 2 OR (len(am) = 1 AND {_CLOSES}) AS full_ FROM n)
), w AS (SELECT doc_id, 0::BIGINT AS seq, 0 AS state, 0::BIGINT AS segment, '' AS action FROM (SELECT DISTINCT doc_id FROM k)
  UNION ALL SELECT k.doc_id, k.seq, CASE kind WHEN 'DATED' THEN 1 WHEN 'DATED_AMOUNTS' THEN 0 WHEN 'AMOUNTS' THEN 0 ELSE state END, segment + CASE WHEN kind IN ('DATED', 'DATED_AMOUNTS') THEN 1 ELSE 0 END,
    CASE WHEN kind = 'DATED' THEN 'OPENED' WHEN kind = 'DATED_AMOUNTS' OR (kind = 'AMOUNTS' AND state = 1) THEN 'CLOSED' WHEN kind = 'TEXT' AND state = 1 THEN 'NARRATION' ELSE 'IGNORED' END FROM w JOIN k ON k.doc_id = w.doc_id AND k.seq = w.seq + 1
), r AS MATERIALIZED (SELECT k.*, w.segment, w.action FROM w JOIN k USING (doc_id, seq)
), s AS (SELECT *, CASE WHEN action = 'CLOSED' THEN trim(regexp_replace(regexp_replace(CASE WHEN date = '' THEN line ELSE rest END, '[0-9]+(,[0-9]+)*\\.[0-9]{{2}}', '', 'g'), '\\b4378$', '')) WHEN date <> '' THEN rest ELSE line END AS said FROM r WHERE segment > 0 AND action <> 'IGNORED'
), t AS (SELECT doc_id, segment AS seq, min(page) AS page, arg_min(date, seq) AS date, coalesce(nullif(trim(regexp_replace(string_agg(said, ' ' ORDER BY seq) FILTER (said <> ''), '\\s{{2,}}', ' ', 'g')), ''), 'Bank Transaction') AS description, arg_max(am, seq) FILTER (action = 'CLOSED') AS am, bool_or(action = 'CLOSED') AS closed, arg_max(line, seq) FILTER (action = 'CLOSED') AS ended, bool_or(said <> '') AS told FROM s GROUP BY ALL
), x AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k, len(am) AS n, CAST(replace(am[1], ',', '') AS DECIMAL(18,2)) AS a, CAST(replace(am[-1], ',', '') AS DECIMAL(18,2)) AS st, CASE WHEN regexp_matches(upper(description), '{layout.CREDIT_WORDS}') THEN 1 ELSE -1 END AS g FROM t WHERE closed
), b AS (SELECT doc_id, 0::BIGINT AS k, 1000::DECIMAL(18,2) AS bal, 0 AS side, false AS cont, false AS unsure FROM (SELECT DISTINCT doc_id FROM x)
  UNION ALL SELECT doc_id, k, CAST(CASE WHEN n = 1 THEN prev + g * a ELSE st END AS DECIMAL(18,2)), CASE WHEN n = 1 THEN g WHEN abs(prev + a - st) <= 0.05 THEN 1 WHEN abs(prev - a - st) <= 0.05 THEN -1 WHEN st > prev THEN 1 WHEN st < prev THEN -1 ELSE g END,
    n = 1 OR abs(abs(st - prev) - a) <= 0.05, n = 2 AND abs(abs(st - prev) - a) > 0.05 AND st = prev FROM (SELECT x.*, b.bal AS prev FROM b JOIN x ON x.doc_id = b.doc_id AND x.k = b.k + 1)
), y AS MATERIALIZED (SELECT x.*, b.bal, b.side, b.cont, b.unsure, coalesce(try_strptime(date, '%d-%m-%Y'), try_strptime(date, '%d %b %Y'))::DATE AS d FROM x JOIN b USING (doc_id, k)
), z AS MATERIALIZED (SELECT * FROM (SELECT *, lag((d, a, bal, description, side)) OVER (PARTITION BY doc_id ORDER BY seq) AS before FROM y) WHERE before IS DISTINCT FROM (d, a, bal, description, side))"""
_AT = "strpos(lower(header), '{}') - 1"


def _cut(a: str, b: str) -> str:
    return f"trim(substring(line, CAST({a} AS BIGINT) + 1, CAST({b} AS BIGINT) - CAST({a} AS BIGINT)))"


def _mid(a: str, b: str) -> str:
    centre = lambda n: f"(2 * ({_AT.format(n)}) + {len(n)}) / 2.0"
    return f"floor(({centre(a)} + {centre(b)}) / 2)"


_FIXED = f"{EVENTS}, f AS (SELECT acct, seq, repeat(' ', acct % 5) || '{HEADER}' AS header, repeat(' ', acct % 5) || strftime(d, '%d-%m-%Y') || '  ' || rpad(description, 22, ' ') || lpad(CASE WHEN debit > 0 THEN CAST(debit AS VARCHAR) ELSE '' END, 10, ' ') || '   ' || lpad(CASE WHEN credit > 0 THEN CAST(credit AS VARCHAR) ELSE '' END, 10, ' ') || '   ' || lpad(CAST(balance AS VARCHAR), 10, ' ') AS line FROM led)"
_EDGES = ["0", _mid("tran date", "particulars"), _mid("particulars", "debit"), _mid("debit", "credit"), _mid("credit", "balance"), "length(line)"]
ORACLE_SQL = {
    "line_actions": f"{READ} SELECT doc_id, seq, page, kind, action, segment, CAST(len(am) AS BIGINT) AS amounts FROM r",
    "line_transactions": f"{READ} SELECT doc_id, seq, page, strftime(d, '%Y-%m-%d') AS d, description, CASE WHEN ended LIKE '%4378' THEN '4378' END AS branch, CASE WHEN ended LIKE '0045123 %' THEN '0045123' END AS cheque, CASE WHEN side > 0 THEN 'CREDIT' ELSE 'DEBIT' END AS type, {dbl('a')} AS amount, {dbl('bal')} AS balance, cont AS continuous, unsure AS ambiguous FROM z",
    "line_report": f"""{READ}, q AS (SELECT doc_id, coalesce(sum(a) FILTER (side > 0), 0) AS cr, coalesce(sum(a) FILTER (side < 0), 0) AS dr, count(*) AS n, count(*) FILTER (NOT cont) AS broken, count(*) FILTER (unsure) AS unsure, arg_max(bal, seq) AS ended FROM z GROUP BY doc_id
), cl AS (SELECT doc_id, arg_min(CAST(replace(regexp_extract(line, '{lines.CLOSING}', 1), ',', '') AS DECIMAL(18,2)), seq) AS v FROM r WHERE closing AND kind <> 'OPENING' GROUP BY doc_id
), fr AS (SELECT doc_id, count(*) AS n FROM (SELECT t.*, max(segment_) AS m FROM t JOIN (SELECT doc_id, max(segment) AS segment_ FROM r GROUP BY doc_id) USING (doc_id) WHERE NOT closed AND told GROUP BY ALL) WHERE seq < m GROUP BY doc_id
), o AS (SELECT d.doc_id, coalesce(q.cr, 0) AS cr, coalesce(q.dr, 0) AS dr, coalesce(q.n, 0) AS n, coalesce(broken, 0) AS broken, coalesce(q.unsure, 0) AS unsure, coalesce(fr.n, 0) AS dropped, coalesce(cl.v, q.ended, 1000 + coalesce(q.cr, 0) - coalesce(q.dr, 0)) AS st FROM (SELECT DISTINCT doc_id FROM r) d LEFT JOIN q USING (doc_id) LEFT JOIN cl USING (doc_id) LEFT JOIN fr USING (doc_id))
SELECT doc_id, 1000.0::DOUBLE AS opening_balance, {dbl('st')} AS closing_balance, {dbl('cr')} AS credits, {dbl('dr')} AS debits, n, broken, unsure AS ambiguous, dropped, {dbl('abs(1000 + cr - dr - st)')} AS difference, abs(1000 + cr - dr - st) <= 0.01 AS verified FROM o""",
    "column_slices": f"{_FIXED} SELECT acct, seq, {_AT.format('debit')} AS debit_at, " + ", ".join(f"{_cut(a, b)} AS {n}" for n, a, b in zip(("date", "particulars", "debit", "credit", "balance"), _EDGES, _EDGES[1:], strict=False)) + ", CAST(NULL AS VARCHAR) AS chq FROM f",
    "column_of_amount": f"""{_FIXED}, g AS (SELECT acct, seq, strpos(line, regexp_extract(line, '[0-9]+\\.[0-9]{{2}}')) - 1 AS at_, (2 * ({_AT.format('debit')}) + 5) / 2.0 AS dc, (2 * ({_AT.format('credit')}) + 6) / 2.0 AS cc, (2 * ({_AT.format('balance')}) + 7) / 2.0 AS bc FROM f)
SELECT acct, seq, CASE WHEN abs(at_ - bc) < abs(at_ - dc) AND abs(at_ - bc) < abs(at_ - cc) THEN 'BALANCE' WHEN abs(at_ - dc) < abs(at_ - cc) THEN 'DEBIT' ELSE 'CREDIT' END AS side FROM g""",
}
