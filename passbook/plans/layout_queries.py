"""Queries over positioned tokens derived from line items, and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TYPED_CREDIT
from ..operators import accounts, fraud, integrity, layout
from ..sources import ledgers
from ..sources.tables import items
from .ledger_queries import shown
from .sql import EVENTS, dbl

#: Column ranges of the derived pages.
COLUMNS = [("DATE", 0, 90), ("DESCRIPTION", 90, 215), ("DEBIT", 215, 290), ("CREDIT", 290, 370), ("BALANCE", 370, 470)]


def tokens(spark, sf_dir) -> DataFrame:
    """A token a line item: page of 3 tokens, x by quantity, y by number with some jitter."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    li = items(spark, sf_dir, "l_orderkey").withColumn("tok", F.row_number().over(order).cast("long"))
    x, y = F.col("l_quantity") * 10, F.col("tok") * 5 + F.col("l_partkey") % 3 * 2.0
    return li.select(
        F.col("l_orderkey").alias("doc_id"), F.floor((F.col("tok") + 2) / 3).cast("long").alias("page"), "tok", F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("text"),
        x.alias("x0"), y.alias("y0"), (x + 20).alias("x1"), (y + 4 + F.col("l_suppkey") % 4).alias("y1"), F.col("tok").alias("row"),
    )


TOKENS = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS tok FROM lineitem
), t AS (SELECT l_orderkey AS doc_id, (tok + 2) // 3 AS page, tok, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS text, l_quantity * 10 AS x0, CAST(tok * 5 + l_partkey % 3 * 2 AS DOUBLE) AS y0,
  l_quantity * 10 + 20 AS x1, CAST(tok * 5 + l_partkey % 3 * 2 + 4 + l_suppkey % 4 AS DOUBLE) AS y1 FROM n)"""


def columns(toks: DataFrame) -> DataFrame:
    c = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(n).alias("name"), F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("x1")) for k, (n, a, b) in enumerate(COLUMNS)])
    return toks.select("doc_id", "page").distinct().select("doc_id", "page", F.explode(c).alias("c")).select("doc_id", "page", "c.*")


def headers(spark, sf_dir) -> DataFrame:
    """Pages with a header of some columns, or none."""
    t = tokens(spark, sf_dir)
    k = (F.col("doc_id") + F.col("page") * 7) % 5
    names = F.when(k == 0, F.array(F.lit("DATE"), F.lit("DEBIT"), F.lit("CREDIT"), F.lit("BALANCE"))).when(k == 1, F.array(F.lit("DATE"), F.lit("AMOUNT"))).when(k == 2, F.array(F.lit("DEBIT"), F.lit("CREDIT")))
    return t.select("doc_id", "page").distinct().select("doc_id", "page", names.alias("names"))


NAMES = "CASE (doc_id + page * 7) % 5 WHEN 0 THEN 'DATE,DEBIT,CREDIT,BALANCE' WHEN 1 THEN 'DATE,AMOUNT' WHEN 2 THEN 'DEBIT,CREDIT' END"
HEADERS = TOKENS + f", h AS (SELECT DISTINCT doc_id, page, {NAMES} AS names, CASE (doc_id + page * 7) % 5 WHEN 0 THEN 90 WHEN 1 THEN 30 WHEN 2 THEN 45 END AS score FROM t), best AS (SELECT doc_id, arg_max(page, score * 1000 - page) AS best_page, arg_max(names, score * 1000 - page) AS best_names, max(score) AS score FROM h WHERE names IS NOT NULL GROUP BY doc_id)"


def _assign(spark, sf_dir):
    t = tokens(spark, sf_dir)
    return layout.assign_columns(t, columns(t)).select("doc_id", "tok", "column")


def _bin(spark, sf_dir):
    t = tokens(spark, sf_dir)
    return layout.assign_columns(t, columns(t), default=None).select("doc_id", "tok", "column")


def _text(spark, sf_dir):
    return layout.rows_text(tokens(spark, sf_dir).withColumn("row", F.lit(1).cast("long"))).select("doc_id", "page", "row_text", "x0", "y0", "x1", "y1", "tokens")


def _bounds(spark, sf_dir):
    return layout.column_bounds(tokens(spark, sf_dir).withColumn("name", F.col("tok").cast("string")))


def _regions(spark, sf_dir):
    return layout.regions(tokens(spark, sf_dir), F.lit(45.0)).select("doc_id", "tok", "region")


def _zone(spark, sf_dir):
    t = tokens(spark, sf_dir)
    return layout.table_zone(t, t.where("tok % 3 = 1").select("doc_id", "page", F.col("y1").alias("header_y1"))).select("doc_id", "tok")


def _right(spark, sf_dir):
    t = tokens(spark, sf_dir)
    return layout.values_right_of(t, t.where("tok % 3 = 2"))


def _clusters(spark, sf_dir):
    return layout.cluster_rows(tokens(spark, sf_dir).withColumn("page", F.lit(1).cast("long")))


def _decimals(spark, sf_dir):
    t = tokens(spark, sf_dir)
    even = F.col("tok") % 2 == 0
    cells = t.select("doc_id", F.lit(1).cast("long").alias("page"), F.lit(1).cast("long").alias("row"), F.lit("DEBIT").alias("column"), "tok", F.when(even, F.lpad((F.col("tok") * 7).cast("string"), 2, "0")).otherwise((F.col("tok") * 31).cast("string")).alias("text"), (F.col("tok") * 30 + F.when(even, -8).otherwise(0)).cast("double").alias("x0"), (F.col("tok") * 30 + 20).cast("double").alias("x1"))
    return layout.join_decimals(cells).select("doc_id", "cell")


def _points(spark, sf_dir):
    return layout.to_points(tokens(spark, sf_dir), 30.0, 400.0, 30.0, 0.25, 0.5).select("doc_id", "tok", "x0", "y0", "x1", "y1")


def raw_rows(spark, sf_dir) -> DataFrame:
    """Ledger rows with blanks, as a page gives them: money in the columns of sides, in a general column, or inside the narration; headers and footers between."""
    e = ledgers.events(spark, sf_dir)
    k, form = F.col("id") % 6, F.col("id") % 4
    put = lambda value, test: F.coalesce(F.when(test, value.cast("string")), F.lit(""))
    by_side = (k != 5) & (form < 2)
    general = F.concat(F.col("amount").cast("string"), F.when((F.col("type") == "CREDIT") & (F.col("id") % 8 == 2), " Cr").otherwise(""))
    text = F.when(F.col("id") % 17 == 0, "Opening balance: 1,200.00").when(F.col("id") % 19 == 0, "Date Particulars Debit Credit Balance").otherwise("row")
    return e.select(
        F.col("acct").alias("doc_id"), "seq", F.floor(F.col("seq") / 20).cast("long").alias("page"), F.when(k.isin(0, 1), F.col("d")).alias("d"),
        F.when((form == 3) & (k == 1), F.concat_ws(" ", "description", F.format_number("amount", 2), F.lit("paid"))).otherwise(F.col("description")).alias("description"),
        put(F.col("debit"), by_side & (F.col("debit") > 0)).alias("debit_raw"), put(F.col("credit"), by_side & (F.col("credit") > 0)).alias("credit_raw"),
        put(general, (k != 5) & (form == 2) & (F.col("amount") > 0)).alias("amount_raw"), put(F.lit("CREDIT"), F.col("id") % 5 == 0).alias("dr_cr_raw"), put(F.col("balance"), k.isin(0, 2, 3)).alias("balance_raw"), text.alias("row_text"),
    )


def _actions(spark, sf_dir):
    return shown(layout.audit(layout.reconstruct(raw_rows(spark, sf_dir))))


def _drafts(spark, sf_dir):
    return shown(layout.finalize(layout.reconstruct(raw_rows(spark, sf_dir))))


def _by_page(spark, sf_dir):
    actions = layout.reconstruct(raw_rows(spark, sf_dir))
    return shown(layout.audit_pages(actions, layout.finalize(actions)))


#: A recursion over the rows of each account: draft number, and whether the open draft has an amount and a printed balance.
RAW = rf"""WITH RECURSIVE {EVENTS[5:]}, r AS MATERIALIZED (SELECT acct AS doc_id, seq, seq // 20 AS page, CASE WHEN id % 17 = 0 THEN 'FOOTER' WHEN id % 19 = 0 THEN 'HEADER' ELSE 'ROW' END AS kind, CASE WHEN id % 6 IN (0, 1) THEN d END AS d,
  CASE WHEN id % 4 = 3 AND id % 6 = 1 THEN description || ' ' || format('{{:,.2f}}', amount::DOUBLE) || ' paid' ELSE description END AS description,
  CASE WHEN id % 6 <> 5 AND id % 4 < 2 AND debit > 0 THEN debit END AS dr, CASE WHEN id % 6 <> 5 AND id % 4 < 2 AND credit > 0 THEN credit END AS cr, CASE WHEN id % 6 <> 5 AND id % 4 = 2 AND amount > 0 THEN amount END AS am,
  CASE WHEN type = 'CREDIT' AND id % 8 = 2 THEN 1 ELSE 0 END AS marked, CASE WHEN id % 5 = 0 THEN 'CREDIT' END AS side, CASE WHEN id % 6 IN (0, 2, 3) THEN balance END AS bal FROM led
), w AS (SELECT doc_id, 0::BIGINT AS seq, 0 AS seg, false AS has_a, false AS has_b, NULL::DATE AS date, '' AS action FROM (SELECT DISTINCT doc_id FROM r)
  UNION ALL SELECT doc_id, seq, CASE WHEN opens THEN seg + 1 ELSE seg END, CASE WHEN opens THEN a WHEN fills THEN has_a OR a ELSE has_a END, CASE WHEN opens THEN b WHEN fills THEN has_b OR b ELSE has_b END, CASE WHEN dated THEN d ELSE date END,
    CASE WHEN kind = 'HEADER' THEN 'HEADER_ROW_REMOVED' WHEN kind = 'FOOTER' THEN 'NON_TRANSACTION_ROW_REMOVED' WHEN dated THEN 'ACCEPTED_DATE_ROW' WHEN opens THEN 'ACCEPTED_SAME_DAY_ROW' WHEN a OR b THEN CASE WHEN seg > 0 THEN 'MERGED_AMOUNT_ROW' ELSE 'REJECTED_UNATTACHED_AMOUNT' END WHEN seg > 0 THEN 'MERGED_CONTINUATION_ROW' ELSE 'REJECTED_UNATTACHED_TEXT' END
  FROM (SELECT *, dated OR (kind = 'ROW' AND (a OR b) AND seg > 0 AND has_a AND has_b) AS opens, kind = 'ROW' AND seg > 0 AND NOT dated AND (a OR b) AS fills FROM (
    SELECT r.*, w.seg, w.has_a, w.has_b, w.date, kind = 'ROW' AND r.d IS NOT NULL AS dated, coalesce(dr, cr, am) IS NOT NULL AS a, bal IS NOT NULL AS b FROM w JOIN r ON r.doc_id = w.doc_id AND r.seq = w.seq + 1))
), acts AS MATERIALIZED (SELECT w.*, r.page, r.description, dr, cr, am, marked, side, bal FROM w JOIN r USING (doc_id, seq)
), g AS (SELECT doc_id, seg, min(date) AS d, arg_min(page, seq) AS page, trim(string_agg(description, ' ' ORDER BY seq)) AS description, arg_min(dr, seq) FILTER (f AND dr IS NOT NULL) AS dr, arg_min(cr, seq) FILTER (f AND cr IS NOT NULL) AS cr, arg_min(am, seq) FILTER (f AND am IS NOT NULL) AS am,
    arg_min(marked, seq) FILTER (f AND am IS NOT NULL) AS marked, arg_min(side, seq) FILTER (f AND side IS NOT NULL) AS side, arg_min(bal, seq) FILTER (f AND bal IS NOT NULL) AS bal
  FROM (SELECT *, action <> 'MERGED_CONTINUATION_ROW' AS f FROM acts WHERE seg > 0 AND action NOT LIKE '%REMOVED' AND action NOT LIKE 'REJECTED%') GROUP BY ALL
), h AS (SELECT *, TRY_CAST(replace(regexp_extract(description, '\d{{1,3}}(?:,\d{{3}})*(?:\.\d{{2}})'), ',', '') AS DECIMAL(18,2)) AS inside FROM g
), k AS (SELECT *, coalesce(dr, cr, am, inside) AS amt, last_value(bal IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM h WHERE coalesce(dr, cr, am, inside) > 0
), t AS (SELECT *, CASE WHEN dr IS NOT NULL THEN 'DEBIT' WHEN cr IS NOT NULL THEN 'CREDIT' WHEN abs(abs(bal - prev) - amt) <= 0.05 AND bal > prev THEN 'CREDIT' WHEN abs(abs(bal - prev) - amt) <= 0.05 AND bal < prev THEN 'DEBIT' WHEN side = 'CREDIT' THEN 'CREDIT' WHEN am IS NOT NULL AND marked = 1 THEN 'CREDIT'
    WHEN regexp_matches(lower(description), '{TYPED_CREDIT}') THEN 'CREDIT' ELSE 'DEBIT' END AS type, CAST(amt AS VARCHAR) AS sa, CAST(abs(bal - prev) AS VARCHAR) AS sb FROM k
), fin AS (SELECT *, coalesce(((type = 'DEBIT' AND bal < prev) OR (type = 'CREDIT' AND bal > prev)) AND length(sa) = length(sb) AND len(list_filter(range(1, length(sa) + 1), lambda i: sa[i] <> sb[i])) = 1, false) AS fix FROM t)"""


def _sides(spark, sf_dir):
    e = ledgers.events(spark, sf_dir)
    raw = F.concat(F.col("amount").cast("string"), F.when(F.col("id") % 3 == 0, " Cr").when(F.col("id") % 3 == 1, "").otherwise(" DR"))
    rows = e.select("id", raw.alias("raw"), F.when(F.col("id") % 4 == 0, "CREDIT").when(F.col("id") % 4 == 1, "Dr").alias("column_type"), "description", F.when(F.col("id") % 5 == 0, F.lit(100).cast("decimal(18,2)")).alias("prev_balance"), F.when(F.col("id") % 10 == 0, F.col("amount") + 100).when(F.col("id") % 10 == 5, 100 - F.col("amount")).alias("balance"))
    return shown(layout.classify_side(rows).select("id", "side", "amount"))


def statement_lines(spark, sf_dir) -> DataFrame:
    """Printed statements: a dated line a transaction, and a second line for some."""
    e = ledgers.events(spark, sf_dir).where("balance is not null")
    first = F.concat(F.date_format("d", "dd-MM-yyyy"), F.lit(" "), F.lit("entry "), F.col("type"), F.lit(" "), F.when(F.col("id") % 2 == 0, F.concat(F.format_number("amount", 2), F.lit(" "), F.format_number("balance", 2))).otherwise(""))
    second = F.when(F.col("id") % 2 == 1, F.concat(F.format_number("amount", 2), F.lit(" "), F.format_number("balance", 2)))
    lines = F.array_compact(F.array(F.struct((F.col("seq") * 2).alias("seq"), first.alias("line")), F.when(second.isNotNull(), F.struct((F.col("seq") * 2 + 1).alias("seq"), second.alias("line")))))
    return e.select(F.col("acct").alias("doc_id"), F.explode(lines).alias("l")).select("doc_id", "l.*")


def _lines(spark, sf_dir):
    return shown(layout.resolve_line_amounts(layout.parse_lines(statement_lines(spark, sf_dir)), 1000.0).select("doc_id", "seq", "amount", "balance"))


def printed_amounts(spark, sf_dir) -> DataFrame:
    """Transactions with none to three printed amounts, some of which do not explain the balance."""
    e = ledgers.events(spark, sf_dir)
    m = lambda x: F.lit(x).cast("decimal(18,2)")
    a, b = F.col("amount"), F.col("balance")
    forms = [F.array().cast("array<decimal(18,2)>"), F.array(a), F.array(a, b), F.array(m(7), a, b), F.array(a, m(0), b), F.array(a, (b + 3).cast("decimal(18,2)")), F.array(m(0), a, (b - 9).cast("decimal(18,2)")), F.array(a, a, (b + 40).cast("decimal(18,2)"))]
    return e.select(F.col("acct").alias("doc_id"), "seq", "description", F.when(F.col("id") % 11 == 0, "CREDIT").alias("hint"), F.get(F.array(*forms), (F.col("id") % 8).cast("int")).alias("amounts"))


def _financials(spark, sf_dir):
    return shown(layout.resolve_line_amounts(printed_amounts(spark, sf_dir)))


def _row_kinds(spark, sf_dir):
    t = F.array(*[F.lit(x) for x in ("Date Particulars Debit Credit Balance", "Opening balance: 1,200.00", "UPI/P2M/Swiggy 12.00", "Page 2 of 9", "Total deposits 44", "carried forward: 3", "details amount")])
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", layout.row_kind(F.get(t, (F.col("p_partkey") % 7).cast("int"))).alias("kind"))


def report(spark, sf_dir) -> DataFrame:
    """One nested result an account, as JSON: summary, months, categories, risk, rules that triggered, integrity."""
    led = ledgers.events(spark, sf_dir)
    one = lambda df, name: df.select("acct", F.struct(*[F.col(c) for c in df.columns if c != "acct"]).alias(name))
    many = lambda df, name, key: df.select("acct", F.struct(key, *[c for c in df.columns if c not in ("acct", key)]).alias("r")).groupBy("acct").agg(F.array_sort(F.collect_list("r")).alias(name))
    out = one(accounts.summary(led), "summary")
    parts = [many(accounts.monthly_cash_flow(led), "monthly_cash_flow", "month"), many(accounts.category_rollup(led), "categories", "first_seq"), one(accounts.risk_profile(led), "risk"), many(fraud.evaluate(led).where("triggered"), "fraud", "rule_id"), one(integrity.status(led), "integrity")]
    for p in parts:
        out = out.join(p, "acct", "left")
    return out.select("acct", F.to_json(F.struct(*[c for c in out.columns if c != "acct"])).alias("report"))


QUERIES = {
    "column_assign": _assign, "column_bin": _bin, "row_text": _text, "column_bounds": _bounds, "region_segment": _regions, "table_zone": _zone,
    "dominant_schema": lambda spark, sf_dir: shown(layout.dominant_schema(headers(spark, sf_dir))), "schema_forward_fill": lambda spark, sf_dir: layout.inherit_schema(headers(spark, sf_dir)), "horizontal_values": _right,
    "y_bucket_cluster": lambda spark, sf_dir: layout.bucket_rows(tokens(spark, sf_dir).withColumn("page", F.lit(1).cast("long"))), "row_cluster": _clusters, "decimal_token_join": _decimals, "coord_transform": _points, "row_kind": _row_kinds,
    "ledger_state_machine": _actions, "ledger_drafts": _drafts, "ledger_page_audit": _by_page, "debit_credit_signals": _sides, "line_statement": _lines, "resolve_financials": _financials, "report_json": report,
}

_COL = "CASE " + " ".join(f"WHEN (x0 + x1) / 2 BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in COLUMNS) + " END"
_COUNTS = ", ".join(f"count(*) FILTER (action = '{n}') AS {n.lower()}" for n in [*layout.ACTIONS, *layout.REMOVED.values()])
ORACLE_SQL = {
    "column_assign": f"{TOKENS} SELECT doc_id, tok, coalesce({_COL}, 'DESCRIPTION') AS \"column\" FROM t",
    "column_bin": f"{TOKENS} SELECT doc_id, tok, {_COL} AS \"column\" FROM t WHERE {_COL} IS NOT NULL",
    "row_text": f"{TOKENS} SELECT doc_id, page, string_agg(text, ' ' ORDER BY x0, tok) AS row_text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS tokens FROM t GROUP BY doc_id, page",
    "column_bounds": f"{TOKENS} SELECT doc_id, page, CAST(tok AS VARCHAR) AS name, row_number() OVER w - 1 AS ord, coalesce((lag(x1) OVER w + x0) / 2, 0.0) AS lo, coalesce((x1 + lead(x0) OVER w) / 2, 10000.0) AS hi FROM t WINDOW w AS (PARTITION BY doc_id, page ORDER BY x0, tok)",
    "region_segment": f"""{TOKENS}, r AS (SELECT doc_id, tok, page, y0 / 45.0 AS rel FROM t) SELECT doc_id, tok, 'HEADER' AS region FROM r WHERE page = 1 AND rel < 0.15 UNION ALL SELECT doc_id, tok, 'ACCOUNT_INFORMATION' FROM r WHERE page = 1 AND rel >= 0.15 AND rel < 0.38
UNION ALL SELECT doc_id, tok, 'TRANSACTION_TABLE' FROM r WHERE (page = 1 AND rel >= 0.38 AND rel < 0.88) OR (page > 1 AND rel >= 0.08 AND rel < 0.92) UNION ALL SELECT doc_id, tok, u.region FROM r, (VALUES ('SUMMARY'), ('FOOTER')) u(region) WHERE rel >= 0.88""",
    "table_zone": f"{TOKENS} SELECT a.doc_id, a.tok FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.page = b.page AND b.tok % 3 = 1 WHERE a.y0 >= b.y1 - 2",
    "dominant_schema": f"{HEADERS} SELECT doc_id, best_page, best_names, CAST(score AS BIGINT) AS score FROM best",
    "schema_forward_fill": f"{HEADERS} SELECT doc_id, page, coalesce(names, last_value(names IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), best_names) AS names, CASE WHEN names IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS confidence FROM h LEFT JOIN best USING (doc_id)",
    "horizontal_values": f"""{TOKENS}, j AS (SELECT a.doc_id, a.page, b.tok AS label, a.text, a.x0, a.tok, row_number() OVER (PARTITION BY a.doc_id, a.page, b.tok ORDER BY a.tok) AS k FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.page = b.page AND b.tok % 3 = 2 AND a.tok <> b.tok
  WHERE a.x0 BETWEEN b.x1 - 2 AND b.x1 + 350 AND abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) <= greatest(8, b.y1 - b.y0) * 0.85) SELECT doc_id, page, label, string_agg(text, ' ' ORDER BY x0, tok) AS value FROM j WHERE k <= 3 GROUP BY ALL""",
    "y_bucket_cluster": f"""WITH RECURSIVE {TOKENS[5:]}, o AS (SELECT doc_id, tok, y0, row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0, tok) AS k FROM t
), w AS (SELECT doc_id, tok, k, floor(y0) AS anchor FROM o WHERE k = 1 UNION ALL SELECT o.doc_id, o.tok, o.k, CASE WHEN abs(o.y0 - w.anchor) <= 8 THEN w.anchor ELSE floor(o.y0) END FROM w JOIN o ON o.doc_id = w.doc_id AND o.k = w.k + 1) SELECT doc_id, CAST(1 AS BIGINT) AS page, tok, anchor FROM w""",
    "decimal_token_join": f"""{TOKENS}, c AS (SELECT doc_id, tok, CASE WHEN tok % 2 = 0 THEN lpad(CAST(tok * 7 AS VARCHAR), 2, '0') ELSE CAST(tok * 31 AS VARCHAR) END AS x FROM t), p AS (SELECT doc_id, tok, x, lead(x) OVER w AS nx, lead(tok) OVER w AS nt, lag(tok) OVER w AS pt FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY tok))
SELECT doc_id, string_agg(CASE WHEN tok % 2 = 1 AND nt = tok + 1 THEN x || '.' || nx ELSE x END, ' ' ORDER BY tok) AS cell FROM p WHERE NOT (tok % 2 = 0 AND pt IS NOT NULL AND pt = tok - 1) GROUP BY doc_id""",
    "coord_transform": f"{TOKENS} SELECT doc_id, tok, round(greatest(0, least(400, x0 - 30)) * 0.25, 2) AS x0, round(greatest(0, least(30, y0 - 30)) * 0.5, 2) AS y0, round(greatest(0, least(400, x1 - 30)) * 0.25, 2) AS x1, round(greatest(0, least(30, y1 - 30)) * 0.5, 2) AS y1 FROM t",
    "row_kind": "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'HEADER' WHEN 2 THEN 'ROW' WHEN 6 THEN 'HEADER' ELSE 'FOOTER' END AS kind FROM part",
    "debit_credit_signals": f"""{EVENTS}, s AS (SELECT *, id % 3 AS m, id % 4 AS c FROM led)
SELECT id, CASE WHEN amount = 0 THEN 'DEBIT' WHEN id % 10 = 0 THEN 'CREDIT' WHEN id % 10 = 5 THEN 'DEBIT' WHEN c = 0 THEN 'CREDIT' WHEN m = 0 THEN 'CREDIT' WHEN m = 2 THEN 'DEBIT'
  WHEN regexp_matches(lower(description), '\\b(salary|payroll|refund|credit|reversed|inward|interest\\s*credit)\\b') THEN 'CREDIT' ELSE 'DEBIT' END AS side, {dbl('amount')} AS amount FROM s""",
    # A recursion over the rows of each account, one case after the other; Spark's plan is a running sum.
    "resolve_financials": f"""WITH RECURSIVE {EVENTS[5:]}, x AS (SELECT acct, seq, id % 8 AS k, CASE WHEN id % 8 = 0 THEN 0 WHEN id % 8 = 1 THEN 1 WHEN id % 8 IN (2, 5) THEN 2 ELSE 3 END AS n, CASE id % 8 WHEN 3 THEN 7 WHEN 6 THEN 0 ELSE amount END AS a1, CASE id % 8 WHEN 4 THEN 0 ELSE amount END AS a2,
  balance + CASE id % 8 WHEN 5 THEN 3 WHEN 6 THEN -9 WHEN 7 THEN 40 ELSE 0 END AS st, CASE WHEN id % 11 = 0 OR regexp_matches(upper(description), '{layout.CREDIT_WORDS}') THEN 1 ELSE -1 END AS g FROM led
), w AS (SELECT acct, CAST(0 AS BIGINT) AS seq, 0 AS n, 0 AS side, CAST(NULL AS DECIMAL(18,2)) AS amount, CAST(NULL AS DECIMAL(18,2)) AS bal, false AS cont, false AS unsure FROM (SELECT DISTINCT acct FROM x)
  UNION ALL SELECT acct, seq, n, side, CAST(amount AS DECIMAL(18,2)), CAST(CASE n WHEN 0 THEN prev WHEN 1 THEN prev + side * amount ELSE st END AS DECIMAL(18,2)), cont, unsure FROM (
    SELECT *, CASE WHEN n = 0 THEN -1 WHEN n = 1 THEN g WHEN prev IS NULL AND n = 2 THEN g WHEN prev IS NULL THEN CASE WHEN a1 > 0 AND a2 = 0 THEN -1 WHEN a2 > 0 AND a1 = 0 THEN 1 ELSE g END WHEN fit > 0 THEN CASE WHEN abs(prev + f - st) <= 0.05 THEN 1 ELSE -1 END WHEN st > prev THEN 1 WHEN st < prev OR n = 3 THEN -1 ELSE g END AS side,
      CASE WHEN n = 0 THEN 0 WHEN n <= 2 THEN a1 WHEN fit > 0 THEN f WHEN prev IS NOT NULL THEN a2 WHEN a1 > 0 AND a2 = 0 THEN a1 WHEN a2 > 0 AND a1 = 0 THEN a2 WHEN g = 1 THEN coalesce(nullif(a2, 0), a1) ELSE coalesce(nullif(a1, 0), a2) END AS amount,
      CASE WHEN n = 0 THEN false WHEN n = 1 THEN true WHEN prev IS NOT NULL THEN fit > 0 ELSE n = 2 OR (a1 > 0) <> (a2 > 0) END AS cont, n = 0 OR (n = 2 AND coalesce(st = prev AND fit = 0, false)) OR (n = 3 AND prev IS NULL AND NOT (a1 > 0) <> (a2 > 0)) AS unsure
    FROM (SELECT *, CASE fit WHEN 2 THEN a2 ELSE a1 END AS f FROM (SELECT x.*, w.bal AS prev, CASE WHEN w.bal IS NULL OR x.n < 2 THEN 0 WHEN x.n = 3 AND a2 > 0 AND abs(abs(st - w.bal) - a2) <= 0.05 THEN 2 WHEN (x.n = 2 OR a1 > 0) AND abs(abs(st - w.bal) - a1) <= 0.05 THEN 1 ELSE 0 END AS fit FROM w JOIN x ON x.acct = w.acct AND x.seq = w.seq + 1))))
SELECT acct AS doc_id, seq, CASE WHEN side > 0 THEN 'CREDIT' ELSE 'DEBIT' END AS type, {dbl('amount')} AS amount, {dbl('bal')} AS balance, cont AS continuous, unsure AS ambiguous FROM w WHERE seq > 0""",
    "ledger_state_machine": f"{RAW} SELECT doc_id, count(*) AS candidates, {_COUNTS} FROM acts GROUP BY doc_id",
    "ledger_page_audit": f"{RAW} SELECT doc_id, page, count(*) AS candidates, {_COUNTS}, coalesce(any_value(n), 0) AS transactions FROM acts LEFT JOIN (SELECT doc_id, page, count(*) AS n FROM fin GROUP BY ALL) USING (doc_id, page) GROUP BY doc_id, page",
    "ledger_drafts": f"{RAW} SELECT doc_id, CAST(seg AS BIGINT) AS segment, page, strftime(d, '%Y-%m-%d') AS d, description, type, CAST(CASE WHEN fix THEN abs(bal - prev) ELSE amt END AS DOUBLE) AS amount, CAST(bal AS DOUBLE) AS balance, fix AS corrected FROM fin",
    "line_statement": f"{EVENTS} SELECT acct AS doc_id, seq, {dbl('amount')} AS amount, {dbl('abs(balance)')} AS balance FROM led",
}
