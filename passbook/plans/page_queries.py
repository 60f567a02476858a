"""Queries over pages of words derived from line items: rows, headings, schemas; and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.narration import HEADING_ENDS, HEADINGS, NOTICES, WHOLE_HEADINGS
from ..operators import headers, layout
from ..sources.tables import items
from . import layout_queries
from .sql import case, hit

WORDS = ["Date", "Value", "Particulars", "Debit", "Credit", "Balance", "Withdrawal", "(Dr)", "Deposit", "Amount", "Ref", "No", "shop", "12.00", "Cheque", "Paid", "out", "Txn", "details", "of"]


def words(spark, sf_dir) -> DataFrame:
    """A word a line item: a document a part, pages of two lines of five words, tops with some jitter."""
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    li = items(spark, sf_dir, "l_partkey").withColumn("tok", F.row_number().over(order).cast("long"))
    spot = (F.col("tok") - 1) % 10
    x, y = (spot % 5) * 60 + F.col("l_quantity") % 10, F.floor(spot / 5) * 20 + (F.col("l_suppkey") % 4) * 2.0
    text = F.get(F.array(*map(F.lit, WORDS)), ((F.col("l_suppkey") * 7 + F.col("l_linenumber") * 5 + F.col("tok")) % len(WORDS)).cast("int"))
    return li.select(F.col("l_partkey").alias("doc_id"), F.floor((F.col("tok") + 9) / 10).cast("long").alias("page"), "tok", text.alias("text"), x.alias("x0"), y.alias("y0"), (x + 40).alias("x1"), (y + 9).alias("y1"))


T = f"""n AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS tok FROM lineitem
), t AS (SELECT doc_id, (tok + 9) // 10 AS page, tok, text, x AS x0, y AS y0, x + 40 AS x1, y + 9 AS y1 FROM (SELECT l_partkey AS doc_id, tok, list_extract({WORDS}, CAST(1 + (l_suppkey * 7 + l_linenumber * 5 + tok) % {len(WORDS)} AS BIGINT)) AS text, ((tok - 1) % 5) * 60 + l_quantity % 10 AS x, ((tok - 1) % 10 // 5) * 20 + (l_suppkey % 4) * 2.0::DOUBLE AS y FROM n))"""


def pages(spark, sf_dir) -> DataFrame:
    """Text of each page; some are notices."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok", "text"))), lambda t: t["text"]), " ")
    notice = F.when((F.col("doc_id") + F.col("page")) % 4 == 0, F.concat(F.lit(" "), F.get(F.array(*map(F.lit, NOTICES)), (F.col("doc_id") % len(NOTICES)).cast("int")))).otherwise("")
    return words(spark, sf_dir).groupBy("doc_id", "page").agg(text.alias("raw_text")).withColumn("raw_text", F.concat("raw_text", notice))


def _headers(spark, sf_dir):
    return headers.page_headers(words(spark, sf_dir)).select("doc_id", "page", "y0", "y1", "raw_text", "score", "confidence", F.inline("columns"))


def _names(columns: str = "columns"):
    return F.array_join(F.transform(columns, lambda c: c["name"]), ",").alias("names")


def _schemas(spark, sf_dir):
    return headers.page_schemas(headers.page_headers(words(spark, sf_dir)), pages(spark, sf_dir)).withColumn("columns", _names())


def _bands(spark, sf_dir):
    return headers.band_headers(words(spark, sf_dir)).select("doc_id", "page", "bottom", F.array_join("headings", ",").alias("headings"), F.inline("columns"))


def _one_page(spark, sf_dir):
    return layout_queries.tokens(spark, sf_dir).withColumn("page", F.lit(1).cast("long"))


QUERIES = {
    "token_page_text": lambda spark, sf_dir: layout.page_text(words(spark, sf_dir)),
    "page_headers": _headers, "page_schemas": _schemas, "band_headers": _bands,
    "row_slices": lambda spark, sf_dir: layout.row_slices(_one_page(spark, sf_dir)),
    "visual_lines": lambda spark, sf_dir: layout.visual_lines(_one_page(spark, sf_dir)),
    "reading_order": lambda spark, sf_dir: layout.reading_order(_one_page(spark, sf_dir)),
}


def _heading(x: str) -> str:
    return case([(hit(f"lower(trim({x}))", p), f"'{n}'") for n, p in HEADINGS], "NULL")


_ENDS = ", ".join(f"'{w}'" for w in HEADING_ENDS)
#: Each line word by word; then phrases, the best line of each page, and ranges.
_HEADERS = f"""WITH RECURSIVE {T}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, tok) AS k FROM t
), a AS (SELECT doc_id, page, tok, k, floor(y0) AS anchor FROM o WHERE k = 1 UNION ALL SELECT o.doc_id, o.page, o.tok, o.k, CASE WHEN abs(o.y0 - a.anchor) <= 8 THEN a.anchor ELSE floor(o.y0) END FROM a JOIN o ON o.doc_id = a.doc_id AND o.page = a.page AND o.k = a.k + 1
), w AS MATERIALIZED (SELECT *, {_heading("text")} AS own, CASE WHEN after IS NOT NULL THEN {_heading("text || ' ' || after")} END AS pair, lower(text) IN ({_ENDS}) AS ends FROM (
  SELECT t.*, anchor, lead(text) OVER l AS after, row_number() OVER l AS i FROM t JOIN a USING (doc_id, page, tok) WINDOW l AS (PARTITION BY doc_id, page, anchor ORDER BY x0, y0, tok))
), f AS (SELECT doc_id, page, anchor, i, coalesce(own, pair) AS name, pair, own IS NULL AND pair IS NOT NULL AS takes, i AS began, x0, x1 FROM w WHERE i = 1
  UNION ALL SELECT doc_id, page, anchor, i, CASE WHEN goes THEN name ELSE begun END, pair, NOT goes AND own IS NULL AND pair IS NOT NULL, CASE WHEN goes THEN began ELSE i END, x0, x1 FROM (
    SELECT w.doc_id, w.page, w.anchor, w.i, w.own, w.pair, coalesce(w.own, w.pair) AS begun, w.x0, w.x1, f.name, f.began, f.takes OR (f.name IS NOT NULL AND CASE WHEN w.own IS NOT NULL THEN w.own = f.name ELSE w.ends OR coalesce(f.pair = f.name, false) END) AS goes
    FROM f JOIN w ON w.doc_id = f.doc_id AND w.page = f.page AND w.anchor = f.anchor AND w.i = f.i + 1)
), ph AS (SELECT * FROM (SELECT doc_id, page, anchor, began, name, arg_min(x0, i) AS x0, arg_max(x1, i) AS x1 FROM f WHERE name IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, page, anchor, name ORDER BY began) = 1
), ln AS (SELECT doc_id, page, anchor, list(name ORDER BY began) AS names FROM ph GROUP BY ALL
), sc AS (SELECT *, len(names) * 10 + CASE WHEN list_contains(names, 'DEBIT') AND list_contains(names, 'CREDIT') THEN 15 ELSE 0 END + CASE WHEN list_contains(names, 'BALANCE') THEN 10 ELSE 0 END + CASE WHEN list_contains(names, 'DATE') THEN 10 ELSE 0 END AS score FROM ln
  WHERE (list_contains(names, 'DATE') AND len(list_intersect(names, ['DESCRIPTION', 'REFERENCE', 'DEBIT', 'CREDIT', 'AMOUNT', 'BALANCE'])) > 0) OR (len(list_intersect(names, ['DESCRIPTION', 'REFERENCE'])) > 0 AND len(names) >= 3)
), hd AS MATERIALIZED (SELECT sc.*, y0, y1, raw_text, round(least(1.0, 0.4 + 0.15 * len(names)), 2)::DOUBLE AS confidence FROM (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY score DESC, anchor) = 1) sc JOIN (SELECT doc_id, page, anchor, min(y0) AS y0, max(y1) AS y1, string_agg(text, ' ' ORDER BY x0, y0, tok) AS raw_text FROM w GROUP BY ALL) USING (doc_id, page, anchor))"""
_GROWN = "CASE WHEN c IS NULL THEN list_append({v}, {x}) ELSE list_transform({v}, lambda v, j: CASE WHEN j = c THEN {f}(v, {x}) ELSE v END) END"
_T1 = layout_queries.TOKENS[5:]


def _rows_sql(order: str, grow: str, best: str, down: bool = False) -> str:
    """Lines gathered token by token; lists hold their tops (and ends), ``row`` the place of a token's line among them when all are known."""
    sign = "-" if down else ""
    return f"""WITH RECURSIVE {_T1}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS k FROM t
), w AS (SELECT doc_id, k, [y0] AS lo, [y1] AS hi, 1 AS c, 1 AS line FROM o WHERE k = 1 UNION ALL SELECT doc_id, k, {grow}, coalesce(c, len(lo) + 1) FROM (SELECT o.doc_id, o.k, o.y0, o.y1, w.lo, w.hi, {best} AS c FROM w JOIN o ON o.doc_id = w.doc_id AND o.k = w.k + 1)
), e AS (SELECT doc_id, arg_max(lo, k) AS tops FROM w GROUP BY doc_id)
SELECT doc_id, CAST(1 AS BIGINT) AS page, tok, 1 + len(list_filter(list_transform(tops, lambda v, j: {{'v': {sign}v, 'j': j}}), lambda s: s.v < {sign}tops[line] OR (s.v = {sign}tops[line] AND s.j < line))) AS row FROM w JOIN o USING (doc_id, k) JOIN e USING (doc_id)"""


_LO = _GROWN.format(v="lo", x="y0", f="least")
_MOVING, _FIXED = (f"{lo}, hi, c" for lo in (_LO, "CASE WHEN c IS NULL THEN list_append(lo, y0) ELSE lo END"))
_NEAR = "list_filter(range(1, len(w.lo) + 1), lambda j: abs(w.lo[j] - o.y0) <= {})[1]"
_BEST = """list_sort(list_filter(list_transform(range(1, len(w.lo) + 1), lambda j: {'away': abs((o.y0 + o.y1) / 2 - (w.lo[j] + w.hi[j]) / 2), 'j': j, 'fits': greatest(0, least(o.y1, w.hi[j]) - greatest(o.y0, w.lo[j])) / least(greatest(o.y1 - o.y0, 6), greatest(w.hi[j] - w.lo[j], 6)) >= 0.35 OR abs((o.y0 + o.y1) / 2 - (w.lo[j] + w.hi[j]) / 2) <= 3.5}), lambda s: s.fits))[1].j"""

_SCHEMA_SCORE = "len(names) * 10 + CASE WHEN list_contains(names, 'DEBIT') AND list_contains(names, 'CREDIT') THEN 25 ELSE 0 END + CASE WHEN list_contains(names, 'BALANCE') THEN 15 ELSE 0 END + CASE WHEN list_contains(names, 'DATE') THEN 10 ELSE 0 END"
_NOTICE = "list_extract([" + ", ".join(f"'{p}'" for p in NOTICES) + f"], CAST(1 + doc_id % {len(NOTICES)} AS BIGINT))"
_WHOLE = case([(hit("text", p), f"'{n}'") for n, p in WHOLE_HEADINGS], "NULL")

ORACLE_SQL = {
    "token_page_text": f"""WITH RECURSIVE {T}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, tok) AS k FROM t
), a AS (SELECT doc_id, page, tok, k, floor(y0) AS anchor FROM o WHERE k = 1 UNION ALL SELECT o.doc_id, o.page, o.tok, o.k, CASE WHEN abs(o.y0 - a.anchor) <= 6 THEN a.anchor ELSE floor(o.y0) END FROM a JOIN o ON o.doc_id = a.doc_id AND o.page = a.page AND o.k = a.k + 1
), l AS (SELECT doc_id, page, anchor, string_agg(text, ' ' ORDER BY x0, tok) AS line FROM t JOIN a USING (doc_id, page, tok) GROUP BY ALL) SELECT doc_id, page, string_agg(line, chr(10) ORDER BY anchor) AS raw_text FROM l GROUP BY ALL""",
    "page_headers": f"{_HEADERS} SELECT hd.doc_id, hd.page, hd.y0, hd.y1, hd.raw_text, CAST(score AS BIGINT) AS score, confidence, name, coalesce((lag(x1) OVER g + x0) / 2, 0.0) AS x0, coalesce((x1 + lead(x0) OVER g) / 2, 10000.0) AS x1 FROM hd JOIN ph USING (doc_id, page, anchor) WINDOW g AS (PARTITION BY hd.doc_id, hd.page ORDER BY began)",
    "page_schemas": f"""{_HEADERS}, best AS (SELECT doc_id, names AS bn, raw_text AS bt, confidence AS bc FROM hd QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {_SCHEMA_SCORE} DESC, page) = 1
), p AS (SELECT *, (doc_id + page) % 4 = 0 AND NOT coalesce(list_contains(names, 'DATE'), false) AS notice FROM (SELECT DISTINCT doc_id, page FROM t) LEFT JOIN hd USING (doc_id, page) JOIN best USING (doc_id)
), s AS (SELECT *, names IS NOT NULL AND NOT notice AS own, len(names) >= len(bn) OR list_sort(names) = list_sort(bn) AS whole FROM p
), m AS (SELECT *, CASE WHEN NOT own THEN NULL WHEN whole THEN names ELSE bn END AS cols, CASE WHEN NOT own THEN NULL WHEN whole THEN confidence ELSE greatest(confidence, bc * 0.9) END AS sure, CASE WHEN own THEN raw_text END AS txt FROM s
), l AS (SELECT *, last_value(cols IGNORE NULLS) OVER b AS lc, last_value(sure IGNORE NULLS) OVER b AS ls, last_value(txt IGNORE NULLS) OVER b AS lt FROM m WINDOW b AS (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, page, CASE WHEN NOT own THEN 'INHERITED' WHEN whole THEN 'OWN' ELSE 'RECONCILED' END AS kind, CASE WHEN own THEN y0 ELSE 40.0::DOUBLE END AS y0, CASE WHEN own THEN y1 ELSE 60.0::DOUBLE END AS y1, array_to_string(CASE WHEN own THEN cols ELSE coalesce(lc, bn) END, ',') AS columns, CASE WHEN own THEN txt ELSE coalesce(lt, bt) END AS raw_text, round(CASE WHEN own THEN sure ELSE coalesce(ls, bc) * 0.9 END, 4) AS confidence FROM l WHERE NOT notice""",
    "band_headers": f"""WITH {T}, h AS (SELECT *, (x0 + x1) / 2 AS centre, {_WHOLE} AS name FROM t), d AS (SELECT doc_id, page, arg_min(y0, tok) FILTER (name = 'DATE') AS top, bool_or(name IN ('DEBIT', 'CREDIT', 'BALANCE')) AS money FROM h GROUP BY ALL
), c AS (SELECT h.* FROM h JOIN d USING (doc_id, page) WHERE money AND name IS NOT NULL AND abs(y0 - top) <= 15 QUALIFY row_number() OVER (PARTITION BY doc_id, page, name ORDER BY tok) = 1
), k AS (SELECT *, array_position(['DATE', 'DESCRIPTION', 'REFERENCE', 'DEBIT', 'CREDIT', 'BALANCE'], name) AS kind FROM c QUALIFY count(*) OVER (PARTITION BY doc_id, page) >= 3)
SELECT doc_id, page, max(y1) OVER p AS bottom, string_agg(text, ',') OVER (PARTITION BY doc_id, page ORDER BY centre, kind ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS headings, name, coalesce((lag(centre) OVER g + centre) / 2, 0.0) AS x0, coalesce((centre + lead(centre) OVER g) / 2, 10000.0) AS x1 FROM k WINDOW p AS (PARTITION BY doc_id, page), g AS (PARTITION BY doc_id, page ORDER BY centre, kind)""",
    "row_slices": _rows_sql("tok", _MOVING, _NEAR.format(5)),
    "visual_lines": _rows_sql("tok", _FIXED, _NEAR.format(3.5), down=True),
    "row_cluster": _rows_sql("y0, x0, tok", f"{_LO}, {_GROWN.format(v='hi', x='y1', f='greatest')}, c", _BEST),
    "reading_order": f"WITH {_T1}, c AS (SELECT *, CASE WHEN y0 - lag(y0) OVER q <= 3.5 THEN 0 ELSE 1 END AS cut FROM t WINDOW q AS (PARTITION BY doc_id ORDER BY y0, x0, tok)), l AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY y0, x0, tok ROWS UNBOUNDED PRECEDING) AS line FROM c) SELECT doc_id, CAST(1 AS BIGINT) AS page, tok, row_number() OVER (PARTITION BY doc_id ORDER BY line, x0, tok) AS place FROM l",
}
