"""Pieces of the SQL that states the same rows as the queries (DuckDB dialect)."""

from __future__ import annotations

from ..functions import text as T
from ..sources.ledgers import CREDIT_TEXTS, DEBIT_TEXTS, narration_sql

_TAIL = """
, led AS (
  SELECT acct, id, seq, d, description, type, amount, credit, debit,
         CAST(1000 + sum(credit - debit) OVER (PARTITION BY acct ORDER BY seq ROWS UNBOUNDED PRECEDING)
              + CASE WHEN id % 97 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS balance
  FROM (SELECT *, CASE WHEN type = 'CREDIT' THEN amount ELSE CAST(0 AS DECIMAL(18,2)) END AS credit,
               CASE WHEN type = 'DEBIT' THEN amount ELSE CAST(0 AS DECIMAL(18,2)) END AS debit FROM raw)
)"""

EVENTS = f"""WITH typed AS (
  SELECT user_id AS acct, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
         CAST(ts AS DATE) AS d, CASE WHEN event_type IN ('signup', 'purchase') THEN 'CREDIT' ELSE 'DEBIT' END AS type,
         CAST(coalesce(value, 0) AS DECIMAL(18,2)) AS amount FROM events
), raw AS (
  SELECT *, CASE WHEN type = 'CREDIT' THEN {narration_sql('id', CREDIT_TEXTS)} ELSE {narration_sql('id', DEBIT_TEXTS)} END AS description FROM typed
){_TAIL}"""

ORDERS = f"""WITH raw AS (
  SELECT o_custkey AS acct, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq,
         CAST(o_orderdate AS DATE) AS d, 'order ' || o_orderpriority AS description,
         CASE WHEN o_orderstatus = 'F' THEN 'CREDIT' ELSE 'DEBIT' END AS type, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders
){_TAIL}"""


def hit(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}')"


def case(rules: list[tuple[str, str]], rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {rest} END"


MODE = case([(hit("lower(description)", p), f"'{m}'") for m, p in T.MODES], "'OTHER'")
MODE_ALT = case([(hit("upper(description)", p), f"'{m}'") for m, p in T.MODES_ALT], "'OTHER'")
CODE = case([(f"type = '{s}' AND " + hit("lower(description)", p), f"'{c}'") for c, _, s, p in T.CATEGORIES], "CASE WHEN type = 'CREDIT' THEN 'RE_07' ELSE 'ZZ_99' END")
NAME = case([(f"type = '{s}' AND " + hit("lower(description)", p), f"'{n}'") for _, n, s, p in T.CATEGORIES], "CASE WHEN type = 'CREDIT' THEN 'General Inflow' ELSE 'General Outflow' END")
CODE_ALT = case(
    [*((hit("lower(description)", p), f"'{c}'") for c, _, p in T.CATEGORIES_ALT), (hit("lower(description)", r"\b(atm|cash\s+wdl|cash\s+withdrawal|nfs\s+cash)\b") + f" OR {MODE_ALT} = 'ATM'", "'OO_02'"), (f"{MODE_ALT} = 'UPI' OR " + hit("lower(description)", r"\b(upi|gpay|phonepe|paytm)\b"), "CASE WHEN type = 'CREDIT' THEN 'RE_17' ELSE 'OO_03' END")],
    "CASE WHEN type = 'CREDIT' THEN 'RE_07' ELSE 'ZZ_99' END",
)


def cents(x: str) -> str:
    return f"CAST(({x}) * 100 AS BIGINT)"


def divided(a: str, b: str, scale: int) -> str:
    return f"(CAST(sign({a}) AS DOUBLE) * ((abs({a}) * {2 * scale} + {b}) // (2 * {b})) / {float(scale)})"


def mean(total: str, n: str) -> str:
    return divided(cents(total), f"CAST({n} AS BIGINT)", 1) + " / 100.0"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"
