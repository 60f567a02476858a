"""Queries over the derived ledgers, and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.money import MONEY
from ..operators import accounts, fraud, integrity, sequence
from ..sources import ledgers
from . import sql as S
from .sql import cents, dbl, divided, hit, mean


def shown(df: DataFrame) -> DataFrame:
    """Money as double and dates as text: what readers of any engine compare alike."""
    kinds = dict(df.dtypes)

    def column(c: str) -> Column:
        if kinds[c].startswith("decimal"):
            return F.col(c).cast("double").alias(c)
        if kinds[c] == "date":
            return F.date_format(c, "yyyy-MM-dd").alias(c)
        return F.col(c).cast("long").alias(c) if kinds[c] == "int" else F.col(c)

    return df.select(*map(column, df.columns))


def over_events(op):
    return lambda spark, sf_dir: shown(op(ledgers.events(spark, sf_dir)))


def over_orders(op):
    return lambda spark, sf_dir: shown(op(ledgers.orders(spark, sf_dir)))


def holed(ledger: DataFrame) -> DataFrame:
    """The ledger with every fifth balance, and every seventh date, unknown."""
    return ledger.withColumn("balance", F.when(F.col("id") % 5 != 0, F.col("balance"))).withColumn("d", F.when(F.col("id") % 7 != 0, F.col("d")))


HOLED = ", holed AS (SELECT acct, id, seq, CASE WHEN id % 7 <> 0 THEN d END AS d, description, type, amount, credit, debit, CASE WHEN id % 5 <> 0 THEN balance END AS balance FROM led)"
PREV = "last_value(balance IGNORE NULLS) OVER (PARTITION BY acct ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SUMS = """SELECT acct, coalesce(sum(credit) FILTER (WHERE credit > 0), 0) AS cr, coalesce(sum(debit) FILTER (WHERE debit > 0), 0) AS dr,
  count(*) FILTER (WHERE credit > 0) AS n_cr, count(*) FILTER (WHERE debit > 0) AS n_dr, count(*) AS n, arg_min(type, seq) AS t1, arg_min(credit, seq) AS c1, arg_min(debit, seq) AS d1,
  arg_min(balance, seq) AS b1, arg_max(balance, seq) AS bn, sum(balance) AS sb, min(balance) AS lo, max(balance) AS hi, abs(max(d) - min(d)) AS days FROM led GROUP BY acct"""
OPEN = "CASE WHEN t1 = 'CREDIT' THEN b1 - c1 ELSE b1 + d1 END"


def cash_flow_sql(base: str) -> str:
    return f"""{base}, m AS (SELECT acct, strftime(d, '%Y-%m') AS month, coalesce(sum(credit) FILTER (WHERE credit > 0), 0) AS inc, coalesce(sum(debit) FILTER (WHERE debit > 0), 0) AS exp,
  count(*) AS n, sum(balance) AS sb, min(balance) AS lo, max(balance) AS hi, arg_min(balance, seq) AS ob, arg_max(balance, seq) AS cb FROM led GROUP BY 1, 2)
SELECT acct, month, n >= 8 AS full_month, {dbl('inc')} AS income_amount, {dbl('-exp')} AS expenses_amount, {dbl('inc - exp')} AS saving_amount,
  CASE WHEN inc > 0 THEN {divided(cents('inc - exp'), cents('inc'), 10000)} ELSE 0.0 END AS saving_ratio,
  CASE WHEN exp > 0 THEN {divided(cents('inc'), cents('exp'), 10000)} ELSE 1.0 END AS income_expenses_ratio,
  {dbl('ob')} AS opening_balance, {dbl('cb')} AS closing_balance, {mean('sb', 'n')} AS average_balance, {dbl('lo')} AS minimum_balance, {dbl('hi')} AS maximum_balance, n AS transaction_count
FROM m ORDER BY month DESC, acct"""


def _typed(spark, sf_dir):
    rows = ledgers.events(spark, sf_dir)
    mode = T.payment_mode_alt(F.col("description"))
    return rows.select("id", T.payment_mode(F.col("description")).alias("mode"), mode.alias("mode_alt"), F.concat(F.lit("IND_CE|"), mode).alias("mode_tag"))


def _categories(spark, sf_dir):
    rows = ledgers.events(spark, sf_dir)
    d, t = F.col("description"), F.col("type")
    return rows.select("id", T.category(d, t).alias("code"), T.category(d, t, name=True).alias("category"), T.category_alt(d, t, T.payment_mode_alt(d)).alias("code_alt"))


def _signed(spark, sf_dir):
    rows = accounts.enrich(holed(ledgers.events(spark, sf_dir)))
    return shown(rows.select("acct", "id", "seq", "signed", F.coalesce("balance", F.lit(0)).cast(MONEY).alias("balance_or_zero"), "month", F.coalesce(F.nullif(F.date_format("d", "yyyy-MM-dd"), F.lit("")), F.lit("unknown")).alias("value_date")))


def _kpi(spark, sf_dir):
    s = accounts.summary(holed(ledgers.events(spark, sf_dir)))
    return shown(s.select("acct", "min_balance", "max_balance", F.greatest(F.lit(1.0), F.col("period_days") / 30.0).alias("months"), F.greatest(F.lit(1), F.floor(F.col("period_days") / 30)).cast("long").alias("whole_months")))


def _history(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(30).select("event_id", "user_id", "event_type")


def _bridge(spark, sf_dir):
    """Printed numbers step by one more, and balances fall by 7.00 more, at each eleventh id: rows that weren't printed."""
    lost = F.count_if(F.col("id") % 11 == 0).over(Window.partitionBy("acct").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = ledgers.events(spark, sf_dir).withColumn("lost", lost)
    return shown(sequence.bridge_gaps(rows.withColumn("serial", F.col("seq") + F.col("lost")).withColumn("balance", (F.col("balance") - F.col("lost") * 7).cast(MONEY))))


def _glyph(spark, sf_dir):
    rows = ledgers.events(spark, sf_dir).withColumn("amount", F.when(F.col("id") % 9 == 0, F.col("amount") + 10).otherwise(F.col("amount")).cast(MONEY))
    return shown(sequence.repair_glyphs(rows).select("acct", "id", "amount", "repaired"))


def _segments(spark, sf_dir):
    rows = ledgers.events(spark, sf_dir)
    rows = rows.select("acct", "id", "seq", F.when(F.col("id") % 3 == 0, F.col("d")).alias("d"), F.when(F.col("id") % 2 == 0, F.col("amount")).alias("amount"), F.when(F.col("id") % 5 == 0, F.col("balance")).alias("balance"), "description")
    return shown(sequence.segments(rows))


def _stated(spark, sf_dir):
    """Balances step by 5.00 at each fiftieth id."""
    stepped = F.count_if(F.col("id") % 50 == 0).over(Window.partitionBy("acct").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) * 5
    rows = ledgers.events(spark, sf_dir).withColumn("balance", (F.col("balance") + stepped).cast(MONEY))
    return rows.withColumn("stated_closing", F.when(F.col("acct") % 3 == 0, F.lit(1234.5)).when(F.col("acct") % 3 == 1, F.lit(0)).cast(MONEY))


def _audited(spark, sf_dir):
    rows = ledgers.events(spark, sf_dir)
    audit = rows.groupBy("acct").agg(F.count("*").alias("candidates"), F.count_if((F.col("acct") % 4 != 0) | (F.col("id") % 3 != 0)).alias("accounted")).withColumn("suspicious", F.col("acct") % 5)
    return integrity.checks(rows, audit=audit).select("acct", "failed", "check_d", "completeness_ratio")


def _dedup(spark, sf_dir):
    rows = ledgers.events(spark, sf_dir)
    twice = rows.withColumn("copy", F.explode(F.when(F.col("id") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return shown(sequence.drop_consecutive(twice.withColumn("seq", F.col("seq") * 2 + F.col("copy"))).select("acct", "id", "seq"))


def _signed_by_balance(spark, sf_dir):
    return sequence.type_by_balance(holed(ledgers.events(spark, sf_dir))).select("acct", "id", "derived_type")


QUERIES = {
    "monthly_cash_flow": over_orders(accounts.monthly_cash_flow),
    "monthly_cash_flow_events": over_events(accounts.monthly_cash_flow),
    "statement_summary": over_events(accounts.summary),
    "balance_continuity_gaps": over_events(sequence.gaps),
    "payment_mode": _typed,
    "category_assign": _categories,
    "category_rollup": over_events(accounts.category_rollup),
    "risk_profile": over_events(accounts.risk_profile),
    "fraud_rules": over_events(fraud.evaluate),
    "fraud_rules_orders": over_orders(fraud.evaluate),
    "fraud_flag_counts": over_events(lambda x: fraud.counts(x, "transactional")),
    "rapid_in_out": over_orders(sequence.rapid_in_out),
    "recurring_salary": over_events(accounts.recurring_salary),
    "recurring_candidates": over_events(accounts.recurring_candidates),
    "integrity_checks": lambda spark, sf_dir: shown(integrity.checks(_stated(spark, sf_dir))),
    "integrity_status": lambda spark, sf_dir: shown(integrity.status(_stated(spark, sf_dir))),
    "integrity_audited": _audited,
    "prev_balance_fill": over_events(lambda x: sequence.fill_previous(holed(x)).select("acct", "id", "prev_balance")),
    "inherited_date": over_events(lambda x: sequence.inherit_date(holed(x)).select("acct", "id", "d")),
    "continuity_flags": over_events(lambda x: sequence.continuity_flags(holed(x)).select("acct", "id", "continuous")),
    "consecutive_dedup": _dedup,
    "glyph_repair": _glyph,
    "gap_bridge": _bridge,
    "delta_typing": _signed_by_balance,
    "coord_segments": _segments,
    "signed_ledger": _signed,
    "kpi_minmax": _kpi,
    "chart_scale": over_orders(lambda x: accounts.chart_scale(accounts.monthly_cash_flow(x))),
    "txn_search_page": over_events(lambda x: accounts.search(x, "upi", "DEBIT", "UPI", 2, 5)),
    "history_topk": _history,
}

_RULES = "(VALUES " + ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in r) + ")" for r in fraud.RULES) + ") AS r(rule_id, name, category, severity, description)"


def fraud_sql(base: str, tail: str) -> str:
    low = "lower(description)"
    return f"""{base}, s AS ({SUMS}), g AS (
  SELECT acct, count(*) AS n, bool_or(amount >= 50000 AND amount % 10000 = 0) AS rnd, bool_or(balance < 0) AS neg, coalesce(sum(debit) FILTER (WHERE {S.MODE} = 'ATM' OR contains({low}, 'atm')), 0) AS atm,
    bool_or({hit(low, T.FRAUD_BOUNCE)}) AS bounced, bool_or(contains({low}, 'amb charge')) AS amb, bool_or({hit(low, T.GAMBLING)}) AS gamb, bool_or({hit(low, T.CRYPTO)}) AS crypto, count(*) FILTER (WHERE {hit(low, T.FRAUD_EMI)}) AS emi
  FROM led GROUP BY acct
), f AS (SELECT g.*, cr, dr, CAST({mean('sb', 's.n')} AS DECIMAL(18,2)) AS av, g.n >= 4 AND abs(cr - dr) * 20 < cr AND cr > 50000 AS thru FROM g JOIN s USING (acct)
), e AS (SELECT acct, rule_id, name, category, severity, description, CASE rule_id
    WHEN 'FA_01' THEN n > 50 WHEN 'FA_02' THEN rnd WHEN 'FA_03' THEN neg WHEN 'FA_04' THEN dr > 0 AND atm * 100 > dr * 35 WHEN 'FA_05' THEN thru WHEN 'FA_06' THEN bounced WHEN 'FA_07' THEN thru WHEN 'FA_14' THEN amb
    WHEN 'FA_18' THEN gamb WHEN 'FA_19' THEN crypto WHEN 'FA_23' THEN emi > 4 WHEN 'FA_25' THEN av > 0 AND dr > av * 20 WHEN 'FA_34' THEN rnd OR neg ELSE false END AS triggered FROM f CROSS JOIN {_RULES})
{tail}"""


FRAUD_TAIL = "SELECT acct, rule_id, name, category, triggered, CASE WHEN triggered THEN 'YES' ELSE 'NO' END AS identified, severity, CAST(0.95 AS DOUBLE) AS confidence, description, CASE WHEN triggered THEN 'Triggered by transaction condition: ' || name END AS evidence FROM e"
LOW = "lower(description)"
CASHED = f"(type = 'DEBIT' AND ({S.MODE} = 'ATM' OR {hit(LOW, T.CASH)}))"
EMIED = f"(type = 'DEBIT' AND {hit(LOW, T.EMI)})"
BOUNCE = hit(LOW, T.BOUNCED)
BASE = "CASE WHEN inc > 0 THEN " + cents("inc") + " ELSE 100 END"

STATED = f"""{S.EVENTS}, st AS (SELECT * REPLACE (CAST(balance + 5 * count(*) FILTER (id % 50 = 0) OVER (PARTITION BY acct ORDER BY seq ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS balance), CASE WHEN acct % 3 = 0 THEN 1234.5 WHEN acct % 3 = 1 THEN 0.0 END AS stated FROM led
), w AS (SELECT *, lag(balance) OVER (PARTITION BY acct ORDER BY seq) + credit - debit - balance AS gap FROM st
), g AS (SELECT acct, coalesce(sum(credit), 0) AS cr, coalesce(sum(debit), 0) AS dr, count(*) AS n, arg_max(balance, seq) AS bn, max(stated) AS stated, count(*) FILTER (WHERE abs(gap) <= 0.05) AS passed, count(*) FILTER (WHERE abs(gap) > 0.05) AS failed,
    arg_min(CASE WHEN type = 'CREDIT' THEN balance - credit ELSE balance + debit END, seq) AS ob FROM w GROUP BY acct
), c AS (SELECT acct, passed, failed, {dbl('cr')} AS total_credits, {dbl('dr')} AS total_debits, n AS transaction_count, {dbl('stated')} AS stated_closing,
    CASE WHEN abs(ob + cr - dr - bn) <= 0.01 THEN 'PASS' ELSE 'FAIL' END AS check_a, {dbl('abs(ob + cr - dr - bn)')} AS a_difference,
    CASE WHEN stated IS NULL THEN 'NOT_APPLICABLE' WHEN abs(ob + cr - dr - CAST(stated AS DECIMAL(18,2))) <= 0.01 THEN 'PASS' ELSE 'FAIL' END AS check_b, coalesce({dbl('abs(ob + cr - dr - CAST(stated AS DECIMAL(18,2)))')}, 0) AS b_difference,
    CASE WHEN passed + failed = 0 THEN 'NOT_APPLICABLE' WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END AS check_c,
    CASE WHEN passed + failed > 0 THEN {divided('passed', 'greatest(passed + failed, 1)', 10000)} ELSE 1.0 END AS continuity_rate, CASE WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END AS check_d FROM g)"""

ORACLE_SQL = {
    "monthly_cash_flow": cash_flow_sql(S.ORDERS),
    "monthly_cash_flow_events": cash_flow_sql(S.EVENTS),
    "statement_summary": f"""{S.EVENTS}, s AS ({SUMS}), o AS (SELECT *, {OPEN} AS ob FROM s)
SELECT acct, {dbl('ob')} AS opening_balance, {dbl('bn')} AS closing_balance, {dbl('ob + cr - dr')} AS calculated_closing, {dbl('cr')} AS total_credits, {dbl('dr')} AS total_debits, {dbl('cr - dr')} AS net_cash_flow, {mean('sb', 'n')} AS average_balance,
  n AS transaction_count, n_cr AS credit_count, n_dr AS debit_count, {dbl('lo')} AS min_balance, {dbl('hi')} AS max_balance, CAST(0 AS DOUBLE) AS reconciliation_difference, true AS balance_reconciled, coalesce(nullif(days, 0), 30) AS period_days FROM o""",
    "balance_continuity_gaps": f"""{S.EVENTS}, w AS (SELECT *, abs(lag(balance) OVER (PARTITION BY acct ORDER BY seq) + credit - debit - balance) AS gap FROM led
), k AS (SELECT *, row_number() OVER (PARTITION BY acct ORDER BY seq) AS k FROM w WHERE gap > 0.05
), f AS (SELECT acct, string_agg(CAST(id AS VARCHAR), ',' ORDER BY seq) AS failed_ids, {dbl('sum(gap) FILTER (WHERE k <= 10)')} AS first_gaps_total FROM k GROUP BY acct
), c AS (SELECT acct, count(*) FILTER (WHERE gap <= 0.05) AS passed, count(*) FILTER (WHERE gap > 0.05) AS failed FROM w GROUP BY acct)
SELECT acct, passed, failed, failed_ids, first_gaps_total FROM c LEFT JOIN f USING (acct)""",
    "payment_mode": f"{S.EVENTS} SELECT id, {S.MODE} AS mode, {S.MODE_ALT} AS mode_alt, 'IND_CE|' || {S.MODE_ALT} AS mode_tag FROM led",
    "category_assign": f"{S.EVENTS} SELECT id, {S.CODE} AS code, {S.NAME} AS category, {S.CODE_ALT} AS code_alt FROM led",
    "category_rollup": f"""{S.EVENTS}, c AS (SELECT acct, type, {S.CODE} AS code, {S.NAME} AS category, credit + debit AS a, seq FROM led
), g AS (SELECT acct, type, code, category, sum(a) AS amount, count(*) FILTER (WHERE a > 0) AS n, min(seq) AS first_seq FROM c GROUP BY ALL HAVING count(*) FILTER (WHERE a > 0) > 0
), t AS (SELECT *, sum(amount) OVER (PARTITION BY acct, type) AS side FROM g)
SELECT acct, type, code, category, {dbl('amount')} AS amount, n, {mean('amount', 'n')} AS average_amount, {divided(cents('amount'), cents('side'), 10000)} * 10000 / 100 AS percentage, first_seq, CASE WHEN type = 'CREDIT' THEN CAST(0.85 AS DOUBLE) ELSE CAST(0.80 AS DOUBLE) END AS stability FROM t""",
    "risk_profile": f"""{S.EVENTS}, g AS (SELECT acct, coalesce(sum(credit) FILTER (WHERE credit > 0), 0) AS inc, coalesce(sum(debit) FILTER (WHERE debit > 0), 0) AS outf, coalesce(sum(debit) FILTER (WHERE {EMIED}), 0) AS emi, coalesce(sum(debit) FILTER (WHERE {CASHED}), 0) AS cash,
    count(*) FILTER (WHERE {BOUNCE}) AS nb, coalesce(sum(CASE WHEN debit <> 0 THEN debit ELSE amount END) FILTER (WHERE {BOUNCE}), 0) AS ab, count(*) FILTER (WHERE balance < 0) AS neg, count(*) FILTER (WHERE {EMIED}) AS ne, count(*) FILTER (WHERE {CASHED}) AS nc,
    coalesce(nullif(max(d) - min(d), 0), 30) AS days FROM led GROUP BY acct)
SELECT acct, {divided(cents('emi'), BASE, 10000)} AS emi_to_income_ratio, {divided(cents('cash'), BASE, 10000)} AS cash_withdrawal_ratio, nb AS returned_count, {dbl('ab')} AS returned_amount, {dbl('emi')} AS total_emi, {dbl('cash')} AS total_cash, neg AS negative_rows, ne AS emi_count, nc AS cash_count, days AS period_days,
  {divided(cents('inc') + ' * 30', 'greatest(30, days)', 1)} / 100.0 AS monthly_income, {divided(cents('outf') + ' * 30', 'greatest(30, days)', 1)} / 100.0 AS monthly_outflow, CAST(0.88 AS DOUBLE) AS income_stability_score, CAST(0.15 AS DOUBLE) AS expense_volatility_score FROM g""",
    "fraud_rules": fraud_sql(S.EVENTS, FRAUD_TAIL),
    "fraud_rules_orders": fraud_sql(S.ORDERS, FRAUD_TAIL),
    "fraud_flag_counts": fraud_sql(S.EVENTS, "SELECT acct, count(*) AS rules, count(*) FILTER (WHERE triggered) AS flagged, count(*) FILTER (WHERE NOT triggered) AS passed, count(*) FILTER (WHERE triggered AND severity = 'HIGH') AS high FROM e WHERE category = 'transactional' GROUP BY acct"),
    "rapid_in_out": f"{S.ORDERS}, n AS (SELECT *, lead(type) OVER w AS nt, lead(amount) OVER w AS na FROM led WINDOW w AS (PARTITION BY acct ORDER BY seq)) SELECT acct, id, {dbl('amount')} AS amount, {dbl('na')} AS next_amount FROM n WHERE type = 'CREDIT' AND amount > 25000 AND nt = 'DEBIT' AND na * 10 >= amount * 8",
    "recurring_salary": f"""{S.EVENTS} SELECT acct, 'SALARY' AS type, arg_min(description, seq) AS source, {mean('sum(credit)', 'count(*)')} AS monthly_average_amount, 'MONTHLY' AS frequency, count(*) AS matched_count, string_agg(CAST(id AS VARCHAR), ',' ORDER BY seq) AS matched_ids, CAST(0.96 AS DOUBLE) AS confidence, CAST(30 AS BIGINT) AS average_gap_days, max(d) - min(d) AS longevity_days
FROM led WHERE type = 'CREDIT' AND credit > 0 AND {hit(LOW, T.SALARY)} GROUP BY acct""",
    "recurring_candidates": rf"""{S.EVENTS}, c AS (SELECT acct, credit, substring(trim(regexp_replace({LOW}, '[\d/\-_]', '', 'g')), 1, 20) || '_' || CAST(CAST(round_even({dbl('credit')} / 1000, 0) * 1000 AS BIGINT) AS VARCHAR) AS key FROM led WHERE type = 'CREDIT' AND credit > 0) SELECT acct, key, count(*) AS n, {dbl('sum(credit)')} AS amount FROM c GROUP BY acct, key""",
    "integrity_checks": f"{STATED} SELECT * FROM c",
    "integrity_audited": f"""{S.EVENTS}, w AS (SELECT *, lag(balance) OVER (PARTITION BY acct ORDER BY seq) + credit - debit - balance AS gap FROM led
), g AS (SELECT acct, count(*) FILTER (WHERE abs(gap) > 0.05) AS failed, count(*) FILTER (WHERE acct % 4 <> 0 OR id % 3 <> 0) AS accounted, count(*) AS candidates FROM w GROUP BY acct
), r AS (SELECT *, {divided('accounted', 'candidates', 10000)} AS completeness_ratio FROM g)
SELECT acct, failed, CASE WHEN failed = 0 AND completeness_ratio >= 0.98 AND acct % 5 <= 2 THEN 'PASS' ELSE 'FAIL' END AS check_d, completeness_ratio FROM r""",
    "integrity_status": f"""{STATED}, s AS (SELECT *, CASE WHEN check_d = 'PASS' AND check_a <> 'FAIL' AND check_b <> 'FAIL' AND check_c <> 'FAIL' THEN 'GREEN' WHEN check_a <> 'FAIL' AND check_b <> 'FAIL' AND failed <= 1 THEN 'YELLOW' ELSE 'RED' END AS status,
  1 + CAST(stated_closing IS NOT NULL AS BIGINT) + CAST(total_credits > 0 AS BIGINT) + CAST(total_debits > 0 AS BIGINT) + CAST(transaction_count > 0 AS BIGINT) AS fields_present FROM c)
SELECT acct, status, CASE WHEN status = 'RED' THEN concat_ws(', ', CASE WHEN check_a = 'FAIL' THEN 'arithmetic' END, CASE WHEN check_b = 'FAIL' THEN 'statement' END, CASE WHEN check_c = 'FAIL' THEN failed || ' gap(s)' END) ELSE '' END AS reasons,
  CASE status WHEN 'GREEN' THEN '{integrity.MESSAGES['verified']}' WHEN 'YELLOW' THEN '{integrity.MESSAGES['minor']}' ELSE 'Mathematical integrity verification failed: ' || concat_ws(', ', CASE WHEN check_a = 'FAIL' THEN '{integrity.MESSAGES['a']}' END, CASE WHEN check_b = 'FAIL' THEN '{integrity.MESSAGES['b']}' END, CASE WHEN check_c = 'FAIL' THEN failed || '{integrity.MESSAGES['c']}' END, CASE WHEN check_d = 'FAIL' THEN 'completeness ratio 100.0% below threshold' END) || '.' END AS message, fields_present,
  (1900 + 2400 + 1500 + 300 * fields_present + 25 * CASE status WHEN 'GREEN' THEN 100 WHEN 'YELLOW' THEN 70 ELSE 30 END) / 10000.0 AS confidence FROM s""",
    "prev_balance_fill": f"{S.EVENTS}{HOLED} SELECT acct, id, {dbl(PREV)} AS prev_balance FROM holed",
    "inherited_date": f"{S.EVENTS}{HOLED} SELECT acct, id, strftime(coalesce(d, {PREV.replace('balance', 'd')}, DATE '2026-01-01'), '%Y-%m-%d') AS d FROM holed",
    "continuity_flags": f"{S.EVENTS}{HOLED}, p AS (SELECT *, {PREV} AS pb FROM holed) SELECT acct, id, coalesce(abs(pb + credit - debit - balance) <= 0.01, true) AS continuous FROM p",
    "consecutive_dedup": f"{S.EVENTS}, t AS (SELECT led.*, seq * 2 + copy AS s2 FROM led, (VALUES (0), (1)) v(copy) WHERE copy = 0 OR id % 4 = 0), w AS (SELECT *, lag(row(d, amount, balance, description, type)) OVER (PARTITION BY acct ORDER BY s2) AS b FROM t) SELECT acct, id, s2 AS seq FROM w WHERE b IS NULL OR b <> row(d, amount, balance, description, type)",
    "glyph_repair": f"""{S.EVENTS}, a AS (SELECT acct, id, seq, type, balance, CAST(CASE WHEN id % 9 = 0 THEN amount + 10 ELSE amount END AS DECIMAL(18,2)) AS amount FROM led
), p AS (SELECT *, balance - {PREV} AS ch FROM a), q AS (SELECT *, CAST(amount AS VARCHAR) AS x, CAST(abs(ch) AS VARCHAR) AS y FROM p
), r AS (SELECT *, coalesce(((type = 'DEBIT' AND ch < 0) OR (type = 'CREDIT' AND ch > 0)) AND length(x) = length(y) AND hamming(x, y) = 1, false) AS repaired FROM (SELECT * FROM q WHERE length(x) = length(y) UNION ALL SELECT acct, id, seq, type, balance, amount, ch, x, rpad('', CAST(length(x) AS INTEGER), 'z') FROM q WHERE length(x) <> length(y) OR y IS NULL))
SELECT acct, id, {dbl('CASE WHEN repaired THEN abs(ch) ELSE amount END')} AS amount, repaired FROM r""",
    "gap_bridge": f"""{S.EVENTS}, r AS (SELECT * REPLACE (CAST(balance - 7 * count(*) FILTER (id % 11 = 0) OVER o AS DECIMAL(18,2)) AS balance), seq + count(*) FILTER (id % 11 = 0) OVER o AS serial FROM led WINDOW o AS (PARTITION BY acct ORDER BY seq ROWS UNBOUNDED PRECEDING)), p AS (SELECT *, {PREV} + credit - debit - balance AS missing, serial - lag(serial) OVER (PARTITION BY acct ORDER BY seq) > 1 AS skipped FROM r
) SELECT acct, id, seq, strftime(d, '%Y-%m-%d') AS d, false AS bridge, type, {dbl('amount')} AS amount, {dbl('balance')} AS balance FROM p
UNION ALL SELECT acct, id, seq, strftime(d, '%Y-%m-%d'), true, 'DEBIT', {dbl('missing')}, {dbl('balance')} FROM p WHERE skipped AND missing > 0""",
    "delta_typing": f"{S.EVENTS}{HOLED}, p AS (SELECT *, balance - {PREV} AS ch FROM holed) SELECT acct, id, CASE WHEN abs(abs(ch) - amount) <= 0.05 AND ch > 0 THEN 'CREDIT' WHEN abs(abs(ch) - amount) <= 0.05 AND ch < 0 THEN 'DEBIT' ELSE type END AS derived_type FROM p",
    "coord_segments": f"""{S.EVENTS}, r AS (SELECT acct, id, seq, CASE WHEN id % 3 = 0 THEN d END AS d, CASE WHEN id % 2 = 0 THEN amount END AS amount, CASE WHEN id % 5 = 0 THEN balance END AS balance, description FROM led
), n AS (SELECT *, sum(CASE WHEN d IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY acct ORDER BY seq) AS segment FROM r)
SELECT acct, CAST(segment AS BIGINT) AS segment, strftime(min(d), '%Y-%m-%d') AS d, {dbl('arg_min(amount, seq) FILTER (WHERE amount IS NOT NULL)')} AS amount, {dbl('arg_min(balance, seq) FILTER (WHERE balance IS NOT NULL)')} AS balance, string_agg(description, ' ' ORDER BY seq) AS description, count(*) AS rows FROM n WHERE segment > 0 GROUP BY acct, segment""",
    "signed_ledger": f"{S.EVENTS}{HOLED} SELECT acct, id, seq, {dbl('CASE WHEN type = chr(68) || chr(69) || chr(66) || chr(73) || chr(84) THEN -amount ELSE amount END')} AS signed, coalesce({dbl('balance')}, 0) AS balance_or_zero, coalesce(strftime(d, '%Y-%m'), '2026-01') AS month, coalesce(strftime(d, '%Y-%m-%d'), 'unknown') AS value_date FROM holed".replace("chr(68) || chr(69) || chr(66) || chr(73) || chr(84)", "'DEBIT'"),
    "kpi_minmax": f"{S.EVENTS}{HOLED}, k AS (SELECT acct, min(balance) AS lo, max(balance) AS hi, coalesce(nullif(max(d) - min(d), 0), 30) AS days FROM holed GROUP BY acct) SELECT acct, {dbl('lo')} AS min_balance, {dbl('hi')} AS max_balance, greatest(1.0, days / 30.0) AS months, greatest(1, days // 30) AS whole_months FROM k",
    "chart_scale": f"""{S.ORDERS}, m AS (SELECT acct, strftime(d, '%Y-%m') AS month, sum(credit) AS inc, sum(debit) AS exp FROM led GROUP BY 1, 2), t AS (SELECT *, greatest(1000, max(greatest(inc, exp)) OVER (PARTITION BY acct)) AS top FROM m)
SELECT acct, month, least(100.0, {divided(cents('inc'), cents('top'), 100)} * 100) AS income_pct, least(100.0, {divided(cents('exp'), cents('top'), 100)} * 100) AS expenses_pct FROM t""",
    "txn_search_page": f"{S.EVENTS}, f AS (SELECT acct, id, seq, row_number() OVER (PARTITION BY acct ORDER BY seq) AS rank, count(*) OVER (PARTITION BY acct) AS n FROM led WHERE contains({LOW}, 'upi') AND type = 'DEBIT' AND contains({S.MODE}, 'UPI')) SELECT acct, id, seq, rank, greatest(1, (n + 4) // 5) AS pages FROM f WHERE rank BETWEEN 6 AND 10",
    "history_topk": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 30",
}
