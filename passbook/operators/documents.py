"""Document operators: evidence and decision, account fields, guards and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, fields, masking, text


def _shown(pages: DataFrame) -> DataFrame:
    """doc_id and evidence (array) of each document: one grouping over its pages."""
    part = lambda c: F.col(c) if c in pages.columns else F.lit("")
    number = F.col("page") if "page" in pages.columns else F.lit(1)
    text = F.coalesce("raw_text", F.lit(""))
    line = F.transform(F.split(text, "\n"), fields.ledger_lines)
    found = pages.select("doc_id", number.alias("page"), text.alias("text"), F.coalesce(part("header"), F.lit("")).alias("header"), F.coalesce(part("info"), F.lit("")).alias("info"), line.alias("lines"))
    # The first header line counts, as pages and lines follow.
    columns = F.get(F.filter(F.transform("lines", lambda x: x["columns"]), lambda n: n >= 3), 0)
    found = found.select("doc_id", F.struct("page", "text", "header", "info", columns.alias("columns"), F.size(F.filter("lines", lambda x: x["is_row"])).alias("rows")).alias("p"))
    docs = found.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    first = F.get("ps", 0)
    texts = docs.select(
        "doc_id", F.lower(first["header"]).alias("head"), F.lower(F.concat_ws(" ", first["info"], first["header"])).alias("info"), F.lower(first["text"]).alias("one"), F.lower(F.array_join(F.transform("ps", lambda p: p["text"]), " ")).alias("all"),
        F.coalesce(F.get(F.filter(F.transform("ps", lambda p: p["columns"]), lambda n: n.isNotNull()), 0), F.lit(0)).alias("columns"), F.aggregate("ps", F.lit(0), lambda n, p: n + p["rows"]).alias("rows"),
    )
    return texts.select("doc_id", fields.evidence({k: F.col(k) for k in ("head", "info", "one", "all")}, F.col("columns"), F.col("rows")).alias("evidence"))


def evidence(pages: DataFrame) -> DataFrame:
    """Evidence rows (doc_id, signal, kind, weight, sign) of documents' pages (doc_id, raw_text; page, and texts of the header and info regions, if known)."""
    return _shown(pages).select("doc_id", F.inline("evidence"))


def decide(pages: DataFrame) -> DataFrame:
    """Kind of each document: summed evidence, then the decision table; documents without evidence are uncertain."""
    add = lambda test: F.aggregate("evidence", F.lit(0).cast("long"), lambda n, e: n + F.when(test(e), e["weight"]).otherwise(0))
    sums = _shown(pages).select("doc_id", add(lambda e: e["sign"] == 1).alias("positive"), add(lambda e: e["sign"] == -1).alias("negative"), add(lambda e: e["kind"] == "LEDGER").alias("table_score"), F.size("evidence").cast("long").alias("signals"))
    pos, neg = F.col("positive"), F.col("negative")
    no = (neg >= 60) & (neg > pos + 25)
    yes = (pos >= 50) | ((F.col("table_score") >= 35) & (pos >= 35))
    sure = F.round(F.least(F.lit(0.99), 0.7 + pos / 150.0 * 0.28), 2)
    return sums.select("*", F.when(no, "NOT_BANK_STATEMENT").when(yes, "BANK_STATEMENT").otherwise("UNCERTAIN").alias("decision"), F.when(no, 0.0).when(yes, sure).otherwise(F.round(pos / 100.0, 2)).alias("confidence"))


def account_fields(pages: DataFrame) -> DataFrame:
    """Bank, account, codes, period, balances and stated totals of each document (doc_id, raw_text)."""
    t = F.col("raw_text")
    found = pages.select("doc_id", "raw_text", fields.account_number(t).alias("account"), dates.period(t).alias("period"))
    return found.select(
        "doc_id", fields.bank(t).alias("bank"), F.col("account").alias("account_number"), masking.account(F.col("account")).alias("account_masked"), fields.account_type(t).alias("account_type"), text.ifsc(t).alias("ifsc"), text.micr(t).alias("micr"),
        fields.labelled_amount(t, fields.OPENING).alias("opening_balance"), fields.labelled_amount(t, fields.CLOSING).alias("closing_balance"), fields.labelled_amount(t, fields.CREDITS).alias("stated_credits"), fields.labelled_amount(t, fields.DEBITS).alias("stated_debits"),
        F.col("period.start").alias("from_date"), F.col("period.end").alias("to_date"), text.currency(t).alias("currency"),
    )


def guard(files: DataFrame, most: int = 25 * 1024 * 1024) -> DataFrame:
    """First reason to refuse each file (path, length, content), or null: checks in order, no exception."""
    head = F.hex(F.substring("content", 1, 1024))
    code = (
        F.when(F.col("content").isNull() | (F.length("content") == 0), "EMPTY_FILE")
        .when(F.col("length") > most, "FILE_TOO_LARGE")
        .when(~F.lower("path").endswith(".pdf"), "INVALID_FILE_TYPE")
        .when(~head.contains("255044462D"), "INVALID_PDF")
    )
    return files.select("path", "length", code.alias("error_code"))


def scan_gate(tokens: DataFrame) -> DataFrame:
    """Whether a page's scanned tokens (doc_id, page, text, conf) suffice."""
    word = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    g = tokens.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.coalesce(F.avg(F.when(F.col("conf") > 0, F.col("conf"))), F.lit(0.0)).alias("confidence"), F.count_if(word.isin(fields.GATE_WORDS)).alias("keywords"))
    good = ((F.col("n") >= 15) & (F.col("confidence") >= 0.6) & (F.col("keywords") >= 2)) | ((F.col("n") >= 30) & (F.col("confidence") >= 0.5))
    return g.select("doc_id", "page", "n", "keywords", F.round("confidence", 4).alias("confidence"), good.alias("passed"))


def validate(ledger: DataFrame) -> DataFrame:
    """Errors and warnings of each account's rows with double amounts."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    g = ledger.groupBy("acct").agg(F.count_if(bad(F.col("amount")) | (F.col("amount") < 0)).alias("bad_amounts"), F.count_if(bad(F.col("balance"))).alias("bad_balances"), F.count("*").alias("n"))
    errors = F.array_compact(F.array(F.when(F.col("bad_amounts") > 0, "amount"), F.when(F.col("bad_balances") > 0, "balance")))
    return g.select("acct", "n", "bad_amounts", "bad_balances", F.array_join(errors, ",").alias("errors"), (F.size(errors) == 0).alias("valid"))


def warnings(accounts: DataFrame) -> DataFrame:
    """Warnings of each account (acct, n: transactions, difference): nothing found, and totals that do not reconcile by more than a cent."""
    said = F.array_compact(F.array(F.when(F.coalesce("n", F.lit(0)) == 0, "No individual transaction lines were identified from the statement."), F.when(F.col("difference") > 0.01, F.format_string("Balance difference of %s", F.col("difference").cast("decimal(18,2)").cast("string")))))
    return accounts.select("acct", said.alias("warnings"), F.size(said).cast("long").alias("n_warnings"))
