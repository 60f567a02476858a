"""The second dialect's view of a document: capped scores of its signals, penalties, and a decision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import let
from ..functions.narration import payment_words
from ..functions.text import first_match

# Banks and the words that tell them; of several the one that stands first counts.
BANKS = [
    ("State Bank of India", r"(?i)\b(state\s+bank\s+of\s+india|sbi\b|sb\s+india|sbi\s+card)\b"), ("HDFC Bank", r"(?i)\b(hdfc\s+bank|hdfc\s+bank\s+ltd|hdfc\b)\b"),
    ("ICICI Bank", r"(?i)\b(icici\s+bank|icici\s+bank\s+limited|icici\b)\b"), ("Axis Bank", r"(?i)\b(axis\s+bank|axis\s+bank\s+ltd|uti\s+bank|axis\b)\b"),
    ("Kotak Mahindra Bank", r"(?i)\b(kotak\s+mahindra\s+bank|kotak\s+bank|kotak\b)\b"), ("Punjab National Bank", r"(?i)\b(punjab\s+national\s+bank|pnb\b)\b"),
    ("Bank of Baroda", r"(?i)\b(bank\s+of\s+baroda|bob\b|baroda\s+bank)\b"), ("Canara Bank", r"(?i)\b(canara\s+bank|canara\b)\b"), ("Union Bank of India", r"(?i)\b(union\s+bank\s+of\s+india|union\s+bank|ubi\b)\b"),
    ("IndusInd Bank", r"(?i)\b(indusind\s+bank|indusind\b)\b"), ("IDFC FIRST Bank", r"(?i)\b(idfc\s+first\s+bank|idfc\s+bank|idfc\b)\b"), ("Yes Bank", r"(?i)\b(yes\s+bank|yes\s+bank\s+ltd|yesbank)\b"),
    ("Bank of India", r"(?i)\b(bank\s+of\s+india|boi\b)\b"), ("Central Bank of India", r"(?i)\b(central\s+bank\s+of\s+india|cbi\b)\b"), ("Indian Overseas Bank", r"(?i)\b(indian\s+overseas\s+bank|iob\b)\b"),
    ("Indian Bank", r"(?i)\b(indian\s+bank)\b"), ("UCO Bank", r"(?i)\b(uco\s+bank|uco\b)\b"), ("Punjab & Sind Bank", r"(?i)\b(punjab\s*(&|\s+and\s+)\s*sind\s+bank|psb\b)\b"),
    ("Federal Bank", r"(?i)\b(federal\s+bank|federal\b)\b"), ("RBL Bank", r"(?i)\b(rbl\s+bank|ratnakar\s+bank|rbl\b)\b"), ("Bandhan Bank", r"(?i)\b(bandhan\s+bank|bandhan\b)\b"),
    ("AU Small Finance Bank", r"(?i)\b(au\s+small\s+finance\s+bank|au\s+bank|aubank)\b"), ("Equitas Small Finance Bank", r"(?i)\b(equitas\s+small\s+finance\s+bank|equitas\s+bank|equitas)\b"),
    ("Ujjivan Small Finance Bank", r"(?i)\b(ujjivan\s+small\s+finance\s+bank|ujjivan\s+bank|ujjivan)\b"), ("South Indian Bank", r"(?i)\b(south\s+indian\s+bank|sib\b)\b"),
    ("City Union Bank", r"(?i)\b(city\s+union\s+bank|cub\b)\b"), ("Karur Vysya Bank", r"(?i)\b(karur\s+vysya\s+bank|kvb\b)\b"), ("Karnataka Bank", r"(?i)\b(karnataka\s+bank)\b"),
    ("Jammu & Kashmir Bank", r"(?i)\b(jammu\s*(&|\s+and\s+)\s*kashmir\s+bank|j&k\s+bank|jk\s+bank)\b"), ("Paytm Payments Bank", r"(?i)\b(paytm\s+payments\s+bank|paytm\s+bank)\b"),
    ("Airtel Payments Bank", r"(?i)\b(airtel\s+payments\s+bank)\b"), ("India Post Payments Bank", r"(?i)\b(india\s+post\s+payments\s+bank|ippb\b)\b"),
    ("Saraswat Bank", r"(?i)\b(saraswat\s+co-operative\s+bank|saraswat\s+bank)\b"), ("Cosmos Bank", r"(?i)\b(cosmos\s+co-operative\s+bank|cosmos\s+bank)\b"),
    ("SVC Bank", r"(?i)\b(svc\s+co-operative\s+bank|svc\s+bank|shamrao\s+vithal)\b"), ("TJSB Bank", r"(?i)\b(tjsb\s+co-operative\s+bank|tjsb\s+bank)\b"), ("DBS Bank", r"(?i)\b(dbs\s+bank|dbs\b)\b"),
    ("Standard Chartered", r"(?i)\b(standard\s+chartered(\s+bank)?|stan\s+chart)\b"), ("HSBC Bank", r"(?i)\b(hsbc(\s+bank)?)\b"), ("Citibank", r"(?i)\b(citibank|citi\s+bank|citi\b)\b"),
    ("Barclays", r"(?i)\b(barclays(\s+bank)?)\b"), ("Chase Bank", r"(?i)\b(chase\s+bank|jpmorgan\s+chase|chase\b)\b"), ("Bank of America", r"(?i)\b(bank\s+of\s+america|bofa\b)\b"),
    ("Wells Fargo", r"(?i)\b(wells\s+fargo(\s+bank)?)\b"),
]
# What other kinds of documents say, and how much that counts against a statement.
AGAINST = [
    ("Aadhaar Card / UIDAI Document", r"(?i)(unique\s+identification\s+authority\s+of\s+india|uidai|mera\s+aadhaar|aadhaar\s+number|enrollment\s+no|vid\s*:\s*\d{4})", 70),
    ("PAN Card / Income Tax Filing", r"(?i)(income\s+tax\s+department|govt\.\s+of\s+india|permanent\s+account\s+number\s+card|form\s+26as|tax\s+deducted\s+at\s+source\s+certificate)", 65),
    ("Salary Slip / Payslip", r"(?i)\b(payslip|pay\s+slip|salary\s+slip|earnings\s+and\s+deductions|basic\s+pay|provident\s+fund\s+deduction|gross\s+earnings|net\s+pay\s+in\s+words)\b", 60),
    ("Tax Invoice / Commercial Bill", r"(?i)\b(tax\s+invoice|commercial\s+invoice|bill\s+to\s*:|ship\s+to\s*:|buyer\s*\(bill\s+to\)|invoice\s+value|proforma\s+invoice)\b", 60),
    ("Loan Agreement / Sanction Letter", r"(?i)\b(sanction\s+letter|loan\s+sanction|facility\s+agreement|term\s+loan\s+agreement|borrower\s+details|disbursal\s+schedule|terms\s+of\s+sanction)\b", 55),
    ("Utility Bill (Electricity/Water/Gas)", r"(?i)\b(electricity\s+bill|power\s+distribution|consumer\s+number|meter\s+reading|tariff\s+category|units\s+consumed|connected\s+load)\b", 60),
    ("Insurance Policy Document", r"(?i)\b(insurance\s+policy|policy\s+schedule|sum\s+insured|sum\s+assured|premium\s+receipt|period\s+of\s+insurance|proposer\s+name)\b", 60),
    ("Academic Document / Marksheet", r"(?i)\b(marksheet|semester\s+examination|roll\s+number|credits\s+earned|controller\s+of\s+examinations|degree\s+certificate)\b", 70),
]
#: Kinds of documents whose words a ledger's narrations may have.
IN_LEDGERS = ["Salary", "Invoice", "Utility", "Insurance", "Loan", "Academic"]
# Most points of each signal; least points of a statement and of an uncertain document; least length of a text.
WEIGHTS = {"bank_identity": 20, "account_info": 20, "statement_period": 15, "transaction_table": 25, "financial_columns": 15, "banking_keywords": 5}
STATEMENT, UNCERTAIN, READABLE = 50, 25, 10
# Patterns of the signals.
_DAY = r"\d{1,2}[/\-.\s](?:[a-zA-Z]{3,9}|\d{1,2})[/\-.\s]\d{2,4}"
SIGNALS = {
    "bank_word": r"(?i)\b(bank|banking|branch|co-operative\s+bank|gramin\s+bank|financial\s+services)\b",
    "statement_word": r"(?i)\b(account\s+statement|statement\s+of\s+account|e-statement|account\s+summary)\b",
    "ifsc": r"\b([A-Z]{4}0[A-Z0-9]{6})\b",
    "routing": r"(?i)\b(ifsc|micr|branch\s*code|sort\s*code|routing\s*no|iban|swift|bsb)\b",
    "account": r"(?i)(?:account\s*(?:number|no|#|\.)|a/c\s*(?:no|number|\.)|acct\s*no|account\s*id)\s*[:\-]?\s*([X\d]{5,24})",
    "account_word": r"(?i)\b(savings\s+account|current\s+account|cif\s+no|customer\s+id|account\s+holder|a/c)\b",
    "period": rf"(?i)(?:statement\s+period|period\s+from|from\s+date|txn\s+period|statement\s+from|period|date\s+range|from)\s*[:\-]?\s*({_DAY})\s*(?:to|-)\s*({_DAY})",
    "period_word": r"(?i)(?:statement|period|date|summary|transactions)\b",
    "day": r"\b\d{1,2}[/\-.\s](?:\d{1,2}|[a-zA-Z]{3,9})[/\-.\s]\d{2,4}\b",
    "row": r"\b\d{1,2}[/\-.](?:\d{1,2}|[a-zA-Z]{3})[/\-.]\d{2,4}\b[^\n\r]{3,100}\b\d+(?:\.\d{2})?\b",
    "date_column": r"(?i)\b(date|txn\s*date|value\s*date|posting\s*date|booking\s*date)\b",
    "text_column": r"(?i)\b(narration|particulars|description|details|remarks|transaction\s*details)\b",
    "amount_column": r"(?i)\b(withdrawal|debit|deposit|credit|dr\b|cr\b|amount|chq\s*/|ref\s*no)\b",
    "balance_column": r"(?i)\b(balance|bal\b|closing\s*bal|running\s*bal)\b",
    "stated": r"(?i)(?:opening\s+balance|closing\s+balance|clear\s+balance|book\s+balance|b/f|c/f|available\s+balance|total\s+balance)",
    "sides": r"(?i)(?:debit|withdrawal|dr\b|credit|deposit|cr\b)",
    "balance": r"(?i)(?:balance|bal\b)",
}


#: All banks as one pattern: it finds the first place that has any, and there the first of the list.
_ANY_BANK = "(?i)\\b(?:" + "|".join(p.removeprefix(r"(?i)\b").removesuffix(r"\b") for _, p in BANKS) + r")\b"


def first_bank(text: Column) -> Column:
    """The bank whose words stand first; among equals the first of the list. The text is searched once; the words found then tell the bank."""

    def named(words: Column) -> Column:
        return first_match([(words.rlike("^(?i:" + p.removeprefix("(?i)") + ")"), n) for n, p in BANKS], None)

    return let(F.regexp_extract(text, _ANY_BANK, 0), lambda words: F.when(words != "", named(words)))


def score(documents: DataFrame) -> DataFrame:
    """Points of each signal of a document's text (doc_id, raw_text), penalties (kinds of other documents, each once), total, confidence and decision."""
    t = F.col("text")
    has = lambda k: t.rlike(SIGNALS[k])
    part = lambda k, share: F.lit(int(WEIGHTS[k] * share))
    named = documents.select("doc_id", F.trim(F.coalesce("raw_text", F.lit(""))).alias("text")).withColumn("bank", first_bank(t)).withColumn("words", payment_words(t)).withColumn("rows", F.size(F.regexp_extract_all(t, F.lit(SIGNALS["row"]), 0)))
    bank = F.when(F.col("bank").isNotNull(), part("bank_identity", 1)).when(has("bank_word"), part("bank_identity", 0.6)).when(has("statement_word"), part("bank_identity", 0.5)).otherwise(0)
    account = F.when(has("ifsc"), 10).when(has("routing"), 6).otherwise(0) + F.when(has("account"), 10).when(has("account_word"), 7).otherwise(0)
    period = F.when(has("period"), part("statement_period", 1)).when(has("period_word") & has("day"), part("statement_period", 0.8)).otherwise(0)
    columns = has("date_column") & has("text_column") & (has("amount_column") | has("balance_column"))
    table = F.when(columns & (F.col("rows") >= 3), part("transaction_table", 1)).when(columns | (F.col("rows") >= 4), part("transaction_table", 0.8)).when((F.col("rows") >= 1) | (has("date_column") & has("balance_column")), part("transaction_table", 0.5)).otherwise(0)
    money = F.when(has("stated"), 6).otherwise(0) + F.when(has("sides"), 6).otherwise(0) + F.when(has("balance"), 3).otherwise(0)
    words = F.when(F.col("words") >= 2, part("banking_keywords", 1)).when(F.col("words") == 1, part("banking_keywords", 0.6)).otherwise(0)
    parts = dict(zip(WEIGHTS, (bank, account, period, table, money, words), strict=True))
    points = named.select("*", *[F.least(F.lit(WEIGHTS[k]), v).alias(k) for k, v in parts.items()])
    c = F.col
    ledger = (c("transaction_table") >= 15) & (c("financial_columns") >= 9) & ((c("bank_identity") >= 10) | (c("account_info") >= 7) | (c("words") >= 2))
    spared = lambda n: any(w in n for w in IN_LEDGERS)
    seen = F.array_distinct(F.array_compact(F.array(*[F.when(t.rlike(p) & (~ledger if spared(n) else F.lit(True)), F.struct(F.lit(n).alias("name"), F.lit(w).alias("penalty"))) for n, p, w in AGAINST])))
    found = points.withColumn("against", seen).withColumn("penalty", F.aggregate("against", F.lit(0), lambda n, a: n + a["penalty"]))
    found = found.withColumn("total", F.greatest(F.lit(0), F.least(F.lit(100), reduce(lambda a, b: a + b, map(c, WEIGHTS)) - c("penalty"))))
    backed = (c("penalty") == 0) & (c("transaction_table") >= 15) & ((c("financial_columns") >= 6) | (c("bank_identity") >= 10) | (c("account_info") >= 7))
    decision = (
        F.when(F.length("text") < READABLE, "UNREADABLE").when((c("penalty") >= 50) | ((c("penalty") > 0) & (c("total") < UNCERTAIN)), "NOT_BANK_STATEMENT").when((c("total") >= STATEMENT) | backed, "BANK_STATEMENT")
        .when(c("total") >= UNCERTAIN, "UNCERTAIN").otherwise("NOT_BANK_STATEMENT")
    )
    readable = F.length("text") >= READABLE
    zero = lambda k: F.when(readable, c(k)).otherwise(0).cast("long").alias(k)
    return found.select("doc_id", F.when(readable, c("bank")).alias("bank"), *map(zero, [*WEIGHTS, "penalty", "total"]), F.when(readable, F.array_join(F.transform("against", lambda a: a["name"]), ", ")).otherwise("").alias("against"), (F.when(readable, c("total")).otherwise(0) / 100.0).alias("confidence"), decision.alias("decision"))
