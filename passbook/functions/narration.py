"""Narrations over several lines, table headings, holders' names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import let
from .phrases import has_phrase, has_word
from .text import clean_narration, first_match

# Payment words that speak for a statement.
PAYMENT_WORDS = ["UPI", "NEFT", "IMPS", "RTGS", "ACH", "NACH", "ECS", "ATM", "POS", "CHQ", "CHEQUE", "REV-UPI", "TRANSFER", "BBPS", "DEPOSIT", "WITHDRAWAL", "INTEREST"]
# Table headings by column; the first column one of whose headings is found counts.
HEADINGS = [
    ("DATE", r"\b(tran|trans|transaction|value|posting|txn)?date\b"),
    ("DESCRIPTION", r"\bdescription\b|\bparticulars?\b|\bnarrations?\b|\bremarks\b|\b(transaction)?details\b"),
    ("REFERENCE", r"\breference\b|\bref(no)?\b|\bcheque\s*no\b|\bchq(no)?\b|\butr\b|\btransaction\s*id\b|\btxn\s*id\b|\bcha\s*/\s*ref\b"),
    ("DEBIT", r"\bdebits?\b|\bdebitamount\b|\bdr\b|\bwithdrawals?\b|\bpaid\s*out\b|\b(withdrawal|debit)dr\b|\(dr\.?\)|\bdr\.|\(or\.?\)"),
    ("CREDIT", r"\bcredits?\b|\bcreditamount\b|\bcr\b|\bdeposits?\b|\bpaid\s*in\b|\b(deposit|credit)cr\b|\(cr\.?\)|\bcr\."),
    ("BALANCE", r"\b(running|available|closing|net)?balance(inr|rs)?\b|\bbal\b"),
    ("AMOUNT", r"\b(txn|transaction)?amount(inr|rs)?\b"),
    ("DR_CR", r"\bcr\s*/\s*dr\b|\bdr\s*/\s*cr\b|\btype\b|\bc\s*/\s*d\b|\bd\s*/\s*c\b"),
]
# Words that go on a heading, whatever its column.
HEADING_ENDS = ["no", "no.", "id", "num", "number", "details", "dr", "cr", "dr.", "cr.", "(dr)", "(cr)", "(dr.)", "(cr.)", "(or)", "(or.)"]
# Whole words that are a column's heading in the second dialect.
WHOLE_HEADINGS = [
    ("DATE", r"(?i)^(date|tran\s*date|txn\s*date|value\s*date)$"), ("DESCRIPTION", r"(?i)^(particulars|narration|description|details)$"), ("REFERENCE", r"(?i)^(chq|ref|chq/ref|cheque|reference|chq\s*no)$"),
    ("DEBIT", r"(?i)^(withdrawal|withdrawals|debit|dr|dr\.|withdrawal\s*\(dr\))$"), ("CREDIT", r"(?i)^(deposit|deposits|credit|cr|cr\.|deposit\s*\(cr\))$"), ("BALANCE", r"(?i)^(balance|running\s*balance|bal)$"),
]
# Phrases of pages without a table.
NOTICES = ["important information", "account summary", "end of statement", "terms and conditions", "statutory notice", "step into the", "commonly used narrations"]
# Display names of categories.
CATEGORY_NAMES = {
    "RE_05": "Salary / Employment Income", "RE_17": "Inward UPI / Bank Transfers", "RE_07": "Inward Credit Transfers", "LO_05": "Loan Disbursal / Credit", "ZZ_98": "Other Inward Credits", "RE_11": "Investment Dividends / Returns", "TF_05": "Account Verification Credits",
    "FD_00": "Food, Dining & Delivery", "FD_01": "Groceries & Supermarkets", "FD_03": "Cafes & Fast Food", "SH_00": "Shopping & General Retail", "SH_01": "Electronics & Gadgets", "SH_03": "Apparel & Department Stores", "BL_01": "Utility & Mobile Recharge", "BL_02": "Rent & Subscriptions",
    "LO_03": "Loan Repayments / EMI", "HF_05": "Courier & Logistics Services", "HF_06": "Healthcare & Medical", "IN_03": "Insurance Premiums", "TR_07": "Travel, Fuel & Rides", "OO_03": "Outward P2P UPI Transfers", "OO_02": "Cash Withdrawal", "OO_00": "Bank Charges & SMS Fees", "ZZ_99": "General Account Outflows", "FA_03": "Mutual Funds / Securities Investments",
}
# Labels before a holder's name, and what no name is.
HOLDER = r"(?i)(?:customer\s*name|name\s*of\s*(?:the\s*)?(?:account\s*)?holder|account\s*holder(?:\s*name)?|a/c\s*holder(?:\s*name)?|primary\s*holder|account\s*name)[\s:.\-_#]*([A-Za-z\s.]{3,45})(?:\n|\r|,|account|a/c|address|cust|crn|cif|ifsc|micr|phone|mobile|$)"
TITLED = r"(?i)(?:m/s|mr\.|mrs\.|ms\.|shri|smt\.|dr\.)[\s:]*([A-Za-z\s.]{3,35})(?:\n|\r|,|account|a/c|address|cust|crn|cif|$)"
NAMED = r"(?i)(?:^|\n|\r)(?:name)[\s:.\-_]+([A-Za-z\s.]{3,35})(?:\n|\r|,|account|a/c|address|$)"
NOT_NAMES = [
    "primary account", "account", "savings account", "current account", "primary", "customer", "statement", "details", "bank", "transactions", "savings", "current", "overdraft", "account holder", "customer name",
    "nominee", "branch", "ifsc", "micr", "period", "number", "type", "of", "date", "balance", "opening", "closing", "page", "total", "joint account", "joint", "resident", "individual", "salaried", "particulars", "description", "summary", "crn", "cif", "pan",
    "mobile", "email", "address", "registered", "branch code", "currency", "inr", "mode of operation", "nomination", "registered mobile", "customer id", "statement period", "statement date", "from date", "to date",
]
NOT_NAME_ENDS = ["primary account", "savings account", "current account", "account details", "bank statement"]
# Phrases of which no customer's name has one, and words that are none of its words.
NOT_CUSTOMERS = [
    "goods and services tax", "goods & services tax", "gst", "tax", "tax invoice", "kotak", "kotak mahindra", "axis bank", "hdfc bank", "icici bank", "state bank", "bank", "statement", "statement of account", "account statement", "savings account", "current account", "overdraft", "crn", "ifsc", "micr",
    "rtgs", "neft", "imps", "nomination", "registered office", "head office", "branch office", "zonal office", "terms and conditions", "banking ombudsman", "customer id", "customer care", "account number", "opening balance", "closing balance", "available balance", "particulars", "description",
    "withdrawal", "deposit", "transaction", "badarpur", "badarpur border", "molar band", "molarband",
]
NOT_CUSTOMER_WORDS = [
    "branch", "br", "bo", "border", "road", "rd", "street", "st", "marg", "lane", "gali", "nagar", "vihar", "pur", "pura", "puri", "enclave", "block", "sector", "sec", "phase", "pocket",
    "delhi", "mumbai", "bangalore", "bengaluru", "kolkata", "chennai", "hyderabad", "noida", "gurgaon", "gurugram", "faridabad", "ghaziabad", "pune", "ahmedabad", "jaipur", "chandigarh", "lucknow",
    "floor", "flr", "bldg", "building", "tower", "house", "plot", "flat", "apartment", "apt", "complex", "plaza", "chambers", "arcade", "centre", "center", "residency", "villas", "society",
    "colony", "extn", "extension", "bazaar", "market", "mandi", "chowk", "junction", "circle", "bridge", "flyover", "station", "depot", "terminal", "airport", "cantt", "post", "po", "pin",
    "pincode", "dist", "district", "state", "india", "opp", "opposite", "near", "nr", "behind", "ltd", "limited", "pvt", "private", "inc", "corp", "corporation", "services", "solutions",
    "enterprises", "holdings", "ventures", "technologies", "industries", "trading", "agency", "associates", "consultancy", "management", "finance", "financial", "insurance", "capital",
    "trust", "foundation", "association", "club", "board", "council", "authority", "commission", "ministry", "department", "govt", "government", "office", "gstin", "cin", "pan", "tan",
]


def merged(lines: Column) -> Column:
    """Lines of one narration joined: at slashes and hyphens without a blank, within a split word without one, else with one."""
    kept = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")

    def join(acc: Column, x: Column) -> Column:
        slash = F.when(acc.endswith("/") & x.startswith("/"), F.concat(acc, F.substring(x, F.lit(2), F.length(x)))).otherwise(F.concat(acc, x))
        tight = (acc.rlike("[a-zA-Z]$") & x.rlike("^[a-z]")) | acc.endswith("-")
        return F.when(acc == "", x).when(acc.endswith("/") | x.startswith("/"), slash).when(tight, F.concat(acc, x)).otherwise(F.concat(acc, F.lit(" "), x))

    text = clean_narration(F.aggregate(kept, F.lit(""), join))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("Bank Transaction"))


def heading(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return first_match([(low.rlike(p), name) for name, p in HEADINGS], None)


def payment_words(text: Column) -> Column:
    """How many of the payment words the text has."""
    return F.size(F.array_compact(F.array(*[F.when(text.rlike(rf"(?i)\b{w}\b"), F.lit(1)) for w in PAYMENT_WORDS]))).cast("long")


def category_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in CATEGORY_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, code), F.concat(F.lit("Category ("), code, F.lit(")")))


def nearest_column(at: Column, debit: Column, credit: Column, balance: Column) -> Column:
    """Column whose centre is nearest to a printed amount; CREDIT among equals."""
    d, c, b = F.abs(at - debit), F.abs(at - credit), F.abs(at - F.coalesce(balance, F.lit(1e9)))
    return F.when(at.isNull() | debit.isNull() | credit.isNull(), "UNKNOWN").when((b < d) & (b < c), "BALANCE").when(d < c, "DEBIT").otherwise("CREDIT")


def customer(name: Column) -> Column:
    """Whether ``name`` may be a customer's: three characters, no digit, none of the phrases and words that names don't have."""

    def ok(low: Column) -> Column:
        return (F.length(low) >= 3) & ~has_phrase(low, NOT_CUSTOMERS) & ~has_word(low, NOT_CUSTOMER_WORDS, r"\s,.\-_/\\()") & ~low.rlike(r"\d")

    return F.coalesce(let(F.lower(F.trim(name)), ok), F.lit(False))


def bare(text: Column) -> Column:
    """Without blanks and marks at its ends."""
    return F.regexp_replace(text, r"^[\s:.\-_#]+|[\s:.\-_#]+$", "")


def holder_candidate(text: Column) -> Column:
    """Whether a text may be a holder's name: three characters, no digit, no banking term, a word of letters that is no such term alone."""

    def ok(name: Column) -> Column:
        low, words = F.lower(name), F.filter(F.split(name, r"\s+"), lambda w: w.rlike(r"^\pL{2,}$"))
        ends = "|".join(NOT_NAME_ENDS)
        alone = (F.size(words) == 1) & F.lower(F.get(words, 0)).isin(NOT_NAMES)
        return (F.length(name) >= 3) & ~name.rlike(r"\d") & ~low.isin(NOT_NAMES) & ~low.rlike(rf"^(?:{ends})(?: |$)|(?:^| )(?:{ends})$") & (F.size(words) > 0) & ~alone

    return F.coalesce(let(bare(text), ok), F.lit(False))


def titled(name: Column) -> Column:
    """Each word, also behind a point, with a capital."""
    return F.array_join(F.transform(F.split(name, r"\.", -1), F.initcap), ".")


def holder(*texts: Column) -> Column:
    """The first holder's name behind a holder label, else behind a title, else behind "name"; each is sought in all ``texts`` in turn."""
    found = [F.coalesce(F.regexp_extract_all(t, F.lit(p), 1), F.array().cast("array<string>")) for p in (HOLDER, TITLED, NAMED) for t in texts]
    return let(F.get(F.filter(F.concat(*found), holder_candidate), 0), lambda name: titled(bare(name)))


def native_sufficient(text: Column) -> Column:
    """Whether a page's own text needs no scan: 50 characters and six words of two letters."""
    return (F.length(text) >= 50) & (F.size(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 1)) >= 6)
