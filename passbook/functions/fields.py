"""Account fields, document evidence and page kinds from statement text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import parse
from .money import clean_amount, let
from .text import _found, first_match

# Bank names with the aliases and routing prefix that tell them; the first that is found in the text counts.
BANKS = [
    ("Kotak Mahindra Bank", ["kotak", "kotak mahindra", "kotak bank", "kkbk"]),
    ("Axis Bank", ["axis", "axis bank", "utib"]),
    ("HDFC Bank", ["hdfc", "hdfc bank", "hdfcbank"]),
    ("State Bank of India", ["sbi", "state bank", "state bank of india", "sbin"]),
    ("ICICI Bank", ["icici", "icici bank", "icic"]),
    ("Punjab National Bank", ["pnb", "punjab national bank", "punb"]),
    ("Bank of Baroda", ["bob", "bank of baroda", "barb"]),
    ("Canara Bank", ["canara", "canara bank", "cnrb"]),
    ("Standard Chartered Bank", ["standard chartered", "scb", "sc", "scbl"]),
    ("HSBC", ["hsbc", "hsbc bank", "hongkong and shanghai"]),
]
# Labels before amounts and numbers.
AMOUNT = r"([₹$€\d,.\-]+)"
OPENING = [r"(?i)(?:opening\s*balance|beginning\s*balance|open\s*bal|op\s*bal)[\s:.\-_#=]*" + AMOUNT, r"(?i)(?:b/f|brought\s*forward)[\s:.\-_#=]*" + AMOUNT]
CLOSING = [r"(?i)(?:closing\s*balance|ending\s*balance|close\s*bal|cl\s*bal|total\s*closing\s*balance)[\s:.\-_#=]*" + AMOUNT, r"(?i)(?:c/f|carried\s*forward|available\s*balance)[\s:.\-_#=]*" + AMOUNT]
CREDITS = [r"(?i)(?:total\s*credits?|total\s*deposits?|total\s*cr(?:\.?\s*amount)?)[\s:.\-_#=]*" + AMOUNT]
DEBITS = [r"(?i)(?:total\s*debits?|total\s*withdrawals?|total\s*dr(?:\.?\s*amount)?)[\s:.\-_#=]*" + AMOUNT]
ACCOUNT = [r"(?i)(?:account\s*(?:number|num|no)|a/c\s*(?:number|num|no)|acc\s*(?:no|number)|a/c)[\s:.\-_#]*([A-Za-z0-9]{8,22})", r"(?i)(?:account)[\s:.\-_#]+([A-Za-z0-9]{8,22})"]
# Words that look like account numbers to the patterns, and words that speak for a scanned statement.
NOT_ACCOUNTS = ["statement", "transactions", "particulars", "description", "information", "summary", "category", "financial", "details", "opening", "closing", "balance"]
GATE_WORDS = ["statement", "account", "balance", "transaction", "debit", "credit", "withdrawal", "deposit", "bank", "branch", "ifsc", "particulars", "narration", "cheque", "opening", "closing", "date", "amount", "inr", "cr", "dr"]
# Words that tell kinds of pages: what must and what must not be there.
PAGES = [
    ("ADVERTISEMENT_PAGE", [r"\b(rewards\s+program|credit\s+card\s+offers|exclusive\s+deals|apply\s+now\s+for|download\s+our\s+app|explore\s+our\s+products|personal\s+loan\s+offers)\b"], r"\b(tran\s*date|particulars|withdrawal|deposit|balance|opening\s+balance|closing\s+balance)\b"),
    ("INFORMATION_PAGE", [r"\b(important\s+information|terms\s*(&|\s+and\s+)\s*conditions|grievance\s+redressal|banking\s+ombudsman|statutory\s+notice|legend\s*:\s*upi)\b"], r"\b(tran\s*date|withdrawal|deposit|opening\s+balance|closing\s+balance)\b"),
    ("SUMMARY_PAGE", [r"\b(account\s+summary|statement\s+summary|total\s+withdrawals|total\s+deposits|closing\s+balance\s*[:=]|summary\s+of\s+accounts)\b"], r"\b(tran\s*date|chq\s*no|ref\s*no|upi/|neft/|imps/)\b"),
    ("TRANSACTION_PAGE", [r"\b(tran\s*date|value\s*date|date)\b", r"\b(particulars|narration|description|details|withdrawal|deposit|debit|credit|balance)\b"], None),
    ("ACCOUNT_INFO_PAGE", [r"\b(account\s*(number|no)|customer\s*(id|name)|ifsc|branch|account\s+type|micr)\b"], None),
]
# Evidence by pattern on lower-cased text: signal, group, weight, where it is sought (info: account region, then page one; all: every page).
EVIDENCE = [
    ("ACCOUNT_NUMBER", "ACCOUNT_INFO", 25, "info", r"(?:account\s*(?:no|number|num)|a/c\s*(?:no|num|number)|acc\s*(?:no|num)|a/c)[\s:.\-_#]*([a-z0-9]{8,22})|\b(?:account|a/c)[\s:.\-_#]+(\d{9,18})\b"),
    ("CUSTOMER_ID", "ACCOUNT_INFO", 15, "info", r"\b(?:customer\s*(?:id|no|number)|cust\s*id|crn|cif\s*(?:no|number)|client\s*id)[\s:.\-_#]*([a-z0-9]{4,18})\b"),
    ("ACCOUNT_HOLDER", "ACCOUNT_INFO", 15, "info", r"\b(?:customer\s*name|name\s*of\s*(?:holder|account|customer)|account\s*holder|mr\.|mrs\.|ms\.|shri|smt\.)[\s:]*([a-z\s.]{3,35})"),
    ("ACCOUNT_TYPE", "ACCOUNT_INFO", 15, "info", r"\b(?:savings\s*(?:account|a/c)|current\s*(?:account|a/c)|checking\s*(?:account|a/c)|salary\s*(?:account|a/c)|overdraft\s*(?:account|a/c))\b"),
    ("IFSC", "ROUTING_CODES", 20, "all", r"\b([a-z]{4}0[a-z0-9]{6})\b"),
    ("MICR_CODE", "ROUTING_CODES", 15, "all", r"\bmicr(?:\s*code)?[\s:.\-_]*(\d{9})\b"),
    ("STATEMENT_PERIOD", "STATEMENT_PERIOD", 15, "all", r"\b(?:statement\s*period|period\s*from|statement\s*date|for\s*the\s*period|statement\s*from|account\s*statement\s*for)\b"),
    ("OPENING_BALANCE", "BALANCES", 15, "all", r"\b(?:opening\s*balance|beginning\s*balance|brought\s*forward|b/f)\b"),
    ("CLOSING_BALANCE", "BALANCES", 15, "all", r"\b(?:closing\s*balance|ending\s*balance|carried\s*forward|c/f|available\s*balance|cleared\s*balance)\b"),
]
SWIFT = r"\b(?:swift|bic)(?:\s*code)?[\s:.\-_]*([a-z]{6}[a-z0-9]{2,5})\b"
HEADER_BANK = r"\bbank\b|\bbanking\b|\bfinancial\s+services\b|\bcredit\s+union\b|\bbuilding\s+society\b|\bfinances?\b"
GENERIC_BANK = r"[a-z\s]+\s+bank\b"
# Columns that a ledger's header line names.
LEDGER_HEADER = [
    r"\b(date|tran\s*date|trans\s*date|txn\s*date|value\s*date|posting\s*date)\b",
    r"\b(particulars|description|narration|remarks|transaction\s*details|details)\b",
    r"\b(debit|credit|dr|cr|withdrawal|deposit|withdrawals|deposits|paid\s*out|paid\s*in|amount)\b",
    r"\b(balance|running\s*balance|available\s*balance|closing\s*balance|net\s*balance)\b",
]
# Pillars of other kinds of documents; a pillar holds if all its patterns are found in (head: page one's header region, one: page one, all: every page).
INVOICE = [
    [("head", r"\b(tax\s*invoice|commercial\s*invoice|bill\s*of\s*supply|proforma\s*invoice)\b")],
    [("one", r"\b(invoice\s*(?:no|number|#)|bill\s*(?:no|number))\b"), ("one", r"\b(invoice\s*date|due\s*date|po\s*(?:no|number|date))\b")],
    [("one", r"\b(sold\s*by|seller|vendor|supplier)\b"), ("one", r"\b(bill\s*to|ship\s*to|buyer|consignee)\b")],
    [("one", r"\b(qty|quantity|units?)\b"), ("one", r"\b(rate|unit\s*price|price/unit)\b"), ("one", r"\b(hsn|sac|cgst|sgst|igst|tax\s*rate)\b")],
]
LOAN = [
    [("head", r"\b(loan\s*agreement|facility\s*agreement|sanction\s*letter|promissory\s*note|mortgage\s*deed|deed\s*of\s*hypothecation)\b")],
    [("one", r"\b(borrower|debtor|obligor|borrower\s*name)\b"), ("one", r"\b(lender|creditor|financier|bank\s*as\s*lender)\b")],
    [("one", r"\b(whereas|recitals|now\s*therefore|terms\s*and\s*conditions|event\s*of\s*default|governing\s*law|jurisdiction)\b")],
    [("all", r"\b(in\s*witness\s*whereof|signature\s*of\s*borrower|authorised\s*signatory|witness\s*1|signed,\s*sealed)\b")],
]
PAYSLIP = {
    "title": r"\b(payslip|salary\s*slip|pay\s*slip\s*for\s*the\s*month)\b",
    "employee": r"\b(employee\s*(?:id|code|name)|uan|pf\s*no|designation|department)\b",
    "earnings": r"\b(basic|hra|gross\s*salary|gross\s*earnings|net\s*pay|take\s*home)\b",
    "deductions": r"\b(provident\s*fund|epf|professional\s*tax|tds|deductions)\b",
}
AADHAAR = r"\b(unique\s+identification\s+authority\s+of\s+india|uidai)\b|मेरा\s+आधार"
PAN_CARD = r"\b(incometax\s+department|permanent\s+account\s+number\s+card)\b"
RESUME = (r"\b(curriculum\s+vitae|resume)\b", r"\b(education|experience|skills|projects)\b")


def bank(text: Column) -> Column:
    """The first bank of the list of which the text has an alias, as a bare substring."""
    low = F.lower(text)
    rules = []
    for name, aliases in BANKS:
        found = low.contains(aliases[0])
        for alias in aliases[1:]:
            found = found | low.contains(alias)
        rules.append((found, name))
    return first_match(rules, None)


def earliest_bank(text: Column) -> Column:
    """The bank whose alias stands first in the text; among equal places, the first of the list."""
    low = F.lower(text)
    places = [F.struct(F.array_min(F.filter(F.array(*[F.instr(low, a) for a in aliases]), lambda p: p > 0)).alias("at"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, aliases) in enumerate(BANKS)]
    return F.array_min(F.filter(F.array(*places), lambda p: p["at"].isNotNull()))["name"]


def labelled_amount(text: Column, patterns: list[str]) -> Column:
    """The amount behind the first label that has one."""
    return F.coalesce(*[clean_amount(_found(text, p)) for p in patterns])


def account_number(text: Column) -> Column:
    """A labelled account number with four digits or more that is no common word or routing code; else 9 to 18 digits that aren't the MICR code."""
    tries = []
    for pattern in ACCOUNT:
        good = F.filter(F.regexp_extract_all(text, F.lit(pattern), 1), lambda c: (F.length(F.regexp_replace(c, r"\D", "")) >= 4) & ~F.lower(c).isin(NOT_ACCOUNTS) & ~c.rlike(r"^[A-Z]{4}0[A-Z0-9]{6}$"))
        tries.append(F.get(good, 0))
    bare = F.regexp_extract_all(text, F.lit(r"\b(\d{9,18})\b"), 1)
    code = _found(text, r"(?i)\bmicr(?:\s*code)?[\s:.\-_]*(\d{9})\b")
    return F.coalesce(*tries, F.get(F.filter(bare, lambda c: ~c.eqNullSafe(code)), 0))


def account_type(text: Column) -> Column:
    return F.when(F.lower(text).contains("saving"), "Savings").otherwise("Current")


def page_kind(text: Column) -> Column:
    low, rules = F.lower(text), []
    for kind, need, without in PAGES:
        test = low.rlike(need[0])
        for p in need[1:]:
            test = test & low.rlike(p)
        rules.append((test if without is None else test & ~low.rlike(without), kind))
    return first_match(rules, "UNKNOWN")


def ledger_lines(line: Column) -> Column:
    """struct(columns, is_row) of a printed line: how many of the four header columns it names, and whether it is a dated row with an amount."""
    low = F.lower(line)
    columns = sum((F.when(low.rlike(p), 1).otherwise(0) for p in LEDGER_HEADER), F.lit(0))

    def row(words: Column) -> Column:
        dated = parse(F.get(words, 0)).isNotNull() | parse(F.array_join(F.slice(words, 1, 2), " ")).isNotNull()
        return dated & F.exists(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: clean_amount(w).isNotNull())

    return F.struct(columns.alias("columns"), F.coalesce(let(F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != ""), row), F.lit(False)).alias("is_row"))


def evidence(where: dict[str, Column], header: Column, rows: Column) -> Column:
    """array<struct<signal, kind, weight, sign>> of what a document shows for and against a bank statement.

    ``where`` has its lower-cased texts: head (header region of page one), info
    (account and header regions), one (page one), all (every page). ``header``: most
    columns that one line names, from 3; ``rows``: dated lines with an amount.
    """
    item = lambda test, *v: F.when(test, F.struct(F.lit(v[0]).alias("signal"), F.lit(v[1]).alias("kind"), (v[2] if isinstance(v[2], Column) else F.lit(v[2])).cast("long").alias("weight"), F.lit(v[3]).cast("long").alias("sign")))
    seen = lambda place, pattern: where["info"].rlike(pattern) | where["one"].rlike(pattern) if place == "info" else where[place].rlike(pattern)
    known, head_word = bank(where["all"]).isNotNull(), where["head"].rlike(HEADER_BANK)
    generic = ~known & ~head_word & F.substring(where["all"], 1, 1000).rlike(GENERIC_BANK)
    identity, ledger = known | head_word | generic, (header >= 3) | (rows >= 3)
    items = [item(known, "KNOWN_BANK", "BANK_IDENTITY", 35, 1), item(head_word, "HEADER_BANK", "BANK_IDENTITY", 25, 1), item(generic, "GENERIC_BANK", "BANK_IDENTITY", 20, 1)]
    items += [item(seen(place, p), s, k, w, 1) for s, k, w, place, p in EVIDENCE]
    items += [item(where["all"].rlike(SWIFT) & ~where["all"].rlike(next(e[4] for e in EVIDENCE if e[0] == "IFSC")), "SWIFT", "ROUTING_CODES", 20, 1)]
    items += [item(header >= 3, "TABLE_HEADER", "LEDGER", F.when(header == 4, 35).otherwise(25), 1), item(rows > 0, "LEDGER_ROWS", "LEDGER", F.when(rows >= 10, 35).when(rows >= 4, 25).otherwise(15), 1)]

    def pillars(groups: list) -> Column:
        held = F.lit(0)
        for group in groups:
            test = F.lit(True)
            for place, p in group:
                test = test & where[place].rlike(p)
            held = held + F.when(test, 1).otherwise(0)
        return held

    title = F.coalesce(F.nullif(where["head"], F.lit("")), where["one"])
    pay = {k: (title if k == "title" else where["one"]).rlike(p) for k, p in PAYSLIP.items()}
    against = F.when(ledger, 30).otherwise(70)
    items += [item(~(ledger & identity) & (pillars(groups) >= 3), k, k, against, -1) for k, groups in (("INVOICE", INVOICE), ("LOAN_AGREEMENT", LOAN))]
    items += [item(~ledger & pay["title"] & pay["employee"] & (pay["earnings"] | pay["deductions"]), "PAYSLIP", "PAYSLIP", 75, -1), item(~ledger & where["all"].rlike(AADHAAR), "AADHAAR", "AADHAAR", 80, -1)]
    items += [item(~ledger & ~identity & where["all"].rlike(PAN_CARD), "PAN_CARD", "PAN_CARD", 80, -1), item(~ledger & title.rlike(RESUME[0]) & where["one"].rlike(RESUME[1]), "RESUME", "RESUME", 80, -1)]
    return F.array_compact(F.array(*items))


#: Lines of a page that are read for its head and its foot, and letters of a document that tell its bank and its kind.
HEAD_LINES, FOOT_LINES, BANK_LETTERS, KIND_LETTERS = 35, 30, 1500, 1000


def head_lines(text: Column, most: int = HEAD_LINES) -> Column:
    """The first lines of a page."""
    return F.array_join(F.slice(F.split(text, "\n"), 1, most), "\n")


def foot_lines(text: Column, most: int = FOOT_LINES) -> Column:
    """The last lines of a page."""
    return let(F.split(text, "\n"), lambda x: F.array_join(F.slice(x, F.greatest(F.size(x) - most + 1, F.lit(1)), F.lit(most)), "\n"))
