"""Narration rules and text scalars: ordered keyword rules become one CASE chain each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Payment modes by narration, first match counts.
MODES = [
    ("UPI", r"\b(upi|gpay|phonepe|paytm|bhim)\b"),
    ("NEFT", r"\bneft\b"),
    ("IMPS", r"\bimps\b"),
    ("RTGS", r"\brtgs\b"),
    ("ATM", r"\b(atm|nfs|cash\s*wdl)\b"),
    ("POS", r"\b(pos|ecom|swiped)\b"),
    ("ACH", r"\b(ach|nach|mandate)\b"),
    ("CHEQUE", r"\b(chq|cheque|clearing)\b"),
    ("CARD", r"\b(card|visa|mastercard|rupay)\b"),
]
# The other dialect's modes, on upper-cased narrations.
MODES_ALT = [
    ("UPI", r"\bUPI\b|REV-UPI|/UPI/"),
    ("IMPS", r"\bIMPS\b|/IMPS/"),
    ("NEFT", r"\bNEFT\b|/NEFT/"),
    ("RTGS", r"\bRTGS\b|/RTGS/"),
    ("ATM", r"\bATM\b|CASH\s+WDL|NFS\s+ATM|BNA/"),
    ("POS", r"\bPOS\b|E-COMM|SWIPE|MERCHANT"),
    ("ACH", r"\b(ACH|NACH|ECS|SALARY|DIVIDEND)\b"),
    ("CARD", r"\b(CARD|DEBIT\s+CARD|CREDIT\s+CARD|VISA|MASTERCARD|RUPAY)\b"),
]
# Categories by narration and side, first match counts.
CATEGORIES = [
    ("RE_05", "Salary / Income", "CREDIT", r"\b(salary|payroll|sprinklr|wipro|infosys|tcs|google|amazon|monthly\s*pay)\b"),
    ("FD_00", "Dining & Food", "DEBIT", r"\b(swiggy|zomato|mcdonald|starbucks|domino|restaurant|cafe|food)\b"),
    ("FD_01", "Groceries", "DEBIT", r"\b(blinkit|zepto|instamart|dmart|bigbasket|supermarket|grocery)\b"),
    ("SH_00", "Shopping", "DEBIT", r"\b(amazon|flipkart|myntra|ajio|meesho|nykaa|retail|store)\b"),
    ("BL_01", "Utilities", "DEBIT", r"\b(airtel|jio|vi|electricity|bescom|water|gas|bill\s*desk|recharge)\b"),
    ("LO_03", "Loan EMI", "DEBIT", r"\b(emi|loan|bajaj\s*finance|muthoot|repayment|instalment)\b"),
    ("TR_07", "Travel & Fuel", "DEBIT", r"\b(uber|ola|rapido|irctc|makemytrip|petrol|fuel|hpcl|bpcl|ioc)\b"),
    ("HF_06", "Healthcare", "DEBIT", r"\b(apollo|pharmacy|1mg|netmeds|hospital|clinic|medplus|doctor)\b"),
    ("IN_03", "Insurance", "DEBIT", r"\b(lic|hdfc\s*ergo|icici\s*lombard|star\s*health|insurance)\b"),
    ("OO_02", "Cash Withdrawal", "DEBIT", r"\b(atm|cash\s*wdl|cash\s*withdrawal)\b"),
    ("RE_17", "Inward Transfer", "CREDIT", r"\b(upi|inward|imps|neft)\b"),
    ("OO_03", "P2P Transfer", "DEBIT", r"\b(upi|transfer|paid\s*to)\b"),
]
CREDIT_REST, DEBIT_REST = ("RE_07", "General Inflow"), ("ZZ_99", "General Outflow")
# The other dialect's categories; no side is asked, a mode may decide.
CATEGORIES_ALT = [
    ("RE_05", "Salary / Employment Income", r"\b(salary|payroll|sprinklr|wipro|infosys|tcs|hcl|cognizant|google|amazon|microsoft|accenture|monthly\s+pay)\b"),
    ("FD_00", "Food, Dining & Delivery", r"\b(swiggy|zomato|mcdonald|starbucks|domino|kfc|burger|restaurant|cafe|food|dining|eats)\b"),
    ("FD_01", "Groceries & Supermarkets", r"\b(blinkit|zepto|instamart|dmart|bigbasket|grofers|grocery|supermarket|spencer|reliance\s+fresh)\b"),
    ("SH_00", "Shopping & General Retail", r"\b(amazon|flipkart|myntra|ajio|meesho|nykaa|tatacliq|retail|store|shopping)\b"),
    ("BL_01", "Utility & Mobile Recharge", r"\b(airtel|jio|vi\s+|vodafone|electricity|power|bescom|tneb|water|gas|bill\s+desk|bbps|recharge)\b"),
    ("LO_03", "Loan Repayments / EMI", r"\b(emi|loan|bajaj\s+finance|muthoot|cred\s+loan|chola|tata\s+capital|repayment|instalment)\b"),
    ("TR_07", "Travel, Fuel & Rides", r"\b(uber|ola|rapido|irctc|makemytrip|goibibo|petrol|fuel|hpcl|bpcl|ioc|shell|indigo|air\s+india)\b"),
    ("HF_06", "Healthcare & Medical", r"\b(apollo|pharmacy|1mg|netmeds|hospital|clinic|medplus|doctor|health)\b"),
    ("IN_03", "Insurance Premiums", r"\b(lic|hdfc\s+ergo|icici\s+lombard|star\s+health|policybazaar|insurance|premium)\b"),
]
# Vocabularies of risk, recurring income and typing.
EMI = r"\b(emi|loan|repayment|bajaj|muthoot|instalment)\b"
CASH = r"\b(atm|cash\s*wdl|cash\s*withdrawal)\b"
BOUNCED = r"\b(bounce|return|chg\s*ret|dishonour|ecs\s*ret|nach\s*ret)\b"
SALARY = r"\b(salary|payroll|sprinklr|wipro|infosys|tcs|google|amazon|hcl|accenture|monthly\s*pay)\b"
TYPED_CREDIT = r"\b(salary|payroll|refund|credit|reversed|inward|interest\s*credit)\b"
TYPED_DEBIT = r"\b(atm|withdrawal|purchase|pos|emi|debit|charge|fee|paid\s*to)\b"
FRAUD_BOUNCE = r"\b(bounce|dishonour|return)\b"
GAMBLING = r"\b(dream11|betway|rummy|gambl|casino)\b"
CRYPTO = r"\b(wazirx|coindcx|binance|crypto)\b"
FRAUD_EMI = r"\b(emi|loan)\b"
# Currencies by text, first match counts; dollars only where nothing says rupees.
RUPEES = r"(?i)\bINR\b|₹|\bRs\.?"
CURRENCIES = [("USD", r"(?i)\bUSD\b|\bUS\s+DOLLAR\b|\$"), ("EUR", r"(?i)\bEUR\b|\bEURO\b|€"), ("GBP", r"(?i)\bGBP\b|\bPOUND\b|£"), ("AED", r"(?i)\bAED\b|\bDIRHAM\b"), ("CAD", r"(?i)\bCAD\b|\bCANADIAN\s+DOLLAR\b"), ("AUD", r"(?i)\bAUD\b|\bAUSTRALIAN\s+DOLLAR\b"), ("SGD", r"(?i)\bSGD\b|\bSINGAPORE\s+DOLLAR\b")]


def first_match(rules: list[tuple[Column, object]], rest: object) -> Column:
    """Value of the first condition that holds."""
    chain = F.when(*[rules[0][0], rules[0][1]])
    for test, value in rules[1:]:
        chain = chain.when(test, value)
    return chain.otherwise(rest)


def payment_mode(narration: Column) -> Column:
    low = F.lower(narration)
    return first_match([(low.rlike(p), m) for m, p in MODES], "OTHER")


def payment_mode_alt(narration: Column) -> Column:
    up = F.upper(narration)
    return first_match([(up.rlike(p), m) for m, p in MODES_ALT], "OTHER")


def category(narration: Column, kind: Column, name: bool = False) -> Column:
    low, k = F.lower(narration), int(name)
    rest = F.when(kind == "CREDIT", CREDIT_REST[k]).otherwise(DEBIT_REST[k])
    return first_match([((kind == side) & low.rlike(p), (code, label)[k]) for code, label, side, p in CATEGORIES], rest)


def category_alt(narration: Column, kind: Column, mode: Column) -> Column:
    low = F.lower(narration)
    rules = [(low.rlike(p), code) for code, _, p in CATEGORIES_ALT]
    rules.append((low.rlike(r"\b(atm|cash\s+wdl|cash\s+withdrawal|nfs\s+cash)\b") | (mode == "ATM"), "OO_02"))
    rules.append(((mode == "UPI") | low.rlike(r"\b(upi|gpay|phonepe|paytm)\b"), F.when(kind == "CREDIT", "RE_17").otherwise("OO_03")))
    return first_match(rules, F.when(kind == "CREDIT", "RE_07").otherwise("ZZ_99"))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def reference_number(narration: Column) -> Column:
    """UPI reference, any 12 digits, IMPS, NEFT, cash deposit: the first there is; else null."""
    # How references are printed.
    bna = r"(?i)BNA/([A-Z0-9]+)/(\d+)"
    return F.coalesce(
        _found(narration, r"(?i)UPI/(?:P2A|P2M|PAY)/(\d{12})\b"),
        _found(narration, r"\b(\d{12})\b"),
        _found(narration, r"(?i)IMPS/(?:P2A|P2M|INB|MOB)/([A-Z0-9]{10,18})\b"),
        _found(narration, r"(?i)NEFT/([A-Z0-9]{10,22})\b"),
        F.when(narration.rlike(bna), F.concat_ws("/", F.regexp_extract(narration, bna, 1), F.regexp_extract(narration, bna, 2))),
    )


def currency(text: Column) -> Column:
    rules = [(text.rlike(p) & (~text.rlike(RUPEES) if code == "USD" else F.lit(True)), code) for code, p in CURRENCIES]
    return F.when(text.isNull(), "INR").otherwise(first_match(rules, "INR"))


def clean_narration(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\r\n\t]+", " "), r"\s{2,}", " "))


def recurring_key(text: Column) -> Column:
    """Lower-cased narration without digits, slashes, hyphens and underscores, at most 20 characters."""
    return F.substring(F.trim(F.regexp_replace(F.lower(text), r"[\d/\-_]", "")), 1, 20)


def safe_filename(name: Column) -> Column:
    """No NULs or parent paths, odd characters as underscores, at most 190 characters and the extension."""
    # What file names may hold.
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.translate(name, "\0", ""), r"(\.\.[/\\])+", ""), r"[^a-zA-Z0-9._\s-]", "_"))
    short = F.when(F.length(clean) > 200, F.concat(F.substring(clean, 1, 190), F.regexp_extract(clean, r"(\.[^.]*)$", 1))).otherwise(clean)
    return F.when(name.isNull() | (name == ""), "unnamed.pdf").when(short == "", "document.pdf").otherwise(short)


def error_code(message: Column) -> Column:
    return _found(message, r"^\[([A-Z0-9_]+)\]\s*(.*)$")


def ifsc(text: Column) -> Column:
    # Fixed value: the form of a routing code.
    return _found(text, r"\b([A-Z]{4}0[A-Z0-9]{6})\b")


def micr(text: Column) -> Column:
    """A labelled 9-digit code; a bare one only where there is no IFSC."""
    return F.coalesce(_found(text, r"(?i)\bmicr(?:\s*code)?[\s:.\-_]*(\d{9})\b"), F.when(ifsc(text).isNull(), _found(text, r"\b(\d{9})\b")))
