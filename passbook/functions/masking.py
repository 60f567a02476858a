"""Masks for account numbers and personal data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def account(c: Column) -> Column:
    clean = F.regexp_replace(c, r"[\s\-]", "")
    n = F.length(clean)
    masked = F.concat(F.repeat(F.lit("X"), F.greatest(F.lit(4), n - 4)), F.right(clean, F.lit(4)))
    return F.when(c.isNull() | (c == ""), "X" * 12).when(n <= 4, clean).otherwise(masked)


def account_alt(c: Column) -> Column:
    clean = F.regexp_replace(c, r"[\s\-]", "")
    n = F.length(clean)
    return F.when(c.isNull() | (n <= 4), "XXXX").otherwise(F.concat(F.repeat(F.lit("X"), n - 4), F.right(clean, F.lit(4))))


def pan(c: Column) -> Column:
    clean = F.upper(F.trim(c))
    return F.when(c.isNull() | (c == ""), "XXXXX0000X").when(F.length(clean) == 10, F.concat(F.left(clean, F.lit(5)), F.lit("****"), F.right(clean, F.lit(1)))).otherwise(clean)


def pan_alt(c: Column) -> Column:
    clean = F.upper(F.trim(c))
    return F.when(F.length(clean) == 10, F.concat(F.lit("XXXXX"), F.substring(clean, 6, 5))).otherwise("XXXXX")


def phone(c: Column) -> Column:
    clean = F.regexp_replace(c, r"\D", "")
    return F.when(c.isNull() | (c == ""), "XXXXXX0000").when(F.length(clean) >= 10, F.concat(F.lit("XXXXXX"), F.right(clean, F.lit(4)))).otherwise(clean)


def aadhaar(c: Column) -> Column:
    clean = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(clean) >= 4, F.concat(F.lit("XXXX-XXXX-"), F.right(clean, F.lit(4)))).otherwise("XXXX-XXXX-XXXX")


def email(c: Column) -> Column:
    local, domain = F.substring_index(c, "@", 1), F.substring_index(c, "@", -1)
    short = F.when(F.length(local) <= 2, "**").otherwise(F.concat(F.left(local, F.lit(1)), F.lit("***"), F.right(local, F.lit(1))))
    return F.concat(short, F.lit("@"), domain)


def text(c: Column) -> Column:
    """Account numbers, PANs, Aadhaar numbers and phones in running text, in that order: the first rule takes the long digit runs."""
    c = F.regexp_replace(c, r"\b(\d{2,4})\d{4,10}(\d{4})\b", "$1******$2")
    c = F.regexp_replace(c, r"(?i)\b([A-Z]{5})\d{4}([A-Z])\b", "$1****$2")
    c = F.regexp_replace(c, r"\b\d{4}\s?\d{4}\s?(\d{4})\b", "XXXX-XXXX-$1")
    return F.regexp_replace(c, r"\b[6-9]\d{5}(\d{4})\b", "XXXXXX$1")
