"""Exact money: two decimals, half up; ratios from whole cents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def money(c: Column) -> Column:
    """Two decimals, half away from zero."""
    return F.round(c, 2).cast(MONEY)


def cents(c: Column) -> Column:
    return (c * 100).cast("long")


def divided(a: Column, b: Column, scale: int) -> Column:
    """a / b for whole numbers, b > 0, rounded half away from zero to 1 / scale; as double."""
    twice = F.abs(a) * F.lit(2 * scale).cast("long") + b
    whole = ((twice - F.pmod(twice, b * 2)) / (b * 2)).cast("double")
    return F.signum(a.cast("double")) * whole / float(scale)


def mean(total: Column, n: Column) -> Column:
    """Mean of money: one rounding, so no double rounding through an average of six decimals."""
    return money(total / n)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often ``use`` names it: a plan grows with the steps, not with their product."""
    return F.get(F.transform(F.array(value), use), 0)


def _plain(body: Column) -> Column:
    """Digits with a point: comma and point by their places."""
    pointed = F.translate(F.translate(body, ".", ""), ",", ".")
    last = F.regexp_extract(body, r"([,.])[^,.]*$", 1)
    return (
        F.when(body.rlike(r"^\d{1,3}(\.\d{3})+,\d{2}$"), pointed)
        .when(body.contains(",") & body.contains("."), F.when(last == ".", F.translate(body, ",", "")).otherwise(pointed))
        .when(body.rlike(r"^[^,]*,[^,]{2}$"), F.translate(body, ",", "."))
        .otherwise(F.translate(body, ",", ""))
    )


def _number(plain: Column) -> Column:
    return F.round(F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), plain.try_cast("decimal(38,6)")), 2).try_cast(MONEY)


def clean_amount(raw: Column) -> Column:
    """Printed amount to money: brackets or a minus negate; currency signs, letters and blanks go; comma and point by place; else null."""

    def signed(text: Column) -> Column:
        bracketed = text.startswith("(") & text.endswith(")")
        inner = F.when(bracketed, F.trim(F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text)
        body = F.regexp_replace(inner, r"^-|[₹$€£¥\sA-Za-z]", "")
        value = let(let(body, _plain), _number)
        return F.when(text.rlike(r"^-|(?s)^\(.*\)$"), -value).otherwise(value).cast(MONEY)

    return let(F.trim(raw), signed)


def indicator(raw: Column) -> Column:
    """CREDIT or DEBIT by the marks in a printed amount; a negative amount is a debit."""
    marked = lambda upper: F.when(upper.contains("CR"), "CREDIT").when(upper.contains("DR") | upper.contains("DEBIT"), "DEBIT")
    return F.when(clean_amount(raw) < 0, "DEBIT").otherwise(let(F.upper(F.trim(raw)), marked))
