"""Printed dates to dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import let

# Month names, with misreadings that scans produce.
MONTHS = {"01": "jan january", "02": "feb february", "03": "mar march", "04": "apr april", "05": "may", "06": "jun june", "07": "jul july", "08": "aug august aus avg auq", "09": "sep sept september", "10": "oct october", "11": "nov november", "12": "dec december"}
# The forms of printed dates.
DAY, MONTH, YEAR = r"(0?[1-9]|[12]\d|3[01])", r"(0?[1-9]|1[0-2])", r"(20\d{2}|19\d{2}|\d{2})"
DAY_NAME = rf"\b{DAY}[\s\-_/]*([a-zA-Z]{{3,9}})[\s\-_/]+{YEAR}\b"
NAME_DAY = rf"\b([a-zA-Z]{{3,9}})[\s\-_/]+{DAY}(?:,)?[\s\-_/]+{YEAR}\b"
DAY_MONTH = rf"\b{DAY}[-/.]{MONTH}[-/.]{YEAR}\b"
YEAR_MONTH = rf"\b(20\d{{2}}|19\d{{2}})[-/.]{MONTH}[-/.]{DAY}\b"


MONTH_OF = {name: number for number, names in MONTHS.items() for name in names.split()}


def _date(text: Column, pattern: str, day: int, month: int, year: int, named: bool) -> Column:
    """The first match of ``pattern`` as a date; null if there is none or no such day."""

    def made(parts: Column) -> Column:
        y, m, d = (F.get(parts, k) for k in range(3))
        number = F.try_element_at(F.create_map(*[F.lit(x) for pair in MONTH_OF.items() for x in pair]), F.lower(m)) if named else m
        return F.concat(F.when(F.length(y) == 2, "20").otherwise(""), y, F.lit("-"), number, F.lit("-"), d).try_cast("date")

    return let(F.split(F.regexp_replace(F.regexp_extract(text, pattern, 0), pattern, f"${year} ${month} ${day}"), " "), made)


def _any(text: Column) -> Column:
    return F.coalesce(_date(text, DAY_NAME, 1, 2, 3, True), _date(text, NAME_DAY, 2, 1, 3, True), _date(text, DAY_MONTH, 1, 2, 3, False), _date(text, YEAR_MONTH, 3, 2, 1, False))


def sanitized(text: Column) -> Column:
    """Letters that scans put for digits before a digit: O for 0, l or I for 1."""
    text = F.regexp_replace(text, r"O([1-9])", "0$1")
    text = F.regexp_replace(text, r"\b[oO](\d)\b", "0$1")
    return F.regexp_replace(text, r"\b[lI](\d)\b", "1$1")


def parse(raw: Column) -> Column:
    """ISO strictly; else the first of day-month name, month name-day, day/month and year/month forms that is a date, in the text as it is and then as sanitized."""

    def of(text: Column) -> Column:
        iso, none = text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(None).cast("date")
        printed = F.aggregate(F.array(text, sanitized(text)), none, lambda found, form: F.coalesce(found, _any(form)))
        return F.when(iso, text.try_cast("date")).when(text.rlike(r"\d"), printed)

    return let(F.trim(raw), of)


# Labels of a period's two dates.
RANGE = r"(?i)(?:period|statement\s+period|from|dated|duration)[\s:]*([^\n\r]+?)(?:to|through|-|–|\s+till\s+)([^\n\r,]+)"
BETWEEN = r"(?i)(?:between)[\s:]*([^\n\r]+?)(?:and)([^\n\r,]+)"


def period(text: Column) -> Column:
    """struct(start, end): a labelled range of two dates, else the least and greatest date among runs of four words."""

    def of(text: Column) -> Column:
        ends = F.array(*[F.array(*[F.regexp_extract(text, p, g) for g in (1, 2)]) for p in (RANGE, BETWEEN)])
        pairs = F.transform(ends, lambda pair: F.transform(pair, parse))
        both = lambda d: F.get(d, 0).isNotNull() & F.get(d, 1).isNotNull()
        labelled = let(F.get(F.filter(pairs, both), 0), lambda d: F.when(d.isNotNull(), F.struct(F.get(d, 0).alias("start"), F.get(d, 1).alias("end"))))
        return F.coalesce(labelled, let(F.filter(F.split(text, r"\s+"), lambda w: w != ""), scan))

    def scan(words: Column) -> Column:
        runs = F.transform(words, lambda _, i: F.array_join(F.slice(words, i + 1, 4), " "))
        dates = F.filter(F.transform(F.filter(runs, lambda run: run.rlike(r"\d")), parse), lambda d: d.isNotNull())
        return let(dates, lambda d: F.when(F.size(d) > 0, F.struct(F.array_min(d).alias("start"), F.array_max(d).alias("end"))))

    return let(text, of)


def period_days(start: Column, end: Column) -> Column:
    """Days between, the end day not counted; 30 where that is zero or unknown."""
    return F.coalesce(F.nullif(F.abs(F.datediff(end, start)), F.lit(0)), F.lit(30))
