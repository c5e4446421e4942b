"""Dates that texts mention, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
#: The forms of a date, the fuller ones first: 2024-01-31, 2024/01/31, Jan 31 2024, Jan 2024, Q1 2024, 2024.
ISO, SLASHED = r"\d{4}-\d{2}-\d{2}", r"\d{4}/\d{2}/\d{2}"
DAY_OF_MONTH = rf"(?:{'|'.join(MONTHS)})\w*\.?\s+\d{{1,2}},?\s+\d{{4}}"
MONTH_OF_YEAR = rf"(?:{'|'.join(MONTHS)})\w*\.?\s+\d{{4}}"
QUARTER, YEAR = r"Q[1-4]\s+\d{4}", r"\d{4}"
FIRST_YEAR, LAST_YEAR = 1900, 2100
# End of the fixed values.

ANY = rf"\b(?:{ISO}|{SLASHED}|{DAY_OF_MONTH}|{MONTH_OF_YEAR}|{QUARTER}|{YEAR})\b"
PARAGRAPHS = r"\n\s*\n"


def _day(found: Column) -> Column:
    """The day that one mention names; a month or quarter its year's or month's first, days beyond a month's end go on into the next."""
    number = lambda p: F.regexp_extract(found, p, 1).cast("int")
    numeric = found.rlike(rf"^(?:{ISO}|{SLASHED})$")
    named = found.rlike("^[A-PR-Z]")
    year = F.when(numeric, number(r"^(\d{4})")).otherwise(number(r"(\d{4})$"))
    place = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(found, 1, 3)).cast("int")
    month = F.when(numeric, number(r"^\d{4}.(\d{2})")).when(named, place).otherwise(1)
    day = F.when(numeric, number(r"(\d{2})$")).when(found.rlike(rf"^{DAY_OF_MONTH}$"), number(r"\s(\d{1,2}),?\s")).otherwise(1)
    first = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1)
    return F.when(year.between(FIRST_YEAR, LAST_YEAR), F.date_add(first, day - 1))


def mentioned(text: Column) -> Column:
    """The days that a text mentions, in its order; null has none."""
    days = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANY), 0), _day)
    return F.filter(days, lambda d: d.isNotNull())


def two_in_a_paragraph(text: Column) -> Column:
    """Whether some paragraph mentions two different days."""
    return F.exists(F.split(F.coalesce(text, F.lit("")), PARAGRAPHS), lambda p: F.size(F.array_distinct(mentioned(p))) >= 2)
