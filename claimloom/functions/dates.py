"""Dates in text: day first, with a mark on those that could be read either way."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.binding import let

# -- fixed values -----------------------------------------------------------------------
NUMERIC_DATE = r"\b(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})(?!\d)"
TEXTUAL_DATE = r"\b(\d{1,2})\s*(?:st|nd|rd|th)?\s*(?:day\s*of\s*)?([A-Za-z]{3,9}?)[,\s]*(\d{4})(?!\d)"
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6,
    "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10, "november": 11,
    "nov": 11, "december": 12, "dec": 12,
}
#: Two-digit years up to this one are of this century.
PIVOT = 30


def expand_year(year: Column) -> Column:
    """A two-digit year with its century; others as they are."""
    return F.when(year >= 100, year).when(year <= PIVOT, year + 2000).otherwise(year + 1900)


def _date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null if there is no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(text, pattern, n).try_cast("int")


def date_text(text: str) -> str | None:
    """The part of a text that parse_date reads its date from."""
    named = re.search(TEXTUAL_DATE, text)
    found = named if named and named[2].lower() in MONTHS else re.search(NUMERIC_DATE, text)
    return found[0] if found else None


def parse_date(text: Column) -> Column:
    """The first date: value and ambiguous; null if there is none.

    A date with a month's name goes first; if its day doesn't exist there is no date. Numeric dates are day first, and month
    first where only that exists.
    """
    month = F.try_element_at(F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair)), F.lower(F.regexp_extract(text, TEXTUAL_DATE, 2)))
    parts = F.struct(
        month.alias("month"),
        _group(text, TEXTUAL_DATE, 3).alias("year"),
        _group(text, TEXTUAL_DATE, 1).alias("day"),
        _group(text, NUMERIC_DATE, 1).alias("a"),
        _group(text, NUMERIC_DATE, 2).alias("b"),
        _group(text, NUMERIC_DATE, 3).alias("y"),
    )
    made = lambda value, doubt: F.when(value.isNotNull(), F.struct(value.alias("value"), doubt.alias("ambiguous")))

    def read(p: Column) -> Column:
        first, second = _date(expand_year(p["y"]), p["b"], p["a"]), _date(expand_year(p["y"]), p["a"], p["b"])
        numeric = F.when(first.isNotNull(), made(first, (p["a"] <= 12) & (p["b"] <= 12) & (p["a"] != p["b"]))).otherwise(made(second, F.lit(False)))
        return F.when(p["month"].isNotNull(), made(_date(p["year"], p["month"], p["day"]), F.lit(False))).otherwise(numeric)

    return let(parts, read)
