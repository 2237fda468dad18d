"""Dates in text, as ISO dates: by separators and country, by month names, else as they are."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATED = r"^\s*(\d{1,4})[/-](\d{1,2})[/-](\d{1,4})\s*$"
SLASHED = r"(?<!\d)(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})(?!\d)"


def _year(fragment: Column) -> Column:
    """Two digits below 70 are of this century, others of the last."""
    n = fragment.try_cast("int")
    return F.when(F.length(fragment) == 2, F.when(n < 70, 2000 + n).otherwise(1900 + n)).otherwise(n)


def _date(year: Column, month: Column, day: Column) -> Column:
    """A DATE; null if there is no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def separated(s: Column, country: Column) -> Column:
    """A numeric date as a DATE: year first, or day and month by what cannot be a month, else by country (US: month first)."""
    a, b, c = (F.regexp_extract(s, SEPARATED, k) for k in (1, 2, 3))
    first, second = a.try_cast("int"), b.try_cast("int")
    month_first = (second > 12) | ((first <= 12) & (F.upper(F.coalesce(country, F.lit(""))) == "US"))
    day_month = F.when((first > 12) & (second > 12), None).when(month_first, _date(_year(c), first, second)).otherwise(_date(_year(c), second, first))
    return F.when(s.rlike(SEPARATED), F.when(F.length(a) == 4, _date(_year(a), second, c.try_cast("int"))).otherwise(day_month))


def named(s: Column) -> Column:
    """A date with a month's name as a DATE: ``March 5, 2024``, ``5 Mar 2024``, ``Mar 5 2024``."""
    t = F.regexp_replace(F.regexp_replace(F.trim(s), r"(?i)(\d)(st|nd|rd|th)\b", "$1"), r"[\s,.]+", " ")
    word = F.initcap(F.substring(F.regexp_extract(t, "([A-Za-z]{3,})", 1), 1, 3))
    month_first, day_first = r"^[A-Za-z]{3,} (\d{1,2}) (\d{4})$", r"^(\d{1,2}) [A-Za-z]{3,} (\d{4})$"
    text = F.when(t.rlike(month_first), F.concat_ws(" ", F.regexp_extract(t, month_first, 1), word, F.regexp_extract(t, month_first, 2)))
    text = text.when(t.rlike(day_first), F.concat_ws(" ", F.regexp_extract(t, day_first, 1), word, F.regexp_extract(t, day_first, 2)))
    return F.try_to_date(text, "d MMM yyyy")


def parsed(s: Column, country: Column) -> Column:
    """A DATE where the text is one of the plain forms, else null."""
    return F.coalesce(separated(s, country), named(s))


def iso(s: Column, country: Column) -> Column:
    """The ISO date of a text, or the text without spaces at its ends where it is no plain date."""
    return F.coalesce(F.date_format(parsed(s, country), "yyyy-MM-dd"), F.trim(s))


def iso_fuzzy(s: Column, country: Column) -> Column:
    """``iso``; texts of no plain form are read by a fuzzy parser in Arrow batches, and only those reach it."""

    def read(texts: pd.Series) -> pd.Series:
        from dateutil.parser import parse

        def one(t):
            if t is None:
                return None
            try:
                return parse(t, fuzzy=True).strftime("%Y-%m-%d")
            except (ValueError, OverflowError):
                return t

        return texts.map(one)

    plain = F.date_format(parsed(s, country), "yyyy-MM-dd")
    rest = F.when(plain.isNull() & ~s.rlike(SEPARATED), F.trim(s))
    return F.coalesce(plain, F.pandas_udf(read, "string")(rest), F.trim(s))


def plausible(d: Column) -> Column:
    """Whether a DATE is from 1990 to 2100."""
    return F.coalesce(F.year(d).between(1990, 2100), F.lit(False))


def ambiguous(s: Column) -> Column:
    """Whether a slashed date could be read with day or month first."""
    a, b = F.regexp_extract(s, SLASHED, 1).try_cast("int"), F.regexp_extract(s, SLASHED, 2).try_cast("int")
    return F.coalesce((a <= 12) & (b <= 12) & (a != b), F.lit(False))


def dates_in(text: Column) -> Column:
    """All different numeric dates in a text, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]{1,4}[/-][0-9]{1,2}[/-][0-9]{2,4}"), F.lit(0)), lambda x: F.trim(x)))
