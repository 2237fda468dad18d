"""Numbers in text: separators, locale votes, percentages, guards, and arithmetic with tolerances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = r"[$€£]?\s?\d[\d,]*(?:[.]\d{1,4})?"


def _last(s: Column, mark: str) -> Column:
    """Place of the last mark, from 1; 0 without one."""
    return F.when(s.contains(mark), F.length(s) - F.length(F.substring_index(s, mark, -1))).otherwise(0)


def _double(s: Column) -> Column:
    return s.try_cast("double")


def _kept(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\d.,-]", "")


def _both(s: Column) -> Column:
    """Of a number with commas and full stops: the last of them is the decimal mark."""
    comma = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(_last(s, ",") > _last(s, "."), comma).otherwise(F.replace(s, F.lit(","), F.lit("")))


def _parsed(s: Column, lone_comma_is_thousands: Column) -> Column:
    lone = F.when(lone_comma_is_thousands, F.replace(s, F.lit(","), F.lit(""))).otherwise(F.replace(s, F.lit(","), F.lit(".")))
    return _double(F.when(s.contains(",") & s.contains("."), _both(s)).when(s.contains(","), lone).otherwise(s))


def number(s: Column) -> Column:
    """A number in text; a lone comma before three last digits parts thousands. Null where there is none."""
    kept = _kept(s)
    return _parsed(kept, F.length(kept) - _last(kept, ",") == 3)


def amount(s: Column) -> Column:
    """``number``, and 0 for a text without one; null stays null."""
    return F.when(s.isNotNull(), F.coalesce(number(s), F.lit(0.0)))


def token_number(s: Column) -> Column:
    """A number in a token; a lone comma is a decimal mark only before two last digits."""
    kept = _kept(s)
    return _parsed(kept, F.length(kept) - _last(kept, ",") != 2)


def implausible(s: Column) -> Column:
    """Scientific notation, twelve digits or more, or one digit repeated ten times or more."""
    digits = F.regexp_replace(s, r"\D", "")
    return s.rlike(r"(?i)\d\s*e\s*[+-]?\d") | (F.length(digits) >= 12) | ((F.length(digits) >= 10) & (F.size(F.array_distinct(F.split(digits, ""))) == 1))


def plain_number(s: Column) -> Column:
    """A number in text whose lone comma is always a decimal mark; null where it is implausible."""
    return F.when(~implausible(s), _parsed(_kept(s), F.lit(False)))


def dot_vote(s: Column) -> Column:
    """How strongly a numeric text speaks for the full stop as decimal mark: 2 with both marks in that order, 1 for two last digits."""
    k = _kept(s)
    both = k.contains(",") & k.contains(".")
    return F.when(both & (_last(k, ".") > _last(k, ",")), 2).when(both, 0).when(k.rlike(r"^-?\d+[.]\d{2}$"), 1).when(k.rlike(r"^-?\d{1,3}(,\d{3})+$"), 1).otherwise(0)


def comma_vote(s: Column) -> Column:
    """The same for the comma."""
    k = _kept(s)
    both = k.contains(",") & k.contains(".")
    return F.when(both & (_last(k, ",") > _last(k, ".")), 2).when(both, 0).when(k.rlike(r"^-?\d+,\d{2}$"), 1).when(k.rlike(r"^-?\d{1,3}([.]\d{3})+$"), 1).otherwise(0)


def amount_by_convention(s: Column, convention: Column) -> Column:
    """An amount read with ``dot`` or ``comma`` as decimal mark; without a convention like ``number``. Rounded to cents."""
    k = _kept(s)
    dot = _double(F.replace(k, F.lit(","), F.lit("")))
    comma = _double(F.replace(F.replace(k, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    return F.round(F.when(convention == "dot", dot).when(convention == "comma", comma).otherwise(number(s)), 2)


def percent(s: Column, convention: Column | None = None) -> Column:
    """A percentage as a number; null without a figure."""
    bare = F.replace(s, F.lit("%"), F.lit(""))
    return number(bare) if convention is None else amount_by_convention(bare, convention)


def amounts_in(text: Column) -> Column:
    """All different amounts in a text, in order, without spaces at the ends."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]+(?:,[0-9]{3})*[.][0-9]{2}"), F.lit(0)), lambda x: F.trim(x)))


def near(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Whether two numbers are closer than the tolerance; false where one is null."""
    return F.coalesce(F.abs(a - b) < tolerance, F.lit(False))


def within(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    """Whether two numbers are no further apart than the tolerance; false where one is null."""
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def ratio(n: Column, d: Column) -> Column:
    """n / d; 0 where d is not positive."""
    return F.when(d > 0, n / d).otherwise(0.0)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def triplet(a: Column, b: Column, c: Column) -> Column:
    """Whether a + b makes c, within the larger of 1 and 3 percent."""
    return F.abs(a + b - c) <= F.greatest(F.lit(1.0), F.abs(c) * 0.03)


def money(x: Column, precision: int = 12, scale: int = 2) -> Column:
    """A decimal, so that sums do not depend on their order."""
    return x.cast(f"decimal({precision},{scale})")
