"""Amount readers as Column expressions: decimal(18,2) or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_match, strip

MONEY = "decimal(18,2)"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)$"


def _number(c: Column) -> Column:
    return F.when(c.rlike(_NUMBER), c.try_cast(MONEY))


def amount_strict(c: Column) -> Column:
    """Commas, blanks and one leading plus removed; null when not a number."""
    return _number(without_marks(c))


def without_marks(c: Column) -> Column:
    """The number as written, without commas, blanks and one leading plus."""
    t = F.translate(strip(c), ", ", "")
    return F.when(t.startswith("+"), F.substring(t, F.lit(2), F.length(t))).otherwise(t)


def without_currency(c: Column) -> Column:
    """Text without commas, blanks, ￥ and the CNY mark."""
    return F.replace(F.replace(F.translate(strip(c), ", ￥", ""), F.lit("CNY"), F.lit("")), F.lit("cny"), F.lit(""))


def amount_lenient(c: Column) -> Column:
    """First run of digits, the sign is lost; 0 when there is none."""
    digits = first_match(F.translate(c, "￥元,， ", ""), r"\d+\.?\d*")
    return F.coalesce(_number(digits), F.lit(0).cast(MONEY))


def amount_clean(c: Column) -> Column:
    """Commas, blanks, ￥ and the CNY mark removed; null when empty or no number."""
    return _number(without_currency(c))


def amount_cny(c: Column) -> Column:
    """Number after CNY, else the first number with two decimals."""
    hit = F.coalesce(first_match(c, r"(?i)CNY\s*([\d,]+\.?\d*)", 1), first_match(c, r"([\d,]+\.\d{2})", 1))
    return _number(F.translate(hit, ",", ""))


def round2(c: Column) -> Column:
    """Two decimals, halves go up."""
    return F.floor(c * 100 + F.lit(0.5)) / 100

