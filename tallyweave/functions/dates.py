"""Date readers as Column expressions: null when the text is not a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

_CN = r"\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日"
_LOOSE = r"\d{4}[年-]\d{1,2}[月-]\d{1,2}"
_ISO = r"\d{4}-\d{2}-\d{2}"
_PACKED = r"\d{8}"


def _find(c: Column, pattern: str) -> Column:
    """Date of the first hit, one regex pass; null if there is no hit or no such day.

    The hit is brought to Y-M-D and cast: unlike a format parser the cast does not raise
    and catch for every impossible day.
    """
    hit = F.nullif(F.regexp_extract(c, pattern, 0), F.lit(""))
    if _PACKED in pattern:
        ymd = F.concat(F.substring(hit, 1, 4), F.lit("-"), F.substring(hit, 5, 2), F.lit("-"), F.substring(hit, 7, 2))
    else:
        ymd = F.translate(hit, "年月日 \t\n\r\x0b\x0c", "--")
    return ymd.try_cast("date")


def _whole(pattern: str) -> str:
    return f"^{pattern}$"


def looks_compact(c: Column) -> Column:
    return strip(c).rlike(f"^({_PACKED}|{_ISO})$")


def looks_iso(c: Column) -> Column:
    return strip(c).rlike(_whole(_ISO))


def looks_flexible(c: Column) -> Column:
    """Holds the Y年M月D日 form, the only flexible form whose impossible days are errors."""
    return strip(c).rlike(_CN)


def date_compact(c: Column) -> Column:
    """YYYYMMDD or YYYY-MM-DD, whole text."""
    t = strip(c)
    return F.coalesce(_find(t, _whole(_PACKED)), _find(t, _whole(_ISO)))


def date_compact_failed(c: Column) -> Column:
    """The shape is right and the day does not exist: a row error, not a skip."""
    return F.coalesce(looks_compact(c) & date_compact(c).isNull(), F.lit(False))


def date_iso(c: Column) -> Column:
    """YYYY-MM-DD only, whole text."""
    return _find(strip(c), _whole(_ISO))


def date_chinese(c: Column) -> Column:
    """First Y年M月D or Y-M-D in the text."""
    return F.coalesce(_find(c, _LOOSE), _find(c, _ISO))


def date_flexible(c: Column) -> Column:
    """ISO, packed, or Y年M月D日 with blanks."""
    t = strip(c)
    return F.coalesce(
        _find(t, r"^\d{4}-\d{1,2}-\d{1,2}$"), _find(t, _whole(_PACKED)), _find(t, _CN)
    )


def date_receipt(c: Column) -> Column:
    """Receipt order: the first form found decides, even if the day does not exist."""
    return (
        F.when(c.rlike(_CN), _find(c, _CN))
        .when(c.rlike(_PACKED), _find(c, _PACKED))
        .otherwise(_find(c, _ISO))
    )


def timestamp_date(c: Column) -> Column:
    """Date in front of a timestamp such as 2026-03-26-19.33.30."""
    return _find(c, "^" + _ISO)


def month_label(c: Column) -> Column:
    return F.date_format(c, "yyyy年MM月")
