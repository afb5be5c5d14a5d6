"""Text helpers as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \s knows ASCII blanks only; statements also carry NBSP and the full-width blank.
BLANK = r"[\s\x{00A0}\x{3000}]"
_BLANK_CHARS = " \t\n\r\x0b\x0c\u00a0\u3000"


def strip(c: Column) -> Column:
    """Remove blanks at both ends."""
    return F.btrim(c, F.lit(_BLANK_CHARS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_text(c: Column) -> Column:
    """Stripped text without tabs and line ends; null becomes ''."""
    return F.translate(strip(F.coalesce(c, F.lit(""))), "\t\r\n", "")


def compact_ws(c: Column) -> Column:
    """Text without any blank."""
    return F.regexp_replace(c, f"{BLANK}+", "")


def normalize_key(c: Column) -> Column:
    """Header key without blanks, NBSP and colons."""
    return F.translate(c, "\u00a0 ：:", "")


def join_nonempty(parts: Sequence[Column], sep: str, default: str | None = None, distinct: bool = False) -> Column:
    """Join the non-empty parts; ``default`` when none is left."""
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))
    if distinct:
        kept = F.array_distinct(kept)
    text = F.nullif(F.array_join(kept, sep), F.lit(""))
    return text if default is None else F.coalesce(text, F.lit(default))


def labelled(label: str, c: Column) -> Column:
    """``label`` + value, null when the value is null or ''."""
    return F.when(c.isNotNull() & (c != ""), F.concat(F.lit(label), c))


def colon_key(c: Column) -> Column:
    """Key before the first full-width colon, else before the first plain one, else null."""
    return strip(F.when(c.contains("："), F.substring_index(c, "：", 1)).when(c.contains(":"), F.substring_index(c, ":", 1)))


def colon_value(c: Column) -> Column:
    """Text after the colon that ``colon_key`` splits at."""
    def after(mark: str) -> Column:
        return F.substring(c, F.instr(c, mark) + 1, F.length(c))

    return strip(F.when(c.contains("："), after("：")).when(c.contains(":"), after(":")))


def is_masked(c: Column) -> Column:
    return c.contains("*")


def is_account_like(c: Column) -> Column:
    return c.rlike(r"^[\d*]+\s*$")


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """First regex hit, null when there is none."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def summary_hash(c: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the text."""
    return F.substring(F.sha2(c, 256), 1, 16)


def matching_text(c: Column) -> Column:
    """Letters, digits and CJK ideographs only: what similarity looks at."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}\x{4E00}-\x{9FFF}]", "")


def char_bigrams(cleaned: Column) -> Column:
    """Overlapping two-character grams; a single character stands for itself."""
    grams = F.transform(F.sequence(F.lit(1), F.length(cleaned) - 1), lambda i: F.substring(cleaned, i, F.lit(2)))
    return (
        F.when(F.length(cleaned) >= 2, grams)
        .when(F.length(cleaned) == 1, F.array(cleaned))
        .otherwise(F.array().cast("array<string>"))
    )


def lookup(c: Column, table: dict[str, str], passthrough: bool = False) -> Column:
    """Literal map lookup."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    hit = F.try_element_at(F.create_map(*pairs), c)
    return F.coalesce(hit, c) if passthrough else hit
