"""Routing and readiness: which bank, which extractor, which rows go on."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    BANK_CODES, BANK_NAMES, DOCUMENT_SIGNATURES, EXTRACTORS, RECEIPT, STATEMENT, TABLE_TITLES, UNKNOWN_BANK, UNKNOWN_CODE,
)
from ..functions.text import compact_ws, lookup
from ..plans.segments import SEGMENT_BITS, ordinal_segment, segmented
from ..session import materialize
from .accounts import first_by_key


def document_class(text: Column, signatures: Sequence = DOCUMENT_SIGNATURES) -> Column:
    """Struct (bank_code, doc_type) of the first signature found in the text, blanks ignored."""
    compact = compact_ws(F.coalesce(text, F.lit("")))
    choice = None
    for words, bank, kind, mode in signatures:
        marks = [compact.contains("".join(w.split())) for w in words]
        cond = marks[0]
        for m in marks[1:]:
            cond = (cond & m) if mode == "all" else (cond | m)
        hit = F.struct(F.lit(bank).alias("bank_code"), F.lit(kind).alias("doc_type"))
        choice = F.when(cond, hit) if choice is None else choice.when(cond, hit)
    other = F.struct(F.lit(UNKNOWN_BANK).alias("bank_code"), F.lit(STATEMENT).alias("doc_type"))
    return other if choice is None else choice.otherwise(other)


def statement_subtype(text: Column) -> Column:
    """'table' when one of the titles is present, else 'column'."""
    titled = F.lit(False)
    for title in TABLE_TITLES:
        titled = titled | text.contains(title)
    return F.when(titled, "table").otherwise("column")


def file_name(path: Column) -> Column:
    """Last part of a path with either slash."""
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def route_files(files: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Bank, type and verdict per file.

    files (path, text, readable); overrides (path, bank, doc_type) replace the detection: a
    bank without a type means a statement, a type without a bank is an unknown bank.
    """
    ext = extension(F.col("path"))
    found = document_class(F.col("text"))
    detected = files.withColumn("__ext", ext).withColumns({
        "__bank": F.when(F.col("__ext") == "csv", "ICBC").when(F.col("__ext") == "xlsx", "CMB")
        .when((F.col("__ext") == "pdf") & F.col("readable"), found["bank_code"]).otherwise(UNKNOWN_BANK),
        "__type": F.when(F.col("__ext").isin("csv", "xlsx"), STATEMENT).otherwise(found["doc_type"]),
    })
    if overrides is not None:
        o = first_by_key(overrides.withColumn("__o", F.lit(0)), ["path"], "__o").select(
            "path", F.nullif(F.col("bank"), F.lit("")).alias("__ob"), F.nullif(F.col("doc_type"), F.lit("")).alias("__ot")
        )
        detected = detected.join(o, "path", "left")
    else:
        detected = detected.withColumns({"__ob": F.lit(None).cast("string"), "__ot": F.lit(None).cast("string")})
    named = lookup(F.col("__ob"), BANK_CODES, passthrough=True)
    pdf = F.col("__ext") == "pdf"
    bank = F.when(pdf & F.col("__ob").isNotNull(), named).when(
        pdf & F.col("__ot").isNotNull(), UNKNOWN_BANK).otherwise(F.col("__bank"))
    kind = F.when(pdf & F.col("__ot").isNotNull(), F.col("__ot")).when(
        pdf & F.col("__ob").isNotNull(), STATEMENT).otherwise(F.col("__type"))
    routed = detected.withColumns({"bank_code": bank, "doc_type": kind})
    known = F.col("bank_code").isin(*EXTRACTORS)
    return routed.select(
        *files.columns, "bank_code", F.coalesce(lookup(F.col("bank_code"), BANK_NAMES), F.col("bank_code")).alias("bank"),
        "doc_type",
        F.when(~F.col("readable"), "failed").when(~F.col("__ext").isin("csv", "xlsx", "pdf"), "failed")
        .when(~known, "rejected").otherwise("routed").alias("status"),
    )


def extractor_candidates(routed: DataFrame) -> DataFrame:
    """Extractors to try per file, in order; receipts of ICBC are not tried on a statement."""
    listed = F.lit(None).cast("array<string>")
    for bank, names in EXTRACTORS.items():
        tries = F.array(*(F.lit(n) for n in names))
        if bank == "ICBC":
            tries = F.when(F.col("doc_type") == STATEMENT, F.array(*(F.lit(n) for n in names if "receipt" not in n))).otherwise(tries)
        listed = F.when(F.col("bank_code") == bank, tries).otherwise(listed)
    return routed.where(F.col("status") == "routed").select(
        "path", F.posexplode(listed).alias("cand_ord", "extractor")
    )


def first_nonempty(candidates: DataFrame, file_key: str = "file_id") -> DataFrame:
    """Rows of the first extractor (lowest cand_ord) that produced any for the file."""
    best = candidates.groupBy(file_key).agg(F.min("cand_ord").alias("cand_ord"))
    return candidates.join(best, [file_key, "cand_ord"], "left_semi")


def run_extractors(
    rows: DataFrame, candidates: DataFrame, extractors: Mapping[str, Callable[[DataFrame], DataFrame]], file_key: str = "file_id"
) -> DataFrame:
    """Run each file's extractors and keep the rows of the first that produced any.

    candidates (file_id, cand_ord, extractor).  Every extractor gets the rows of the files that name it and returns
    rows with ``file_id``, all extractors the same columns.  A name without an extractor produces nothing.
    """
    out = None
    for name, extract in extractors.items():
        mine = candidates.where(F.col("extractor") == name).select(file_key, "cand_ord").distinct()
        made = extract(rows.join(mine.select(file_key).distinct(), file_key, "left_semi")).join(mine, file_key)
        out = made if out is None else out.unionByName(made)
    if out is None:
        raise ValueError("no extractors")
    return first_nonempty(materialize(out, "extracted"), file_key)


def ready_status(files: DataFrame) -> DataFrame:
    """Whether a file may be parsed: configured with a known bank and a type; else the reason."""
    bank, kind = F.coalesce("bank", F.lit("")), F.coalesce("doc_type", F.lit(""))
    no_bank = bank.isin("", "未知", UNKNOWN_CODE, UNKNOWN_BANK)
    reason = F.when(no_bank, "bank not set").when(kind == "", "type not set")
    return files.withColumns({"reason": reason, "status": F.when(reason.isNull(), "ready").otherwise("failed")})


def list_files(incoming: DataFrame, present: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """New paths (batch_id, ord, path) with their file name; the first of equal paths stays.

    ``cap`` is the largest batch allowed; files beyond it are marked, not lost.
    """
    fresh = first_by_key(incoming, ["batch_id", "path"], "ord")
    if present is not None:
        fresh = fresh.join(present.select("batch_id", "path"), ["batch_id", "path"], "left_anti")
    fresh = fresh.withColumn("file_name", file_name(F.col("path")))
    if cap is None:
        return fresh
    placed = segmented(fresh, ["batch_id"], ["ord"], ordinal_segment("ord", SEGMENT_BITS), rank="place")
    return placed.withColumn("accepted", F.col("place") <= cap)


def union_successful(rows: DataFrame, files: DataFrame, file_key: str = "file_id") -> DataFrame:
    """Rows of the successful files; (file_ord, row_no) is their order."""
    good = files.where(F.col("status") == "success").select(file_key, "file_ord")
    return rows.join(good, file_key)


__all__ = [
    "RECEIPT", "document_class", "extension", "extractor_candidates", "file_name", "first_nonempty", "list_files",
    "ready_status", "route_files", "run_extractors", "statement_subtype", "union_successful",
]
