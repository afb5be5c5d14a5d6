"""Sheets as cell tables (file_id, row, col, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    SHEET_ACCOUNT_LABEL, SHEET_CLOSING_LABELS, SHEET_COLUMNS, SHEET_HEADER_LAST_ROW, SHEET_HEADER_MARKS,
    SHEET_NAME_LABELS, SHEET_OPENING_LABELS,
)
from ..functions.text import lookup, strip


def _stripped(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("value").isNotNull()).withColumn("value", strip(F.col("value")))


def header_rows(cells: DataFrame) -> DataFrame:
    """(file_id, header_row): the first of the top rows whose text holds all header marks.

    The text of a row is joined left to right, as a mark may be split over cells; only the
    top rows of a file are read.
    """
    top = _stripped(cells.where(F.col("row") <= SHEET_HEADER_LAST_ROW))
    parts = F.array_sort(F.collect_list(F.struct("col", "value")))
    text = top.groupBy("file_id", "row").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "").alias("t"))
    for mark in SHEET_HEADER_MARKS:
        text = text.where(F.col("t").contains(mark))
    return text.groupBy("file_id").agg(F.min("row").alias("header_row"))


def scan_sheet_cells(cells: DataFrame) -> DataFrame:
    """Records below the header: one text column per known field, rows without an amount dropped."""
    clean = _stripped(cells)
    headers = header_rows(cells)
    names = clean.where(F.col("row") <= SHEET_HEADER_LAST_ROW).join(
        headers.withColumnRenamed("header_row", "row"), ["file_id", "row"]
    ).select("file_id", "col", F.col("row").alias("header_row"), lookup(F.col("value"), SHEET_COLUMNS).alias("field"))
    named = names.where(F.col("field").isNotNull())
    body = clean.join(named, ["file_id", "col"]).where(F.col("row") > F.col("header_row"))
    fields = list(dict.fromkeys(SHEET_COLUMNS.values()))
    # A field named by two columns takes the right-most value.
    picked = [F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("col"))).alias(f) for f in fields]
    rows = body.groupBy("file_id", "row").agg(*picked)
    return rows.where(F.col("debit_amount").isNotNull() | F.col("credit_amount").isNotNull())


def _label(value: Column) -> Column:
    def any_of(words) -> Column:
        return value.rlike("|".join(words))

    return (
        F.when(any_of(SHEET_OPENING_LABELS), "opening_balance").when(any_of(SHEET_CLOSING_LABELS), "closing_balance")
        .when(any_of(SHEET_NAME_LABELS), "account_name").when(value.startswith(SHEET_ACCOUNT_LABEL), "account_no")
    )


def sheet_metadata(cells: DataFrame) -> DataFrame:
    """(file_id, field, value): labels above the header with the nearest value up to four columns right.

    Each label looks up four exact positions; the last label of a field wins.
    """
    clean = _stripped(cells.where(F.col("row") <= SHEET_HEADER_LAST_ROW))
    above = clean.join(header_rows(cells), "file_id").where(F.col("row") < F.col("header_row"))
    labels = above.select("file_id", "row", F.col("col").alias("label_col"), _label(F.col("value")).alias("field")).where(
        F.col("field").isNotNull()
    )
    spots = labels.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumn(
        "col", F.col("label_col") + F.col("step")
    )
    hit = spots.join(above.select("file_id", "row", "col", "value"), ["file_id", "row", "col"])
    number = F.col("field").isin("opening_balance", "closing_balance")
    usable = F.when(number, F.col("value").rlike(r"^[\d,]+\.?\d*$")).otherwise(
        (F.col("value") != "") & ~F.col("value").startswith("None")
    )
    nearest = hit.where(usable).groupBy("file_id", "field", "row", "label_col").agg(F.min_by("value", "step").alias("value"))
    kept = nearest.where((F.col("field") != "account_no") | ~F.col("value").contains("名称"))
    return kept.groupBy("file_id", "field").agg(F.max_by("value", F.struct("row", "label_col")).alias("value"))
