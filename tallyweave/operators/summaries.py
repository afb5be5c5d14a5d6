"""Roll-ups, labels and display orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import MONEY
from ..functions.dates import month_label
from ..plans.segments import SEGMENT_BITS, ordinal_segment, segmented


def txn_summary(txns: DataFrame) -> DataFrame:
    """Counts and sums by direction in one pass."""
    inc, exp = F.col("direction") == "income", F.col("direction") == "expense"
    zero = F.lit(0).cast(MONEY)

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("amount"))), zero).cast(MONEY)

    return txns.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(inc).alias("income_count"), F.count_if(exp).alias("expense_count"),
        total(inc).alias("income_total"), total(exp).alias("expense_total"),
    )


def statement_summary(rows: DataFrame, step: float = 0.01, receipts: bool = False) -> DataFrame:
    """One row per file: balances of the first and last raw row, last date, errors, confidence.

    rows (file_id, row_no, balance, status ok/skip/error, reason, txn_date).  Errors are kept
    whole, in row order.  The opening balance is the one printed on the first row.
    """
    bad = F.col("status") == "error"
    errors = F.count_if(bad)
    good = F.count_if(F.col("status") == "ok")
    confidence = F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(step) * errors)
    if receipts:
        confidence = F.when(good == 0, 0.0).otherwise(confidence)
    return rows.groupBy("file_id").agg(
        F.min_by("balance", "row_no").alias("opening_balance"),
        F.max_by("balance", "row_no").alias("closing_balance"),
        F.max(F.when(F.col("status") == "ok", F.col("txn_date"))).alias("statement_date"),
        good.alias("transactions"), errors.alias("error_count"), F.round(confidence, 4).alias("confidence"),
    )


def statement_errors(rows: DataFrame) -> DataFrame:
    """The errors of each file as rows: a file's error list may be as long as the file."""
    return rows.where(F.col("status") == "error").select(
        "file_id", "row_no", F.concat(F.lit("Row "), F.col("row_no").cast("string"), F.lit(": "), F.col("reason")).alias("error")
    )


def batch_summary(files: DataFrame, keys: list[str]) -> DataFrame:
    """Files, successes, failures and transactions."""
    return files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum(F.when(F.col("status") == "success", F.col("transactions"))), F.lit(0)).alias("transactions"),
    )


def distinct_categories(subjects: DataFrame) -> DataFrame:
    """Non-empty categories with the position of their first use."""
    return subjects.where(F.coalesce("category", F.lit("")) != "").groupBy("category").agg(F.min("ord").alias("first_ord"))


def period_label(txns: DataFrame, supplied: Column | None = None) -> DataFrame:
    """Earliest month of each batch as a label unless one is supplied."""
    label = month_label(F.min("txn_date"))
    out = txns.groupBy("batch_id").agg(label.alias("period"))
    if supplied is not None:
        out = out.withColumn("period", F.coalesce(F.nullif(supplied, F.lit("")), "period"))
    return out.withColumn("period", F.coalesce("period", F.lit("")))


def date_position(txns: DataFrame) -> DataFrame:
    """Position of each transaction in its batch by (date, source order).

    Segments are days, so a batch of any size is ranked by many tasks.
    """
    return segmented(txns, ["batch_id"], ["txn_date", "txn_seq"],
                     F.struct("txn_date", ordinal_segment("txn_seq")), rank="position")


def sort_by_amount(txns: DataFrame, descending: bool = False) -> DataFrame:
    size = F.abs("amount")
    return txns.orderBy(size.desc() if descending else size.asc(), "txn_seq")


def files_display_order(files: DataFrame) -> DataFrame:
    """Successful files first, then by name (binary order)."""
    return files.orderBy(F.when(F.col("status") == "success", 0).otherwise(1), "file_name")


def page_rows(txns: DataFrame, page: int, size: int, bits: int = SEGMENT_BITS) -> DataFrame:
    """One page of each batch with its display number."""
    numbered = segmented(txns, ["batch_id"], ["txn_seq"], ordinal_segment("txn_seq", bits), rank="display_no")
    return numbered.where(F.col("display_no").between((page - 1) * size + 1, page * size))


def first_of_group(txns: DataFrame, keys: list[str]) -> DataFrame:
    """Date and text of each group's first transaction."""
    return txns.groupBy(*keys).agg(
        F.min_by(F.struct("txn_date", "description"), "txn_seq").alias("f")
    ).select(*keys, F.col("f.txn_date").alias("first_date"), F.col("f.description").alias("first_description"))


