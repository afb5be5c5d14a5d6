"""Export layouts and writers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DETAIL_COLUMNS, EXPORT_COLUMNS


def default_export() -> dict[int, Column]:
    """Position -> column expression; positions not named stay empty."""
    return {
        1: F.coalesce(F.col("date").cast("string"), F.lit("")),
        2: F.lit("记"),
        3: F.col("voucher_no"),
        4: F.lit(0),
        5: F.col("entry_seq"),
        6: F.col("summary"),
        7: F.col("subject_code"),
        8: F.col("subject_name"),
        9: F.col("debit_amount").cast("double"),
        10: F.col("credit_amount").cast("double"),
        15: F.nullif(F.col("aux_category"), F.lit("")),
        23: F.col("original_amount").cast("double"),
        24: F.lit("RMB"),
        25: F.lit(1.0),
    }


def voucher_export(entries: DataFrame, period: Column | None = None, columns: Mapping[int, Column] | None = None) -> DataFrame:
    """The 25-column layout, as composed and edited: no row is matched again.

    ``columns`` replaces what stands at the positions.
    """
    mapped = default_export() if columns is None else columns
    cells = [mapped.get(i, F.lit(None).cast("string")).alias(name) for i, name in enumerate(EXPORT_COLUMNS, 1)]
    sheet = F.lit("凭证列表") if period is None else F.when(
        F.coalesce(period, F.lit("")) != "", F.concat(F.lit("凭证列表#"), period)).otherwise("凭证列表")
    return entries.select(F.col("batch_id"), sheet.alias("sheet"), *cells)


def detail_export(txns: DataFrame) -> DataFrame:
    """The nine-column transaction detail."""
    values = (
        F.col("txn_date").cast("string"), F.col("description"), F.col("amount").cast("double"), F.col("currency"),
        F.col("direction"), F.col("counterparty"), F.col("reference_number"), F.col("account_number"), F.col("account_name"),
    )
    return txns.select("batch_id", "txn_seq", *(v.alias(n) for v, n in zip(values, DETAIL_COLUMNS)))


def write_partitioned(df: DataFrame, path: str, by: str, fmt: str = "parquet", **options: str) -> None:
    """One directory per value of ``by``, replaced as a whole by a rerun."""
    writer = df.write.mode("overwrite").format(fmt).option("partitionOverwriteMode", "dynamic")
    writer.options(**options).partitionBy(by).save(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
