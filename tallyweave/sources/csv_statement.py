"""CSV statements in GBK: a splittable scan that still knows the row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import CSV_STATEMENT_COLUMNS, CSV_STATEMENT_MARKS
from ..functions.text import clean_text

#: Short names for the fixed columns, in order.
FIELDS = (
    "voucher", "own_account", "ref_account", "txn_time", "value_date", "flag", "debit", "credit", "ref_bank",
    "summary", "remark", "purpose", "counterparty", "balance",
)
assert len(FIELDS) == len(CSV_STATEMENT_COLUMNS)
#: Tasks that list folders of statements.
LISTING, LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 128


def scan_csv_statement(spark: SparkSession, path: str | list[str], encoding: str = "GBK") -> DataFrame:
    """(file_id, file_pos, file_row, fields): cleaned text columns, marker rows dropped; files of a folder at any depth.

    A byte of a two-byte GBK character is never a line end, so the scan may split a large
    file at any line.  ``(file_pos, file_row)`` orders the rows of a file: the start of the
    split, then the place in the task.  Both are taken in the scan, before any shuffle.
    """
    if encoding.upper() in ("GBK", "GB18030"):
        # Spark 4 accepts these charsets only with this setting.
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    schema = ", ".join(f"`{f}` string" for f in FIELDS)
    # Folders are listed many to a task; one task for each costs more than reading a small statement.
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(before), LISTING_TASKS)))
    try:
        raw = spark.read.schema(schema).option("encoding", encoding).option("recursiveFileLookup", "true").csv(path)
    finally:
        spark.conf.set(LISTING, before)
    first = F.coalesce(F.col("voucher"), F.lit(""))
    placed = raw.select(
        F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("file_pos"),
        F.monotonically_increasing_id().alias("file_row"), *FIELDS,
    )
    return placed.where(~first.isin(*CSV_STATEMENT_MARKS)).select(
        "file_id", "file_pos", "file_row", *(clean_text(F.col(f)).alias(f) for f in FIELDS)
    )


def number_rows(scanned: DataFrame) -> DataFrame:
    """Add ``row_no`` 1..n per file; a split is ranked by one task and splits are then offset."""
    split = ["file_id", "file_pos"]
    local = F.row_number().over(Window.partitionBy(*split).orderBy("file_row"))
    sizes = scanned.groupBy(*split).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("file_id").orderBy("file_pos").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*split, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return scanned.withColumn("__rn", local).join(offsets, split).withColumn(
        "row_no", (F.col("__rn") + F.col("__before")).cast("bigint")
    ).drop("__rn", "__before", "file_pos", "file_row")


def edge_balances(scanned: DataFrame, amount: Column) -> DataFrame:
    """Balance printed on the first and on the last row of each file, null if that is no number."""
    at = F.struct("file_pos", "file_row")
    value = F.struct(amount.alias("v"))
    return scanned.groupBy("file_id").agg(F.min_by(value, at).alias("a"), F.max_by(value, at).alias("b")).select(
        "file_id", F.col("a.v").alias("opening_balance"), F.col("b.v").alias("closing_balance")
    )
