"""Transactions to balanced double-entry vouchers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import UNMATCHED_CODE
from ..functions.amounts import MONEY
from ..plans.segments import SEGMENT_BITS, dense_number, ordinal_segment
from .accounts import Account, account_column, bank_subject, match_accounts

#: Voucher key below the batch; the last part is the counterparty's reference.
GROUP_KEY = ("account_number", "counter_code", "direction", "group_ref")

ENTRY_COLUMNS = (
    "batch_id", "voucher_no", "entry_seq", "date", "summary", "subject_code", "subject_name",
    "debit_amount", "credit_amount", "direction", "counterparty", "match_source", "rule_id",
    "original_summary", "original_amount", "is_manual", "aux_category", "aux_category_name",
)
ENTRY_SCHEMA = (
    "batch_id string, voucher_no bigint, entry_seq bigint, date date, summary string, subject_code string, "
    f"subject_name string, debit_amount {MONEY}, credit_amount {MONEY}, direction string, counterparty string, "
    f"match_source string, rule_id string, original_summary string, original_amount {MONEY}, is_manual boolean, "
    "aux_category string, aux_category_name string"
)


def with_group_key(classified: DataFrame, reference: str = "reference_number") -> DataFrame:
    """Add the voucher key.  A row without a subject gets a key of its own."""
    empty = F.lit("")
    code = F.coalesce(F.nullif(F.col("subject_code"), empty), F.lit(UNMATCHED_CODE))
    alone = code == UNMATCHED_CODE
    return classified.withColumns({
        "account_number": F.coalesce("account_number", empty),
        "counter_code": code,
        # Plainly not null, so no "is not null" filter evaluates the rules a second time.
        "group_ref": F.coalesce(
            F.when(alone, F.concat(F.lit("#"), F.col("txn_seq").cast("string"))).otherwise(F.col(reference)), empty
        ),
    })


def grouped(classified: DataFrame, bits: int = SEGMENT_BITS) -> DataFrame:
    """Classified transactions with their voucher: number, place in it, size and total.

    Adds voucher_no, voucher_pos, voucher_size, voucher_total.  Nothing here depends on how
    large a batch or a voucher is: rows are ranked inside (voucher, segment), and batches
    are numbered over (batch, segment).  A row without a subject is a voucher already: it only
    looks up its number.  The rows are read several times, so they had better be stored.
    """
    every = with_group_key(classified)
    alone = F.col("counter_code") == UNMATCHED_CODE
    lone = every.where(alone)
    rows = every.where(~alone).withColumn("__seg", ordinal_segment("txn_seq", bits))
    key = ["batch_id", *GROUP_KEY]
    pieces = rows.groupBy(*key, "__seg").agg(
        F.count(F.lit(1)).alias("__n"), F.sum("amount").alias("__amt"), F.min("txn_seq").alias("__first")
    )
    whole = Window.partitionBy(*key)
    before = whole.orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        *key, "__seg",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(whole).alias("voucher_size"),
        F.sum("__amt").over(whole).cast(MONEY).alias("voucher_total"),
        F.min("__first").over(whole).alias("__lead"),
    )
    leads = lone.select("batch_id", F.col("txn_seq").alias("__lead")).unionByName(pieces.select("batch_id", "__lead"))
    numbers = dense_number(leads.distinct(), ["batch_id"], "__lead", "voucher_no", bits)
    place = F.row_number().over(Window.partitionBy(*key, "__seg").orderBy("txn_seq"))
    many = (
        rows.withColumn("__rn", place)
        .join(pieces.join(numbers, ["batch_id", "__lead"]), [*key, "__seg"])
        .withColumn("voucher_pos", (F.col("__rn") + F.col("__before")).cast("bigint"))
        .drop("__rn", "__before", "__seg", "__lead")
    )
    one = F.lit(1).cast("bigint")
    single = lone.withColumn("__lead", F.col("txn_seq")).join(numbers, ["batch_id", "__lead"]).withColumns({
        "voucher_size": one, "voucher_total": F.col("amount").cast(MONEY), "voucher_pos": one}).drop("__lead")
    return many.unionByName(single)


def compose_vouchers(
    classified: DataFrame, accounts: DataFrame | Sequence[Account], bits: int = SEGMENT_BITS
) -> DataFrame:
    """Balanced entries: one per transaction and one bank entry per voucher.

    The first transaction of a voucher also emits the bank entry, which takes its date and
    text; no second pass over the groups is needed.
    """
    rows = grouped(classified, bits)
    if isinstance(accounts, DataFrame):
        rows = match_accounts(rows, accounts, "account_number", "own")
    else:
        rows = rows.withColumn("own", account_column(accounts, F.col("account_number")))
    bank_code, bank_name = bank_subject(F.col("own"))
    spend = F.col("direction") == "expense"
    empty, none = F.lit(""), F.lit(None).cast(MONEY)
    amount, total = F.col("amount").cast(MONEY), F.col("voucher_total")

    entry = F.struct(
        (F.col("voucher_pos") + F.when(spend, 0).otherwise(1)).cast("bigint").alias("entry_seq"),
        F.col("txn_date").alias("date"), F.col("description").alias("summary"),
        F.col("counter_code").alias("subject_code"), F.coalesce("subject_name", empty).alias("subject_name"),
        F.when(spend, amount).alias("debit_amount"), F.when(~spend, amount).alias("credit_amount"),
        F.col("direction").alias("direction"), F.coalesce("counterparty", empty).alias("counterparty"),
        F.col("source").alias("match_source"), F.coalesce("rule_id", empty).alias("rule_id"),
        F.col("description").alias("original_summary"), amount.alias("original_amount"),
        F.lit(False).alias("is_manual"),
        F.coalesce("aux_category", empty).alias("aux_category"),
        F.coalesce("aux_category_name", empty).alias("aux_category_name"),
    )
    bank = F.struct(
        F.when(spend, F.col("voucher_size") + 1).otherwise(F.lit(1)).cast("bigint").alias("entry_seq"),
        F.col("txn_date").alias("date"), F.col("description").alias("summary"),
        bank_code.alias("subject_code"), bank_name.alias("subject_name"),
        F.when(~spend, total).otherwise(none).alias("debit_amount"),
        F.when(spend, total).otherwise(none).alias("credit_amount"),
        F.lit("bank").alias("direction"), empty.alias("counterparty"),
        F.lit("auto").alias("match_source"), empty.alias("rule_id"), empty.alias("original_summary"),
        F.lit(0).cast(MONEY).alias("original_amount"), F.lit(False).alias("is_manual"),
        empty.alias("aux_category"), empty.alias("aux_category_name"),
    )
    both = F.when(F.col("voucher_pos") == 1, F.array(entry, bank)).otherwise(F.array(entry))
    return rows.select("batch_id", "voucher_no", F.explode(both).alias("e")).select(
        "batch_id", "voucher_no", "e.*"
    ).select(*ENTRY_COLUMNS)


def voucher_heads(classified: DataFrame, accounts: DataFrame | Sequence[Account]) -> DataFrame:
    """One row per voucher: number, date, direction, bank subject, counter subject."""
    first = grouped(classified).where("voucher_pos = 1")
    own = match_accounts(first, accounts, "account_number", "own")
    return own.select(
        "batch_id", "voucher_no", F.col("txn_date").alias("date"), "direction",
        bank_subject(F.col("own"))[0].alias("bank_subject_code"),
        F.col("counter_code").alias("counterpart_subject_code"), F.col("voucher_size"), "voucher_total",
    )


def unmatched_non_bank(source: str = "match_source", direction: str = "direction"):
    """Predicate: the entry still needs a subject."""
    return (F.col(source) == "unmatched") & (F.col(direction) != "bank")


def preview_warnings(entries: DataFrame) -> DataFrame:
    """One message per voucher that has entries without a subject."""
    open_ = entries.where(unmatched_non_bank()).groupBy("batch_id", "voucher_no").agg(
        F.count(F.lit(1)).alias("unmatched")
    )
    return open_.withColumn("message", F.format_string("凭证#%d: %d 条分录科目未匹配", "voucher_no", "unmatched"))


def header_rollup(entries: DataFrame) -> DataFrame:
    """Header row (count and totals) before the entry rows of each voucher.

    Order by batch_id, voucher_no, is_entry, entry_seq to show them interleaved.
    """
    zero = F.lit(0).cast(MONEY)
    heads = entries.groupBy("batch_id", "voucher_no").agg(
        F.count(F.lit(1)).alias("entry_count"),
        F.coalesce(F.sum("debit_amount"), zero).cast(MONEY).alias("total_debit"),
        F.coalesce(F.sum("credit_amount"), zero).cast(MONEY).alias("total_credit"),
    ).select(
        "batch_id", "voucher_no", F.lit(0).alias("is_entry"), F.lit(0).cast("bigint").alias("entry_seq"),
        "entry_count", "total_debit", "total_credit",
    )
    rows = entries.select(
        "batch_id", "voucher_no", F.lit(1).alias("is_entry"), "entry_seq",
        F.lit(None).cast("bigint").alias("entry_count"),
        F.col("debit_amount").alias("total_debit"), F.col("credit_amount").alias("total_credit"),
    )
    return heads.unionByName(rows)
