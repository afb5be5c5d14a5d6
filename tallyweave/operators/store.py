"""Table changes: drafts, history, upserts, deletes, export log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import summary_hash
from .accounts import first_by_key

HISTORY_KEY = ["summary_hash", "subject_code", "direction"]


def table_select(
    table: DataFrame, columns: Sequence[str] | None = None, where: Column | None = None,
    order_by: Sequence[Column] | None = None, limit: int | None = None,
) -> DataFrame:
    """Columns, filter, order and limit, in that meaning; order + limit is a top-k, not a full sort."""
    out = table if where is None else table.where(where)
    if order_by:
        out = out.orderBy(*order_by)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*columns) if columns else out


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Incoming rows whose key is new, the first of equal keys: what has to be appended."""
    keys = list(keys)
    fresh = first_by_key(incoming, keys, ordinal)
    return fresh.join(existing.select(*keys), keys, "left_anti").select(*incoming.columns)


def last_by_key(df: DataFrame, keys: Sequence[str], ordinal: str | Column) -> DataFrame:
    """The row with the highest ordinal for each key (partially aggregated, no sort)."""
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), ordinal).alias("__r"))
    return packed.select("__r.*")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], ordinal: str | Column) -> DataFrame:
    """Whole table after insert-or-replace by key; of incoming rows of one key the last by ``ordinal`` counts."""
    keys = list(keys)
    fresh = last_by_key(incoming, keys, ordinal).select(*existing.columns)
    return existing.join(fresh.select(*keys), keys, "left_anti").select(*existing.columns).unionByName(fresh)


def delete_rows(existing: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return existing.join(doomed.select(*keys).distinct(), list(keys), "left_anti").select(*existing.columns)


def missing_keys(existing: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys asked to be deleted that are not there."""
    return doomed.select(*keys).distinct().join(existing.select(*keys), list(keys), "left_anti")


def delete_cascade(
    heads: DataFrame, children: DataFrame, doomed: DataFrame, head_key: str = "id", child_key: str = "draft_id"
) -> tuple[DataFrame, DataFrame]:
    """Heads and children that remain."""
    return (
        delete_rows(heads, doomed, [head_key]),
        delete_rows(children, doomed.select(F.col(head_key).alias(child_key)), [child_key]),
    )


def draft_id(*parts: Column) -> Column:
    """Digest of what identifies the draft, so a retried write repeats it; its first eight characters are enough to show."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def save_drafts(entries: DataFrame, period: Column, name: Column, at: Column) -> tuple[DataFrame, DataFrame]:
    """Draft heads (one per batch) and entries tagged with their draft."""
    key = draft_id(F.col("batch_id"))
    heads = entries.select("batch_id").distinct().select(
        key.alias("id"), name.alias("name"), period.alias("period"), F.lit("draft").alias("status"),
        at.alias("created_at"), at.alias("updated_at"),
    )
    return heads, entries.withColumn("draft_id", key)


def check_entries(entries: DataFrame) -> DataFrame:
    """Refuse an empty set: reads one row, not the table."""
    if entries.isEmpty():
        raise ValueError("no entries to save")
    return entries


def load_draft(heads: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Entries of one draft with its head fields, by voucher and sequence."""
    head = heads.where(F.col("id") == key).select(
        F.col("id").alias("draft_id"), "name", "period", "status"
    )
    mine = entries.where(F.col("draft_id") == key)
    return mine.join(head, "draft_id").orderBy("voucher_no", "entry_seq")


def draft_list(heads: DataFrame, entries: DataFrame) -> DataFrame:
    """Heads with their number of entries, newest first.  Entries are counted before the join."""
    counts = entries.groupBy("draft_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        heads.join(counts, heads["id"] == counts["draft_id"], "left")
        .select(*heads.columns, F.coalesce("n", F.lit(0)).alias("entry_count"))
        .orderBy(F.col("updated_at").desc(), "id")
    )


def mark_exported(heads: DataFrame, exported: DataFrame, at: Column) -> DataFrame:
    """Status and time of the exported heads."""
    done = exported.select("id", F.lit(True).alias("__done")).distinct()
    hit = F.col("__done").isNotNull()
    return heads.join(done, "id", "left").withColumns({
        "status": F.when(hit, "exported").otherwise(F.col("status")),
        "updated_at": F.when(hit, at).otherwise(F.col("updated_at")),
    }).select(*heads.columns)


def learned_rows(entries: DataFrame, ordinal: Sequence[str] = ("batch_id", "voucher_no", "entry_seq")) -> DataFrame:
    """History rows from manual entries, the first of each (text, subject, direction).

    Automatic matches are never learned; bank entries are not transactions.
    """
    manual = entries.where(F.col("is_manual") & F.col("direction").isin("expense", "income"))
    text = F.coalesce(F.nullif(F.col("original_summary"), F.lit("")), F.col("summary"))
    rows = manual.select(
        text.alias("summary"), summary_hash(text).alias("summary_hash"), "subject_code",
        F.coalesce("subject_name", F.lit("")).alias("subject_name"), "direction",
        F.coalesce("counterparty", F.lit("")).alias("counterparty"), F.col("batch_id").alias("voucher_id"),
        F.struct(*ordinal).alias("ord"),
    )
    return first_by_key(rows, HISTORY_KEY, "ord")


def learn(history: DataFrame, entries: DataFrame) -> DataFrame:
    """History rows to append after an export."""
    return learned_rows(entries).join(history.select(*HISTORY_KEY), HISTORY_KEY, "left_anti")


def export_stats(entries: DataFrame) -> DataFrame:
    """Counts per batch and a JSON of counts per match source.

    The map is built from at most one row per match source, a short fixed list of values.
    """
    source = F.coalesce(F.nullif(F.col("match_source"), F.lit("")), F.lit("unmatched"))
    per_source = entries.groupBy("batch_id", source.alias("source")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("direction") != "bank").alias("t")
    )
    stats = per_source.groupBy("batch_id").agg(
        F.sum("n").alias("entry_count"), F.sum("t").alias("transaction_count"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n"))))).alias("match_stats"),
    )
    vouchers = entries.select("batch_id", "voucher_no").distinct().groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("voucher_count")
    )
    return stats.join(vouchers, "batch_id").select(
        "batch_id", "voucher_count", "entry_count", "transaction_count", "match_stats"
    )


def export_log(entries: DataFrame, files: DataFrame, at: Column, path: Column) -> DataFrame:
    """One audit row per batch, with how many different source files (batch_id, file_name) it had.

    The names themselves are rows of ``export_log_files``: a batch may have any number.
    """
    counted = export_log_files(files).groupBy("batch_id").agg(F.count(F.lit(1)).alias("source_file_count"))
    return export_stats(entries).join(counted, "batch_id", "left").select(
        at.alias("exported_at"), F.col("batch_id"), path.alias("file_path"), "voucher_count", "entry_count",
        "transaction_count", F.coalesce("source_file_count", F.lit(0)).alias("source_file_count"), "match_stats",
        draft_id(F.col("batch_id")).alias("draft_id"),
    )


def export_log_files(files: DataFrame) -> DataFrame:
    """(batch_id, file_name), each once: the source files of the export log."""
    return files.select("batch_id", "file_name").distinct()


def files_text(log_files: DataFrame) -> DataFrame:
    """The names of one batch's files as sorted JSON, for writing a log out: as long as the list is."""
    return log_files.groupBy("batch_id").agg(F.to_json(F.array_sort(F.collect_set("file_name"))).alias("source_files"))


def require_columns(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Refuse unknown fields by name before any job runs, then order the known ones."""
    unknown = sorted(set(df.columns) - set(allowed))
    if unknown:
        raise ValueError("unknown fields: " + ", ".join(unknown))
    return df.select(*[c for c in allowed if c in df.columns])


def evolve_schema(old: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Add missing columns with their default, and fill nulls of existing ones with it."""
    return old.withColumns({c: F.coalesce(F.col(c), d) if c in old.columns else d for c, d in defaults.items()})


def fill_blank(rows: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """Take ``column`` from ``source`` where it is '' here and not '' there; of several the largest."""
    new = source.where(F.col(column) != "").groupBy(key).agg(F.max(column).alias("__new"))
    value = F.when((F.col(column) == "") & (F.coalesce("__new", F.lit("")) != ""), F.col("__new")).otherwise(F.col(column))
    return rows.join(new, key, "left").withColumn(column, value).select(*rows.columns)
