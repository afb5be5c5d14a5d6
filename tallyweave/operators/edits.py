"""Bulk edits of vouchers: patch, fill, move, split, rebalance, renumber."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import MONEY
from ..plans.segments import SEGMENT_BITS, dense_number, ordinal_segment, segmented
from .vouchers import unmatched_non_bank

VOUCHER = ["batch_id", "voucher_no"]


def _is_bank() -> Column:
    return F.col("direction") == "bank"


def rebalance_bank(entries: DataFrame) -> DataFrame:
    """Bank entries take the sums of the other side; a zero sum becomes null.

    Only the bank rows (one or few per voucher) meet the sums; other rows do not move.
    """
    others = entries.where(~_is_bank())
    sums = others.groupBy(*VOUCHER).agg(
        F.sum("credit_amount").cast(MONEY).alias("__cr"), F.sum("debit_amount").cast(MONEY).alias("__dr")
    )
    zero = F.lit(0).cast(MONEY)
    bank = (
        entries.where(_is_bank()).drop("debit_amount", "credit_amount")
        .join(sums, VOUCHER, "left")
        .withColumn("debit_amount", F.nullif(F.col("__cr"), zero))
        .withColumn("credit_amount", F.nullif(F.col("__dr"), zero))
        .select(*entries.columns)
    )
    return others.unionByName(bank)


def _reseat(entries: DataFrame, place: list[str], coarse: list[Column]) -> DataFrame:
    """One ordered pass per voucher: entry_seq 1..n with bank entries last, bank amounts rebalanced.

    ``place`` orders the other entries and ``coarse`` cuts that order into segments.  The
    sums of the other side come from the same pass.  Adds ``__others``, the number of
    entries that are not bank entries.
    """
    other = ~_is_bank()
    flagged = entries.withColumn("__bank", _is_bank().cast("int"))
    seated = segmented(
        flagged, VOUCHER, ["__bank", *place], F.struct(F.col("__bank"), *coarse), rank="__new",
        totals={
            "__others": other.cast("bigint"),
            "__cr": F.when(other, F.col("credit_amount")),
            "__dr": F.when(other, F.col("debit_amount")),
        },
    )
    zero = F.lit(0).cast(MONEY)

    def amount(side: str, total: str) -> Column:
        return F.when(_is_bank(), F.nullif(F.col(total).cast(MONEY), zero)).otherwise(F.col(side))

    return seated.withColumns({
        "debit_amount": amount("debit_amount", "__cr"),
        "credit_amount": amount("credit_amount", "__dr"),
        "entry_seq": F.col("__new"),
    })


def renumber(entries: DataFrame, bits: int = SEGMENT_BITS) -> DataFrame:
    """Bank entries last and rebalanced, entry_seq 1..n, vouchers 1..k in their existing order."""
    placed = entries.withColumn("__seq", F.col("entry_seq"))
    ordered = _reseat(placed, ["__seq"], [ordinal_segment("__seq", bits)]).select(*entries.columns)
    return _renumber_vouchers(ordered, entries.select(*VOUCHER).distinct(), bits)


def _renumber_vouchers(entries: DataFrame, vouchers: DataFrame, bits: int) -> DataFrame:
    """Vouchers 1..k per batch; ``vouchers`` lists those that stay, each once."""
    numbered = dense_number(vouchers, ["batch_id"], "voucher_no", "__no", bits)
    return entries.join(numbered, VOUCHER).withColumn("voucher_no", F.col("__no")).select(*entries.columns)


def manual_patch(entries: DataFrame, patches: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Patch entries by (batch, voucher, seq); a null in the patch keeps the old value.

    A patched entry is manual.  Several patches of an entry take effect in the order of ``ordinal``: for each field
    the last value that isn't null counts.
    """
    at = [*VOUCHER, "entry_seq"]
    changed = [c for c in patches.columns if c not in (*at, ordinal)]
    turn = F.col(ordinal) if ordinal else F.struct(*changed)
    new = patches.groupBy(*at).agg(
        F.lit(True).alias("__hit"), *(F.max_by(c, F.when(F.col(c).isNotNull(), turn)).alias(f"__{c}") for c in changed))
    joined = entries.join(new, at, "left")
    hit = F.col("__hit").isNotNull()
    out = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in changed}
    out["is_manual"] = F.when(hit, True).otherwise(F.col("is_manual"))
    out["match_source"] = F.when(hit, "manual").otherwise(F.col("match_source"))
    return joined.withColumns(out).select(*entries.columns)


def bulk_fill(entries: DataFrame, code: str, name: str, aux_category: str = "", aux_category_name: str = "") -> DataFrame:
    """Give every open entry the subject; those entries become manual.  A map-only step."""
    open_ = unmatched_non_bank()
    new = {
        "subject_code": F.lit(code), "subject_name": F.lit(name), "aux_category": F.lit(aux_category),
        "aux_category_name": F.lit(aux_category_name), "is_manual": F.lit(True), "match_source": F.lit("manual"),
    }
    # The flag is taken before match_source changes.
    return entries.withColumn("__open", open_).withColumns(
        {c: F.when(F.col("__open"), v).otherwise(F.col(c)) for c, v in new.items()}
    ).select(*entries.columns)


def bulk_fill_counts(entries: DataFrame) -> DataFrame:
    """How many entries a fill would change, per batch."""
    return entries.groupBy("batch_id").agg(F.count_if(unmatched_non_bank()).alias("filled"))


def move_entries(
    entries: DataFrame, selected: DataFrame, targets: DataFrame, bits: int = SEGMENT_BITS
) -> DataFrame:
    """Move the selected entries to the end of their batch's target voucher.

    selected (batch_id, voucher_no, entry_seq), targets (batch_id, target_no).  Vouchers left
    with bank entries only are dropped (never the target), bank entries go last, entries and
    vouchers are renumbered and bank entries rebalanced.
    """
    picked = selected.select(*VOUCHER, "entry_seq", F.lit(True).alias("__sel")).distinct()
    # One target per batch: selections carry it, so only selected rows are looked up.
    flagged = entries.join(picked.join(targets, "batch_id"), [*VOUCHER, "entry_seq"], "left")
    moving = F.col("__sel").isNotNull() & (F.col("voucher_no") != F.col("target_no"))
    placed = flagged.withColumns({
        "__moved": moving.cast("int"),
        "__from": F.when(moving, F.col("voucher_no")).otherwise(F.lit(0)),
        "__seq": F.col("entry_seq"),
    }).withColumn("voucher_no", F.when(F.col("__moved") == 1, F.col("target_no")).otherwise(F.col("voucher_no")))
    placed = placed.drop("__sel", "target_no")
    staying = placed.groupBy(*VOUCHER).agg(F.max((~_is_bank()).cast("int")).alias("__any"))
    staying = (
        staying.join(targets.withColumnRenamed("target_no", "__target"), "batch_id", "left")
        .where((F.col("__any") == 1) | (F.col("voucher_no") == F.col("__target")))
        .select(*VOUCHER)
    )
    seated = _reseat(
        placed, ["__moved", "__from", "__seq"], [F.col("__moved"), F.col("__from"), ordinal_segment("__seq", bits)]
    )
    return _renumber_vouchers(seated.select(*entries.columns), staying, bits)


def split_entries(entries: DataFrame, parts: DataFrame, bits: int = SEGMENT_BITS) -> DataFrame:
    """Replace entries by their parts, in place.

    parts (batch_id, voucher_no, entry_seq, part_no, amount [, subject_code, subject_name,
    summary]); other fields are inherited.  The amount goes to the side the entry had.
    """
    at = [*VOUCHER, "entry_seq"]
    extra = [c for c in ("subject_code", "subject_name", "summary") if c in parts.columns]
    new = parts.select(*at, "part_no", F.col("amount").cast(MONEY).alias("__amt"),
                       *(F.col(c).alias(f"__{c}") for c in extra))
    joined = entries.join(new, at, "left")
    is_part = F.col("part_no").isNotNull()
    values = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in extra}
    for side in ("debit_amount", "credit_amount"):
        values[side] = F.when(is_part & F.col(side).isNotNull(), F.col("__amt")).otherwise(F.col(side))
    replaced = joined.withColumns(values).withColumns({
        "__seq": F.col("entry_seq"), "__part": F.coalesce("part_no", F.lit(0)).cast("bigint"),
    }).select(*entries.columns, "__seq", "__part")
    touched = parts.select(*VOUCHER).distinct()
    changed = replaced.join(touched, VOUCHER, "left_semi")
    untouched = entries.join(touched, VOUCHER, "left_anti")
    seated = _reseat(changed, ["__seq", "__part"], [ordinal_segment("__seq", bits)])
    return untouched.unionByName(seated.select(*entries.columns))


def check_split(entries: DataFrame, parts: DataFrame) -> DataFrame:
    """Verdict per split: reason is null when the parts are acceptable."""
    at = [*VOUCHER, "entry_seq"]
    sums = parts.groupBy(*at).agg(
        F.count(F.lit(1)).alias("parts"), F.sum(F.col("amount").cast(MONEY)).cast(MONEY).alias("total"),
        F.min(F.col("amount").cast(MONEY)).alias("__least"),
    )
    original = entries.select(*at, F.coalesce("debit_amount", "credit_amount").alias("original"))
    return sums.join(original, at, "left").select(
        *at, "parts", "total", "original",
        F.when(F.col("original").isNull(), "no such entry").when(F.col("parts") < 2, "fewer than two parts")
        .when(F.col("__least") <= 0, "part not positive").when(F.col("total") > F.col("original"), "parts exceed entry")
        .alias("reason"),
    )


def edited_or_original(edited: DataFrame, original: DataFrame) -> DataFrame:
    """Per batch the edited entries when there are any, else the original ones."""
    return edited.unionByName(original.join(edited.select("batch_id").distinct(), "batch_id", "left_anti"))


def replace_rows(rows: DataFrame, edited: DataFrame, keys: list[str]) -> DataFrame:
    """Whole rows replaced by their edited copies."""
    values = [c for c in rows.columns if c not in keys]
    new = edited.select(*keys, F.struct(*values).alias("__new"))
    joined = rows.select(*keys, F.struct(*values).alias("__old")).join(new, keys, "left")
    return joined.select(*keys, F.coalesce("__new", "__old").alias("__v")).select(*keys, "__v.*").select(*rows.columns)


def partial_update(rows: DataFrame, patches: DataFrame, key: str, patch: str = "patch", ordinal: str | None = None) -> DataFrame:
    """Text columns change only where the patch map has them; null or '' in it clears.

    patches (key, map<string,string>).  The key itself never changes.  Of several patches of a row the last by
    ``ordinal`` counts for each column.
    """
    turn = F.col(ordinal) if ordinal else F.lit(0)
    each = patches.select(key, turn.alias("__at"), F.explode(patch).alias("__c", "__v"))
    # One entry for each column that is patched at most.
    last = each.groupBy(key, "__c").agg(F.max_by("__v", F.struct("__at", "__v")).alias("__v")).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("__c", "__v"))).alias("__p"))
    joined = rows.join(last, key, "left")

    def value(c: str) -> Column:
        has = F.col("__p").isNotNull() & F.map_contains_key("__p", F.lit(c))
        return F.when(has, F.coalesce(F.trim(F.try_element_at("__p", F.lit(c))), F.lit(""))).otherwise(F.col(c)).alias(c)

    return joined.select(*(F.col(c) if c == key else value(c) for c in rows.columns))
