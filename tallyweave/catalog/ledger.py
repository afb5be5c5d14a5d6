"""Queries: edits, stored tables, roll-ups and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import summary_hash
from ..operators import edits as E
from ..operators import filters as X
from ..operators import store as ST
from ..operators import subjects as SU
from ..operators import summaries as SM
from ..session import work_path
from ..sources import sinks as SK
from .base import Data, register

c = F.col
_KEYS = "batch_id:s voucher_no:l entry_seq:l "
_SHORT = _KEYS + "summary:s subject_code:s debit_amount:f credit_amount:f direction:s match_source:s is_manual:b"

# The bank side recomputed from the rest of the voucher.
_REBALANCED = """CASE WHEN direction='bank' THEN nullif(cast(sum(CASE WHEN direction<>'bank' THEN credit_amount END) OVER v as decimal(18,2)),0) ELSE debit_amount END AS debit_amount,
 CASE WHEN direction='bank' THEN nullif(cast(sum(CASE WHEN direction<>'bank' THEN debit_amount END) OVER v as decimal(18,2)),0) ELSE credit_amount END AS credit_amount"""


# --- edits -------------------------------------------------------------------------------

@register("rebalance_bank", _KEYS + "direction:s debit_amount:f credit_amount:f",
          f"SELECT batch_id, voucher_no, entry_seq, direction, {_REBALANCED} FROM (SELECT * REPLACE (CASE WHEN entry_seq % 3 = 1 AND direction<>'bank' THEN debit_amount * 2 ELSE debit_amount END AS debit_amount) FROM entries) WINDOW v AS (PARTITION BY batch_id, voucher_no)",
          ("entries",))
def rebalance_bank(d: Data):
    doubled = (c("entry_seq") % 3 == 1) & (c("direction") != "bank")
    changed = d.entries().withColumn("debit_amount", F.when(doubled, (c("debit_amount") * 2).cast("decimal(18,2)")).otherwise(c("debit_amount")))
    return E.rebalance_bank(changed)


@register("renumber", _KEYS + "direction:s summary:s debit_amount:f credit_amount:f",
          f"""SELECT batch_id, dense_rank() OVER (PARTITION BY batch_id ORDER BY voucher_no) AS voucher_no,
          row_number() OVER (PARTITION BY batch_id, voucher_no ORDER BY direction='bank', entry_seq) AS entry_seq, direction, summary, {_REBALANCED}
          FROM (SELECT * FROM entries WHERE voucher_no % 3 <> 0 AND (entry_seq <> 2 OR direction='bank')) WINDOW v AS (PARTITION BY batch_id, voucher_no)""",
          ("entries",))
def renumber(d: Data):
    return E.renumber(d.entries().where((c("voucher_no") % 3 != 0) & ((c("entry_seq") != 2) | (c("direction") == "bank"))))


@register("manual_patch", _SHORT,
          """SELECT batch_id, voucher_no, entry_seq, CASE WHEN hit AND entry_seq % 2 = 1 THEN 'patched' ELSE summary END AS summary,
          CASE WHEN hit THEN 'P1' ELSE subject_code END AS subject_code, debit_amount, credit_amount, direction,
          CASE WHEN hit THEN 'manual' ELSE match_source END AS match_source, hit AS is_manual
          FROM (SELECT *, voucher_no % 11 = 0 AND direction <> 'bank' AS hit FROM entries)""", ("entries",))
def manual_patch(d: Data):
    e = d.entries()
    patches = e.where((c("voucher_no") % 11 == 0) & (c("direction") != "bank")).select(
        "batch_id", "voucher_no", "entry_seq", F.lit("P1").alias("subject_code"), F.when(c("entry_seq") % 2 == 1, "patched").alias("summary"), F.lit(2).alias("turn"))
    # An earlier patch of the same entries; the later one takes effect where it has a value.
    earlier = patches.withColumns({"subject_code": F.lit("P0"), "turn": F.lit(1), "summary": F.when(c("entry_seq") % 2 == 1, "first")})
    return E.manual_patch(e, earlier.unionByName(patches), "turn")


_OPEN = "match_source='unmatched' AND direction<>'bank'"


@register("bulk_fill", _SHORT,
          f"""SELECT batch_id, voucher_no, entry_seq, summary, CASE WHEN {_OPEN} THEN '50602' ELSE subject_code END AS subject_code, debit_amount,
          credit_amount, direction, CASE WHEN {_OPEN} THEN 'manual' ELSE match_source END AS match_source, {_OPEN} AS is_manual FROM entries""", ("entries",))
def bulk_fill(d: Data):
    return E.bulk_fill(d.entries(), "50602", "管理费用")


@register("bulk_fill_counts", "batch_id:s filled:l", f"SELECT batch_id, count(*) FILTER (WHERE {_OPEN}) AS filled FROM entries GROUP BY batch_id", ("entries",))
def bulk_fill_counts(d: Data):
    return E.bulk_fill_counts(d.entries())


@register("move_entries", _KEYS + "summary:s direction:s debit_amount:f credit_amount:f",
          f"""SELECT batch_id, dense_rank() OVER (PARTITION BY batch_id ORDER BY voucher_no) AS voucher_no,
          row_number() OVER (PARTITION BY batch_id, voucher_no ORDER BY direction='bank', moved, origin, entry_seq) AS entry_seq,
          summary, direction, {_REBALANCED}
          FROM (SELECT p.* FROM (
             SELECT * REPLACE (CASE WHEN sel THEN 3 ELSE voucher_no END AS voucher_no), CASE WHEN sel THEN 1 ELSE 0 END AS moved,
                    CASE WHEN sel THEN voucher_no ELSE 0 END AS origin
             FROM (SELECT *, voucher_no % 5 = 0 AND entry_seq <= 2 AND direction<>'bank' AS sel FROM entries)) p
             SEMI JOIN (SELECT batch_id, CASE WHEN voucher_no % 5 = 0 AND entry_seq <= 2 THEN 3 ELSE voucher_no END AS voucher_no
                   FROM entries WHERE direction<>'bank') k USING (batch_id, voucher_no))
          WINDOW v AS (PARTITION BY batch_id, voucher_no)""", ("entries",))
def move_entries(d: Data):
    e = d.entries()
    selected = e.where((c("voucher_no") % 5 == 0) & (c("entry_seq") <= 2) & (c("direction") != "bank")).select("batch_id", "voucher_no", "entry_seq")
    targets = e.where("voucher_no = 3").select("batch_id", c("voucher_no").alias("target_no")).distinct()
    return E.move_entries(e, selected, targets)


_P1 = "cast(floor(original_amount * 25) / 100 as decimal(18,2))"


@register("split_entry", _KEYS + "summary:s subject_code:s direction:s debit_amount:f credit_amount:f",
          f"""SELECT batch_id, voucher_no, row_number() OVER (PARTITION BY batch_id, voucher_no ORDER BY direction='bank', entry_seq, part) AS entry_seq,
          summary, subject_code, direction, {_REBALANCED}
          FROM (SELECT batch_id, voucher_no, entry_seq, part, summary, CASE WHEN part=2 THEN 'S2' ELSE subject_code END AS subject_code, direction,
                CASE WHEN part > 0 AND debit_amount IS NOT NULL THEN amt ELSE debit_amount END AS debit_amount,
                CASE WHEN part > 0 AND credit_amount IS NOT NULL THEN amt ELSE credit_amount END AS credit_amount
                FROM (SELECT *, 0 AS part, NULL AS amt FROM entries WHERE NOT (voucher_no % 7 = 0 AND direction<>'bank')
                      UNION ALL SELECT *, 1, {_P1} FROM entries WHERE voucher_no % 7 = 0 AND direction<>'bank'
                      UNION ALL SELECT *, 2, original_amount - {_P1} FROM entries WHERE voucher_no % 7 = 0 AND direction<>'bank'))
          WHERE voucher_no % 7 = 0 WINDOW v AS (PARTITION BY batch_id, voucher_no)
          UNION ALL SELECT batch_id, voucher_no, entry_seq, summary, subject_code, direction, debit_amount, credit_amount FROM entries WHERE voucher_no % 7 <> 0""",
          ("entries",))
def split_entry(d: Data):
    return E.split_entries(d.entries(), _parts(d))


def _parts(d: Data):
    chosen = d.entries().where((c("voucher_no") % 7 == 0) & (c("direction") != "bank"))
    first = (F.floor(c("original_amount") * 25) / 100).cast("decimal(18,2)")
    return chosen.select("batch_id", "voucher_no", "entry_seq", "subject_code", first.alias("p1"),
                         (c("original_amount") - first).alias("p2")).select(
        "batch_id", "voucher_no", "entry_seq",
        F.explode(F.array(F.struct(F.lit(1).alias("part_no"), c("p1").alias("amount"), c("subject_code").alias("subject_code")),
                          F.struct(F.lit(2).alias("part_no"), c("p2").alias("amount"), F.lit("S2").alias("subject_code")))).alias("p")
    ).select("batch_id", "voucher_no", "entry_seq", "p.*")


@register("check_split", _KEYS + "parts:l total:f reason:s",
          f"""SELECT batch_id, voucher_no, entry_seq, 2 AS parts, original_amount + CASE WHEN entry_seq % 2 = 0 THEN 1 ELSE 0 END AS total,
          CASE WHEN entry_seq % 2 = 0 THEN 'parts exceed entry' END AS reason FROM entries WHERE voucher_no % 7 = 0 AND direction<>'bank'""", ("entries",))
def check_split(d: Data):
    raised = F.when((c("part_no") == 1) & (c("entry_seq") % 2 == 0), c("amount") + 1).otherwise(c("amount"))
    return E.check_split(d.entries(), _parts(d).withColumn("amount", raised))


@register("edited_or_original", _KEYS + "subject_code:s",
          """SELECT batch_id, voucher_no, entry_seq, CASE WHEN batch_id IN ('B1993','B1995') THEN 'E' ELSE subject_code END AS subject_code FROM entries""", ("entries",))
def edited_or_original(d: Data):
    e = d.entries()
    edited = e.where(c("batch_id").isin("B1993", "B1995")).withColumn("subject_code", F.lit("E"))
    return E.edited_or_original(edited, e)


@register("edit_transaction", "batch_id:s txn_seq:l amount:f description:s",
          """SELECT batch_id, txn_seq, CASE WHEN txn_seq % 10 = 0 THEN amount + 1 ELSE amount END AS amount,
          CASE WHEN txn_seq % 10 = 0 THEN 'edited' ELSE description END AS description FROM txn""", ("txn",))
def edit_transaction(d: Data):
    t = d.view("txn")
    edited = t.where("txn_seq % 10 = 0").withColumns({"amount": (c("amount") + 1).cast("decimal(18,2)"), "description": F.lit("edited")})
    return E.replace_rows(t, edited, ["batch_id", "txn_seq"])


@register("partial_update", "code:s name:s category:s aux_category:s",
          """SELECT code, CASE length(code) WHEN 2 THEN concat('x ', code) WHEN 3 THEN '' ELSE name END AS name, category,
          CASE WHEN length(code) = 4 THEN '' ELSE aux_category END AS aux_category FROM subjects""", ("subjects",))
def partial_update(d: Data):
    s = d.view("subjects").select("code", "name", "category", "aux_category")
    n = F.length("code")
    patches = s.where(n > 1).select(
        "code", F.when(n == 2, F.create_map(F.lit("name"), F.concat(F.lit("  x "), "code", F.lit(" "))))
        .when(n == 3, F.create_map(F.lit("name"), F.lit(None).cast("string")))
        .otherwise(F.create_map(F.lit("aux_category"), F.lit(""), F.lit("code"), F.lit("never"))).alias("patch"), F.lit(2).alias("turn"))
    earlier = patches.withColumns({"patch": F.transform_values("patch", lambda k, v: F.lit("earlier")), "turn": F.lit(1)})
    return E.partial_update(s, patches.unionByName(earlier), "code", ordinal="turn")


# --- stored tables -----------------------------------------------------------------------

@register("table_select", "txn_seq:l description:s amount:f",
          "SELECT txn_seq, description, amount FROM txn WHERE direction='income' AND amount > 1000 ORDER BY amount DESC, txn_seq LIMIT 50", ("txn",))
def table_select(d: Data):
    return ST.table_select(d.view("txn"), ["txn_seq", "description", "amount"], (c("direction") == "income") & (c("amount") > 1000),
                           [c("amount").desc(), c("txn_seq")], 50)


@register("limit_rows", "txn_seq:l txn_date:s", "SELECT txn_seq, txn_date FROM txn ORDER BY txn_date DESC, txn_seq LIMIT 25", ("txn",))
def limit_rows(d: Data):
    return ST.table_select(d.view("txn"), None, None, [c("txn_date").desc(), c("txn_seq")], 25)


@register("insert_or_ignore", "txn_seq:l description:s direction:s",
          """SELECT min(txn_seq) AS txn_seq, description, direction FROM txn WHERE (description, direction) NOT IN (SELECT (description, direction) FROM txn WHERE txn_seq % 3 = 0)
          GROUP BY description, direction""", ("txn",))
def insert_or_ignore(d: Data):
    t = d.view("txn").select("txn_seq", "description", "direction")
    return ST.insert_or_ignore(t.where("txn_seq % 3 = 0"), t, ["description", "direction"], "txn_seq")


@register("upsert", "c_custkey:l c_name:s c_acctbal:f",
          """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer
          UNION ALL SELECT c_custkey + 10000000, 'new', 0 FROM customer WHERE c_custkey % 3 = 0""")
def upsert(d: Data):
    old = d.table("customer").select("c_custkey", "c_name", "c_acctbal")
    new = old.where("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    new = new.unionByName(new.withColumn("c_custkey", c("c_custkey") + 10000000))
    again = new.withColumn("c_name", F.lit("replaced"))  # comes first and is replaced itself
    return ST.upsert(old, again.withColumn("ord", F.lit(0)).unionByName(new.withColumn("ord", F.lit(1))), ["c_custkey"], "ord")


@register("delete_rows", "txn_seq:l amount:f", "SELECT txn_seq, amount FROM txn WHERE txn_seq % 5 <> 0", ("txn",))
def delete_rows(d: Data):
    t = d.view("txn")
    return ST.delete_rows(t, t.where("txn_seq % 5 = 0"), ["txn_seq"])


@register("missing_keys", "txn_seq:l", "SELECT DISTINCT txn_seq + 1 AS txn_seq FROM txn WHERE txn_seq + 1 NOT IN (SELECT txn_seq FROM txn)", ("txn",))
def missing_keys(d: Data):
    t = d.view("txn")
    return ST.missing_keys(t, t.select((c("txn_seq") + 1).alias("txn_seq")), ["txn_seq"])


@register("draft_list", "id:s name:s updated_at:s entry_count:l",
          "SELECT d.id, d.name, d.updated_at, count(e.batch_id) AS entry_count FROM drafts d LEFT JOIN (SELECT batch_id FROM entries WHERE batch_id <> 'B1995') e ON e.batch_id = d.id GROUP BY ALL",
          ("drafts", "entries"))
def draft_list(d: Data):
    return ST.draft_list(d.view("drafts"), d.entries().where("batch_id <> 'B1995'").withColumnRenamed("batch_id", "draft_id"))


@register("drafts_recent", "id:s updated_at:s", "SELECT id, updated_at FROM drafts ORDER BY updated_at DESC, id", ("drafts",))
def drafts_recent(d: Data):
    return ST.table_select(d.view("drafts"), ["id", "updated_at"], order_by=[c("updated_at").desc(), c("id")])


@register("delete_cascade", "draft_id:s voucher_no:l entry_seq:l",
          "SELECT batch_id AS draft_id, voucher_no, entry_seq FROM entries WHERE batch_id NOT IN ('B1994','B1996') UNION ALL SELECT id, NULL, NULL FROM drafts WHERE id NOT IN ('B1994','B1996')",
          ("drafts", "entries"))
def delete_cascade(d: Data):
    heads, kids = ST.delete_cascade(d.view("drafts"), d.entries().withColumnRenamed("batch_id", "draft_id"),
                                    d.view("drafts").where(c("id").isin("B1994", "B1996")))
    none = F.lit(None).cast("bigint")
    return kids.select("draft_id", "voucher_no", "entry_seq").unionByName(
        heads.select(c("id").alias("draft_id"), none.alias("voucher_no"), none.alias("entry_seq")))


@register("sink_draft", "draft_id:s name:s status:s voucher_no:l entry_seq:l",
          "SELECT sha256(batch_id) AS draft_id, concat('draft ', batch_id) AS name, 'draft' AS status, voucher_no, entry_seq FROM entries", ("entries",))
def sink_draft(d: Data):
    heads, rows = ST.save_drafts(ST.check_entries(d.entries()), c("batch_id"), F.concat(F.lit("draft "), c("batch_id")), F.lit("2024-01-01"))
    path = work_path(d.spark, "draft")
    SK.write_partitioned(rows, f"{path}/entries", "draft_id")
    SK.append_rows(heads, f"{path}/heads")
    saved = d.spark.read.schema(rows.schema).parquet(f"{path}/entries")
    kept = d.spark.read.schema(heads.schema).parquet(f"{path}/heads").withColumnRenamed("id", "draft_id")
    return saved.join(kept, "draft_id")


@register("load_draft", "draft_id:s name:s voucher_no:l entry_seq:l subject_code:s",
          "SELECT batch_id AS draft_id, concat('draft ', batch_id) AS name, voucher_no, entry_seq, subject_code FROM entries WHERE batch_id = 'B1995'", ("entries",))
def load_draft(d: Data):
    return ST.load_draft(d.view("drafts"), d.entries().withColumnRenamed("batch_id", "draft_id"), "B1995")


@register("mark_exported", "id:s status:s updated_at:s",
          "SELECT id, CASE WHEN id >= 'B1995' THEN 'exported' ELSE status END AS status, CASE WHEN id >= 'B1995' THEN date '2030-01-01' ELSE updated_at END AS updated_at FROM drafts", ("drafts",))
def mark_exported(d: Data):
    return ST.mark_exported(d.view("drafts"), d.view("drafts").where("id >= 'B1995'"), F.lit("2030-01-01").cast("date"))


@register("learn_from_export", "summary_hash:s subject_code:s direction:s summary:s subject_name:s counterparty:s",
          f"""SELECT substring(sha256(summary),1,16) AS summary_hash, '50602' AS subject_code, direction, summary, '管理费用' AS subject_name,
          min_by(counterparty, (batch_id, voucher_no, entry_seq)) AS counterparty FROM entries
          WHERE {_OPEN} AND NOT EXISTS (SELECT 1 FROM history h WHERE h.description = summary AND h.direction = entries.direction AND h.hid % 2 = 0)
          GROUP BY summary, direction""", ("entries", "history"))
def learn_from_export(d: Data):
    filled = E.bulk_fill(d.entries(), "50602", "管理费用")
    known = d.view("history").where("hid % 2 = 0").select(
        summary_hash(c("description")).alias("summary_hash"), F.lit("50602").alias("subject_code"), "direction")
    return ST.learn(known, filled)


_STATS = """SELECT s.batch_id, voucher_count, entry_count, transaction_count,
 concat('{', string_agg(concat('"', src, '":', cast(n as varchar)), ',' ORDER BY src), '}') AS match_stats FROM (
 SELECT batch_id, match_source AS src, count(*) AS n FROM entries GROUP BY ALL) s JOIN (
 SELECT batch_id, count(DISTINCT voucher_no) AS voucher_count, count(*) AS entry_count, count(*) FILTER (WHERE direction<>'bank') AS transaction_count
 FROM entries GROUP BY batch_id) t ON s.batch_id = t.batch_id GROUP BY s.batch_id, voucher_count, entry_count, transaction_count"""
_LOGC = "batch_id:s voucher_count:l entry_count:l transaction_count:l match_stats:s"


@register("export_stats", _LOGC, _STATS, ("entries",))
def export_stats(d: Data):
    return ST.export_stats(d.entries())


_FILESQL = "SELECT DISTINCT batch_id, concat('m', lpad(cast(month(txn_date) as varchar),2,'0'), '.csv') AS file_name FROM txn"


def _source_files(d: Data):
    return d.view("txn").select("batch_id", F.concat(F.lit("m"), F.date_format("txn_date", "MM"), F.lit(".csv")).alias("file_name"))


@register("sink_export_log", _LOGC + " source_file_count:l draft_id:s",
          f"""SELECT x.*, source_file_count, sha256(x.batch_id) AS draft_id FROM ({_STATS}) x JOIN (
          SELECT batch_id, count(*) AS source_file_count FROM ({_FILESQL}) GROUP BY batch_id) y USING (batch_id)""",
          ("entries", "txn"))
def sink_export_log(d: Data):
    log = ST.export_log(d.entries(), _source_files(d), F.lit("2024-01-01T00:00:00"), F.concat(c("batch_id"), F.lit(".xlsx")))
    path = work_path(d.spark, "export_log")
    SK.append_rows(log, path)
    return d.spark.read.schema(log.schema).parquet(path)


@register("export_log_files", "batch_id:s file_name:s", _FILESQL, ("txn",))
def export_log_files(d: Data):
    return ST.export_log_files(_source_files(d))


@register("export_files_text", "batch_id:s source_files:s",
          f"""SELECT batch_id, concat('["', string_agg(file_name, '","' ORDER BY file_name), '"]') AS source_files FROM ({_FILESQL}) GROUP BY batch_id""", ("txn",))
def export_files_text(d: Data):
    return ST.files_text(ST.export_log_files(_source_files(d)))


@register("sink_voucher_25col", "batch_id:s sheet:s d1:s d2:s d3:l d4:l d5:l d7:s d9:f d10:f d11:s d15:s d23:f d24:s d25:f",
          """SELECT batch_id, concat('凭证列表#', substring(batch_id,2)) AS sheet, cast(date as varchar) AS d1, '记' AS d2, voucher_no AS d3, 0 AS d4, entry_seq AS d5,
          subject_code AS d7, debit_amount AS d9, credit_amount AS d10, NULL AS d11, nullif(aux_category,'') AS d15, original_amount AS d23, 'RMB' AS d24, 1.0 AS d25 FROM entries""",
          ("entries",))
def sink_voucher_25col(d: Data):
    from ..constants import EXPORT_COLUMNS

    out = SK.voucher_export(d.entries(), F.expr("substring(batch_id, 2)"))
    path = work_path(d.spark, "export")
    SK.write_partitioned(out, path, "batch_id")
    back = d.spark.read.schema(out.schema).parquet(path)
    return back.select("batch_id", "sheet", *(back[n].alias(f"d{i}") for i, n in enumerate(EXPORT_COLUMNS, 1)))


@register("own_export_columns", "batch_id:s sheet:s d2:s d3:f d10:f d25:l",
          """SELECT batch_id, '凭证列表' AS sheet, upper(subject_code) AS d2, coalesce(debit_amount, 0) - coalesce(credit_amount, 0) AS d3, NULL AS d10, voucher_no AS d25 FROM entries""",
          ("entries",))
def own_export_columns(d: Data):
    from ..constants import EXPORT_COLUMNS

    zero = F.lit(0)
    own = {2: F.upper("subject_code"), 3: F.coalesce("debit_amount", zero) - F.coalesce("credit_amount", zero), 25: c("voucher_no")}
    out = SK.voucher_export(d.entries(), columns=own)
    return out.select("batch_id", "sheet", *(out[EXPORT_COLUMNS[i - 1]].alias(f"d{i}") for i in (2, 3, 10, 25)))


@register("sink_txn_detail", "batch_id:s txn_seq:l d1:s d2:s d3:f d4:s d5:s d6:s d7:s d8:s d9:s",
          """SELECT batch_id, txn_seq, cast(txn_date as varchar) AS d1, description AS d2, amount AS d3, currency AS d4, direction AS d5, counterparty AS d6,
          reference_number AS d7, account_number AS d8, NULL AS d9 FROM txn""", ("txn",))
def sink_txn_detail(d: Data):
    from ..constants import DETAIL_COLUMNS

    out = SK.detail_export(d.view("txn").withColumn("account_name", F.lit(None).cast("string")))
    path = work_path(d.spark, "detail")
    SK.write_partitioned(out, path, "batch_id")
    back = d.spark.read.schema(out.schema).parquet(path)
    return back.select("batch_id", "txn_seq", *(back[n].alias(f"d{i}") for i, n in enumerate(DETAIL_COLUMNS, 1)))


@register("strict_schema", _KEYS + "subject_code:s is_manual:b", "SELECT batch_id, voucher_no, entry_seq, subject_code, is_manual FROM entries", ("entries",))
def strict_schema(d: Data):
    from ..operators.vouchers import ENTRY_COLUMNS

    stored = d.entries().withColumn("is_manual", c("is_manual").cast("int"))
    return ST.require_columns(stored, ENTRY_COLUMNS).withColumn("is_manual", c("is_manual").cast("boolean"))


@register("schema_evolve", "code:s aux_category:s rule_id:s aux_category_name:s",
          """SELECT code, aux_category, '' AS rule_id, CASE WHEN length(code) % 2 = 0 THEN concat('filled ', code) ELSE aux_category_name END AS aux_category_name
          FROM (SELECT * REPLACE (CASE WHEN length(code) % 2 = 0 THEN '' ELSE aux_category_name END AS aux_category_name) FROM subjects)""", ("subjects",))
def schema_evolve(d: Data):
    even = F.length("code") % 2 == 0
    old = d.view("subjects").select("code", "aux_category", F.when(~even, c("aux_category_name")).alias("aux_category_name"))
    grown = ST.evolve_schema(old, {"rule_id": F.lit(""), "aux_category_name": F.lit("")})
    source = d.view("subjects").where(even).select("code", F.concat(F.lit("filled "), "code").alias("aux_category_name"))
    return ST.fill_blank(grown, source, "code", "aux_category_name")


@register("own_code_check", "id:s reason:s",
          """SELECT cast(s_suppkey as varchar) AS id, CASE WHEN s_nationkey % 5 = 0 THEN 'bank code required'
          WHEN cast(s_suppkey * 3 as varchar) NOT IN (SELECT code FROM subjects) THEN 'unknown subject' END AS reason FROM supplier""", ("subjects",))
def own_code_check(d: Data):
    from ..operators.accounts import check_accounts

    new = d.table("supplier").select(
        c("s_suppkey").cast("string").alias("id"), F.when(c("s_nationkey") % 5 == 0, "").otherwise("CMB").alias("bank_code"),
        (c("s_suppkey") * 3).cast("string").alias("subject_code"))
    return check_accounts(new, d.view("subjects"))


# --- roll-ups and orders -----------------------------------------------------------------

@register("txn_summary", "batch_id:s total:l income_count:l expense_count:l income_total:f expense_total:f",
          """SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE direction='income') AS income_count, count(*) FILTER (WHERE direction='expense') AS expense_count,
          coalesce(sum(amount) FILTER (WHERE direction='income'),0) AS income_total, coalesce(sum(amount) FILTER (WHERE direction='expense'),0) AS expense_total
          FROM txn GROUP BY batch_id""", ("txn",))
def txn_summary(d: Data):
    return SM.txn_summary(d.view("txn"))


def _file_status(d: Data):
    rows = d.view("stmt_rows").groupBy("file_id").agg(F.count(F.lit(1)).alias("transactions"))
    n = F.expr("substring(file_id, 2)").cast("bigint")
    return rows.select("file_id", n.alias("file_ord"), F.when(n % 4 == 0, "failed").otherwise("success").alias("status"), "transactions",
                       F.concat(c("file_id"), F.lit(".csv")).alias("file_name"), F.concat(F.lit("set"), (n % 3).cast("string")).alias("batch"))


_FS = """(SELECT file_id, cast(substring(file_id,2) as bigint) AS file_ord, CASE WHEN cast(substring(file_id,2) as bigint) % 4 = 0 THEN 'failed' ELSE 'success' END AS status,
 count(*) AS transactions, concat(file_id,'.csv') AS file_name, concat('set', cast(cast(substring(file_id,2) as bigint) % 3 as varchar)) AS batch FROM stmt_rows GROUP BY file_id)"""


@register("batch_summary", "batch:s total_files:l success:l failed:l transactions:l",
          f"""SELECT batch, count(*) AS total_files, count(*) FILTER (WHERE status='success') AS success, count(*) FILTER (WHERE status='failed') AS failed,
          coalesce(sum(transactions) FILTER (WHERE status='success'),0) AS transactions FROM {_FS} GROUP BY batch""", ("stmt_rows",))
def batch_summary(d: Data):
    return SM.batch_summary(_file_status(d), ["batch"])


@register("files_display_order", "file_name:s status:s", f"SELECT file_name, status FROM {_FS} ORDER BY status='failed', file_name", ("stmt_rows",))
def files_display_order(d: Data):
    return SM.files_display_order(_file_status(d))


@register("union_files", "file_ord:l row_no:l amount:f", f"SELECT file_ord, row_no, amount FROM stmt_rows JOIN {_FS} f USING (file_id) WHERE status='success'", ("stmt_rows",))
def union_files(d: Data):
    return X.union_successful(d.view("stmt_rows"), _file_status(d))


@register("distinct_categories", "category:s first_ord:l", "SELECT category, min(ord) AS first_ord FROM subjects WHERE category <> '' GROUP BY category", ("subjects",))
def distinct_categories(d: Data):
    return SM.distinct_categories(d.view("subjects"))


@register("period_label", "batch_id:s period:s",
          "SELECT batch_id, concat(cast(year(min(txn_date)) as varchar),'年',lpad(cast(month(min(txn_date)) as varchar),2,'0'),'月') AS period FROM txn GROUP BY batch_id", ("txn",))
def period_label(d: Data):
    return SM.period_label(d.view("txn"))


@register("sort_txn_date", "batch_id:s txn_seq:l position:l",
          "SELECT batch_id, txn_seq, row_number() OVER (PARTITION BY batch_id ORDER BY txn_date, txn_seq) AS position FROM txn", ("txn",))
def sort_txn_date(d: Data):
    return SM.date_position(d.view("txn"))


@register("sort_amount_abs", "txn_seq:l amount:f", "SELECT txn_seq, amount FROM txn ORDER BY abs(amount), txn_seq", ("txn",))
def sort_amount_abs(d: Data):
    return SM.sort_by_amount(d.view("txn"))


@register("page_rows", "batch_id:s display_no:l txn_seq:l",
          "SELECT batch_id, display_no, txn_seq FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY txn_seq) AS display_no FROM txn) WHERE display_no BETWEEN 41 AND 60", ("txn",))
def page_rows(d: Data):
    return SM.page_rows(d.view("txn"), 3, 20)


@register("direction_filter", "txn_seq:l direction:s", "SELECT txn_seq, direction FROM txn WHERE direction IN ('income')", ("txn",))
def direction_filter(d: Data):
    return d.view("txn").where(c("direction").isin("income"))


_STMT_STATUS = """CASE WHEN regexp_matches(trim(d_iso),'^\\d{4}-\\d{2}-\\d{2}$') AND try_strptime(trim(d_iso),'%Y-%m-%d') IS NULL THEN 'error'
 WHEN try_strptime(trim(d_iso),'%Y-%m-%d') IS NULL OR NOT regexp_matches(trim(d_iso),'^\\d{4}-\\d{2}-\\d{2}$') OR flag NOT IN ('借','贷') THEN 'skip' ELSE 'ok' END"""


def _statement(d: Data):
    from ..functions.amounts import amount_strict
    from ..operators.normalize import flagged_debit_credit

    rows = d.view("stmt_rows").select(
        "file_id", "row_no", c("d_iso").alias("value_date"), "flag", c("out_text").alias("debit"), c("in_text").alias("credit"), "summary", "remark",
        "counterparty", c("reference_number").alias("ref_account"), c("account_number").alias("own_account"), c("balance_text").alias("balance"))
    parsed = flagged_debit_credit(rows.withColumn("shown", amount_strict(c("balance"))), ["file_id", "row_no", "shown"])
    return parsed.withColumnRenamed("shown", "balance")


@register("statement_summary", "file_id:s opening_balance:f closing_balance:f statement_date:s transactions:l error_count:l confidence:f",
          f"""SELECT file_id, first(bal ORDER BY row_no) AS opening_balance, last(bal ORDER BY row_no) AS closing_balance,
          max(CASE WHEN status='ok' THEN txn_date END) AS statement_date, count(*) FILTER (WHERE status='ok') AS transactions, count(*) FILTER (WHERE status='error') AS error_count,
          round(greatest(0.0, 1.0 - 0.01 * count(*) FILTER (WHERE status='error')), 4) AS confidence
          FROM (SELECT *, {_STMT_STATUS} AS status, cast(nullif(replace(balance_text,',',''),'') as decimal(18,2)) AS bal FROM stmt_rows) GROUP BY file_id""",
          ("stmt_rows",))
def statement_summary(d: Data):
    return SM.statement_summary(_statement(d))


@register("statement_errors", "file_id:s row_no:l error:s",
          f"SELECT file_id, row_no, concat('Row ', cast(row_no as varchar), ': invalid date') AS error FROM stmt_rows WHERE {_STMT_STATUS} = 'error'", ("stmt_rows",))
def statement_errors(d: Data):
    return SM.statement_errors(_statement(d))


# --- subjects, routing -------------------------------------------------------------------

@register("prefix_hierarchy", "code:s parent:s full_name:s",
          """SELECT a.code, max_by(CASE WHEN b.code <> a.code THEN b.code END, CASE WHEN b.code <> a.code THEN length(b.code) END) AS parent,
          string_agg(b.name, '_' ORDER BY length(b.code)) AS full_name FROM subjects a JOIN subjects b ON starts_with(a.code, b.code) GROUP BY a.code""", ("subjects",))
def prefix_hierarchy(d: Data):
    return SU.hierarchy(d.view("subjects"))


@register("subject_search", "code:s", "SELECT code FROM subjects WHERE enabled AND category = 'C3' AND (contains(lower(code),'l_1') OR contains(lower(name),'l_1') OR contains(lower(full_name),'l_1'))", ("subjects",))
def subject_search(d: Data):
    return SU.search_subjects(d.view("subjects"), "L_1", "C3")


@register("load_subjects", "code:s name:s category:s direction:s aux_category:s is_cash:b enabled:b",
          """SELECT code, last(name ORDER BY ord) AS name, last(category ORDER BY ord) AS category, last(direction ORDER BY ord) AS direction, last(aux ORDER BY ord) AS aux_category,
          last(cash ORDER BY ord) AS is_cash, last(enabled ORDER BY ord) AS enabled FROM (
          SELECT p_partkey AS ord, cast(p_partkey % 700 as varchar) AS code, p_name AS name, p_brand AS category, CASE WHEN p_size % 3 = 0 THEN '借' ELSE '贷' END AS direction,
          CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type END AS aux, p_size % 2 = 0 AS cash, p_size % 5 <> 0 AS enabled FROM part WHERE p_partkey % 11 <> 0) GROUP BY code""")
def load_subjects(d: Data):
    p = c("p_size")
    rows = d.table("part").select(
        c("p_partkey").alias("ord"), F.when(c("p_partkey") % 11 == 0, "").otherwise(F.concat(F.lit(" "), (c("p_partkey") % 700).cast("string"))).alias("c0"),
        F.concat("p_name", F.lit(" ")).alias("c1"), c("p_brand").alias("c2"), F.when(p % 3 != 0, "贷").alias("c3"),
        F.when(p % 4 != 0, c("p_type")).alias("c4"), F.when(p % 2 == 0, "是").otherwise("否").alias("c5"), F.when(p % 5 == 0, "停用").alias("c6"))
    return SU.load_subjects(rows)


_DOC = """(SELECT doc_id, text, CASE doc_id % 6 WHEN 0 THEN concat(text,'账务 明细清单 借方/ 贷方金额') WHEN 1 THEN concat('出 账 回 单', text) WHEN 2 THEN concat(text,'交易日期 交易类型 本期支出')
 WHEN 3 THEN concat(text,' Date Currency Counter Party') WHEN 4 THEN concat(text,'账务明细清单') ELSE text END AS body FROM documents)"""
_CLASS = """CASE WHEN contains(z,'账务明细清单') AND contains(z,'借方/贷方金额') THEN {0} WHEN contains(z,'Date') AND contains(z,'Currency') AND contains(z,'CounterParty') THEN {0}
 WHEN contains(z,'出账回单') OR contains(z,'入账回单') THEN {1} WHEN contains(z,'交易日期') AND contains(z,'交易类型') AND contains(z,'本期支出') THEN {2} ELSE {3} END"""
_ZED = r"(SELECT *, regexp_replace(body, '\s+', '', 'g') AS z FROM " + _DOC + ")"


def _documents(d: Data):
    m, t = c("doc_id") % 6, c("text")
    body = (F.when(m == 0, F.concat(t, F.lit("账务 明细清单 借方/ 贷方金额"))).when(m == 1, F.concat(F.lit("出 账 回 单"), t))
            .when(m == 2, F.concat(t, F.lit("交易日期 交易类型 本期支出"))).when(m == 3, F.concat(t, F.lit(" Date Currency Counter Party")))
            .when(m == 4, F.concat(t, F.lit("账务明细清单"))).otherwise(t))
    return d.table("documents").select("doc_id", body.alias("text"))


@register("classify_document", "doc_id:l bank_code:s doc_type:s",
          "SELECT doc_id, " + _CLASS.format("'CMB'", "'CMB'", "'GFB'", "'未知银行'") + " AS bank_code, " + _CLASS.format("'流水'", "'回单'", "'流水'", "'流水'") + f" AS doc_type FROM {_ZED}")
def classify_document(d: Data):
    return _documents(d).select("doc_id", X.document_class(c("text")).alias("k")).select("doc_id", "k.*")


@register("subtype_by_title", "doc_id:l subtype:s", f"SELECT doc_id, CASE WHEN contains(body,'账务明细清单') OR regexp_matches(body,'Statement Of Account|Statement of Account|STATEMENT OF ACCOUNT') THEN 'table' ELSE 'column' END AS subtype FROM {_DOC}")
def subtype_by_title(d: Data):
    return _documents(d).select("doc_id", X.statement_subtype(c("text")).alias("subtype"))


def _routed(d: Data):
    m = c("doc_id") % 5
    ext = F.when(m == 0, "csv").when(m == 1, "XLSX").when(m == 4, "txt").otherwise("pdf")
    files = _documents(d).select(F.concat(F.lit("/in/"), c("doc_id").cast("string"), F.lit("."), ext).alias("path"), "text",
                                 (c("doc_id") % 17 != 0).alias("readable"), "doc_id")
    n = c("doc_id")
    over = files.where(n % 7 == 0).select("path", F.when(n % 3 == 0, "招商银行").when(n % 3 == 1, "").otherwise("ICBC").alias("bank"),
                                          F.when(n % 2 == 0, "回单").otherwise("").alias("doc_type"))
    return X.route_files(files, over)


_ROUTE = f"""(SELECT doc_id, path, CASE WHEN ext='pdf' AND ob IS NOT NULL THEN ob WHEN ext='pdf' AND ot IS NOT NULL THEN '未知银行' ELSE db END AS bank_code,
 CASE WHEN ext='pdf' AND ot IS NOT NULL THEN ot WHEN ext='pdf' AND ob IS NOT NULL THEN '流水' ELSE dt END AS doc_type, ext, readable FROM (
 SELECT doc_id, ext, concat('/in/', cast(doc_id as varchar), '.', CASE ext WHEN 'xlsx' THEN 'XLSX' ELSE ext END) AS path, doc_id % 17 <> 0 AS readable,
 CASE WHEN doc_id % 7 = 0 THEN CASE doc_id % 3 WHEN 0 THEN 'CMB' WHEN 1 THEN NULL ELSE 'ICBC' END END AS ob,
 CASE WHEN doc_id % 7 = 0 AND doc_id % 2 = 0 THEN '回单' END AS ot,
 CASE ext WHEN 'csv' THEN 'ICBC' WHEN 'xlsx' THEN 'CMB' WHEN 'pdf' THEN CASE WHEN doc_id % 17 = 0 THEN '未知银行' ELSE {_CLASS.format("'CMB'", "'CMB'", "'GFB'", "'未知银行'")} END ELSE '未知银行' END AS db,
 CASE WHEN ext IN ('csv','xlsx') THEN '流水' ELSE {_CLASS.format("'流水'", "'回单'", "'流水'", "'流水'")} END AS dt
 FROM (SELECT *, CASE doc_id % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'xlsx' WHEN 4 THEN 'txt' ELSE 'pdf' END AS ext FROM {_ZED})))"""
_VERDICT = "CASE WHEN NOT readable OR ext='txt' THEN 'failed' WHEN bank_code NOT IN ('ICBC','CMB','GFB') THEN 'rejected' ELSE 'routed' END"


@register("route_by_extension", "path:s bank_code:s bank:s doc_type:s status:s",
          f"SELECT path, bank_code, CASE bank_code WHEN 'ICBC' THEN '工商银行' WHEN 'CMB' THEN '招商银行' WHEN 'GFB' THEN '广发银行' ELSE bank_code END AS bank, doc_type, {_VERDICT} AS status FROM {_ROUTE}")
def route_by_extension(d: Data):
    return _routed(d)


@register("extractor_candidates", "path:s cand_ord:l extractor:s",
          f"""SELECT path, row_number() OVER (PARTITION BY path ORDER BY o) - 1 AS cand_ord, extractor FROM (
          SELECT * FROM {_ROUTE} r JOIN (VALUES ('ICBC',0,'grid_receipt'),('ICBC',1,'grid_statement'),('CMB',0,'text_receipt'),('CMB',1,'statement'),('GFB',0,'table_statement')) x(bank_code,o,extractor)
          USING (bank_code) WHERE {_VERDICT}='routed' AND NOT (bank_code='ICBC' AND doc_type='流水' AND extractor='grid_receipt'))""")
def extractor_candidates(d: Data):
    return X.extractor_candidates(_routed(d))


@register("first_nonempty_parser", "file_id:s cand_ord:l row_no:l",
          """SELECT file_id, cand_ord, row_no FROM (SELECT *, min(cand_ord) OVER (PARTITION BY file_id) AS best FROM (
          SELECT file_id, 0 AS cand_ord, row_no FROM stmt_rows WHERE cast(substring(file_id,2) as bigint) % 3 = 0
          UNION ALL SELECT file_id, 1, row_no FROM stmt_rows WHERE row_no % 2 = 0 UNION ALL SELECT file_id, 2, row_no FROM stmt_rows)) WHERE cand_ord = best""", ("stmt_rows",))
def first_nonempty_parser(d: Data):
    r = d.view("stmt_rows").select("file_id", "row_no")
    tries = [r.where(F.expr("substring(file_id, 2)").cast("bigint") % 3 == 0), r.where("row_no % 2 = 0"), r]
    union = None
    for i, t in enumerate(tries):
        t = t.withColumn("cand_ord", F.lit(i))
        union = t if union is None else union.unionByName(t)
    return X.first_nonempty(union)


@register("own_extractors", "file_id:s cand_ord:l line:s",
          """SELECT file_id, cand_ord, line FROM (SELECT *, min(cand_ord) OVER (PARTITION BY file_id) AS best FROM (
          SELECT file_id, cast(substring(file_id,2) as bigint) % 2 AS cand_ord, concat('out ', out_text) AS line FROM stmt_rows WHERE row_no % 2 = 0 AND row_no % 3 = 0
          UNION ALL SELECT file_id, 1 - cast(substring(file_id,2) as bigint) % 2, concat('all ', summary) FROM stmt_rows WHERE row_no % 5 > 0)) WHERE cand_ord = best""", ("stmt_rows",))
def own_extractors(d: Data):
    rows = d.view("stmt_rows").select("file_id", "row_no", "out_text", "summary")
    odd = F.expr("substring(file_id, 2)").cast("bigint") % 2
    tries = rows.select("file_id").distinct().select(
        "file_id", F.posexplode(F.when(odd == 0, F.array(F.lit("out"), F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("out")))).alias("cand_ord", "extractor"))
    return X.run_extractors(rows, tries, {
        "out": lambda df: df.where("row_no % 2 = 0 AND row_no % 3 = 0").select("file_id", F.concat(F.lit("out "), "out_text").alias("line")),
        "all": lambda df: df.where("row_no % 5 > 0").select("file_id", F.concat(F.lit("all "), "summary").alias("line")),
    })


@register("batch_ready", "doc_id:l status:s reason:s",
          """SELECT doc_id, CASE WHEN doc_id % 4 IN (0,1) OR doc_id % 3 = 0 THEN 'failed' ELSE 'ready' END AS status,
          CASE WHEN doc_id % 4 IN (0,1) THEN 'bank not set' WHEN doc_id % 3 = 0 THEN 'type not set' END AS reason FROM documents""")
def batch_ready(d: Data):
    n = c("doc_id")
    return X.ready_status(d.table("documents").select(
        "doc_id", F.when(n % 4 == 0, "UNKNOWN").when(n % 4 == 1, "未知").otherwise("招商银行").alias("bank"), F.when(n % 3 != 0, "流水").alias("doc_type")))


@register("file_listing_dedup", "batch_id:s path:s file_name:s place:l accepted:b",
          r"""SELECT batch_id, path, file_name, place, place <= 10 AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY ord) AS place FROM (
          SELECT concat('u', cast(user_id % 50 as varchar)) AS batch_id, concat('C:\in\', event_type, '/', cast(event_id % 97 as varchar), '.pdf') AS path,
          concat(cast(event_id % 97 as varchar), '.pdf') AS file_name, min(event_id) AS ord FROM events WHERE event_id % 97 <> 5 GROUP BY ALL))""")
def file_listing_dedup(d: Data):
    e = d.table("events").select(
        F.concat(F.lit("u"), (c("user_id") % 50).cast("string")).alias("batch_id"), c("event_id").alias("ord"),
        F.concat(F.lit("C:\\in\\"), "event_type", F.lit("/"), (c("event_id") % 97).cast("string"), F.lit(".pdf")).alias("path"))
    present = e.where("ord % 97 = 5")
    return X.list_files(e, present, cap=10)


@register("detect_account_in_text", "row_no:l account:s bank_code:s doc_type:s",
          """SELECT row_no, coalesce(o.account_number, '6222080000000014') AS account, coalesce(o.bank_code, 'ICBC') AS bank_code,
          CASE WHEN row_no % 2 = 0 THEN '回单' ELSE '流水' END AS doc_type
          FROM stmt_rows s LEFT JOIN own_account o ON o.account_number = s.account_number WHERE o.account_number IS NOT NULL OR row_no % 3 <> 0""", ("stmt_rows", "own_account"))
def detect_account_in_text(d: Data):
    from ..operators.accounts import detect_account_in_text as op

    texts = d.view("stmt_rows").select("row_no", F.concat(
        F.when(c("row_no") % 2 == 0, "回单编号 11").otherwise("no 99999999999999 "), F.lit(" acct "), "account_number",
        F.when(c("row_no") % 3 == 0, "").otherwise(" then 6222080000000014")).alias("text"))
    return op(texts, d.view("accounts"), key="row_no")
