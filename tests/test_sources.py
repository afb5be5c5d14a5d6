from __future__ import annotations

import json
import os
from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from tallyweave.catalog.pages import _damaged_copy
from tallyweave.constants import CMB_HEADER_KEYS
from tallyweave.operators import accounts as A
from tallyweave.operators import layout as L
from tallyweave.operators import normalize as N
from tallyweave.operators.classify import load_rules
from tallyweave.operators.filters import run_extractors
from tallyweave.session import work_path
from tallyweave.sources.csv_statement import edge_balances, number_rows, scan_csv_statement
from tallyweave.functions.amounts import amount_strict
from tallyweave.sources.sinks import voucher_export
from tallyweave.streaming.ingest import SOURCE, failed_files, ingest, parquet_rows, retry_failed


def _csv(tmp_path, name, lines):
    path = tmp_path / name
    path.write_bytes("\r\n".join(["[HISTORYDETAIL]", "凭证号,本方账号,对方账号,交易时间,起息日,借/贷,借方发生额,贷方发生额,对方行号,摘要,附言,用途,对方单位名称,余额", *lines, ""]).encode("gbk"))
    return str(path)


GOOD = ['1\t,622208,9988,x,2026-03-26,借,"1,799.00",,b,"货款, 一",备注\t一,u,启胜物业,"10,000.00"', "2,622208,,x,2026-03-25,贷,,5.50,b,,,u,,0.00", "3,622208,,x,2026-02-31,借,1,,b,x,,u,y,7"]


def test_csv_statement(spark, tmp_path):
    scanned = scan_csv_statement(spark, _csv(tmp_path, "a.csv", GOOD))
    rows = number_rows(scanned)
    out = N.flagged_debit_credit(rows, ["file_id", "row_no"]).orderBy("row_no").collect()
    assert [r.status for r in out] == ["ok", "ok", "error"]
    a, b = out[:2]
    assert (a.txn_date, a.amount, a.direction, a.counterparty) == (date(2026, 3, 26), D("1799.00"), "expense", "启胜物业")
    assert (a.description, a.notes, a.reference_number) == ("货款, 一 | 附言:备注一", "余额:10000.00", "9988")
    assert (b.description, b.notes, b.direction, b.counterparty) == ("银行交易", None, "income", None)
    edges = edge_balances(scanned, amount_strict(F.col("balance"))).first()
    assert (edges.opening_balance, edges.closing_balance) == (D("10000.00"), D("7.00"))


def test_split_file_keeps_row_order(spark, tmp_path):
    path = _csv(tmp_path, "big.csv", [f"{i},a,b,x,2026-01-02,借,{i}.00,,b,摘要{i},,u,对方,1" for i in range(3000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        scanned = scan_csv_statement(spark, path)
        assert scanned.rdd.getNumPartitions() > 2
        rows = number_rows(scanned).orderBy("row_no").select("row_no", "voucher").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.row_no, r.voucher) for r in rows] == [(i + 1, str(i)) for i in range(3000)]


def test_folders_of_statements(spark, tmp_path):
    """Statements in folders of folders are found by few listing tasks, and the session's setting stays."""
    for i in range(40):
        (tmp_path / f"a{i % 4}" / f"file_id=F{i}").mkdir(parents=True)
        _csv(tmp_path / f"a{i % 4}" / f"file_id=F{i}", "s.csv", GOOD[:2])
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    got = number_rows(scan_csv_statement(spark, str(tmp_path))).groupBy("file_id").agg(F.max("row_no")).collect()
    assert len(got) == 40 and {r[1] for r in got} == {2}
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before


def test_stream_isolates_and_retries(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    _csv(src, "good.csv", GOOD[:2])
    _csv(src, "bad.csv", ["1,a,b,x,26/03/2026,借,1,,b,s,,u,y,7"])
    schema = scan_csv_statement(spark, str(src)).drop("file_id", "file_pos", "file_row").schema
    out = work_path(spark, "test")

    def start():
        stream = spark.readStream.schema(schema).option("encoding", "GBK").csv(str(src)).where(
            ~F.coalesce("voucher", F.lit("")).isin("[HISTORYDETAIL]", "凭证号")).withColumn("file_id", F.col("_metadata.file_name"))
        ingest(stream, lambda df: N.flagged_debit_credit(df, ["file_id", "voucher"]), out, f"{out}/cp", once=True).awaitTermination()

    start()
    start()  # nothing new: every path is taken once
    done = spark.read.parquet(f"{out}/transactions")
    assert done.groupBy("file_id").count().collect() == [("good.csv", 2)]
    assert [r.file_id for r in failed_files(spark, out).collect()] == ["bad.csv"]
    raw = scan_csv_statement(spark, str(src)).withColumn("file_id", F.regexp_extract("file_id", "([^/]+)$", 1))
    fixed = raw.withColumn("value_date", F.regexp_replace("value_date", r"^(\d+)/(\d+)/(\d+)$", "$3-$2-$1"))
    retry_failed(spark, fixed, lambda df: N.flagged_debit_credit(df, ["file_id", "voucher"]), out, 1)
    assert failed_files(spark, out).count() == 0
    assert spark.read.parquet(f"{out}/transactions").where("file_id = 'bad.csv'").count() == 1


def test_file_damaged_in_the_middle(spark, tmp_path):
    """Its first rows are read, but it is no success; a retry takes it whole, and only from a whole copy."""
    rows = spark.range(3000).selectExpr("id AS voucher", "'ok' AS status", "repeat(md5(cast(id AS string)), 4) AS text").repartition(1)
    rows.write.option("parquet.block.size", 4096).parquet(str(tmp_path / "whole"))
    src = tmp_path / "in"
    _damaged_copy(spark, str(tmp_path / "whole"), str(src))
    spark.range(5).selectExpr("id AS voucher", "'ok' AS status", "'' AS text").coalesce(1).write.mode("append").parquet(str(src))
    name = next((tmp_path / "whole").glob("*.parquet")).name
    out = work_path(spark, "test")
    named = lambda reader, at: reader.schema(rows.schema).options(**SOURCE).parquet(str(at)).select("*", F.col("_metadata.file_name").alias("file_id"))
    part = named(spark.read, src).where(F.col("file_id") == name).agg(F.count("text")).first()[0]
    assert 0 < part < 3000
    before = set(os.listdir(os.path.dirname(out))) if os.path.isdir(os.path.dirname(out)) else set()
    ingest(named(spark.readStream, src), lambda df: df, out, f"{out}/cp", once=True, held=lambda: parquet_rows(spark, str(src))).awaitTermination()
    assert set(os.listdir(os.path.dirname(out))) - before <= {os.path.basename(out)}  # nothing of the batch is left
    assert [r.file_id for r in failed_files(spark, out).collect()] == [name]
    assert sorted(r["count"] for r in spark.read.parquet(f"{out}/files").groupBy("status").count().collect()) == [1, 1]
    assert spark.read.parquet(f"{out}/transactions").count() == 5 and spark.read.parquet(f"{out}/partial").count() == part
    retry_failed(spark, named(spark.read, src), lambda df: df, out, 1, held=lambda: parquet_rows(spark, str(src)))
    assert [r.file_id for r in failed_files(spark, out).collect()] == [name]
    retry_failed(spark, named(spark.read, tmp_path / "whole"), lambda df: df, out, 2, held=lambda: parquet_rows(spark, str(tmp_path / "whole")))
    assert failed_files(spark, out).count() == 0
    assert spark.read.parquet(f"{out}/transactions").count() == spark.read.parquet(f"{out}/transactions").select("voucher", "file_id").distinct().count() == 3005


def test_config_files(spark, tmp_path):
    rules = tmp_path / "rules.json"
    rules.write_text(json.dumps({"income": {"rules": [{"id": "x", "match": {"keywords": ["款"]}, "subject_code": "1"}]}}, ensure_ascii=False))
    assert [r.rule_id for r in load_rules(spark, str(rules))] == ["x"]
    doc = {"accounts": [{"id": "1", "pattern": "99", "subjectCode": "s"}, {"id": "1", "pattern": "00"}, {"id": "2", "matchType": "exact", "pattern": "5", "bankCode": "B"}]}
    found = A.load_accounts(spark, doc).orderBy("ord").collect()
    assert [(r.id, r.match_type, r.pattern) for r in found] == [("1", "suffix", "99"), ("2", "exact", "5")]


def test_accounts_masked_empty_and_large(spark):
    table = [A.Account(1, "s", "suffix", "", "", "ANY", "s0"), A.Account(2, "e", "exact", "77", "", "E", "s1")]
    nums = spark.createDataFrame([("77",), ("1",), (None,)], "account_number string")
    frame = spark.createDataFrame([(a.ord, a.id, a.match_type, a.pattern, a.bank, a.bank_code, a.subject_code, a.subject_name) for a in table], A.ACCOUNT_SCHEMA)
    for got in (A.match_accounts(nums, table), A.join_accounts(nums, frame, "account_number", "own")):
        assert {r.account_number: r.own.id for r in got.collect()} == {"77": "e", "1": "s", None: "s"}
    parties = spark.createDataFrame([("7**7", "77", "a", "b"), ("", "", "a", ""), ("77", "8", "a", "b")], "payer_account string, payee_account string, payer_name string, payee_name string")
    out = A.infer_direction(parties, [table[1]]).collect()
    assert [(r.direction, r.own_account, r.other_party) for r in out] == [("income", "77", "a"), ("expense", None, "a"), ("expense", "77", "b（8）")]


SPAN = "page_id bigint, span_id bigint, x0 double, y0 double, x1 double, y1 double, text string, size double"


def _spans(spark, rows):
    return spark.createDataFrame([(1, i, float(x), float(y), x + 5.0, y + 5.0, t, 9.0) for i, (x, y, t) in enumerate(rows)], SPAN)


def test_key_values_alternate(spark):
    s = _spans(spark, [(1, 1, "账号："), (2, 1, "户名："), (3, 1, "张三"), (1, 5, "币 别:"), (2, 5, "CNY"), (1, 9, "户名: 李四"), (2, 9, "other：x")])
    got = {r.field: r.value for r in L.key_values(s, {"账号": "account_no", "户名": "account_name", "币别": "currency"}).collect()}
    assert got == {"account_no": "户名：", "currency": "CNY", "account_name": "李四"}


def test_nearest_value_prefers_after(spark):
    s = _spans(spark, [(1, 10, "1.00"), (2, 10, "期末余额"), (3, 11, "2.00"), (4, 50, "9.99")])
    assert L.nearest_values(s, "期末余额").first().value == "2.00"
    inline = _spans(spark, [(1, 10, "期末余额 1,234.50"), (2, 10, "2.00")])
    assert L.nearest_values(inline, "期末余额").first().value == "1,234.50"


def test_column_band_edges(spark):
    bands = {"a": (0, 10), "b": (10, 20), "c": (100, 110)}
    df = spark.createDataFrame([(10.0,), (10.5,), (40.0,), (66.0,), (300.0,)], "x double")
    assert [r[0] for r in df.select(L.column_band(F.col("x"), bands)).collect()] == ["a", "b", "b", "c", None]


def test_column_statement(spark):
    text = "Date\nCurrency\nTransaction\nAmount\nBalance\nTransaction Type\nCounter Party\n2026-01-02\nCNY\n-1,000.50\n9\n转账\n甲公司\n账号1\n2026-01-03\nCNY\n7\n8\n利息\n\nignored\n2026-01-04\nCNY\noops\n1\n转账"
    lines = N.text_lines(spark.createDataFrame([(1, text)], "page_id bigint, text string"), "page_id").withColumn("line_no", F.col("line_no").cast("bigint"))
    out = L.column_statement(lines).orderBy("record").collect()
    assert [(r.txn_date, r.amount, r.direction, r.description, r.counterparty) for r in out] == [
        (date(2026, 1, 2), D("1000.50"), "expense", "甲公司 账号1", "甲公司 账号1"), (date(2026, 1, 3), D("7.00"), "income", "利息", "利息")]


def test_dates_inside_a_record_are_walked_in_order(spark):
    """The sequential reading: the next record starts at the first date more than three lines below the last start."""
    texts = {1: ["2024-01-01", "CNY", "2024-01-02", "9.00", "x", "2024-01-03", "CNY", "5.00", "7.00", "kind", "who", ""],
             2: ["2024-01-01", "2024-01-02", "3.00", "2024-01-04", "2024-01-05", "CNY", "8.00", "1.00", "k", ""]}
    rows = [(p, i, line) for p, lines in texts.items() for i, line in enumerate(lines)]
    out = L.column_statement(spark.createDataFrame(rows, "page_id bigint, line_no bigint, line string")).collect()
    assert sorted((r.page_id, r.record, str(r.amount)) for r in out) == [(1, 5, "5.00"), (2, 0, "3.00"), (2, 4, "8.00")]


def test_long_amount_after_a_plus(spark):
    df = spark.createDataFrame([("+" + "0" * 63 + "12.50",), ("+1,000.5",), ("12.50",)], "t string")
    assert [str(r[0]) for r in df.select(amount_strict(F.col("t"))).collect()] == ["12.50", "1000.50", "12.50"]


def test_keys_on_one_line(spark):
    rows = [(1, 1, 0.0, 10.0, "账号："), (1, 2, 90.0, 12.0, "货币："), (1, 3, 200.0, 12.0, "CNY"), (1, 4, 0.0, 20.0, "账户名称："), (1, 5, 0.0, 30.0, "账号："),
            (1, 6, 0.0, 40.0, "上页余额："), (1, 7, 90.0, 41.0, "账号：7"), (1, 8, 0.0, 50.0, "5.00"), (2, 1, 0.0, 1.0, "plain")]
    got = L.key_values_same_line(spark.createDataFrame(rows, "page_id bigint, span_id bigint, x0 double, y0 double, text string"), CMB_HEADER_KEYS).collect()
    assert {(r.page_id, r.field, r.value) for r in got} == {
        (1, "currency", "CNY"), (1, "account_name", "账号："), (1, "account_no", "7"), (1, "opening_balance", "5.00")}


def test_zero_amounts_follow_their_source(spark):
    day = "2026-01-02"
    one = lambda names, *v: spark.createDataFrame([(1, *v)], "id int, " + ", ".join(f"{n} string" for n in names.split()))
    flagged = one("value_date flag debit credit summary remark counterparty ref_account own_account balance", day, "借", "0", "", "s", "", "", "", "", "")
    assert N.flagged_debit_credit(flagged, ["id"]).first().status == "ok"
    signed = one("date business_type bill_no description amount balance counterparty", day, "", "", "", "0.00", "", "")
    assert N.signed_amount(signed, ["id"]).first().direction == "expense"
    exclusive = one("date biz_type bill_no expense income counterparty balance", day, "", "", "0", "", "", "")
    assert N.exclusive_out_in(exclusive, ["id"]).first().status == "skip"
    receipt = one("receipt_type trade_date amount_raw payer_name payer_account payee_name payee_account summary business_type receipt_no transaction_id business_no",
                  "expense", day, "CNY 0.00", "", "", "", "", "", "", "", "", "")
    assert N.receipt_by_type(receipt, ["id"]).first().status == "error"


def test_right_neighbour_takes_nearest_value_not_labels(spark):
    rows = [(1, 1, 0.0, 10.0, 5.0, "金额"), (1, 2, 20.0, 40.0, 6.0, "摘要"), (1, 3, 60.0, 70.0, 40.0, "12.50"), (1, 4, 50.0, 55.0, 50.0, "9.00"),
            (1, 5, 600.0, 610.0, 5.0, "1.00"), (1, 6, 60.0, 70.0, 40.0, "77.00")]
    blocks = spark.createDataFrame(rows, "page_id bigint, span_id bigint, x0 double, x1 double, cy double, text string")
    got = L.right_neighbours(blocks, F.col("text") == "金额", r"\d+\.\d{2}").collect()
    assert [tuple(r) for r in got] == [(1, 1, "12.50")]
    # a label that is itself a candidate never picks itself
    own = L.right_neighbours(blocks.withColumn("x1", F.col("x0") + 5), F.col("span_id").isin(3, 6)).collect()
    assert sorted(tuple(r) for r in own) == [(1, 3, "77.00"), (1, 6, "12.50")]


def test_extractors_are_functions_tried_in_order(spark):
    rows = spark.createDataFrame([("f", "x 1"), ("f", "y 2"), ("g", "y 3"), ("h", "z")], "file_id string, line string")
    tries = spark.createDataFrame([("f", 0, "none"), ("f", 1, "x"), ("f", 2, "y"), ("g", 0, "x"), ("g", 1, "y"), ("h", 0, "x"), ("h", 1, "absent")],
                                  "file_id string, cand_ord int, extractor string")
    take = lambda mark: lambda df: df.where(F.col("line").startswith(mark)).select("file_id", F.upper("line").alias("value"))
    got = run_extractors(rows, tries, {"none": take("#"), "x": take("x"), "y": take("y")}).collect()
    assert {(r.file_id, r.cand_ord, r.value) for r in got} == {("f", 1, "X 1"), ("g", 1, "Y 3")}


def test_own_export_columns(spark):
    entries = spark.createDataFrame([("B", "text", 7)], "batch_id string, summary string, voucher_no int")
    out = voucher_export(entries, columns={2: F.upper("summary"), 25: F.col("voucher_no")}).first()
    assert len(out) == 27 and out[3] == "TEXT" and out[26] == 7 and all(out[i] is None for i in range(4, 26))


def test_texts_folded_by_runs(spark):
    """Whatever the length of a run, texts are those of one ordered list; a key may hold most rows."""
    rows = [("hot" if i % 5 else f"k{i % 3}", i * 7919 % 500, i, None if i % 4 == 0 else f"t{i}", "" if i % 6 == 0 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "key string, x int, n int, a string, b string")
    want = {}
    for key, _, _, a, b in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        texts = want.setdefault(key, ([], []))
        for held, t in zip(texts, (a, b), strict=True):
            if t is not None:
                held.append(t)
    for size in (1, 7, 4096):
        got = L.folded_texts(df, ["key"], ["x", "n"], {"a": F.col("a"), "b": F.col("b")}, "|", size).collect()
        assert {r.key: (r.a, r.b) for r in got} == {k: ("|".join(a), "|".join(b)) for k, (a, b) in want.items()}
    assert L.ordered_text(df.limit(0), ["key"], ["x", "n"], "a").count() == 0


def test_page_of_a_million_spans(spark):
    spans = spark.range(1_000_000).selectExpr("id div 1000000 AS page_id", "id AS span_id", "(id * 7919) % 1000003 AS x0", "'x' AS text")
    texts = L.ordered_text(spans, ["page_id"], ["x0", "span_id"])
    assert texts.selectExpr("length(text) AS n").first().n == 1_000_000
    assert texts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
