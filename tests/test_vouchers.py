from __future__ import annotations

import random
from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import edits as E
from tallyweave.operators import store as ST
from tallyweave.operators import vouchers as V
from tallyweave.operators.accounts import Account

TXN = ("batch_id string, txn_seq bigint, txn_date date, description string, amount decimal(18,2), direction string, counterparty string, "
       "reference_number string, account_number string, subject_code string, subject_name string, source string, rule_id string, "
       "aux_category string, aux_category_name string")
OWN = [Account(1, "a1", "suffix", "14", "", "ICBC", "1000201", "bank one"), Account(2, "a2", "exact", "6214", "", "CMB", "1000202", "bank two")]


def _txn(seq, amount, code="c1", way="expense", ref="r", acct="6214", batch="b", text=None):
    src = "rule" if code else "unmatched"
    return (batch, seq, date(2024, 1, 1 + seq % 28), text or f"t{seq}", D(str(amount)), way, f"p{seq}", ref, acct, code, "n", src, "", "", "")


def _compose(spark, rows, bits=16):
    out = V.compose_vouchers(spark.createDataFrame(rows, TXN), OWN, bits)
    return sorted(out.collect(), key=lambda r: (r.batch_id, r.voucher_no, r.entry_seq))


def test_expense_and_income_sides(spark):
    out = _compose(spark, [_txn(5, "10.10"), _txn(2, "0.20"), _txn(3, 7, way="income", acct="9914"), _txn(9, 1, way="income", acct="9914")])
    assert [(r.voucher_no, r.entry_seq, r.direction, r.debit_amount, r.credit_amount) for r in out] == [
        (1, 1, "expense", D("0.20"), None), (1, 2, "expense", D("10.10"), None), (1, 3, "bank", None, D("10.30")),
        (2, 1, "bank", D("8.00"), None), (2, 2, "income", None, D("7.00")), (2, 3, "income", None, D("1.00")),
    ]
    # exact beats suffix; date and text of the first transaction
    assert (out[2].subject_code, out[2].summary, out[2].date, out[2].match_source) == ("1000202", "t2", date(2024, 1, 3), "auto")
    assert out[3].subject_code == "1000201"


def test_unmatched_stand_alone_and_keys_split(spark):
    out = _compose(spark, [_txn(1, 1, code=""), _txn(2, 1, code=""), _txn(3, 1), _txn(4, 1, ref=None), _txn(5, 1, ref=""), _txn(6, 1, acct="x")])
    by = {r.summary: r.voucher_no for r in out if r.direction != "bank"}
    assert by == {"t1": 1, "t2": 2, "t3": 3, "t4": 4, "t5": 4, "t6": 5}
    assert {r.subject_code for r in out if r.voucher_no == 1} == {"__unmatched__", "1000202"}
    assert [r.subject_code for r in out if r.voucher_no == 5 and r.direction == "bank"] == ["10002"]


def _plain(rows):
    """Numbering by reading the rows in order."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        key = (r[0], r[8] or "", r[9] or "__unmatched__", r[5], r[7] or "" if r[9] else f"#{r[1]}")
        groups.setdefault(r[0], {}).setdefault(key, []).append(r)
    return {(b, no, pos): t[1] for b, g in groups.items() for no, ts in enumerate(g.values(), 1) for pos, t in enumerate(ts, 1)}


@pytest.mark.parametrize("bits", [0, 2, 5, 16])
def test_hot_batch_and_hot_voucher(spark, bits):
    rnd = random.Random(bits)
    rows = [_txn(s, rnd.randint(1, 99), code=rnd.choice(["c1", "c1", "c1", "", "c2"]), way=rnd.choice(["expense", "income"]),
                 ref=rnd.choice(["r", "r", "q", None]), acct=rnd.choice(["6214", "6214", "9914"]), batch=rnd.choice(["hot", "hot", "b"]))
            for s in rnd.sample(range(1, 3000), 400)]
    got = V.grouped(spark.createDataFrame(rows, TXN), bits).collect()
    assert {(r.batch_id, r.voucher_no, r.voucher_pos): r.txn_seq for r in got} == _plain(rows)
    out = _compose(spark, rows, bits)
    sums, seqs = {}, {}
    for r in out:
        k = (r.batch_id, r.voucher_no)
        d, c = sums.get(k, (D(0), D(0)))
        sums[k] = (d + (r.debit_amount or 0), c + (r.credit_amount or 0))
        seqs.setdefault(k, []).append(r.entry_seq)
    assert all(d == c for d, c in sums.values())
    assert all(s == list(range(1, len(s) + 1)) for s in seqs.values())
    assert sorted(r.original_summary for r in out if r.direction != "bank") == sorted(r[3] for r in rows)


# --- edits -------------------------------------------------------------------------------

def _entry(no, seq, way, debit=None, credit=None, code="c", source="rule", batch="b"):
    d = lambda x: None if x is None else D(str(x))
    return (batch, no, seq, date(2024, 1, 1), f"s{no}-{seq}", code, "n", d(debit), d(credit), way, "p", source, "", f"s{no}-{seq}",
            d(debit or credit), False, "", "")


BASE = [
    _entry(1, 1, "expense", debit="0.10"), _entry(1, 2, "bank", credit="0.10"),
    _entry(2, 1, "bank", debit=5), _entry(2, 2, "income", credit=5),
    _entry(3, 1, "expense", debit="0.20"), _entry(3, 2, "expense", debit=9, source="unmatched"), _entry(3, 3, "bank", credit="9.20"),
]


def _frame(spark, rows):
    return spark.createDataFrame(rows, V.ENTRY_SCHEMA)


def _show(df):
    return [(r.voucher_no, r.entry_seq, r.summary, r.debit_amount, r.credit_amount)
            for r in sorted(df.collect(), key=lambda r: (r.voucher_no, r.entry_seq))]


@pytest.mark.parametrize("bits", [0, 16])
def test_move_merges_drops_and_renumbers(spark, bits):
    moved = E.move_entries(_frame(spark, BASE), spark.createDataFrame([("b", 1, 1)], "batch_id string, voucher_no bigint, entry_seq bigint"),
                           spark.createDataFrame([("b", 3)], "batch_id string, target_no bigint"), bits)
    assert _show(moved) == [
        (1, 1, "s2-2", None, D("5.00")), (1, 2, "s2-1", D("5.00"), None),
        (2, 1, "s3-1", D("0.20"), None), (2, 2, "s3-2", D("9.00"), None), (2, 3, "s1-1", D("0.10"), None), (2, 4, "s3-3", None, D("9.30")),
    ]


def test_move_within_target_is_nothing(spark):
    same = E.move_entries(_frame(spark, BASE), spark.createDataFrame([("b", 3, 1)], "batch_id string, voucher_no bigint, entry_seq bigint"),
                          spark.createDataFrame([("b", 3)], "batch_id string, target_no bigint"))
    assert [s for _, _, s, _, _ in _show(same)] == ["s1-1", "s1-2", "s2-2", "s2-1", "s3-1", "s3-2", "s3-3"]


def test_tenths_add_up(spark):
    rows = [_entry(1, 1, "expense", debit="0.1"), _entry(1, 2, "expense", debit="0.2"), _entry(1, 3, "bank", credit=7)]
    assert _show(E.rebalance_bank(_frame(spark, rows)))[2][4] == D("0.30")


def test_split_in_place(spark):
    parts = spark.createDataFrame([("b", 3, 1, 1, D("0.05"), "x"), ("b", 3, 1, 2, D("0.15"), "y")],
                                  "batch_id string, voucher_no bigint, entry_seq bigint, part_no bigint, amount decimal(18,2), subject_code string")
    out = E.split_entries(_frame(spark, BASE), parts)
    assert [(r[1], r[3]) for r in _show(out) if r[0] == 3] == [(1, D("0.05")), (2, D("0.15")), (3, D("9.00")), (4, None)]
    assert _show(out)[-1][4] == D("9.20")
    bad = parts.withColumn("amount", F.col("amount") * 3)
    assert E.check_split(_frame(spark, BASE), bad).first().reason == "parts exceed entry"
    assert E.check_split(_frame(spark, BASE), parts.limit(1)).first().reason == "fewer than two parts"


def test_fill_learn_and_forget_automatic(spark):
    filled = E.bulk_fill(_frame(spark, BASE), "50602", "管理费用")
    assert [r.summary for r in filled.where("is_manual").collect()] == ["s3-2"]
    empty = spark.createDataFrame([], "summary_hash string, subject_code string, direction string")
    learned = ST.learn(empty, filled).collect()
    assert [(r.summary, r.subject_code, r.direction) for r in learned] == [("s3-2", "50602", "expense")]
    assert ST.learn(spark.createDataFrame(learned), filled).count() == 0


def test_partial_update_absent_null_blank(spark):
    rows = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y")], "code string, name string, category string")
    patch = spark.createDataFrame([("1", {"name": None}), ("2", {"category": "  z ", "code": "9"})], "code string, patch map<string,string>")
    assert sorted(map(tuple, E.partial_update(rows, patch, "code").collect())) == [("1", "", "x"), ("2", "b", "z")]


def test_unknown_fields_are_named(spark):
    with pytest.raises(ValueError, match="bogus"):
        ST.require_columns(_frame(spark, BASE).withColumn("bogus", F.lit(1)), V.ENTRY_COLUMNS)
    with pytest.raises(ValueError):
        ST.check_entries(_frame(spark, []))


def test_the_last_of_repeated_keys_counts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "z", 1), (3, "w", 0)], "k int, v string, ord int")
    assert sorted(map(tuple, ST.upsert(old, new, ["k"], "ord").collect())) == [(1, "y"), (2, "b"), (3, "z")]
    blank = spark.createDataFrame([(1, ""), (2, "kept")], "k int, v string")
    assert sorted(map(tuple, ST.fill_blank(blank, new, "k", "v").collect())) == [(1, "y"), (2, "kept")]


def test_draft_ids_do_not_collide(spark):
    ids = spark.range(300_000).select(ST.draft_id(F.col("id").cast("string")).alias("d"))
    assert ids.distinct().count() == 300_000
