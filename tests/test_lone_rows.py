"""Rows without a subject are vouchers as they are: none is dealt by the voucher key, and none is lost by a null in it."""

from __future__ import annotations

from tallyweave.operators import vouchers as V

TXN = "batch_id string, txn_seq bigint, amount decimal(18,2), direction string, reference_number string, account_number string, subject_code string"


def test_numbers_among_groups(spark):
    rows = [("b", 7, 1, "expense", "r", "a", "c1"), ("b", 2, 2, None, "r", None, ""), ("b", 5, 3, "expense", "r", "a", None),
            ("b", 9, 4, "expense", "r", "a", "c1"), ("c", 1, 5, "income", None, "a", "")]
    df = spark.createDataFrame([(*r[:2], None if r[2] is None else __import__("decimal").Decimal(r[2]), *r[3:]) for r in rows], TXN)
    for bits in (0, 1, 16):
        got = {(r.batch_id, r.txn_seq): (r.voucher_no, r.voucher_pos, r.voucher_size, int(r.voucher_total)) for r in V.grouped(df, bits).collect()}
        assert got == {("b", 2): (1, 1, 1, 2), ("b", 5): (2, 1, 1, 3), ("b", 7): (3, 1, 2, 5), ("b", 9): (3, 2, 2, 5), ("c", 1): (1, 1, 1, 5)}
