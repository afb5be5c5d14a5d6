"""Every registered query at the smallest scale: same rows as its SQL, and no pairwise join in its plan."""

from __future__ import annotations

import os

import pytest

import check
from tallyweave.catalog import load
import __spark_entry__ as entry

PATH = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.duck(PATH)


@pytest.mark.parametrize("name", list(load()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, PATH)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, plan
    got, columns = check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        return
    cur = con.execute(SQL[name])
    want, wanted = check.rows_of([c[0] for c in cur.description], cur.fetchall())
    assert columns == wanted
    assert got == want


def test_flagship(spark):
    df = entry.entry(spark)
    assert {"batch_id", "voucher_no", "entry_seq", "debit_amount", "credit_amount"} <= set(df.columns)
    assert df.count() > 0


def test_names_agree():
    assert set(SQL) <= set(entry.queries())
