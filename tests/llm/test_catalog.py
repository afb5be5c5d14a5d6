"""The registered queries at the smallest scale, against their SQL where there is one."""

from __future__ import annotations

import pytest

import check
from tallyweave.llm.catalog import QUERIES

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.duck(PATH)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    build, sql = QUERIES[name]
    df = build(spark, PATH)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got, columns = check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got
    if sql:
        cur = con.execute(sql)
        want, wanted = check.rows_of([c[0] for c in cur.description], cur.fetchall())
        assert columns == wanted and got == want


def test_native_plan(spark):
    """The URL filter runs no Python on executors."""
    plan = QUERIES["op9_url_filter"][0](spark, PATH)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
