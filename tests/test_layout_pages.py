"""Text rows of pages: spans are dealt by bands once, and meet the numbers of their rows only."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import layout as L

BANDS = {"date": (0.0, 10.0), "amount": (20.0, 30.0), "name": (40.0, 50.0)}


def numbered(heights, gap):
    out, last, number = {}, None, 0
    for y in sorted(set(heights)):
        number += last is None or y - last > gap
        out[y], last = number, y
    return out


@pytest.mark.parametrize("gap", [0.5, 2.0, 40.0])
def test_rows_across_bands(spark, gap):
    """Gaps inside bands, rows that run on over several bands, equal heights, empty bands, one page with most spans."""
    pick = random.Random(3)
    pages = {p: [pick.choice([0, 1, 1, 2, 30, 31.5, 32, 33, 64, 95.5, 96, 300, 301 + pick.random()]) * 1.0 for _ in range(4 if p else 400)] for p in range(20)}
    rows = [(p, i, y) for p, ys in pages.items() for i, y in enumerate(ys)]
    df = spark.createDataFrame(rows, "page_id bigint, span_id bigint, y0 double")
    got = {(r.page_id, r.span_id): r.cluster for r in L.gap_clusters(df, gap).collect()}
    assert got == {(p, i): numbered(pages[p], gap)[y] for p, i, y in rows}


def test_spans_are_dealt_once(spark):
    spans = spark.range(1000).selectExpr("id % 9 AS page_id", "id AS span_id", "double(id) AS y0", "'t' AS text")
    plan = L.gap_clusters(spans, 2.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [page_id" in plan and "y0#" in plan
    wide = L.gap_clusters(spans, 2.0)._jdf.queryExecution().executedPlan().toString()
    # By bands for rows and for heights, by pages and by bands for the bands themselves; none by height.
    assert wide.count("Exchange hashpartitioning") <= 4
    assert not any("y0" in line.split("hashpartitioning", 1)[1] for line in wide.splitlines() if "hashpartitioning" in line)


def test_a_region_cuts_a_text_row(spark):
    """Only spans inside the region say that a text row starts a record, and only they give it texts."""
    spans = [(1, 1, 0.0, 100.0, "title", 101.0), (1, 2, 5.0, 110.0, "20240101", 111.0), (1, 3, 25.0, 110.0, "1.00", 111.0), (1, 4, 45.0, 111.0, "a", 112.0),
             (1, 5, 45.0, 116.0, " b ", 117.0), (1, 6, 5.0, 121.0, "20240102", 122.0), (1, 7, 25.0, 122.0, "2.00", 123.0), (1, 8, 45.0, 137.5, "c", 138.0),
             (1, 9, 45.0, 139.0, "far", 140.0), (2, 1, 5.0, 10.0, "20240103", 11.0), (2, 2, 25.0, 10.0, "3.00", 11.0)]
    df = spark.createDataFrame(spans, "page_id bigint, span_id bigint, x0 double, y0 double, text string, y1 double")
    got = [tuple(r) for r in L.table_records(df, ["title"], BANDS, ["amount"]).orderBy("page_id", "record").select("page_id", "record", "date", "amount", "name").collect()]
    assert got == [(1, 1, "20240101", "1.00", "a b"), (1, 2, "20240102", "2.00", "c")]


def test_text_rows_are_not_broadcast(spark):
    """However small the file of text rows is, they and their segments meet the spans in tasks, not in the driver."""
    spans = spark.range(600).selectExpr(
        "id div 60 AS page_id", "id AS span_id", "double(id % 3 * 20) AS x0", "double(100 + id % 60 div 3 * 12) AS y0",
        "CASE id % 3 WHEN 0 THEN '20240101' WHEN 1 THEN '1.00' ELSE 'n' END AS text", "double(101 + id % 60 div 3 * 12) AS y1")
    out = L.table_records(spans, ["title"], BANDS, ["amount"])
    starts = F.when(F.col("x0") == 0, 1).otherwise(0)
    merged = L.merge_continuations(L.gap_clusters(spans, 2.0), F.max(starts))
    for df in (out, merged):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.findall(r"BroadcastHashJoin \[page_id#\d+L?, (?:cluster|__segment|__band)#\d+L?\]", plan), plan
    assert out.count() == 200
    assert merged.agg(F.max("record")).first()[0] == 20


def test_cells_are_dealt_once(spark):
    """Receipts over several segments, a bank one or two rows above or three, titles close together, cells before the first."""
    pick = random.Random(5)
    kinds = ("网上银行电子回单", "中国工商银行", "x", "x", "x", "x", None)
    rows = {(p, r, c): pick.choice(kinds if c == 1 else ("x",)) for p in range(4) for r in pick.sample(range(9000 if p else 60), 60) for c in (1, 2)}
    df = spark.createDataFrame([(*k, v) for k, v in rows.items()], "page_id bigint, row bigint, col bigint, text string")
    grouped = L.title_groups(df)
    assert not re.search(r"Join \[page_id#\d+L, row#\d+L\]", grouped._jdf.queryExecution().executedPlan().toString())
    want = set()
    for p in range(4):
        at = lambda word: sorted(r for (q, r, _), t in rows.items() if q == p and t == word)  # noqa: E731, B023
        titles, banks = at(kinds[0]), at(kinds[1])
        heads = [r for i, r in enumerate(titles) if not i or r - titles[i - 1] > 3]
        starts = [min((b for b in banks if b in (h - 2, h - 1)), default=h) for h in heads]
        want |= {(q, r, c, max(s for s in starts if s <= r)) for q, r, c in rows if q == p and any(s <= r for s in starts)}
    assert {(r.page_id, r.row, r.col, r.receipt) for r in grouped.collect()} == want


def test_lines_are_dealt_once(spark):
    """A header, a record that a blank line closes, dates inside a record, a record in a later segment."""
    text = ["2024-01-01", "Date", "Currency", "x", "x", "x", "Counter Party", "2024-01-02", "CNY", "-1.50", "9", "type", "note", "", "2024-99", "2024-01-03", "CNY", "2024-01-04", "9"]
    lines = [(1, i, t) for i, t in enumerate(text)] + [(1, 9000 + i, t) for i, t in enumerate(["2024-01-05", "CNY", "2.00", "9", "only", "a", "b"])]
    out = L.column_statement(spark.createDataFrame(lines, "page_id bigint, line_no bigint, line string"))
    assert not re.search(r"Join \[page_id#\d+L, line_no#\d+L\]", out._jdf.queryExecution().executedPlan().toString())
    got = [(r.record, str(r.txn_date), float(r.amount), r.direction, r.description, r.counterparty) for r in out.orderBy("record").collect()]
    assert got == [(7, "2024-01-02", 1.5, "expense", "note", "note"), (9000, "2024-01-05", 2.0, "income", "a b", "a b")]
