"""Spans read by runs, and blocks met in a grid of bins, against plain loops."""

from __future__ import annotations

import random

import pytest

from tallyweave.operators.layout import assign_cells, key_values_same_line

KEYS = {"A": "a", "B": "b", "C": "c"}


def fold(spans):
    """One page read in order, span by span."""
    found, held, height = {}, None, 0.0
    for y, _, _, text in sorted((y, x, i, t) for i, x, y, t in spans):
        name, colon, value = text.partition(":")
        field = KEYS.get(name) if colon else None
        if held and not (field and abs(y - height) <= 3.0):
            found[held], held = text, None
        elif field and value:
            found[field] = value
        elif field:
            held, height = field, y
    return found


def page(seed: int, size: int):
    pick = random.Random(seed)
    y, out = 0.0, []
    for i in range(size):
        y += pick.choice([0, 0, 0, 1, 2, 3, 4, 40])
        out.append((i, float(pick.randrange(5)), y, pick.choice(["A:", "B:", "C:", "A:", f"A:{i}", f"B:{i}", f"C:{i}", f"t{i}", f"D:{i}"])))
    return out


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 512])
def test_keys_by_runs(spark, rows):
    pages = {p: page(p, 5 + p % 40) for p in range(120)} | {500: [(i, 0.0, float(5 * i), "A:") for i in range(41)], 501: [(0, 0.0, 0.0, "A:")]}
    df = spark.createDataFrame([(p, *s) for p, spans in pages.items() for s in spans], "page_id bigint, span_id bigint, x0 double, y0 double, text string")
    got: dict = {}
    for r in key_values_same_line(df, KEYS, rows=rows).collect():
        got.setdefault(r.page_id, {})[r.field] = r.value
    assert got == {p: f for p, spans in pages.items() if (f := fold(spans))}


@pytest.mark.parametrize("width,height", [(200.0, 50.0), (3.0, 2.0), (1000.0, 1000.0)])
def test_cells_by_bins(spark, width, height):
    pick = random.Random(2)
    cells = [(p, r, c, c * 10.0, r * 6.0, c * 10.0 + 9, r * 6.0 + 5) for p in (1, 2) for r in range(4) for c in range(3)]
    blocks = []
    for i in range(160):
        x, y = pick.randrange(-8, 36), pick.randrange(-8, 28)
        blocks.append((1 + i % 2, i, float(x), float(y), x + pick.choice([0.5, 4.0, 25.0]), y + pick.choice([0.5, 3.0, 14.0]), "t"))
    want = {}
    for p, i, x0, y0, x1, y1, _ in blocks:
        over = [
            (max(0, min(x1, cx1) - max(x0, cx0)) * max(0, min(y1, cy1) - max(y0, cy0)), -r, -c)
            for q, r, c, cx0, cy0, cx1, cy1 in cells if q == p
        ]
        area, r, c = max(over)
        if area > 0:
            want[i] = (-r, -c)
    b = spark.createDataFrame(blocks, "page_id bigint, span_id bigint, x0 double, y0 double, x1 double, y1 double, text string")
    c = spark.createDataFrame(cells, "page_id bigint, row int, col int, cx0 double, cy0 double, cx1 double, cy1 double")
    only = assign_cells(b, c, False, height, width)
    every = assign_cells(b, c, True, height, width)
    assert {r.span_id: (r.row, r.col) for r in only.collect()} == want
    rows = every.collect()
    assert len(rows) == len(blocks) and {r.span_id: (r.row, r.col) for r in rows if r.span_id in want} == want
    assert every.columns == only.columns and every.schema["row"].dataType.simpleString() in ("int", "bigint")


def test_cells_are_not_broadcast(spark):
    """Few pages whose cells are exploded look small to the planner: their cells are shuffled all the same."""
    cells = spark.range(50).selectExpr("id AS page_id", "explode(sequence(1L, 40L)) AS row").selectExpr(
        "page_id", "row", "1L AS col", "0D AS cx0", "row * 10D AS cy0", "50D AS cx1", "row * 10D + 10D AS cy1")
    blocks = spark.range(100).selectExpr("id % 50 AS page_id", "id AS span_id", "1D AS x0", "double(id) AS y0", "20D AS x1", "double(id) + 5D AS y1")
    found = assign_cells(blocks, cells, nearest=False)
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 94  # the first six end above the first cell
