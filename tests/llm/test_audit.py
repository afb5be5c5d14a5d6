from __future__ import annotations

import re
from itertools import permutations
from math import factorial

from pyspark.sql import functions as F

from tallyweave.llm import audit

LETTERS = "abcdefghijklmnopqrstuvwxyz"
LONG = " ".join(f"w{i}" for i in range(210))
ROWS = [
    (1, LONG, "en"), (2, LONG, "en"), (3, LONG, "de"), (3, LONG, "de"), (None, LONG, "en"), (None, None, None), (4, None, None), (5, "", "en"), (6, "", ""),
    (7, "a a a a a", "en"), (8, "A B C", "en"), (9, "x # y", "fr"), (10, "x # y", "fr"), (11, LONG.upper() + " |", "en"), (12, "w " * 400_000, "en"), (13, "é É & Z", "fr"),
]
LABELS = [(1, 1, 0), (2, 1, 0), (2, 1, 1), (3, 0, None), (8, None, 1), (None, 1, 1), (99, 1, 1), (13, 1, 1)]


def brute(rows, labels):
    """Walk through every order document by document."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, text, part in rows:
        t = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t],
        }
        known = [x for x in labels if i is not None and x[0] == i]
        docs.append((part or "", {f for f, bad in fails.items() if bad}, any(x[1] == 1 for x in known), any(x[2] == 1 for x in known)))
    out, shapley = [], {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = list(mine)
            for k, f in enumerate(order):
                here = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(here)
                out.append((part, "".join(order), k + 1, len(left), len(here), sum(f in d[1] for d in mine) - len(here), sum(d[1] == {f} for d in mine), sum(d[2] for d in here), sum(d[3] for d in here)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def frames(spark, rows=ROWS, labels=LABELS):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, lang string, part string, n int")
    return docs, spark.createDataFrame([(*r, "clash") for r in labels], "doc_id bigint, quality int, toxic int, text string")


def test_against_every_order(spark):
    docs, labels = frames(spark)
    got = audit.audit(audit.failures(docs, labels, "doc_id", "text", "lang")).collect()
    assert sorted(tuple(r) for r in got) == brute(ROWS, LABELS)


def test_efficiency(spark):
    """Shapley values of a part add up to what all filters remove together."""
    docs, labels = frames(spark)
    rows = audit.audit(audit.failures(docs, labels, "doc_id", "text", "lang")).where("filter_order = 'ABCDE'").collect()
    for part in {r.part for r in rows}:
        mine = [r for r in rows if r.part == part]
        assert sum(r.shapley for r in mine) == factorial(5) * sum(r.removed for r in mine)


def test_potential(spark):
    """The potential of a small game by its definition."""
    worth = [0, 5, 7, 20, 1, 9, 8, 40]
    got = spark.range(1).select(audit.potentials(F.lit(worth), 3).alias("p")).first().p
    want = [0.0] * 8
    for s in range(1, 8):
        members = [i for i in range(3) if s >> i & 1]
        want[s] = (worth[s] + sum(want[s - (1 << i)] for i in members)) / len(members)
    assert [x / 6 for x in got] == want


def test_empty(spark):
    docs, labels = frames(spark)
    assert audit.audit(audit.failures(docs.limit(0), labels, "doc_id", "text", "lang")).collect() == []
    some = audit.audit(audit.failures(docs, labels.limit(0), "doc_id", "text", "lang"))
    assert some.agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[:] == (0, 0)
