from __future__ import annotations

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import merkle

COLUMNS = ["id", "kind", "text"]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grow(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        pair = level[i // 2 * 2 : i // 2 * 2 + 2]
        out.append((i % 2, [x for k, x in enumerate(pair) if k != i % 2]))
        i //= 2
    return out


def folded(node, steps):
    for side, others in steps:
        node = h(*((others + [node]) if side else ([node] + others)))
    return node


def brute(rows, now):
    """(id, leaf, subroot, root, siblings, folded root) of every row, from whole trees in memory."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: grow([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = grow([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, _, mine, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = path(trees[g], i) + path(top, k)
            out.append((row[0], mine, trees[g][-1][0], top[-1][0], [x for _, o in steps for x in o], folded(leaf(now(row)), steps)))
    return sorted(out, key=str)


def made(spark, rows, schema="id bigint, kind string, text string, root string, g string"):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], schema)


@pytest.mark.parametrize("bits,sizes", [(1, [9, 1, 2]), (2, [70, 5, 0, 1]), (3, [8, 64, 65]), (10, [3, 40])])
def test_against_whole_trees(spark, bits, sizes):
    pick = random.Random(bits)
    rows = [(pick.randrange(10**12), g, f"té {k}") for g, n in zip(["b", None, "", "ab"], sizes) for k in range(n)]
    got = merkle.manifest(made(spark, rows), "id", "kind", COLUMNS, {"text": F.when(F.col("id") % 3 == 0, F.lit("other")).otherwise(F.col("text"))}, bits).collect()
    want = brute(rows, lambda r: (r[0], r[1], "other") if r[0] % 3 == 0 else r)
    assert sorted(((r.id, r.leaf, r.subroot, r.root, r.proof, r.folded_root) for r in got), key=str) == want
    assert all(r.verified == (r.id % 3 != 0) and r.verified == (r.folded_root == r.root) for r in got)
    # What is returned is enough to fold without the table.
    for r in got:
        proof = iter(r.proof)
        steps = b"".join(bytes(["-LR".index(s)]) + (b"" if s == "-" else bytes.fromhex(next(proof))) for s in r.sides)
        assert merkle.fold(bytes.fromhex(r.leaf), steps).hex() == r.root


def test_awkward_rows(spark):
    rows = [(7, "x", "same")] * 23 + [(None, None, None), (None, "x", ""), (None, "x", None), (2**62, "x", "z" * 300_000), (3, "", "a"), (3, "", "b")]
    got = merkle.manifest(made(spark, rows), "id", "kind", COLUMNS, bits=2).collect()
    assert sorted(((r.id, r.leaf, r.subroot, r.root, r.proof, r.folded_root) for r in got), key=str) == brute(rows, lambda r: r)
    assert all(r.verified for r in got)
    assert merkle.manifest(made(spark, rows).limit(0), "id", "kind", COLUMNS).collect() == []
    one = merkle.manifest(made(spark, rows[:1]), "id", "kind", COLUMNS).collect()
    assert [(r.leaf, r.subroot, r.root, r.proof, r.verified) for r in one] == [(leaf(rows[0]),) * 3 + ([], True)]
