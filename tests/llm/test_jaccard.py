from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tallyweave.llm.components import components
from tallyweave.llm.jaccard import _fold, _shared, join, shingle_sets, walk, Tree, bitmap


def brute(rows, n, pct):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= pct * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed):
    pick = random.Random(seed)
    word = lambda: pick.choice("abcdefghij") + pick.choice("klmnopqrst") + pick.choice("xyz")
    passage = " ".join(word() for _ in range(30))
    bases = [[word() for _ in range(pick.choice([3, 6, 30, 60, 120]))] for _ in range(12)]
    rows = [(None, "null id"), (1, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (4, "one two three"), (5, "É x y z"), (6, "é x y z")]
    for i in range(140):
        base = list(pick.choice(bases[:3] if i % 3 else bases))
        for _ in range(pick.choice([0, 0, 1, 2, 3, 6])):
            base[pick.randrange(len(base))] = word()
        text = " ".join(base)
        rows.append((10 + (i if i % 10 else 0), text.upper() if i % 7 == 0 else text + (" " + passage) * (i % 4 == 0)))
    return rows


@pytest.mark.parametrize("seed,n,pct,block,frequent,bits", [(1, 4, 85, 1024, 1 << 16, 1 << 24), (2, 5, 80, 4, 50, 1 << 15), (3, 4, 60, 16, 0, 1 << 15)])
def test_against_all_pairs(spark, seed, n, pct, block, frequent, bits):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id bigint, text string, n bigint, node string")
    got = sorted((tuple(r) for r in join(df, "doc_id", "text", n, pct, block, frequent, bits).collect()), key=str)
    assert got == brute(rows, n, pct)


def test_first_shingles_are_sent_once(spark):
    """Seldom shingles meet in one shuffle, whatever their number; frequent ones (from place ``rare`` on) only where two nodes have them."""
    whole = spark.createDataFrame([(0, 20, 2, [1, 2, 90]), (1, 20, 2, [3, 2, 91]), (2, 30, 1, [4, 90]), (3, 5, 0, []), (4, 40, 0, [92])], "node bigint, n bigint, rare int, prefix array<bigint>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shared = _shared(whole, 85)
        plan = shared._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan  # seldom rows, counts of frequent ones
    got = sorted((r.h, r.node, r.n, r.most, r["size"]) for r in shared.collect())
    assert got == [(2, 0, 20, 21, 2), (2, 1, 20, 21, 2), (90, 0, 20, 19, 2), (90, 2, 30, 33, 2)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert join(df, "doc_id", "text").count() == 0
    assert [tuple(r) for r in join(spark.createDataFrame([(7, None)], df.schema), "doc_id", "text").collect()] == [(7, 0, 7)]


@pytest.mark.parametrize("seed", range(5))
def test_walk_finds_every_similar_pair(seed):
    """Dual traversal against all pairs of two blocks, trees of different depth."""
    pick = random.Random(seed)
    pool = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(90):
        base = pool[: pick.choice([20, 30, 40])]
        for _ in range(pick.randrange(4)):
            base[pick.randrange(len(base))] = pick.choice(pool)
        texts.append(" ".join(base).encode())
    keys, at = shingle_sets(texts, 2)
    sets = [keys[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    raw = [bitmap(s) for s in sets]
    bits, n = _fold(raw, min(map(len, raw)) * 8), np.array([len(s) for s in sets])
    for left, right in ((slice(0, 80), slice(80, 90)), (slice(0, 90), slice(0, 90))):
        trees = [Tree(bits[x], n[x], np.arange(90)[x]) for x in (left, right)]
        found = {(i + left.start, j + right.start) for a, b, _ in walk(*trees, 80, left == right, step=7) for i, j in zip(a, b, strict=True)}
        want = {
            (i, j) for i in range(*left.indices(90)) for j in range(*right.indices(90))
            if i != j and 100 * (o := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (n[i] + n[j] - o) and (left != right or i < j)
        }
        assert want <= found


def test_components(spark):
    pick = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(pick.randrange(50), pick.randrange(50)) for _ in range(25)]
    root = {}
    for a, b in edges:
        if a != b:
            x, y = root.setdefault(a, a), root.setdefault(b, b)
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == root
