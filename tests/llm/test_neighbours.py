from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import neighbours as N
from tallyweave.llm.neighbours import beam_search, build_graph, even_norms, nearest

SCHEMA = "vec_id bigint, embedding array<float>, score string"


def brute(rows, k):
    """(query, rank, id) of every query row, by product and then id."""
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for at, (q, x) in enumerate(good):
        if q % 20 == 0:
            near = sorted((-float(x @ y), i) for j, (i, y) in enumerate(good) if j != at and len(y) == len(x))[:k]
            out += [(q, rank + 1, i) for rank, (_, i) in enumerate(near)]
    return sorted(out)


def test_small_tables_exactly(spark):
    draw = np.random.default_rng(1)
    vec = lambda: [float(x) for x in draw.integers(-3, 4, 4)]
    rows = [(i, vec(), "x") for i in range(90)] + [(i, [1.0, 2.0, 0.0, -1.0], "x") for i in range(100, 160)] + [(20, [1.0, 2.0, 0.0, -1.0], "x")] * 2
    rows += [(200, None, "x"), (201, [0.0] * 4, "x"), (202, [1.0, None, 2.0, 3.0], "x"), (203, [float("nan")] * 4, "x"), (204, [float("inf"), 1.0, 1.0, 1.0], "x")]
    rows += [(None, [1.0] * 4, "x"), (220, [5.0, 5.0], "x"), (221, [1.0, 1.0], "x"), (240, [1.0], "x"), (7, [], "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    for shard in (8192, 25):
        got = nearest(df, "vec_id", "embedding", F.col("id") % 20 == 0, k=20, shard=shard, block=3, beam=200).collect()
        assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == brute(rows, 20)
    # Repeated query rows each have an answer; a query without candidates has none.
    assert len([r for r in got if r.query_id == 20]) == 60 and not [r for r in got if r.query_id == 240]


def test_empty(spark):
    assert nearest(spark.createDataFrame([], SCHEMA), "vec_id", "embedding", F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("scaled", [False, True])
def test_recall(scaled):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(3000, 32))
    if scaled:
        x *= draw.uniform(0.2, 2, size=(3000, 1))
    graph, starts = build_graph(even_norms(x).astype(np.float32))
    q = np.hstack([x[:200], np.zeros((200, 1))]).astype(np.float32)
    found, _ = beam_search(even_norms(x).astype(np.float32), graph, starts, q, 96)
    true = np.argsort(-(x[:200] @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a[:20]) & set(b)) / 20 for a, b in zip(found, true, strict=True)]) > 0.9


def test_recall_of_a_full_shard():
    """Default settings on plain normal vectors, the hardest of those measured."""
    x = np.random.default_rng(3).normal(size=(N.SHARD, 64))
    points = N.comparable(x)
    graph, starts = build_graph(points)
    q = np.hstack([x[:200], np.zeros((200, 1))]).astype(np.float32)
    found, _ = beam_search(points, graph, starts, q, N.SEARCH_BEAM)
    true = np.argsort(-(x[:200] @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a[:21]) & set(b)) / 20 for a, b in zip(found, true, strict=True)]) >= 0.9


def test_doubles_stay_doubles(spark):
    """Vectors that are equal in single precision are two, and ones beyond its range take part."""
    rows = [(20, [1.0, 1.0]), (1, [1.0, 1.0 + 1e-12]), (2, [1.0, 1.0]), (3, [1e39, 0.0]), (4, [-1e39, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = nearest(df, "vec_id", "embedding", F.col("id") % 20 == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(3, 1e39), (1, 1.0 + (1.0 + 1e-12)), (2, 2.0), (4, -1e39)]


def test_recall_on_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = nearest(df, "vec_id", "embedding", F.col("id") % 20 == 0, shard=2000).collect()
    rows = [(r.vec_id, [float(v) for v in r.embedding], "") for r in df.collect()]
    x, ids = np.array([v for _, v, _ in rows]), np.array([i for i, _, _ in rows])
    want = set()
    for at in np.flatnonzero(ids % 20 == 0):
        s = x @ x[at]
        s[at] = -np.inf
        want |= {(int(ids[at]), int(ids[j])) for j in np.lexsort((ids, -s))[:20]}
    assert len({(r.query_id, r.vec_id) for r in got} & want) / len(want) >= 0.9
