"""Nearest neighbours by inner product over a sharded, robust-pruned directed graph.

Equal vectors are one point.  Points are dealt over shards by a hash; each shard's graph is built by itself: greedy
searches on the graph so far propose neighbours, and a neighbour is kept unless one already kept is closer to it by a
factor, so that edges point in diverse directions.  Blocks of queries search every shard with a beam; the best of all
shards are merged.  A coordinate that evens out the norms turns the largest inner product into the smallest distance.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import Batches, store

#: Points of a shard and queries of a block on average: both are held by one task.
SHARD = 8192
QUERIES = 1024
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAX, STARTS = 32, 48, 320, 1.2, 8
#: A shard is searched with the first of these beams that finds this part of the true neighbours of so many of its points, else with the whole beam.
BEAMS, SURE, PROBES, PROBE_TOP = (96, 160, 224), 0.98, 96, 20


def even_norms(x: np.ndarray) -> np.ndarray:
    """One more coordinate, after which all points are equally long."""
    norms = np.einsum("ij,ij->i", x, x)
    return np.hstack([x, np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))[:, None]])


def comparable(x: np.ndarray) -> np.ndarray:
    """Points for graph and search: scaled by the largest component, so that no double overflows, with even norms."""
    wide = x.astype(np.float64)
    peak = np.abs(wide).max(initial=0)
    return even_norms(wide / peak if peak else wide).astype(np.float32)


def beam_search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and products of the best ``beam`` found for each query, largest product first; -1 where fewer.

    ``x`` has equally long rows, so the largest product is the nearest.  All queries take a step together: each
    expands its best open point and looks at the neighbours it hasn't seen.
    """
    n, m = len(x), len(q)
    width = beam + graph.shape[1]
    ids = np.full((m, width), -1, dtype=np.int32)
    near = np.full((m, width), -np.inf, dtype=x.dtype)
    open_ = np.zeros((m, width), dtype=bool)
    seen = np.zeros((m, n), dtype=bool)
    starts = starts[:beam]
    ids[:, : len(starts)] = starts
    near[:, : len(starts)] = q @ x[starts].T
    open_[:, : len(starts)] = True
    seen[:, starts] = True
    live = np.arange(m)
    while len(live):
        best = np.where(open_[live, :beam], near[live, :beam], -np.inf).argmax(axis=1)
        on = open_[live, best]
        live, best = live[on], best[on]
        if not len(live):
            break
        open_[live, best] = False
        around = graph[ids[live, best]]
        fresh = (around >= 0) & ~seen[live[:, None], around]
        rows, cols = np.nonzero(fresh)
        points = around[rows, cols]
        seen[live[rows], points] = True
        ids[live, beam:] = -1
        near[live, beam:] = -np.inf
        open_[live, beam:] = False
        ids[live[rows], beam + cols] = points
        near[live[rows], beam + cols] = np.einsum("ij,ij->i", q[live[rows]], x[points])
        open_[live[rows], beam + cols] = True
        order = np.argpartition(-near[live], beam - 1, axis=1)
        for a in (ids, near, open_):
            a[live] = np.take_along_axis(a[live], order, axis=1)
    order = np.argsort(-near[:, :beam], axis=1, kind="stable")
    return np.take_along_axis(ids[:, :beam], order, axis=1), np.take_along_axis(near[:, :beam], order, axis=1)


def prune(x: np.ndarray, points: np.ndarray, proposed: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Neighbours kept for each of ``points`` out of a row of proposals (-1: none), nearest first.

    A proposal goes once a kept one is ``relax`` times closer to it than the point itself is.
    """
    m, width = proposed.shape
    order = np.argsort(proposed, axis=1)
    proposed = np.take_along_axis(proposed, order, axis=1)
    ok = (proposed >= 0) & (proposed != points[:, None])
    ok[:, 1:] &= proposed[:, 1:] != proposed[:, :-1]
    c = x[np.maximum(proposed, 0)]
    full = float(np.einsum("j,j->", x[0], x[0]))
    own = np.where(ok, np.maximum(2 * (full - np.einsum("mcd,md->mc", c, x[points])), 0), np.inf)
    between = np.maximum(2 * (full - c @ c.transpose(0, 2, 1)), 0)
    kept = np.full((m, degree), -1, dtype=np.int32)
    at = np.arange(m)
    for k in range(min(degree, width)):
        pick = own.argmin(axis=1)
        there = np.isfinite(own[at, pick])
        if not there.any():
            break
        kept[there, k] = proposed[at, pick][there]
        closer = relax * relax * between[at, pick] <= own
        own[closer] = np.inf
        own[at, pick] = np.inf
    return kept


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(graph, starts) for equally long rows: out-neighbours of each point, and where searches begin."""
    n = len(x)
    draw = np.random.default_rng(7)
    room = degree + degree // 2
    graph = np.full((n, room), -1, dtype=np.int32)
    order = draw.permutation(n).astype(np.int32)
    middle = int((x @ x.mean(axis=0)).argmax()) if n else 0
    # Where norms differ, the last coordinate is small for long vectors, which most queries look for.
    uneven = n > 0 and float(x[:, -1].max()) > 1e-2 * float(np.sqrt(x[0] @ x[0]))
    longest = np.argsort(x[:, -1], kind="stable")[:STARTS] if uneven else order[:0]
    starts = np.unique(np.concatenate(([middle], order[: STARTS - 1], longest))).astype(np.int32) if n else np.zeros(0, dtype=np.int32)
    done, used = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
    done[starts] = True
    for i, s in enumerate(starts):  # the first points know each other
        graph[s, : len(starts) - 1] = np.delete(starts, i)
        used[s] = len(starts) - 1
    rest = order[~done[order]]
    at = 0
    while at < len(rest):
        some = rest[at : at + max(8, min(batch, (at + len(starts)) // 2))]
        at += len(some)
        found, _ = beam_search(x, graph, starts, x[some], beam)
        if uneven:  # also what the point would find as a query
            flat = x[some].copy()
            flat[:, -1] = 0
            found = np.hstack([found, beam_search(x, graph, starts, flat, beam)[0]])
        kept = prune(x, some, found, degree, relax)
        graph[some, :degree] = kept
        used[some] = (kept >= 0).sum(axis=1)
        # And back: each kept neighbour gets an edge to the point, and is pruned again when it has no room.
        src, dst = np.repeat(some, degree), kept.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        first = np.flatnonzero(np.diff(dst, prepend=-1))
        nth = np.arange(len(dst)) - np.repeat(first, np.diff(np.append(first, len(dst))))
        place = used[dst] + nth
        fits = place < room
        graph[dst[fits], place[fits]] = src[fits]
        over = np.unique(dst[~fits])
        np.add.at(used, dst[fits], 1)
        for lo in range(0, len(over), batch):
            part = over[lo : lo + batch]
            here = np.isin(dst, part) & ~fits
            d, s = np.searchsorted(part, dst[here]), src[here]
            ahead = np.flatnonzero(np.diff(d, prepend=-1))
            k = np.arange(len(d)) - np.repeat(ahead, np.diff(np.append(ahead, len(d))))
            wide = np.full((len(part), room + int(k.max()) + 1), -1, dtype=np.int32)
            wide[:, :room] = graph[part]
            wide[d, room + k] = s
            kept = prune(x, part, wide, degree, relax)
            graph[part] = -1
            graph[part, :degree] = kept
            used[part] = (kept >= 0).sum(axis=1)
    return graph, starts


def fit_beam(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, most: int) -> int:
    """A beam for this shard, at most ``most``: recall of some of its points as queries is measured against brute force.

    The point itself doesn't count, and a query's added coordinate is 0, as in a search.
    """
    if len(x) <= PROBE_TOP + 1:
        return most
    some = np.random.default_rng(11).permutation(len(x))[:PROBES]
    ask = x[some].copy()
    ask[:, -1] = 0
    products = ask @ x.T
    products[np.arange(len(some)), some] = -np.inf
    least = np.partition(products, len(x) - PROBE_TOP, axis=1)[:, len(x) - PROBE_TOP]
    for beam in BEAMS:
        if beam >= most:
            break
        found, _ = beam_search(x, graph, starts, ask, beam)
        near = np.where((found >= 0) & (found != some[:, None]), np.take_along_axis(products, np.maximum(found, 0), axis=1), -np.inf)
        if np.minimum((near >= least[:, None]).sum(axis=1), PROBE_TOP).mean() >= SURE * PROBE_TOP:
            return beam
    return most


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _build(table: pa.Table, most: int = SEARCH_BEAM) -> pa.Table:
    """All points of a shard become one row: vectors, graph, ids, the beam to search it with."""
    order = np.lexsort((table.column("k2").to_numpy(), table.column("k1").to_numpy()))
    table = table.take(pa.array(order))
    vectors = _matrix(table.column("vector"))
    x = comparable(vectors)
    graph, starts = build_graph(x)
    return pa.table({
        "beam": pa.array([fit_beam(x, graph, starts, most)], pa.int32()),
        "dims": pa.array([vectors.shape[1]], pa.int32()), "shard": table.column("shard").slice(0, 1), "points": pa.array([len(vectors)], pa.int32()),
        "vectors": [vectors.tobytes()], "graph": [graph.astype(np.int32).tobytes()], "starts": [starts.tobytes()],
        "keys": [np.stack([table.column(c).to_numpy() for c in ("k1", "k2")], axis=1).astype(np.int64).tobytes()],
        "ids": pa.array([table.column("ids").combine_chunks().to_pylist()], pa.list_(pa.list_(pa.int64()))),
    })


INDEX = "beam int, dims int, shard int, points int, vectors binary, graph binary, starts binary, keys binary, ids array<array<bigint>>"


def _pack(table: pa.Table) -> pa.Table:
    vectors = _matrix(table.column("vector"))
    keys = np.stack([table.column(c).to_numpy() for c in ("k1", "k2")], axis=1).astype(np.int64)
    return pa.table({"dims": pa.array([vectors.shape[1]], pa.int32()), "queries": [vectors.tobytes()], "query_keys": [keys.tobytes()]})


def _search(top: int, kind: type):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c, kind, row=row, batch=batch: np.frombuffer(batch.column(c)[row].as_buffer(), dtype=kind)
                n, dims = batch.column("points")[row].as_py(), batch.column("dims")[row].as_py()
                vectors, q = get("vectors", kind).reshape(n, dims), get("queries", kind).reshape(-1, dims)
                graph, starts = get("graph", np.int32).reshape(n, -1), get("starts", np.int32)
                keys, query_keys = get("keys", np.int64).reshape(n, 2), get("query_keys", np.int64).reshape(-1, 2)
                ids = batch.column("ids")[row].as_py()
                least = np.array([i[0] for i in ids], dtype=np.int64)
                x = comparable(vectors)
                flat = (q / np.abs(q).max(axis=1, keepdims=True)).astype(np.float32)  # a query's length changes no order
                ask = np.hstack([flat, np.zeros((len(q), 1), dtype=np.float32)])
                found, _ = beam_search(x, graph, starts, ask, max(batch.column("beam")[row].as_py(), top))
                who, col = np.nonzero(found >= 0)
                point = found[who, col]
                score = np.einsum("ij,ij->i", q[who].astype(np.float64), vectors[point].astype(np.float64))
                order = np.lexsort((least[point], -score, who))
                who, point, score = who[order], point[order], score[order]
                first = np.searchsorted(who, np.arange(len(q)))
                keep = np.arange(len(who)) - first[who] < top
                who, point, score = who[keep], point[keep], score[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_keys[who, 0]), pa.array(query_keys[who, 1]), pa.array(keys[point, 0]), pa.array(keys[point, 1]), pa.array(score),
                     pa.array([ids[p] for p in point], pa.list_(pa.int64()))],
                    names=["q1", "q2", "k1", "k2", "score", "ids"],
                )

    return run


FOUND = "q1 bigint, q2 bigint, k1 bigint, k2 bigint, score double, ids array<bigint>"


def usable(vector):
    """Not null, no null or non-finite component, and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def nearest(df: DataFrame, id_col: str, vector_col: str, is_query, k: int = 20, shard: int = SHARD, block: int = QUERIES, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k nearest other rows found, by inner product.

    ``is_query`` is a condition on the column ``id``.  Rows without id, and vectors that are not ``usable``, take no
    part; vectors of different lengths are never compared.  Equal vectors are searched once and keep their k + 1
    smallest ids, which is all that an answer can need, so a vector that many rows share costs no more than another.
    Repeated rows are candidates of each other, and each has its answer.  A query without candidates has no row.
    Vectors of doubles stay doubles for classes and scores; the graph compares single-precision copies.  Columns of
    ``df`` but the two named are not read.  ``beam`` is the widest: a shard on which a narrower one finds nearly all is searched
    with that (``fit_beam``).  The index is written to the shared folder; a task holds one shard and one block of queries.
    """
    vector = F.col("vector")
    part = "float" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast(part) + F.lit(0).cast(part)).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable(vector)).withColumns({"k1": F.xxhash64(vector), "k2": F.xxhash64(F.lit(1), vector)})
    in_class = Window.partitionBy("k1", "k2").orderBy("id")
    points = store(
        rows.withColumn("nth", F.row_number().over(in_class)).where(F.col("nth") <= k + 1)
        .groupBy("k1", "k2").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("id")).alias("ids")), "points",
    )
    sizes = points.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("n")).select("dims", F.ceil(F.col("n") / shard).cast("int").alias("shards"))
    sizes = store(sizes, "shards")  # one row for each length of vectors
    dealt = points.withColumn("dims", F.size("vector")).join(sizes, "dims")
    dealt = dealt.withColumn("shard", F.pmod(F.col("k2"), F.col("shards")).cast("int"))
    index = store(dealt.select("dims", "shard", "k1", "k2", "vector", "ids").groupBy("dims", "shard").applyInArrow(lambda table: _build(table, beam), INDEX), "graph-index")

    asked = store(rows.where(is_query).groupBy("k1", "k2", "id").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("times")), "asked")
    texts = asked.groupBy("k1", "k2").agg(F.first("vector").alias("vector")).withColumn("dims", F.size("vector"))
    blocks = max(1, math.ceil(asked.count() / block))
    packed = (
        texts.withColumn("block", F.pmod(F.col("k1"), F.lit(blocks))).groupBy("dims", "block")
        .applyInArrow(_pack, "dims int, queries binary, query_keys binary").join(sizes, "dims")
        .select("dims", "queries", "query_keys", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    )
    found = packed.join(index, ["dims", "shard"]).repartition(F.xxhash64("query_keys", "shard")).mapInArrow(_search(k + 1, np.float32 if part == "float" else np.float64), FOUND)
    best = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), F.element_at("ids", 1), "k1", "k2")
    merged = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth")
    query = asked.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("id").alias("query_id"), "times")
    own = (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2"))
    others = F.expr("filter(ids, (x, i) -> i + 1 <> array_position(ids, query_id))")
    each = merged.join(query, ["q1", "q2"]).withColumn("vec_id", F.explode(F.when(own, others).otherwise(F.col("ids"))))
    ranks = Window.partitionBy("q1", "q2", "query_id").orderBy(F.desc("score"), "vec_id", "k1", "k2")
    ranked = each.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).drop("copy")
