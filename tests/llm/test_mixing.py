from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyweave.llm.mixing import mix, targets


def fill(sizes):
    """Share by weight, cap, and share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: float((1, 2, 3)[i % 3]) for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        unit = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if unit * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else unit * weight[s] for s in names}
        capped |= over


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    pick = random.Random(seed)
    sizes = {f"s{i}": pick.choice([0, 1, 10, 1000, 100000]) for i in range(pick.randrange(1, 9))} | {None: 50}
    df = spark.createDataFrame([(k, 1, v) for k, v in sizes.items()], "source string, rows bigint, source_size bigint")
    got = {r.source: r.target for r in targets(df).collect()}
    want = fill(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * (1 + want[k]) for k in want)


def rows(n, seed=1):
    pick = random.Random(seed)
    return [(i, pick.choice(["hot", "hot", "a", "b", None]), pick.choice([0, 1, 7, 50, 400])) for i in range(n)] + [(5, "a", 7)] * 40


@pytest.mark.parametrize("block,fan", [(1 << 20, 64), (16, 2), (50, 4)])
def test_taken_is_near_target_and_agrees(spark, block, fan):
    df = spark.createDataFrame(rows(3000), "doc_id bigint, source string, size bigint").withColumn("copies", F.lit("clash"))
    run = lambda d: mix(d, "source", "size", ["doc_id"], ["doc_id", "source"], block=block, fan=fan)
    got = run(df).collect()
    assert len(got) == df.count() and all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in got)
    by = {}
    for r in got:
        t = by.setdefault(r.source, [0, r.target, r.source_size])
        t[0] += r.taken
    assert all(abs(taken - target) <= 400 for taken, target, _ in by.values())
    assert sorted(map(str, got)) == sorted(map(str, run(df.repartition(13).orderBy(F.desc("doc_id"))).collect()))


def test_expectation(spark):
    """Over many seeds each document is taken about ratio times on average."""
    df = spark.createDataFrame([(i, "a" if i < 30 else "b", 10 + i % 7) for i in range(60)], "doc_id bigint, source string, size bigint")
    total = None
    for seed in range(20):
        part = mix(df, "source", "size", ["doc_id"], ["doc_id"], block=8, fan=2, seed=seed * 7)
        total = part if total is None else total.unionByName(part)
    means = total.groupBy("doc_id").agg(F.avg("copies").alias("m"), F.first("target").alias("t"), F.first("source_size").alias("s")).collect()
    assert all(abs(r.m - r.t / r.s) < 0.5 for r in means)
    assert abs(sum(r.m - r.t / r.s for r in means)) < 1


def test_sizes_do_not_bias_the_draw(spark):
    """190 short documents and 10 that are a hundred times as long, over many seeds in groups: each kind is taken as often as its share asks for."""
    pick = [(k, i, f"s{k:03d}", 1000 if i < 10 else 10) for k in range(150) for i in range(200)]
    df = spark.createDataFrame(pick, "run int, doc_id bigint, source string, size bigint").withColumn("seed", F.xxhash64("run", "doc_id"))
    for block, fan in ((1 << 20, 64), (16, 2)):
        got = mix(df, "source", "size", ["seed"], ["run", "doc_id"], block=block, fan=fan)
        short = F.col("size") == 10
        sums = got.groupBy((F.col("run") % 3).alias("kind"), short.alias("short")).agg(
            F.avg("copies").alias("m"), F.avg(F.col("target") / F.col("source_size")).alias("p")).collect()
        # 1 : 2 : 3 over equal sources are ratios of 0.5, 1 and 1.5.
        assert len(sums) == 6 and {round(r.p, 6) for r in sums} == {0.5, 1.0, 1.5}
        assert all(abs(r.m - r.p) < (0.02 if r.short else 0.05) for r in sums), sums


def test_empty_and_wordless(spark):
    schema = "doc_id bigint, source string, size bigint"
    assert mix(spark.createDataFrame([], schema), "source", "size", ["doc_id"], ["doc_id"]).count() == 0
    assert [(r.copies, r.target) for r in mix(spark.createDataFrame([(1, None, 0)], schema), "source", "size", ["doc_id"], ["doc_id"]).collect()] == [(0, 0.0)]
