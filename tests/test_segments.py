"""Segmented passes equal the plain window, however small the segments are."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyweave.plans.segments import dense_number, nearest_site, ordinal_segment, segmented


def _rows(seed: int, n: int = 400):
    rnd = random.Random(seed)
    # One key holds most rows.
    keys = ["hot"] * 7 + ["a", "b", "c"]
    seqs = rnd.sample(range(5000), n)
    return [(rnd.choice(keys), s, rnd.choice([None, rnd.randint(-5, 9)])) for s in seqs]


@pytest.mark.parametrize("bits", [0, 3, 7, 20])
def test_all_outputs(spark, bits):
    df = spark.createDataFrame(_rows(bits), "k string, seq bigint, v bigint")
    v = F.col("v")
    got = segmented(
        df, ["k"], ["seq"], ordinal_segment("seq", bits), rank="rn", running={"run": v}, totals={"tot": v},
        carry={"car": v}, prior={"pri": v}, ahead={"ahe": v}, previous={"pre": v},
    )
    w = Window.partitionBy("k").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "*", F.row_number().over(w).cast("bigint").alias("rn"), F.sum("v").over(upto).alias("run"),
        F.sum("v").over(Window.partitionBy("k")).alias("tot"), F.last("v", True).over(upto).alias("car"),
        F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("pri"),
        F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("ahe"), F.lag("v").over(w).alias("pre"),
    )
    cols = ["k", "seq", "v", "rn", "run", "tot", "car", "pri", "ahe", "pre"]
    assert sorted(got.select(cols).collect(), key=lambda r: r.seq) == sorted(want.select(cols).collect(), key=lambda r: r.seq)


@pytest.mark.parametrize("bits", [0, 4, 20])
def test_dense_number(spark, bits):
    rnd = random.Random(bits)
    df = spark.createDataFrame([(rnd.choice(["hot", "hot", "x"]), rnd.randint(0, 300)) for _ in range(500)], "k string, n bigint")
    got = dense_number(df, ["k"], "n", "no", bits).distinct().collect()
    want = df.select("k", "n", F.dense_rank().over(Window.partitionBy("k").orderBy("n")).cast("bigint").alias("no")).distinct().collect()
    assert sorted(got) == sorted(want)


def test_nearest_site(spark):
    rnd = random.Random(3)
    pts = [(rnd.choice("pq"), i, float(rnd.randint(0, 200))) for i in range(200)]
    sites = [(rnd.choice("pq"), i, float(rnd.randint(0, 200))) for i in range(20)]
    got = nearest_site(
        spark.createDataFrame(pts, "k string, id bigint, x double"), spark.createDataFrame(sites, "k string, site bigint, x double"),
        ["k"], "x", "site", 16.0,
    ).collect()
    for r in got:
        assert r.site == min((abs(x - r.x), i) for k, i, x in sites if k == r.k)[1]
    assert len(got) == len(pts)
