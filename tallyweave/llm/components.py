"""Connected components of a link table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point the larger (or the smaller) neighbours of every node at the least of its neighbourhood.

    The least is found by a grouped minimum and joined back, so a node with many neighbours is never gathered.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    near = both.join(least, "a")
    if large:
        out = near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge, root being the least node it is connected with.

    ``edges`` has columns a and b.  Each round's edges are written to the shared folder; rounds end when one changes
    nothing, which is after about the logarithm of the longest path.
    """
    now = store(edges.where("a <> b").select("a", "b").distinct(), "links")
    before = None
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    while True:
        state = now.agg(mark.alias("s")).first()["s"]
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = state
        now = store(_star(_star(now, True), False), "links")
