"""What each of several filters removes, alone and together: an audit by the Hart-Mas-Colell potential.

Each document becomes the set of filters it fails, and only the number of documents for each of the 2**5 sets is kept.  In
the removal game a coalition of filters is worth the documents that it removes, v(S).  The potential is P(0) = 0 and
P(S) = (v(S) + sum of P(S without i) over its members) / |S|; a filter's Shapley value is P(all) - P(all without it).  What
a filter removes at a step of an order is the difference of two coalitions.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import WORD

#: The filters' letters, the bit of each being its place.
FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
COPY = 1 << FILTERS.index("E")


def _judged(rows: DataFrame) -> DataFrame:
    """Replace ``text`` by its digest and ``flags``, the bits of the filters A to D that it fails."""
    text, words = F.col("text"), F.col("words")
    bit = lambda letter, failed: F.when(failed, 1 << FILTERS.index(letter)).otherwise(0)
    flags = (
        bit("A", F.size(words) < 200) + bit("B", 100 * F.size(F.array_distinct(words)) < 50 * F.size(words))
        + bit("C", 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text)) + bit("D", text.rlike(r"[#$%&*|]"))
    )
    split = rows.withColumn("words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    return split.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), flags.alias("flags"))


def failures(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail exactly the filters of ``mask``.

    Copies are never gathered: documents of one text are counted by (text, part, labels), each count knowing its
    smallest id and how many documents carry it; all others of that text have a smaller one before them.
    """
    rows = _judged(docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    ))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    # Equal rows first, so that one id or text that many rows share arrives as few.
    counted = rows.groupBy("id", "digest", "part", "flags").agg(F.count(F.lit(1)).alias("n"))
    # Rows without an id have no labels and are spread by their text.
    counted = counted.withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("bigint")))
    labelled = counted.join(known.withColumn("salt", F.lit(0).cast("bigint")), ["id", "salt"], "left").fillna(0, ["good", "toxic"])
    named = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    cell = ["digest", "part", "flags", "good", "toxic"]
    # One row for each id of a cell: ids of one digest differ in part or labels only if rows repeat with other values.
    cells = labelled.groupBy(*cell, "id", "salt").agg(F.sum("n").alias("n")).groupBy(*cell).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"), F.min(named).alias("first"))
    smallest = cells.groupBy("digest").agg(F.min("first.id").alias("least"))
    origin = F.col("unnamed") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    split = cells.join(smallest, "digest").select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("flags").alias("mask"), origin.alias("n")), F.struct((F.col("flags") + COPY).alias("mask"), (F.col("n") - origin).alias("n")),
        )).alias("e"),
    ).select("part", "good", "toxic", "e.*")
    n = F.col("n")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("good") * n).alias("good"), F.sum(F.col("toxic") * n).alias("toxic"))


def _values(counts: DataFrame) -> DataFrame:
    """(part, total, exact, v, good, toxic): documents by mask, and what each coalition removes, as lists of 2**5."""
    masks = F.lit(list(range(ALL + 1)))
    sums = {}
    for c in ("n", "good", "toxic"):
        # A mask's documents count for every coalition that has one of its filters.
        sums[c] = [F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(c)).otherwise(0)) for s in range(ALL + 1)]
    by = counts.groupBy("part").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("mask", "n"))).alias("m"),  # 32 entries at most
        F.array(*sums["n"]).alias("v"), F.array(*sums["good"]).alias("good"), F.array(*sums["toxic"]).alias("toxic"),
    )
    return by.withColumn("exact", F.transform(masks, lambda s: F.coalesce(F.try_element_at("m", s), F.lit(0)))).drop("m")


def potentials(v: Column, players: int = len(FILTERS)) -> Column:
    """players! times the potential of every coalition, in the order of their bits; whole numbers.

    A coalition's subsets come before it, so one pass over the 2**players coalitions fills the list.
    """
    bit = lambda s, i: F.shiftright(s, i).bitwiseAND(F.lit(1))

    def step(done: Column, s: Column) -> Column:
        without = sum((F.when(bit(s, i) == 1, F.get(done, s - (1 << i))).otherwise(0) for i in range(players)), F.lit(0))
        members = sum((bit(s, i) for i in range(players)), F.lit(0))
        worth = F.get(v, s) * factorial(players) + without
        return F.concat(done, F.array(F.call_function("div", worth, members)))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << players) - 1)), F.array(F.lit(0).cast("bigint")), step)


def audit(counts: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step; see the module's text.

    ``counts`` as ``failures`` gives them.  A part without documents does not occur.
    """
    p = potentials(F.col("v"))
    orders = ["".join(o) for o in permutations(FILTERS)]
    parts = _values(counts).withColumn("p", p)
    steps = F.lit(list(range(1, len(FILTERS) + 1)))
    rows = parts.withColumn("filter_order", F.explode(F.lit(orders))).withColumn("step", F.explode(steps))
    bit_of = lambda i: F.element_at(F.lit([1 << k for k in range(len(FILTERS))]), F.call_function("instr", F.lit(FILTERS), F.substring("filter_order", i, 1)))
    bits = lambda upto: sum((F.when(F.lit(i) <= upto, bit_of(i)).otherwise(0) for i in range(1, len(FILTERS) + 1)), F.lit(0))
    rows = rows.withColumns({"s": bits(F.col("step")), "before": bits(F.col("step") - 1)}).withColumn("own", F.col("s") - F.col("before"))
    at = lambda c, s: F.get(F.col(c), s)
    removed = at("v", F.col("s")) - at("v", F.col("before"))
    return rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), (F.col("total") - at("v", F.col("s"))).alias("kept"), removed.alias("removed"),
        (at("v", F.col("own")) - removed).alias("redundant"), at("exact", F.col("own")).alias("unique_fails"),
        (at("good", F.col("s")) - at("good", F.col("before"))).alias("good_lost"), (at("toxic", F.col("s")) - at("toxic", F.col("before"))).alias("toxic_lost"),
        (at("p", F.lit(ALL)) - at("p", F.lit(ALL) - F.col("own"))).alias("shapley"),
    )
