"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / source size times.  The whole part of that ratio is taken
outright; the fractional part is a probability.  Two documents transfer probability mass, weighed by their words,
at random and without changing either's expectation, until one of them is 0 or 1; the other goes on to the next
document.  The sum of expected words never changes, so what a source takes differs from its target by less than one
of its documents.  Documents are dealt over blocks; each block leaves one fractional document at most, and these meet
in a tree of blocks of blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import Batches, store
from .words import WORD
from .words import mix as mix_bits

#: Rows of a block on average, and blocks that meet in one block of the next level.
BLOCK = 1024
FAN = 64
#: Weights of the sources in their order, repeating; most copies of a document.
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 20


def words_in(text):
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, rows, source_size) with ``target`` added: shares of the total by weight, capped at ``most`` sizes.

    Sources by code point, null last, weigh ``weights``, repeating.  What a cap leaves over goes to the others by
    weight: with sources in order of cap / weight, the first k are capped where the remaining words for each unit of
    remaining weight no longer exceed the next one's cap / weight.  There is one row for each source here.
    """
    everything = Window.partitionBy()
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    cap = (F.col("source_size") * most).cast("double")
    ranked = (
        sizes.withColumn("weight", F.element_at(F.lit(list(weights)), (F.row_number().over(ordered) - 1) % len(weights) + 1).cast("double"))
        .withColumn("cap", cap)
        .withColumn("fill", F.col("cap") / F.col("weight"))
    )
    before = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / share)
    first = F.min_by(F.col("level"), F.struct("fill", F.col("source").isNull(), "source")).over(everything)
    fits = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", F.col("source").isNull().alias("last"), "source", "level"))).over(everything)
    return level.withColumn("at", F.coalesce(fits["level"], first)).select(
        "source", "rows", "source_size", F.least("cap", F.col("at") * F.col("weight")).alias("target")
    )


def _draws(u: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) that hang on ``u`` and ``salt``, but don't rise with ``u``."""
    bits = (u * float(1 << 52)).astype(np.uint64) ^ mix_bits(np.array([salt], dtype=np.uint64))
    return (mix_bits(bits + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(12)).astype(np.float64) / float(1 << 52)


def _pivot(last: bool, level: int):
    """Rows ordered by (source, block, u) with p in [0, 1]: copies where decided, else the p that is left.

    ``u`` gives the order only.  What is drawn is independent of it, of what was drawn before, and of other levels, so
    that no transfer changes an expectation; of rows with one ``u`` each has a draw of its own.
    Memory is one batch and one held row.  With ``last``, what is left at the end of a block is drawn.
    """
    def own(u: float, copy: int, what: int) -> float:
        return float(_draws(np.array([u]), (copy << 16) + (level << 2) + what)[0])

    def run(batches: Batches) -> Batches:
        held = None  # [one-row batch or None while in this batch, index, group, weight, p, (u, its number among equal ones)]
        before, copy = None, 0

        def settle(row: pa.RecordBatch, extra: float, p: float | None) -> pa.RecordBatch:
            done = p is None
            return pa.RecordBatch.from_arrays(
                [*(row.column(c) for c in KEYS), pa.array([None if done else p], pa.float64()), pa.array([extra if done else 0], pa.int64())],
                names=[*KEYS, "p", "extra"],
            )

        def close(h) -> pa.RecordBatch:
            return settle(h[0], float(own(*h[5], 1) < h[4]), None) if last else settle(h[0], 0, h[4])

        for batch in batches:
            n = batch.num_rows
            groups = list(zip(batch.column("source").to_pylist(), batch.column("block").to_pylist(), strict=True))
            weight, prob, places = (batch.column(c).to_pylist() for c in ("size", "p", "u"))
            draws = _draws(batch.column("u").to_numpy(), level << 2).tolist()
            left: list[float | None] = [None] * n
            extra = [0] * n
            out = []

            def decide(h, value: int, extra=extra, out=out) -> None:
                if h[0] is None:
                    extra[h[1]] = value
                else:
                    out.append(settle(h[0], value, None))

            for i in range(n):
                if held and held[2] != groups[i]:
                    if held[0] is None:
                        if last:
                            extra[held[1]] = int(own(*held[5], 1) < held[4])
                        else:
                            left[held[1]] = held[4]
                    else:
                        out.append(close(held))
                    held = None
                w, p, u = weight[i], prob[i], draws[i]
                copy = copy + 1 if before == (groups[i], places[i]) else 0
                before = (groups[i], places[i])
                if copy:
                    u = own(places[i], copy, 0)
                if w <= 0 or p <= 0 or p >= 1:
                    extra[i] = int(u < p)
                    continue
                new = [None, i, groups[i], w, p, (places[i], copy)]
                if held is None:
                    held = new
                    continue
                a, x, b, y = held[3], held[4], w, p
                to_new, to_held = min(x * a, (1 - y) * b), min((1 - x) * a, y * b)
                if u * (to_new + to_held) < to_held:  # towards the new row, as often as keeps the expectations
                    x, y = (0.0, y + to_new / b) if x * a <= (1 - y) * b else (x - to_new / a, 1.0)
                else:
                    x, y = (1.0, y - to_held / b) if (1 - x) * a <= y * b else (x + to_held / a, 0.0)
                held[4], new[4] = x, y
                open_rows = [r for r in (held, new) if 1e-12 < r[4] < 1 - 1e-12]
                for r in (held, new):
                    if r not in open_rows:
                        decide(r, int(r[4] > 0.5))
                held = open_rows[0] if open_rows else None
            keep = np.ones(n, dtype=bool)
            if held and held[0] is None:
                keep[held[1]] = False
                held[0] = batch.slice(held[1], 1)
            yield from out
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in KEYS), pa.array(left, pa.float64()), pa.array(extra, pa.int64())], names=[*KEYS, "p", "extra"],
            ).filter(pa.array(keep))
        if held:
            yield close(held)

    return run


KEYS = ("source", "block", "size", "u", "whole", "row")


def mix(df: DataFrame, source_col: str, size_col: str, draw_by: list[str], keep: list[str], weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
        block: int = BLOCK, fan: int = FAN, seed: int = SEED) -> DataFrame:
    """``keep`` columns of every row with size, source_size, target, copies and taken (size times copies).

    ``size_col`` holds each row's words.  Draws hang on ``draw_by`` and the seed alone, so reruns agree however the
    rows are spread; equal rows are interchangeable.  Null sources are one source, the last.  Rows without words add
    nothing and are drawn on their own.  An empty table gives an empty result.  The input is read twice; its kept
    columns are shuffled once, and the block step's result is written to the shared folder.
    """
    named = df.select(
        F.col(f"`{source_col}`").alias("source"), F.coalesce(F.col(f"`{size_col}`"), F.lit(0)).cast("bigint").alias("size"),
        (F.pmod(F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in draw_by)), F.lit(1 << 52)) / float(1 << 52)).alias("u"),
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"),
    )
    totals = named.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    aims = store(targets(totals, weights, most), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    # Nulls meet as one source.
    placed = (
        named.join(aims.withColumnRenamed("source", "aim"), F.col("source").eqNullSafe(F.col("aim")))
        .withColumn("whole", F.floor(ratio).cast("bigint"))
        .withColumn("p", ratio - F.floor(ratio))
        .withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "u"), F.ceil(F.col("rows") / block)))
    )
    row_kind = named.schema["row"].dataType.simpleString()
    kinds = f"source {named.schema['source'].dataType.simpleString()}, block bigint, size bigint, u double, whole bigint, row {row_kind}, p double, extra bigint"

    def level(rows: DataFrame, final: bool, number: int) -> DataFrame:
        ordered = rows.select(*KEYS, "p").repartition("source", "block").sortWithinPartitions("source", "block", "u", "size")
        return ordered.mapInArrow(_pivot(final, number), kinds)

    biggest = aims.agg(F.max("rows")).first()[0] or 1
    depth = math.ceil(math.log(max(1, math.ceil(biggest / block)), fan)) if biggest > block else 0
    parts, rest = [], placed
    for i in range(depth + 1):
        done = level(rest, i == depth, i)
        if i < depth:
            done = store(done, f"mix-level-{i}")
            rest = done.where("p IS NOT NULL").withColumn("block", F.floor(F.col("block") / fan))
        parts.append(done.where("p IS NULL"))
    decided = parts[0]
    for part in parts[1:]:
        decided = decided.unionByName(part)
    copies = F.col("whole") + F.col("extra")
    return decided.join(aims.withColumnRenamed("source", "aim"), F.col("source").eqNullSafe(F.col("aim"))).select(
        "row.*", F.col("size").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
