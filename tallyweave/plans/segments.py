"""Order-dependent work over groups of any size.

``Window.partitionBy(key).orderBy(ordinal)`` sends a whole group to one task.  A company
or period that holds a third of all rows would make that one task the job.  Here a group
is cut into *segments* along its own order:

1. inside a segment a plain window does the work (many tasks per group);
2. each segment is reduced to one row by a partially aggregated ``groupBy``;
3. a window over those few rows turns segment results into "everything before me";
4. the rows join their segment row on (group, segment), so no join key is hot.

Results are exact and do not depend on how the segments are cut, as long as the segment
column never decreases along the order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a segment for dense integer ordinals: at most 2**16 rows per window group.
SEGMENT_BITS = 16

_SEG = "__segment"


def ordinal_segment(column: str | Column, bits: int = SEGMENT_BITS) -> Column:
    """Segment number of an integer ordinal."""
    col = F.col(column) if isinstance(column, str) else column
    return F.shiftright(col.cast("bigint"), bits)


def segmented(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    *,
    rank: str | None = None,
    running: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    carry: Mapping[str, Column] | None = None,
    prior: Mapping[str, Column] | None = None,
    ahead: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add ordered columns computed over each ``keys`` group.

    rank      name of a row number (1..n) column
    running   name -> numeric value, summed from the first row up to this one
    totals    name -> numeric value, summed over the group
    carry     name -> value, the last non-null one up to and with this row
    prior     name -> value, the last non-null one before this row
    ahead     name -> value, the first non-null one from this row on
    previous  name -> value of the row before (null on the first row)

    ``keys`` and ``segment`` must not be null, ``order`` must be a total order (ascending)
    and ``segment`` must not decrease along it.
    """
    running, totals = dict(running or {}), dict(totals or {})
    carry, prior, previous = dict(carry or {}), dict(prior or {}), dict(previous or {})
    ahead = dict(ahead or {})
    keys, order = list(keys), list(order)

    base = df.withColumn(_SEG, segment)
    local = Window.partitionBy(*keys, _SEG).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.struct(*order)

    added: dict[str, Column] = {}
    reduced: list[Column] = []
    if rank:
        added["__rn"] = F.row_number().over(local).cast("bigint")
        reduced.append(F.count(F.lit(1)).alias("__n"))
    for name, value in running.items():
        added[f"__run_{name}"] = F.sum(value).over(upto)
        reduced.append(F.sum(value).alias(f"__s_{name}"))
    for name, value in totals.items():
        reduced.append(F.sum(value).alias(f"__t_{name}"))
    for name, value in {**carry, **prior}.items():
        frame = upto if name in carry else local.rowsBetween(Window.unboundedPreceding, -1)
        added[f"__c_{name}"] = F.last(value, ignorenulls=True).over(frame)
        reduced.append(F.max_by(F.struct(value.alias("v")), F.when(value.isNotNull(), at)).alias(f"__l_{name}"))
    for name, value in ahead.items():
        from_here = local.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        added[f"__a_{name}"] = F.first(value, ignorenulls=True).over(from_here)
        reduced.append(F.min_by(F.struct(value.alias("v")), F.when(value.isNotNull(), at)).alias(f"__f_{name}"))
    for name, value in previous.items():
        added[f"__p_{name}"] = F.lag(F.struct(value.alias("v"))).over(local)
        reduced.append(F.max_by(F.struct(value.alias("v")), at).alias(f"__e_{name}"))

    rows = base.withColumns(added) if added else base
    if rank or running or totals or ahead or previous:
        pieces = base.groupBy(*keys, _SEG).agg(*reduced)
    else:  # rows that carry nothing only tell that their segment is there, and needn't be sorted
        some = reduce(or_, (v.isNotNull() for v in (*carry.values(), *prior.values())))
        pieces = base.select(*keys, _SEG).distinct().join(base.where(some).groupBy(*keys, _SEG).agg(*reduced), [*keys, _SEG], "left")

    line = Window.partitionBy(*keys).orderBy(_SEG)
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets: list[Column] = []
    if rank:
        offsets.append(F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before_n"))
    for name in running:
        offsets.append(F.sum(f"__s_{name}").over(before).alias(f"__before_s_{name}"))
    for name in totals:
        offsets.append(F.sum(f"__t_{name}").over(whole).alias(f"__whole_{name}"))
    for name in (*carry, *prior):
        offsets.append(F.last(f"__l_{name}", ignorenulls=True).over(before).alias(f"__before_l_{name}"))
    after = line.rowsBetween(1, Window.unboundedFollowing)
    for name in ahead:
        offsets.append(F.first(f"__f_{name}", ignorenulls=True).over(after).alias(f"__after_{name}"))
    for name in previous:
        offsets.append(F.lag(f"__e_{name}").over(line).alias(f"__before_e_{name}"))
    pieces = pieces.select(*keys, _SEG, *offsets)

    if added:  # the windows have dealt and sorted the rows by segment already, so segments needn't be broadcast
        pieces = pieces.hint("merge")
    joined = rows.join(pieces, [*keys, _SEG])
    out = [F.col(c) for c in df.columns]
    if rank:
        out.append((F.col("__rn") + F.col("__before_n")).cast("bigint").alias(rank))
    for name in running:
        here, earlier = F.col(f"__run_{name}"), F.col(f"__before_s_{name}")
        out.append(F.coalesce(here + earlier, here, earlier).alias(name))
    for name in totals:
        out.append(F.col(f"__whole_{name}").alias(name))
    for name in (*carry, *prior):
        out.append(F.coalesce(F.col(f"__c_{name}"), F.col(f"__before_l_{name}.v")).alias(name))
    for name in ahead:
        out.append(F.coalesce(F.col(f"__a_{name}"), F.col(f"__after_{name}.v")).alias(name))
    for name in previous:
        held = F.coalesce(F.col(f"__p_{name}"), F.col(f"__before_e_{name}"))
        out.append(held["v"].alias(name))
    return joined.select(*out)


def dense_number(
    df: DataFrame, keys: Sequence[str], value: str, name: str, bits: int = SEGMENT_BITS
) -> DataFrame:
    """Dense rank of a non-negative integer ``value`` inside ``keys``.

    Rows may share a value (they then share the number); the group may be of any size.
    """
    keys = list(keys)
    seg = ordinal_segment(value, bits)
    distinct_per_segment = (
        df.select(*keys, value).distinct()
        .withColumn(_SEG, seg)
        .groupBy(*keys, _SEG)
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    before = Window.partitionBy(*keys).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
    offsets = distinct_per_segment.select(
        *keys, _SEG, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before_n")
    )
    local = Window.partitionBy(*keys, _SEG).orderBy(value)
    ranked = df.withColumn(_SEG, seg).withColumn("__rn", F.dense_rank().over(local))
    return ranked.join(offsets, [*keys, _SEG]).select(
        *df.columns, (F.col("__rn") + F.col("__before_n")).cast("bigint").alias(name)
    )


def nearest_site(
    points: DataFrame,
    sites: DataFrame,
    keys: Sequence[str],
    position: str,
    site_index: str,
    segment_width: float,
) -> DataFrame:
    """For each point the site with the closest position; the lower index wins a tie.

    A one-dimensional nearest neighbour is the closer of "last site before" and "first site
    after": one ordered pass, no pairwise comparison.  Adds ``<site_index>``.
    """
    keys = list(keys)
    unique_sites = sites.groupBy(*keys, position).agg(F.min(site_index).alias("__site"))
    pts = points.withColumn("__pt", F.struct(*points.columns))
    both = unique_sites.select(
        *keys, F.col(position).cast("double").alias("__pos"), F.lit(0).alias("__kind"),
        F.struct(F.col(position).cast("double").alias("p"), F.col("__site").alias("i")).alias("__s"),
        F.lit(None).cast(pts.schema["__pt"].dataType).alias("__pt"), F.lit(0).cast("bigint").alias("__tie"),
    ).unionByName(
        pts.select(
            *keys, F.col(position).cast("double").alias("__pos"), F.lit(1).alias("__kind"),
            F.lit(None).cast("struct<p:double,i:bigint>").alias("__s"), "__pt",
            F.xxhash64(*points.columns).alias("__tie"),
        )
    )
    out = segmented(
        both, keys, ["__pos", "__kind", "__tie"], F.floor(F.col("__pos") / segment_width),
        carry={"__lo": F.col("__s")}, ahead={"__hi": F.col("__s")},
    ).where("__kind = 1")

    def cand(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.p") - F.col("__pos")), F.col(f"{c}.i").alias("i")))

    best = F.least(cand("__lo"), cand("__hi"))
    return out.select("__pt.*", best["i"].alias(site_index))
