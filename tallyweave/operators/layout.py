"""Positioned text: rows, columns, regions, labels and receipts.

Spans are (page_id, span_id, x0, y0, x1, y1, text, size).  What depends on order is computed
over distinct positions or over segments of a page, so a page of any size is shared by many
tasks; what depends on neighbours is an equality join on positions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (
    BAND_TOLERANCE, BRANCH_PATTERN, COLUMN_STATEMENT_HEADER, COMPANY_PATTERN, GRID_RECEIPT_BANK, GRID_RECEIPT_BASE,
    GRID_RECEIPT_FIELDS, GRID_RECEIPT_TITLES, LABEL_PARTS, LABEL_WORDS, PARTY_NOISE_PATTERN, RECEIPT_TITLES,
)
from ..functions.amounts import amount_strict
from ..functions.dates import date_iso
from ..functions.text import compact_ws, lookup, normalize_key, strip
from ..plans.segments import nearest_site, ordinal_segment, segmented
from ..session import materialize, spread
from .normalize import business_type, receipt_number, verify_code

#: Height of a page segment in points.
BAND_HEIGHT = 32.0


def _band(c: str) -> Column:
    return F.floor(F.col(c).cast("double") / BAND_HEIGHT)


def gap_clusters(spans: DataFrame, gap: float = 2.0, key: str = "page_id") -> DataFrame:
    """Add ``cluster`` 1..k per page: a new row of text starts after a vertical gap.

    Spans are dealt once, by bands of a page, and gaps are found inside them; only heights are read for the bands to tell
    each other where they start.
    """
    band = Window.partitionBy(key, "__band").orderBy("y0")
    jump = F.coalesce(F.col("y0") - F.lag("y0").over(band) > gap, F.lit(False)).cast("int")
    rows = spans.withColumn("__band", _band("y0")).withColumn("__jump", jump)
    bands = rows.groupBy(key, "__band").agg(F.sum("__jump").alias("__n"), F.min("y0").alias("__lo"), F.max("y0").alias("__hi"))
    page = Window.partitionBy(key).orderBy("__band")
    opens = F.coalesce(F.col("__lo") - F.lag("__hi").over(page) > gap, F.lit(True)).cast("int")
    bands = bands.withColumn("__opens", opens).select(
        key, "__band",
        (F.sum(F.col("__n") + F.col("__opens")).over(page.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__base"),
    )
    # Up to and with all spans of a height, so that these have one number however they are ordered.
    here = F.sum("__jump").over(band.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("__here", here).join(bands.hint("merge"), [key, "__band"]).select(
        *spans.columns, (F.col("__base") + F.col("__here")).cast("bigint").alias("cluster"))


def column_band(x: Column, bands: Mapping[str, tuple[float, float]], tolerance: float = BAND_TOLERANCE) -> Column:
    """Name of the first band holding x, else of the nearest centre within twice the tolerance."""
    inside = None
    for name, (lo, hi) in bands.items():
        cond = x.between(lo, hi)
        inside = F.when(cond, name) if inside is None else inside.when(cond, name)
    near = F.least(*(
        F.struct(F.abs(x.cast("double") - (lo + hi) / 2).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("n"))
        for i, (name, (lo, hi)) in enumerate(bands.items())
    ))
    return F.coalesce(inside, F.when(near["d"] < 2 * tolerance, near["n"]))


#: Fragments of one text that are gathered at once.
FOLD_ROWS = 4096
#: Spans of a header that are read at once, one after the other.
STATE_ROWS = 512


def folded_texts(df: DataFrame, keys: Sequence[str], order: Sequence[str], texts: Mapping[str, Column], sep: str, rows: int = FOLD_ROWS) -> DataFrame:
    """One row per key with several texts, each joined in order from the rows where its expression isn't null.

    A key's rows are numbered in order, which Spark sorts and spills; runs of ``rows`` become partial texts, and these
    the whole ones.  No array is longer than a run or than the number of runs.  One shuffle, by the keys: the runs of a
    key are folded where it was numbered.  A text without a fragment is empty.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    pieces = df.select(*keys, place.alias("__at"), *(value.alias(name) for name, value in texts.items()))

    def fold(some: DataFrame, by: Sequence[str | Column]) -> DataFrame:
        each = F.array_sort(F.collect_list(F.struct("__at", *texts)))
        return some.groupBy(*by).agg(each.alias("__all"))

    def joined(name: str) -> Column:
        own = F.filter(F.transform("__all", lambda p: p[name]), lambda t: t.isNotNull())
        return F.when(F.size(own) > 0, F.array_join(own, sep)).alias(name)

    runs = fold(pieces, [*keys, F.floor((F.col("__at") - 1) / rows).alias("__run")])
    partial = runs.select(*keys, F.col("__run").alias("__at"), *(joined(name) for name in texts))
    return fold(partial, keys).select(*keys, *(F.coalesce(joined(name), F.lit("")).alias(name) for name in texts))


def ordered_text(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str = "text", sep: str = "", rows: int = FOLD_ROWS
) -> DataFrame:
    """Fragments of one cell or column joined in order.  The result is one text per key."""
    return folded_texts(df, keys, order, {text: F.col(text)}, sep, rows)


def table_regions(
    spans: DataFrame, titles: Sequence[str], fallback: float = 105.0, require_all: bool = False, gap: float = 2.5
) -> DataFrame:
    """(page_id, table_start, table_end) from the column titles and the last row that looks like data."""
    return _regions(gap_clusters(spans, gap), titles, fallback, require_all)


def _regions(clustered: DataFrame, titles: Sequence[str], fallback: float, require_all: bool) -> DataFrame:
    return _bounds(clustered.withColumns(_marks(titles, require_all)), fallback)


def _marks(titles: Sequence[str], require_all: bool) -> dict[str, Column]:
    """What a region is found by, per span: a date, an amount, the height of a title."""
    marks = [F.col("text").contains(t) for t in titles]
    titled = marks[0]
    for m in marks[1:]:
        titled = (titled & m) if require_all else (titled | m)
    return {
        "__date": F.col("text").rlike(r"\d{8}"), "__money": F.col("text").rlike(r"-?\d[\d,]*\.\d{2}"),
        "__title": F.when(titled, F.col("y0")),
    }


def _bounds(marked: DataFrame, fallback: float) -> DataFrame:
    """(page_id, table_start, table_end) of clustered spans with their marks."""
    rows = marked.groupBy("page_id", "cluster").agg(
        F.max("__date").alias("d"), F.max("__money").alias("a"), F.max("y1").alias("bottom"), F.min("__title").alias("title"))
    data = F.col("d") & F.col("a")
    pages = rows.groupBy("page_id").agg(
        F.coalesce(F.min("title") - 5, F.lit(fallback)).cast("double").alias("table_start"),
        F.max_by(F.when(data, F.col("bottom")), F.when(data, F.col("cluster"))).cast("double").alias("__data"),
        F.max("bottom").cast("double").alias("__all"),
    )
    return pages.select(
        "page_id", "table_start",
        F.when(F.col("__data") > F.col("table_start"), F.col("__data") + 10).otherwise(F.col("__all")).alias("table_end"),
    )


def partition_spans(spans: DataFrame, titles: Sequence[str], **kw) -> DataFrame:
    """Add ``part``: header, table or footer."""
    y = F.col("y0").cast("double")
    part = F.when(y < F.col("table_start") - 5, "header").when(y <= F.col("table_end") + 5, "table").otherwise("footer")
    return spans.join(table_regions(spans, titles, **kw), "page_id").withColumn("part", part).select(*spans.columns, "part")


def merge_continuations(rows: DataFrame, is_record: Column) -> DataFrame:
    """Add ``record`` to the spans of text rows (page_id, cluster, ...).

    ``is_record`` is an aggregate over one text row that tells whether it starts a record;
    rows before the first record are dropped.
    """
    lines = rows.groupBy("page_id", "cluster").agg(is_record.cast("bigint").alias("__starts"))
    return rows.join(_numbered(lines), ["page_id", "cluster"])


def _numbered(lines: DataFrame) -> DataFrame:
    """Text rows (page_id, cluster, __starts, ...) with the number of their record, from the first record on.

    They are as many as the tables have lines, yet a file of them is small: numbers that rise by one and equal heights
    pack well.  The planner would broadcast them by that, so they ask for a sort-merge join.
    """
    return segmented(
        lines, ["page_id"], ["cluster"], ordinal_segment("cluster", 12), running={"record": F.col("__starts")}
    ).where("record > 0").drop("__starts").hint("merge")


def table_records(
    spans: DataFrame, titles: Sequence[str], bands: Mapping[str, tuple[float, float]], amounts: Sequence[str],
    require_all: bool = False, gap: float = 2.5, labels: Sequence[str] = (),
) -> DataFrame:
    """Page spans to one row of texts per table record: cluster, cut out the table, assign columns, merge.

    A record starts at a text row with a date and one of the ``amounts`` columns.  The
    fragments of a column are joined by blanks, text row by text row and left to right.
    ``labels`` are column titles, which are no values of a record.
    """
    text, column = strip(F.col("text")), column_band(F.col("x0"), bands)
    if labels:
        column = F.when(~text.isin(*labels), column)
    # Regions, records and texts all read the clustered spans: they are written once, with what is read off each span.
    clustered = gap_clusters(spans.select("page_id", "span_id", "x0", "y0", "y1", "text"), gap)
    clustered = materialize(clustered.select(
        "page_id", "cluster", "span_id", "x0", "y0", "y1", *(v.alias(k) for k, v in _marks(titles, require_all).items()),
        column.alias("column"), F.when(column.isNotNull(), text).alias("text")), "clusters")
    placed = clustered.where("column IS NOT NULL")
    inside = F.col("y0").cast("double").between(F.col("table_start") - 5, F.col("table_end") + 5)
    has = lambda names: F.col("column").isin(*names) & (F.col("text") != "")
    seen = placed.select("page_id", "cluster", "y0", has(["date"]).alias("__dated"), has(amounts).alias("__paid"))
    # Text rows are few beside spans: they carry the region, so that spans meet them and not the pages.
    lines = seen.join(_bounds(clustered, 105.0), "page_id").where(inside).groupBy("page_id", "cluster").agg(
        (F.max("__dated") & F.max("__paid")).cast("bigint").alias("__starts"),
        F.max("table_start").alias("table_start"), F.max("table_end").alias("table_end"))
    merged = placed.join(_numbered(materialize(lines, "lines")), ["page_id", "cluster"]).where(inside)
    texts = {name: F.when(F.col("column") == name, F.col("text")) for name in bands}
    return folded_texts(merged, ["page_id", "record"], ["cluster", "y0", "x0", "span_id"], texts, " ")


def split_receipts(spans: DataFrame) -> DataFrame:
    """Add ``receipt``: the last title at or above (5 points of slack); 0 on pages without titles."""
    title = compact_ws(F.col("text")).rlike("|".join(RECEIPT_TITLES)) & F.col("size").between(12, 16)
    return anchor_intervals(spans, title, slack=5.0, out="receipt")


def anchor_intervals(spans: DataFrame, is_anchor: Column, slack: float = 0.0, out: str = "anchor") -> DataFrame:
    """Give each span the id of the last anchor whose y - slack is not below it.

    An as-of pass over the page order.  Spans above the first anchor are dropped; a page
    without anchors is one group, 0.
    """
    keep = F.struct(*spans.columns)
    rows = spans.select(
        "page_id", F.col("y0").cast("double").alias("__pos"), F.lit(1).alias("__kind"), "span_id", keep.alias("__row"),
        F.lit(None).cast("bigint").alias("__anchor"), F.lit(0).alias("__is"),
    )
    anchors = spans.where(is_anchor).select(
        "page_id", (F.col("y0").cast("double") - slack).alias("__pos"), F.lit(0).alias("__kind"), "span_id",
        F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), F.col("span_id").cast("bigint").alias("__anchor"),
        F.lit(1).alias("__is"),
    )
    done = segmented(
        rows.unionByName(anchors), ["page_id"], ["__pos", "__kind", "span_id"], _band("__pos"),
        carry={out: F.col("__anchor")}, totals={"__anchors": F.col("__is")},
    ).where("__kind = 1")
    group = F.when(F.col("__anchors") == 0, F.lit(0)).otherwise(F.col(out)).cast("bigint")
    return done.withColumn(out, group).where(F.col(out).isNotNull()).select("__row.*", out)


def nearest_values(spans: DataFrame, keyword: str, reach: int = 5) -> DataFrame:
    """(page_id, value): number in or beside the first label with the keyword.

    A number inside the label wins; else the closest neighbour in reading order on the same
    line, the one after before the one before.  Each label looks up its ten positions.
    """
    placed = segmented(spans, ["page_id"], ["y0", "x0", "span_id"], _band("y0"), rank="__i")
    labels = placed.where(F.col("text").contains(keyword)).groupBy("page_id").agg(
        F.min_by(F.struct(F.col("__i").alias("i"), F.col("y0").alias("y"), "text"), "__i").alias("l")
    )
    steps = F.array(*(F.lit(s) for k in range(1, reach + 1) for s in (k, -k)))
    spots = labels.select("page_id", F.col("l.y").alias("__y"), F.posexplode(steps).alias("__pref", "__step"), F.col("l.i").alias("__li"))
    beside = spots.withColumn("__i", F.col("__li") + F.col("__step")).join(
        placed.select("page_id", "__i", "y0", strip(F.col("text")).alias("v")), ["page_id", "__i"]
    ).where((F.abs(F.col("y0") - F.col("__y")) < 3) & F.col("v").rlike(r"^-?\d[\d,]*\.\d{2}$"))
    near = beside.groupBy("page_id").agg(F.min_by("v", "__pref").alias("__near"))
    inline = F.nullif(F.regexp_extract("l.text", r"(\d[\d,]*\.\d{2})", 1), F.lit(""))
    return labels.join(near, "page_id", "left").select(
        "page_id", F.col("l.text").alias("label"), F.coalesce(inline, F.col("__near")).alias("value")
    )


def is_label(text: Column) -> Column:
    """The text is a form label or noise, not a value."""
    t = strip(text)
    short = F.length(t)
    within = F.lit(False)
    for w in LABEL_WORDS:
        within = within | F.lit(w).contains(t)
    named = t.isin(*LABEL_WORDS) | ((short <= 4) & within)
    return (short <= 20) & (named | (t.rlike("|".join(LABEL_PARTS)) & (short <= 8)))


def right_neighbours(blocks: DataFrame, label: Column, value_pattern: str | None = None) -> DataFrame:
    """(page_id, label_id, value): nearest value right of each label block, -10 < dx < 500, |dy| <= 40.

    blocks (page_id, span_id, x0, x1, cy, text).  Blocks and labels at the same spot are
    reduced to one beforehand.  Spots are binned by height (40) and position (510), so a
    label spot meets the value spots of six bins only, however many blocks share them.
    """
    xw, yw = 510.0, 40.0
    labels = blocks.where(label).select(
        "page_id", F.col("span_id").alias("label_id"), F.col("x0").alias("__own"), F.col("x1").alias("lx"), F.col("cy").alias("ly"))
    ok = ~is_label(F.col("text"))
    if value_pattern:
        ok = ok & strip(F.col("text")).rlike(f"^({value_pattern})")
    # Two blocks per spot, so that a label that is itself a candidate can skip itself.
    first = F.struct("span_id", strip(F.col("text")).alias("v"))
    values = blocks.where(ok).groupBy("page_id", "x0", "cy").agg(
        F.min_by(first, "span_id").alias("a"), F.max_by(first, "span_id").alias("z")
    ).withColumns({"__bx": F.floor(F.col("x0") / xw), "__by": F.floor(F.col("cy") / yw)})
    spots = labels.groupBy("page_id", "lx", "ly", "__own").agg(F.min("label_id").alias("__l"))
    near = spots.withColumn("__by", F.explode(F.sequence(F.floor((F.col("ly") - yw) / yw), F.floor((F.col("ly") + yw) / yw)))).withColumn(
        "__bx", F.explode(F.sequence(F.floor((F.col("lx") - 10) / xw), F.floor((F.col("lx") + 500) / xw)))
    )
    dx = F.col("x0") - F.col("lx")
    hit = near.join(values, ["page_id", "__bx", "__by"]).where((dx > -10) & (dx < 500) & (F.abs(F.col("cy") - F.col("ly")) <= yw))
    # Best spot that is not the label's own, and the label's own spot if it qualifies.
    own = (F.col("x0") == F.col("__own")) & (F.col("cy") == F.col("ly"))
    order = F.struct(dx.alias("dx"), F.col("a.span_id").alias("i"))
    found = hit.groupBy("page_id", "lx", "ly", "__own").agg(
        F.min_by(F.struct(order.alias("o"), F.col("a.v").alias("v")), F.when(~own, order)).alias("__other"),
        F.max(F.when(own, F.struct(order.alias("o"), "a", "z"))).alias("__same"),
    )
    mine = F.when(F.col("label_id") == F.col("__same.a.span_id"), F.when(
        F.col("__same.z.span_id") != F.col("label_id"),
        F.struct(F.struct(F.col("__same.o.dx").alias("dx"), F.col("__same.z.span_id").alias("i")).alias("o"), F.col("__same.z.v").alias("v")),
    )).otherwise(F.struct(F.col("__same.o").alias("o"), F.col("__same.a.v").alias("v")))
    mine = F.when(F.col("__same").isNotNull(), mine)
    best = F.least(mine, F.col("__other"))
    return labels.join(found, ["page_id", "lx", "ly", "__own"]).withColumn("value", best["v"]).where(
        F.col("value").isNotNull()).select("page_id", "label_id", "value")


def key_values(spans: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """(page_id, field, value) from "key: value" spans; an empty value is the next span's text.

    In a run of keys without values every second one serves as the value of the one before.
    The last value of a field wins.
    """
    table = {k.translate({ord(ch): None for ch in "\u00a0 ：:"}): v for k, v in keys.items()}
    t = spans.withColumn("text", strip(F.col("text"))).where(F.col("text") != "")
    pattern = r"^(.+?)[:：](.*)$"
    parsed = t.withColumns({
        "__field": F.when(F.col("text").rlike(pattern), lookup(normalize_key(F.regexp_extract("text", pattern, 1)), table)),
        "__value": strip(F.regexp_extract("text", pattern, 2)),
    })
    parsed = parsed.withColumn("__open", F.coalesce(F.col("__field").isNotNull() & (F.col("__value") == ""), F.lit(False)))
    order, seg = ["y0", "x0", "span_id"], _band("y0")
    placed = segmented(parsed, ["page_id"], order, seg, rank="__i")
    seen = segmented(
        placed, ["page_id"], order, seg,
        prior={"__closed": F.when(~F.col("__open"), F.col("__i"))},
        previous={"__last": F.when(F.col("__open"), F.col("__field"))},
    )
    run = F.col("__i") - 1 - F.coalesce("__closed", F.lit(0))
    taken = (run % 2) == 1
    found = seen.select(
        "page_id", "__i",
        F.when(taken, F.col("__last")).when(F.col("__value") != "", F.col("__field")).alias("field"),
        F.when(taken, F.col("text")).otherwise(F.col("__value")).alias("value"),
    ).where(F.col("field").isNotNull())
    return found.groupBy("page_id", "field").agg(F.max_by("value", "__i").alias("value"))


def key_values_same_line(spans: DataFrame, keys: Mapping[str, str], slack: float = 3.0, rows: int = STATE_ROWS) -> DataFrame:
    """(page_id, field, value) like ``key_values``, for headers that print several keys on one line.

    An open key takes the next text as its value, unless that text is a known key at most ``slack`` below or above
    it: such a key is read as usual, and replaces the open one if it is open itself.  The last value of a field wins.

    Spans are read in order, by runs of ``rows``.  What a run leaves open depends on what was open before it in two
    ways at most, so a run is summed up in one row; a scan over a page's runs tells each what is open where it begins,
    and the runs are then read side by side.
    """
    t = spans.withColumn("text", strip(F.col("text"))).where(F.col("text") != "")
    pattern = r"^(.+?)[:：](.*)$"
    hit = F.col("text").rlike(pattern)
    read = t.select(
        "page_id", F.col("y0").cast("double").alias("y0"), F.col("x0").cast("double").alias("x0"), "span_id", "text",
        F.when(hit, lookup(strip(F.regexp_extract("text", pattern, 1)), dict(keys))).alias("field"),
        F.when(hit, strip(F.regexp_extract("text", pattern, 2))).otherwise("").alias("value"),
    )
    band = F.coalesce(_band("y0"), F.lit(-(1 << 62)))  # spans without a height come first
    placed = segmented(read, ["page_id"], ["y0", "x0", "span_id"], band, rank="__i")
    runs = placed.groupBy("page_id", F.floor((F.col("__i") - 1) / rows).alias("__run")).agg(
        F.array_sort(F.collect_list(F.struct("__i", "y0", "text", "field", "value"))).alias("__all"))
    state = "struct<open:string,y:double,found:array<struct<field:string,value:string>>>"
    nothing = F.struct(F.lit(None), F.lit(None), F.array()).cast(state)
    apart = lambda y, before: F.coalesce(F.abs(y - before) > slack, F.lit(False))

    def step(acc: Column, s: Column) -> Column:
        made = lambda open_, y, found: F.struct(open_.alias("open"), y.alias("y"), found.alias("found")).cast(state)
        plus = lambda field, value: F.concat(acc["found"], F.array(F.struct(field.alias("field"), value.alias("value"))))
        taken = acc["open"].isNotNull() & (s["field"].isNull() | apart(s["y0"], acc["y"]))
        return (
            F.when(taken, made(F.lit(None), F.lit(None), plus(acc["open"], s["text"])))
            .when(s["field"].isNull(), acc)
            .when(s["value"] != "", made(acc["open"], acc["y"], plus(s["field"], s["value"])))
            .otherwise(made(s["field"], s["y0"], acc["found"]))
        )

    # Keys with values leave a state as it is.  The first other span, the turn, decides which of two states remains:
    # that of a run which began with nothing open, or that of one whose turn, an open key, was taken as a value.
    turn = F.get(F.filter("__all", lambda s: s["field"].isNull() | (s["value"] == "")), F.lit(0))
    ends = lambda some: F.aggregate(some, nothing, step)
    sums = runs.withColumn("__turn", turn).select("page_id", F.struct(
        "__run", ends(F.col("__all")).alias("plain"), ends(F.filter("__all", lambda s: s["__i"] > F.col("__turn.__i"))).alias("late"),
        F.col("__turn").isNotNull().alias("turns"), F.col("__turn.field").isNotNull().alias("key"), F.col("__turn.y0").alias("y"),
        F.array_max(F.transform(F.filter("__all", lambda s: F.coalesce(s["__i"] < F.col("__turn.__i"), F.lit(True))), lambda s: s["y0"])).alias("ahead"),
    ).alias("s"))
    scan = "struct<open:string,y:double,starts:array<struct<run:bigint,open:string,y:double>>>"

    def pass_on(acc: Column, s: Column) -> Column:
        ahead = apart(s["ahead"], acc["y"])
        left = lambda f: (
            F.when(acc["open"].isNull() | (s["turns"] & ahead), s["plain"][f])
            .when(~s["turns"], F.when(~ahead, acc[f]))
            .when(s["key"] & apart(s["y"], acc["y"]), s["late"][f])
            .otherwise(s["plain"][f])
        )
        here = F.struct(s["__run"].alias("run"), acc["open"].alias("open"), acc["y"].alias("y"))
        return F.struct(left("open").alias("open"), left("y").alias("y"), F.concat(acc["starts"], F.array(here)).alias("starts")).cast(scan)

    pages = sums.groupBy("page_id").agg(F.array_sort(F.collect_list("s")).alias("__sums"))
    begun = F.aggregate("__sums", F.struct(F.lit(None), F.lit(None), F.array()).cast(scan), pass_on)["starts"]
    starts = pages.select("page_id", F.explode(begun).alias("b")).select(
        "page_id", F.col("b.run").alias("__run"), F.struct(F.col("b.open"), F.col("b.y"), F.array()).cast(state).alias("__start"))
    folded = runs.join(starts, ["page_id", "__run"]).select(
        "page_id", "__run", F.posexplode(F.aggregate("__all", F.col("__start"), step)["found"]).alias("__i", "f"))
    return folded.groupBy("page_id", F.col("f.field").alias("field")).agg(F.max_by("f.value", F.struct("__run", "__i")).alias("value"))


def page_statement(
    spans: DataFrame, titles: Sequence[str], keys: Mapping[str, str], closing_label: str, opening_label: str | None = None, require_all: bool = False,
    same_line: bool = False,
) -> DataFrame:
    """One row per page: account_no, account_name, opening_balance, closing_balance, period_start, period_end.

    Fields come from the spans above the table; the opening balance from there or, with ``opening_label``, beside that
    label in the table; the closing balance beside its label below the table.  A period is split at white space.
    """
    parted = materialize(partition_spans(spans, titles, require_all=require_all), "parts")
    part = lambda name: parted.where(F.col("part") == name)
    found = (key_values_same_line if same_line else key_values)(part("header"), keys)
    named = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    heads = found.groupBy("page_id").agg(
        named("account_no").alias("account_no"), named("account_name").alias("account_name"), named("opening_balance").alias("__opening"),
        F.split(named("period"), r"\s+").alias("__period"),
    )
    below = nearest_values(part("footer"), closing_label).select("page_id", F.col("value").alias("__closing"))
    out = parted.select("page_id").distinct().join(heads, "page_id", "left").join(below, "page_id", "left")
    opening = F.col("__opening")
    if opening_label:
        inside = nearest_values(part("table"), opening_label).select("page_id", F.col("value").alias("__inside"))
        out = out.join(inside, "page_id", "left")
        opening = F.coalesce(F.col("__inside"), opening)
    return out.select(
        "page_id", "account_no", "account_name", amount_strict(opening).alias("opening_balance"), amount_strict(F.col("__closing")).alias("closing_balance"),
        F.get("__period", F.lit(0)).alias("period_start"), F.get("__period", F.lit(1)).alias("period_end"),
    )


def assign_cells(blocks: DataFrame, cells: DataFrame, nearest: bool = True, bin_height: float = 50.0, bin_width: float = 200.0) -> DataFrame:
    """Add (row, col) of the cell with the largest overlap to each block.

    cells (page_id, row, col, cx0, cy0, cx1, cy1); blocks (page_id, span_id, x0, y0, x1, y1).
    Blocks and cells meet in the bins of a grid; a pair counts only in the bin where its overlap begins, so it is met
    once.  Blocks without overlap go to the nearest row, then the nearest column of that row, or are dropped
    (``nearest=False``).
    """
    def binned(df: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
        over = lambda lo, hi, size: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
        return df.withColumn("__bx", over(x0, x1, bin_width)).withColumn("__by", over(y0, y1, bin_height))

    left, top = F.greatest("x0", "cx0"), F.greatest("y0", "cy0")
    area = F.greatest(F.lit(0), F.least("x1", "cx1") - left) * F.greatest(F.lit(0), F.least("y1", "cy1") - top)
    b = binned(blocks.select("page_id", "span_id", "x0", "y0", "x1", "y1"), "x0", "y0", "x1", "y1")
    # Exploded rows are estimated at the size from before, and so would be broadcast however many they are.
    c = binned(cells, "cx0", "cy0", "cx1", "cy1").hint("merge")
    met = b.join(c, ["page_id", "__bx", "__by"]).where((F.floor(left / bin_width) == F.col("__bx")) & (F.floor(top / bin_height) == F.col("__by")))
    over = met.withColumn("__area", area).where("__area > 0")
    best = over.groupBy("page_id", "span_id").agg(
        F.max_by(F.struct("row", "col"), F.struct("__area", -F.col("row"), -F.col("col"))).alias("c")
    ).select("page_id", "span_id", "c.row", "c.col")
    if not nearest:
        return blocks.join(best, ["page_id", "span_id"])
    # Found once; those with a cell and those without are then read from it.
    found = materialize(blocks.join(best, ["page_id", "span_id"], "left"), "cells")
    inside = found.where("row IS NOT NULL")
    apart = found.where("row IS NULL").drop("row", "col").withColumns({
        "__y": (F.col("y0") + F.col("y1")).cast("double") / 2, "__x": (F.col("x0") + F.col("x1")).cast("double") / 2,
    })
    # The height of a grid row is that of its first cell.
    rows = cells.groupBy("page_id", "row").agg(F.min_by((F.col("cy0") + F.col("cy1")).cast("double") / 2, "col").alias("__y"))
    cols = cells.select("page_id", "row", F.col("col").cast("bigint").alias("col"), ((F.col("cx0") + F.col("cx1")).cast("double") / 2).alias("__x"))
    in_row = nearest_site(apart, rows.withColumn("row", F.col("row").cast("bigint")), ["page_id"], "__y", "row", BAND_HEIGHT * 2)
    placed = nearest_site(in_row, cols.withColumn("row", F.col("row").cast("bigint")), ["page_id", "row"], "__x", "col", BAND_HEIGHT * 2)
    return inside.unionByName(placed.select(*inside.columns))


def title_groups(cells: DataFrame) -> DataFrame:
    """Add ``receipt`` (its first row) to grid cells (page_id, row, col, text).

    Title rows up to three rows apart are one heading; the receipt starts at the bank's name
    one or two rows above, else at the first title row.  Cells before the first are dropped.
    """
    titles = cells.where(F.col("text").rlike("|".join(GRID_RECEIPT_TITLES))).select("page_id", "row").distinct()
    apart = segmented(titles, ["page_id"], ["row"], ordinal_segment("row", 12), previous={"__last": F.col("row")})
    heads = apart.where(F.col("__last").isNull() | (F.col("row") - F.col("__last") > 3)).select("page_id", F.col("row").alias("head"))
    banks = cells.where(F.col("text").contains(GRID_RECEIPT_BANK)).select("page_id", "row").distinct()
    above = heads.withColumn("row", F.explode(F.array(F.col("head") - 2, F.col("head") - 1))).join(banks, ["page_id", "row"])
    starts = heads.join(above.groupBy("page_id", "head").agg(F.min("row").alias("b")), ["page_id", "head"], "left").select(
        "page_id", F.coalesce("b", "head").cast("bigint").alias("receipt")).distinct()
    # Every cell looks up the last start at or above it; starts stand among the cells, which are dealt once.
    owned = _carried(cells, materialize(starts, "starts"), "row", "receipt")
    return owned.select("page_id", "row", *(c for c in cells.columns if c not in ("page_id", "row")), "receipt")


def _carried(rows: DataFrame, starts: DataFrame, place: str, name: str, **carry: Column) -> DataFrame:
    """``rows`` (page_id, ``place``, ...) at or after a start of their page, with its place as ``name`` and the values in ``carry``.

    starts (page_id, ``name``) are few and stored.
    """
    both = rows.withColumns({place: F.col(place).cast("bigint"), "__kind": F.lit(1)}).unionByName(
        starts.select("page_id", F.col(name).alias(place), F.col(name).alias("__at"), F.lit(0).alias("__kind")), allowMissingColumns=True)
    out = segmented(both, ["page_id"], [place, "__kind"], ordinal_segment(place, 12), carry={name: F.col("__at"), **carry})
    return out.where((F.col("__kind") == 1) & F.col(name).isNotNull()).drop("__kind", "__at")


def grid_fields(cells: DataFrame) -> DataFrame:
    """One row of text fields per receipt from fixed places below its first holder-name row.

    cells (page_id, receipt, row, col, text).
    """
    keys = ["page_id", "receipt"]
    base = cells.where((F.col("col") == 1) & F.col("text").contains(GRID_RECEIPT_BASE)).groupBy(*keys).agg(F.min("row").alias("base"))
    spots = sorted({p for places in GRID_RECEIPT_FIELDS.values() for p in places} | {(3, 6), (3, 7), (4, 5), (4, 6), (8, 3), (9, 3), (-1, 3)})
    near = cells.join(base, keys).withColumn("__r", F.col("row") - F.col("base")).where(F.col("__r").between(-1, 9))

    def at(r: int, c: int) -> Column:
        hit = (F.col("__r") == r) & (F.col("col") == c)
        return F.coalesce(F.max(F.when(hit, strip(F.col("text")))), F.lit("")).alias(f"__{r}_{c}")

    wide = near.groupBy(*keys).agg(*(at(r, c) for r, c in spots))
    cell = lambda r, c: F.col(f"__{r}_{c}")
    fields = {f: F.concat(*(cell(*p) for p in places)) if len(places) > 1 else cell(*places[0]) for f, places in GRID_RECEIPT_FIELDS.items()}
    words = F.when(cell(3, 7) != "", cell(3, 7)).otherwise(cell(3, 6))
    fields["amount_cn"] = F.when((words != "") & (F.length(words) <= 2) & ~words.startswith("人民币"), cell(3, 7)).otherwise(words)
    fields["business_type"] = business_type(cell(4, 5), cell(4, 6))
    fields["verify_code"] = verify_code(cell(8, 3))
    fields["teller"] = F.when(cell(9, 3).contains("记账柜员"), cell(9, 3))
    fields["receipt_no"] = receipt_number(cell(-1, 3))
    return wide.select(*keys, *(v.alias(f) for f, v in fields.items()))


def parties(blocks: DataFrame, left_limit: float) -> DataFrame:
    """(page_id, payer, payee): company names before bank names, the topmost; left payer, right payee.

    blocks (page_id, span_id, cx, y0, text).
    """
    t = strip(F.col("text"))
    company = t.rlike(COMPANY_PATTERN)
    named = blocks.where(F.length(t).between(4, 80) & ~t.rlike(PARTY_NOISE_PATTERN) & (company | t.rlike(BRANCH_PATTERN)))
    rank = F.struct(~company, F.col("y0"), F.col("span_id"))
    left = F.col("cx") < left_limit

    def best(side: Column) -> Column:
        return F.coalesce(F.min_by(F.when(side, t), F.when(side, rank)), F.lit(""))

    return named.groupBy("page_id").agg(best(left).alias("payer"), best(~left).alias("payee"))


def column_statement(lines: DataFrame) -> DataFrame:
    """Records of a one-value-per-line statement (page_id, line_no, line).

    After the header a line that is a date starts a record: currency, amount, balance, type,
    then free text up to a blank line or the next date.  A bad amount rejects the record.
    """
    t = lines.withColumn("line", strip(F.col("line")))
    seg = ordinal_segment("line_no", 12)
    # A date in one of a record's three fixed lines does not start another record.  Dates at most three lines apart
    # form a run, which is walked from its first: the next start is the first date more than three lines further.
    # Only dates are held against the header: lines before the first record belong to none anyway.
    dates = t.where(F.col("line").rlike(r"^\d{4}-\d{2}-\d{2}$")).select("page_id", "line_no").join(_statement_start(t), "page_id", "left")
    dates = materialize(dates.where(F.col("line_no") >= F.coalesce("__start", F.lit(0))).select("page_id", "line_no"), "dates")
    dates = segmented(dates, ["page_id"], ["line_no"], seg, previous={"__before": F.col("line_no")})
    opens = F.col("__before").isNull() | (F.col("line_no") - F.col("__before") > 3)
    runs = segmented(dates.withColumn("__open", F.when(opens, F.col("line_no"))), ["page_id"], ["line_no"], seg, carry={"__run": F.col("__open")})
    walked = spread(runs, "page_id", "__run").groupBy("page_id", "__run").agg(F.array_sort(F.collect_list("line_no")).alias("__all")).select(
        "page_id", F.explode(F.aggregate(
            "__all", F.array().cast("array<bigint>"),
            lambda taken, at: F.when((F.size(taken) == 0) | (at - F.try_element_at(taken, F.lit(-1)) > 3), F.concat(taken, F.array(at.cast("bigint")))).otherwise(taken),
        )).alias("record"))
    blank = F.when(F.col("line") == "", F.col("line_no"))
    owned = _carried(t, materialize(walked, "records"), "line_no", "record", __blank=blank).withColumn("__step", F.col("line_no") - F.col("record"))
    # Closed once the latest blank line lies in the free text of the record.
    stopped = F.coalesce(F.col("__blank") >= F.col("record") + 4, F.lit(False))
    open_ = owned.where(~stopped & ((F.col("__step") < 4) | ~F.col("line").isin(*COLUMN_STATEMENT_HEADER)))
    rows = open_.groupBy("page_id", "record").agg(
        F.max(F.when(F.col("__step") == 0, F.col("line"))).alias("date"),
        F.max(F.when(F.col("__step") == 2, F.col("line"))).alias("amount"),
        F.max(F.when(F.col("__step") == 3, F.lit(1))).alias("__balance"),
        F.array_sort(F.collect_list(F.when(F.col("__step") >= 4, F.struct("line_no", "line")))).alias("__info"),
    ).where("__balance = 1")
    texts = F.transform("__info", lambda p: p["line"])
    rows = rows.withColumns({"__t": texts, "amount": amount_strict(F.col("amount")), "txn_date": date_iso(F.col("date"))}).withColumn(
        "__i", F.when(F.size("__t") > 1, F.slice("__t", F.lit(2), F.greatest(F.size("__t") - 1, F.lit(0)))).otherwise(F.col("__t")))
    n = F.size("__i")
    return rows.where(F.col("amount").isNotNull() & F.col("txn_date").isNotNull()).select(
        "page_id", "record", "txn_date", F.abs("amount").alias("amount"),
        F.when(F.col("amount") > 0, "income").otherwise("expense").alias("direction"),
        F.array_join("__i", " ").alias("description"),
        F.when(n > 0, F.array_join(F.slice("__i", F.greatest(n - 1, F.lit(1)), F.least(n, F.lit(2))), " ")).alias("counterparty"),
    )


def _statement_start(t: DataFrame) -> DataFrame:
    """(page_id, __start): the line after the header's last title, when there is a header."""
    at = lambda word, name: t.where(F.col("line") == word).select("page_id", F.col("line_no").alias(name))
    first = at("Date", "__d").withColumn("__c", F.col("__d") + 1).join(at("Currency", "__c"), ["page_id", "__c"])
    last = t.groupBy("page_id").agg(F.max("line_no").alias("__max"))
    head = first.groupBy("page_id").agg(F.min("__d").alias("__d")).join(last, "page_id").where(F.col("__d") <= F.col("__max") - 5)
    near = head.withColumn("__p", F.explode(F.sequence(F.col("__d"), F.col("__d") + 9))).join(at("Counter Party", "__p"), ["page_id", "__p"])
    found = near.groupBy("page_id").agg(F.min("__p").alias("__p"))
    return head.join(found, "page_id", "left").select("page_id", F.coalesce(F.col("__p") + 1, F.col("__d") + 7).alias("__start"))
