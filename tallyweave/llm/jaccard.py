"""Exact Jaccard join of word n-gram sets with signature trees.

Equal sets are one node.  Two sets that are similar enough share one of their first shingles in any fixed order of all
shingles; the order used puts frequent shingles last, so that passages which many documents share seldom bring them
together.  Nodes that share such a shingle meet in blocks.  A block's nodes form a tree whose inner nodes hold the OR of
their members' token bitmaps and the range of their sizes; two trees are walked together, and a pair of branches is left
as soon as its largest possible overlap is too small.  Pairs of leaves that remain are checked on the full sets.
Only nodes of fitting sizes and of shingles early enough in both sets meet.  Blocks are walked after a first round has
linked each node with the most central one of its group and size, and skip nodes that are already connected, so a large
group of near copies costs about one check for each member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept, scratch
from .batches import Batches, byte_texts, kind, only, store
from .components import components
from .words import grams, mix, portions, scan

#: Frequent shingles that go last in the order; any number gives the same result.
FREQUENT = 1 << 16
#: Bits of the filter that names documents whose sets are needed; any number gives the same result.
FILTER_BITS = 1 << 24
#: Nodes of a block, leaves under a branch, and bits of a bitmap for each shingle.
BLOCK, FAN, LOAD = 1024, 8, 2
#: Checks of one leader in one task.
CHECKS = 4096
#: Candidates of a node with each other component in successive rounds; the last round takes all.
ROUNDS = (4, None)


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and offsets; A-Z count as a-z.

    A text with fewer than n words has its whole sequence as one shingle.
    """
    words = scan(texts, lower=True)
    count = np.bincount(words.doc, minlength=len(texts))
    first, key = grams(words, n)
    docs, keys = [words.doc[first]], [key]
    for c in range(1, n):
        first, key = grams(words, c)
        whole = count[words.doc[first]] == c
        docs.append(words.doc[first[whole]])
        keys.append(mix(key[whole] + np.uint64(c)))
    doc, key = np.concatenate(docs), np.concatenate(keys)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    doc, key = doc[new], key[new]
    return key, np.searchsorted(doc, np.arange(len(texts) + 1))


def required(a, b, pct: int):
    """Least overlap at which sets of these sizes are similar enough: 100 o >= pct (a + b - o)."""
    return -((-pct * (a + b)) // (100 + pct))


def prefix_length(n, pct: int):
    """So many first shingles of a set of n that a similar set has one of them among its own first."""
    return n - (-((-pct * n) // 100)) + 1


def bits_for(n: int) -> int:
    """Size of a bitmap: a power of two, at least LOAD bits for each shingle."""
    return max(64, 1 << (int(n) * LOAD - 1).bit_length())


def bitmap(keys: np.ndarray) -> bytes:
    bits = np.zeros(bits_for(len(keys)), dtype=bool)
    bits[(keys & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _frequent(n: int):
    """(shingle, texts) for shingles of three or more texts of a portion."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            for some in portions([len(t) for t in texts]):
                keys, counts = np.unique(shingle_sets(list(set(texts[some])), n)[0], return_counts=True)  # copies count once
                yield pa.RecordBatch.from_arrays([pa.array(keys[counts >= 3].view(np.int64)), pa.array(counts[counts >= 3])], names=["h", "c"])

    return run


def frequent_shingles(docs: DataFrame, n: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` most frequent shingles, ascending, and the logarithm of their counts: only an order hangs on them."""
    counted = docs.select("text").mapInArrow(_frequent(n), "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    table = counted.orderBy(F.desc("c"), "h").limit(most).toArrow()
    keys = table.column("h").to_numpy().view(np.uint64) if table.num_rows else np.zeros(0, dtype=np.uint64)
    order = np.argsort(keys)
    level = np.log2(table.column("c").to_numpy()).astype(np.int64) + 1 if table.num_rows else np.zeros(0, dtype=np.int64)
    return keys[order], level[order]


SKETCH = "n bigint, k1 bigint, k2 bigint, prefix array<bigint>, rare int, bits binary"


def _sketch(n: int, pct: int, frequent: np.ndarray, level: np.ndarray):
    def run(batches: Batches) -> Batches:
        salt = mix(np.arange(1, 3, dtype=np.uint64))
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            for some in portions([len(t) for t in texts]):
                keys, at = shingle_sets(texts[some], n)
                sizes = np.diff(at)
                late = np.zeros(len(keys), dtype=np.int64)
                if len(frequent):
                    place = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
                    late = np.where(frequent[place] == keys, level[place], 0)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((keys, late, doc))
                first = np.arange(len(keys)) - at[doc] < prefix_length(sizes, pct)[doc]
                prefix = keys[order][first].view(np.int64)
                rare = np.bincount(doc[first & (late[order] == 0)], minlength=len(sizes)).astype(np.int32)  # these come before frequent ones
                ends = np.concatenate(([0], np.cumsum(np.where(sizes > 0, prefix_length(sizes, pct), 0))))
                # Two sums of mixed hashes name a set; each is spread once more with its size.
                sums = [np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(keys ^ s), dtype=np.uint64))) for s in salt]
                names = [mix((s[at[1:]] - s[at[:-1]]) ^ sizes.astype(np.uint64)).view(np.int64) for s in sums]
                bits = [bitmap(keys[a:b]) if b > a else b"" for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(some.start, some.stop - some.start), pa.array(sizes.astype(np.int64)), *map(pa.array, names),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(prefix)), pa.array(rare), pa.array(bits, pa.binary())],
                    names=["id", "n", "k1", "k2", "prefix", "rare", "bits"],
                )

    return run


def _sets(n: int, wanted: bytes):
    """The full sets of documents whose bit is set in ``wanted``."""
    def run(batches: Batches) -> Batches:
        salt = mix(np.arange(1, 3, dtype=np.uint64))
        bits = np.frombuffer(wanted, dtype=np.uint8)
        for batch in batches:
            spot = batch.column("spot").to_numpy()
            batch = batch.filter(pa.array((bits[spot >> 3] >> (spot & 7) & 1).astype(bool)))
            texts = byte_texts(batch.column("text"))
            for some in portions([len(t) for t in texts]):
                keys, at = shingle_sets(texts[some], n)
                sums = [np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(keys ^ s), dtype=np.uint64))) for s in salt]
                names = [mix((s[at[1:]] - s[at[:-1]]) ^ np.diff(at).astype(np.uint64)).view(np.int64) for s in sums]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, names), pa.array([keys[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["k1", "k2", "shingles"]
                )

    return run


def _filter_of(ids: DataFrame, bits: int) -> bytes:
    """A bitmap of fixed size with the bit of each row's ``spot`` set; 4 KB pieces are OR-combined in the cluster."""
    pieces = ids.groupBy(F.bitmap_bucket_number(F.col("spot") + 1).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("spot") + 1)).alias("bits"))
    out = bytearray(bits // 8)
    for piece, part in pieces.collect():  # bits / 32768 rows at most
        out[(piece - 1) * 4096 : piece * 4096] = part
    return bytes(out)


def _check(pct: int):
    """Rows ordered by (a, salt), leader first: pairs (a, b) that are similar enough.  Holds one set."""
    def run(batches: Batches) -> Batches:
        who, leader = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            good = []
            for i, raw in enumerate(batch.column("shingles")):
                keys = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
                if b[i] is None:
                    who, leader = a[i], keys.copy()
                elif a[i] == who:
                    overlap = len(np.intersect1d(leader, keys, assume_unique=True))
                    if 100 * overlap >= pct * (len(leader) + len(keys) - overlap):
                        good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(good, pa.int64())), batch.column("b").take(pa.array(good, pa.int64()))], names=["a", "b"])

    return run


class Tree:
    """Levels from the leaves up: OR of bitmaps, least and largest size, fewest bits."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, roots: np.ndarray):
        count = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, count, roots, roots)]
        while len(self.levels[-1][0]) > 1:
            bits, lo, hi, few, c0, c1 = self.levels[-1]
            at = np.arange(0, len(bits), FAN)
            self.levels.append((
                np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.minimum.reduceat(few, at),
                np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at),
            ))


def _possible(p, q, i: np.ndarray, j: np.ndarray, pct: int) -> np.ndarray:
    """Largest overlap that members of branches i and j can have, less the least overlap that they need."""
    common = np.bitwise_count(p[0][i] & q[0][j]).sum(axis=1, dtype=np.int64)
    # A set with more bits than the two have in common has as many shingles outside the other.
    most = np.minimum(p[2][i] - np.maximum(p[3][i] - common, 0), q[2][j] - np.maximum(q[3][j] - common, 0))
    return most - required(p[1][i], q[1][j], pct)


def walk(left: Tree, right: Tree, pct: int, same: bool, step: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Leaf pairs (i, j, slack) whose bitmaps and sizes allow the similarity and that lie in different components.

    Both trees have a level for each of the other's; the frontier is walked in steps of bounded size, deepest first.
    """
    depth = max(len(left.levels), len(right.levels)) - 1
    level = lambda tree, d: tree.levels[min(d, len(tree.levels) - 1)]
    stack = [(depth, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while stack:
        d, i, j = stack.pop()
        if len(i) > step:
            half = len(i) // 2
            stack += [(d, i[half:], j[half:]), (d, i[:half], j[:half])]
            continue
        p, q = level(left, d), level(right, d)
        keep = ~((p[4][i] == p[5][i]) & (q[4][j] == q[5][j]) & (p[4][i] == q[4][j]))  # not all of one component
        keep &= (100 * p[2][i] >= pct * q[1][j]) & (100 * q[2][j] >= pct * p[1][i])
        i, j = i[keep], j[keep]
        slack = _possible(p, q, i, j, pct)
        i, j, slack = i[slack >= 0], j[slack >= 0], slack[slack >= 0]
        if not len(i):
            continue
        if d == 0:
            yield i, j, slack
            continue
        down_p, down_q = d <= len(left.levels) - 1, d <= len(right.levels) - 1
        n_p, n_q = len(level(left, d - 1)[0]), len(level(right, d - 1)[0])
        kids_p, kids_q = np.arange(FAN if down_p else 1), np.arange(FAN if down_q else 1)
        a = (i[:, None, None] * (FAN if down_p else 1) + kids_p[None, :, None] + 0 * kids_q[None, None, :]).ravel()
        b = (j[:, None, None] * (FAN if down_q else 1) + kids_q[None, None, :] + 0 * kids_p[None, :, None]).ravel()
        keep = (a < n_p) & (b < n_q) & ((a <= b) if same else True)
        stack.append((d - 1, a[keep], b[keep]))


def _fold(raw: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of several sizes brought to one, as rows of 64-bit words."""
    out = np.zeros((len(raw), size // 8), dtype=np.uint8)
    for i, r in enumerate(raw):
        a = np.frombuffer(r, dtype=np.uint8)
        out[i] = np.bitwise_or.reduce(a.reshape(-1, size // 8), axis=0)
    return out.view(np.uint64)


def _class_width(pct: int) -> float:
    """Width of a size class in logarithms: similar sets lie in one class or in neighbouring ones."""
    return float(np.log(100 / pct)) * 1.0000001


def _block_pairs(pct: int, quota: int | None):
    """Rows of one pair of blocks at a time, ordered by (h, kind, cls, low, high): candidate pairs (a, b, cut).

    Nodes of a block are dealt over trees by size class; classes are so wide that similar sets lie in the same class
    or in neighbouring ones.
    """
    step = _class_width(pct)

    def leaf_pairs(rows: dict[str, list], same: bool) -> Iterator[tuple]:
        node, n, root, side = (np.array(rows[c]) for c in ("node", "n", "root", "side"))
        by: dict[tuple[int, int], np.ndarray] = {}
        size_class = np.floor(np.log(n) / step).astype(np.int64)
        for c in np.unique(size_class):
            for s in (0, 1):
                at = np.flatnonzero((size_class == c) & (side == s))
                if len(at):
                    by[int(c), s] = at[np.lexsort((n[at], root[at]))]
        for (c, s), left in by.items():
            if s:
                continue
            for d in (0, 1) if same else (-1, 0, 1):
                right = by.get((c + d, 0 if same else 1))
                if right is None or (same and d == 0 and len(left) == 1):
                    continue
                size = 8 * min(min(len(rows["bits"][x]) for x in part) for part in (left, right))
                trees = [Tree(_fold([rows["bits"][x] for x in part], size), n[part], root[part]) for part in (left, right)]
                for i, j, slack in walk(trees[0], trees[1], pct, same and d == 0):
                    yield left[i], right[j], slack

    def pairs(rows: dict[str, list], same: bool) -> Iterator[tuple]:
        node, root = np.array(rows["node"]), np.array(rows["root"])
        best: dict[tuple[int, int], list] = {}
        for a, b, slack in leaf_pairs(rows, same):
            keep = (root[a] != root[b]) & (node[a] != node[b])
            for x, y, s in zip(a[keep], b[keep], slack[keep], strict=True):
                if quota is None:
                    yield int(node[x]), int(node[y]), False
                    continue
                # The best few of each node with each other component; what is left out is marked as cut.
                key = (int(node[x]), int(root[y]))
                have = best.setdefault(key, [])
                have.append((-int(s), int(node[y])))
                if len(have) > 4 * quota:
                    have.sort()
                    del have[quota + 1 :]
        for (x, _), have in best.items():
            have.sort()
            for k, (_, y) in enumerate(have[:quota]):
                yield x, y, k == 0 and len(have) > quota

    def run(batches: Batches) -> Batches:
        key, rows = None, None
        place, names = ("h", "kind", "cls", "low", "high"), ("node", "n", "root", "side", "bits")

        def give() -> Iterator[pa.RecordBatch]:
            found = list(pairs(rows, key[1] == 0 and key[3] == key[4]))
            for lo in range(0, len(found), 1 << 15):
                a, b, cut = zip(*found[lo : lo + (1 << 15)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(cut, pa.bool_())], names=["a", "b", "cut"])

        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in (*place, *names)}
            for i in range(batch.num_rows):
                now = tuple(cols[c][i] for c in place)
                if now != key:
                    if rows:
                        yield from give()
                    key, rows = now, {c: [] for c in names}
                for c in names:
                    rows[c].append(cols[c][i])
        if rows:
            yield from give()

    return run


def _slots(members: DataFrame, pct: int) -> DataFrame:
    """Deal ``members`` (h, node, n, most, root) over (h, kind, cls, side): where a node can meet one that is similar enough.

    Similar sets lie in one size class (kind 0) or in neighbouring ones (kind 1; the smaller is side 0).  A node whose
    entry allows no partner of the class is left out: what two sets share from their first common shingle on is too
    little then.
    """
    step = _class_width(pct)
    size_class = F.floor(F.log(F.col("n")) / step).cast("int")
    at_least = lambda c: F.exp(c * step) - 0.5
    slot = lambda kind, cls, side: F.struct(F.lit(kind).alias("kind"), cls.alias("cls"), F.lit(side).alias("side"))
    places = F.array(
        F.when(at_least(size_class) <= F.col("most"), slot(0, size_class, 0)),
        F.when(at_least(size_class + 1) <= F.col("most"), slot(1, size_class, 0)),
        slot(1, size_class - 1, 1),
    )
    return members.select("h", "node", "n", "root", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("p")).select("h", "node", "n", "root", "p.*")


def _candidates(members: DataFrame, classes: DataFrame, roots: DataFrame, pct: int, block: int, quota: int | None) -> DataFrame:
    """Pairs (a, b, cut) of nodes of one group in different components that their bitmaps allow.

    Slots that lie in one component are left out, those without two sides to compare, those of two nodes of one class
    (whose pair was checked in the first round), and all but one of those with the same members.  A slot of more than
    ``block`` members is dealt over pairs of blocks.
    """
    labelled = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    slots = _slots(labelled, pct)
    who = F.struct(F.bit_xor(F.xxhash64("node", "side")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node", "side")).alias("y")).alias("who")
    groups = slots.groupBy("h", "kind", "cls").agg(
        F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("size"), F.sum("side").alias("right"), who)
    groups = groups.where("r0 <> r1 AND IF(kind = 0, size > 2, right > 0 AND right < size)").groupBy("who", "size", "right", "kind", "cls").agg(F.min("h").alias("h"))
    rows = slots.join(groups.select("h", "kind", "cls", "size", "right"), ["h", "kind", "cls"])
    # Same class: the triangle of its blocks.  Two classes: the grid of the blocks of either side.
    count = lambda n: F.greatest(F.ceil(n / block), F.lit(1)).cast("int")
    here = F.when(F.col("side") == 1, F.col("right")).otherwise(F.col("size") - F.col("right"))
    rows = rows.withColumns({"own": count(here), "other": F.when(F.col("kind") == 0, count(F.col("size"))).otherwise(count(F.col("size") - here))})
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("own")).cast("int"))
    place = lambda low, high, side: F.struct(low.alias("low"), high.alias("high"), side.alias("side"))
    salt, zero, one = F.col("salt"), F.lit(0), F.lit(1)
    places = F.transform(F.sequence(zero, F.col("other") - 1), lambda s: F.when(
        F.col("kind") == 1, F.when(F.col("side") == 0, place(salt, s, zero)).otherwise(place(s, salt, one))
    ).otherwise(F.when(s >= salt, place(salt, s, zero)).otherwise(place(s, salt, one))))
    dealt = rows.select("h", "kind", "cls", "node", "n", "root", F.explode(places).alias("p")).select("h", "kind", "cls", "node", "n", "root", "p.*")
    full = dealt.join(classes.select("node", "bits"), "node")
    key = ["h", "kind", "cls", "low", "high"]
    ordered = full.select(*key, "node", "n", "root", "side", "bits").repartition(*key).sortWithinPartitions(*key)
    found = ordered.mapInArrow(_block_pairs(pct, quota), "a bigint, b bigint, cut boolean")
    return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("cut").alias("cut"))


def _checked(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The pairs (a, b) that are similar enough.  A leader with many pairs is dealt over several tasks."""
    leaders = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHECKS).cast("int").alias("salts"))
    members = pairs.join(leaders, "a").join(sets.withColumnRenamed("node", "b"), "b").select(
        "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b", "shingles"
    )
    heads = leaders.join(sets.withColumnRenamed("node", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("bigint").alias("b"), "shingles"
    )
    ordered = members.unionByName(heads).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(_check(pct), "a bigint, b bigint")


def join(df: DataFrame, id_col: str, text_col: str, n: int = 5, pct: int = 80, block: int = BLOCK, frequent: int = FREQUENT,
         filter_bits: int = FILTER_BITS, rounds: tuple[int | None, ...] = ROUNDS) -> DataFrame:
    """id, n_shingles and component_id of every row: the smallest id reachable over links, its own included.

    Two rows link when 100 * overlap >= pct * union of their sets of n-word shingles.  Null texts and texts without
    words have an empty set and link with nothing.  Repeated rows and equal sets are one class, so copies are never
    paired.  Rows of one id with different texts are documents of their own.  Null ids are never smallest.
    No link between different sets that could connect two components is missed, whatever the parameters.  An empty table
    gives no row; columns of other names have no influence.  The result is stored, and all else written on the way deleted.
    """
    docs = only(df, id=id_col, text=text_col)
    with scratch(df.sparkSession):
        return kept(_joined(docs, n, pct, block, frequent, filter_bits, rounds), "jaccard").withColumnRenamed("id", id_col)


def _joined(docs: DataFrame, n: int, pct: int, block: int, frequent: int, filter_bits: int, rounds: tuple[int | None, ...]) -> DataFrame:
    """(id, n_shingles, component_id) of ``docs`` (id, text)."""
    spot = F.pmod(F.xxhash64("id"), F.lit(filter_bits))
    late = frequent_shingles(docs, n, frequent)
    first = lambda c: F.first(c).alias(c)
    with scratch(docs.sparkSession):  # prefixes, the most of what is written, go once the shared ones are found
        sketch = store(docs.mapInArrow(_sketch(n, pct, *late), f"id {kind(docs, 'id')}, {SKETCH}"), "jaccard-sketch")
        names = kept(sketch.select("id", "n", "k1", "k2"), "jaccard-names")
        whole = sketch.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("id"), *map(first, ("n", "prefix", "rare", "bits")))
        whole = store(whole.withColumn("node", F.monotonically_increasing_id()), "jaccard-whole")  # written once, so the numbers stay
        shared = kept(_shared(whole, pct), "jaccard-shared")
        classes = kept(whole.select("k1", "k2", "node", "id", "n", "bits"), "jaccard-classes")
    # The text that the others vary shares more of its first shingles with more of them: it leads those of its size.
    central = shared.groupBy("node").agg(F.sum(F.log("size")).alias("weight"))
    members = store(shared.join(central, "node").select("h", "node", "n", "most", "cls", "weight"), "jaccard-members")
    leads = members.groupBy("h", "cls").agg(F.count(F.lit(1)).alias("size"), F.max_by(F.struct("node", "n", "most"), F.struct("weight", -F.col("node"))).alias("lead")).where("size > 1")
    fits = (F.col("n") <= F.col("lead.most")) & (F.col("lead.n") <= F.col("most")) & (100 * F.least("n", "lead.n") >= pct * F.greatest("n", "lead.n")) & (F.col("node") != F.col("lead.node"))
    stars = members.join(leads, ["h", "cls"]).where(fits).select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct()
    stars = _allowed(store(stars, "jaccard-stars"), classes, pct)

    links: DataFrame | None = None
    tested: DataFrame | None = None
    roots = classes.limit(0).select("node", F.col("node").alias("root"))
    met = members.select("h", "node", "n", "most")
    for quota in (0, *rounds):
        seen = stars if quota == 0 else store(_candidates(met, classes, roots, pct, block, quota), "jaccard-candidates")
        more = quota == 0 or bool(seen.agg(F.max("cut")).first()[0])  # candidates that this round left to the next
        if quota and more:  # only groups of nodes that were cut short are walked again
            # Each is written, so that the joins know how few they are and leave the large tables where they lie.
            short = store(seen.where("cut").select(F.explode(F.array("a", "b")).alias("node")).distinct(), "jaccard-short")
            cut = store(met.join(short, "node", "left_semi").select("h").distinct(), "jaccard-cut")
            met = store(met.join(cut, "h", "left_semi"), "jaccard-met")
        pairs = seen.select("a", "b")
        pairs = store(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "jaccard-pairs")
        if not pairs.isEmpty():
            sets = _sets_of(pairs, classes, docs, n, spot, filter_bits)
            good = store(_checked(pairs, sets, pct), "jaccard-links")
            links = good if links is None else links.unionByName(good)
            roots = store(components(links), "jaccard-roots")
            tested = pairs if tested is None else tested.unionByName(pairs)
        if not more:
            break
    labelled = classes.select("k1", "k2", "node", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = labelled.groupBy("root").agg(F.min("id").alias("component_id"))
    named = labelled.join(least, "root").select("k1", "k2", "component_id")
    out = names.join(named, ["k1", "k2"], "left")
    return out.select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )


def _shared(whole: DataFrame, pct: int) -> DataFrame:
    """(h, node, n, most, cls, size) of first shingles that two or more nodes have among theirs.

    The frequent ones are at most as many as their list, so their counts go to every task; those of any other are so few that
    one task counts them, and each is sent there once.
    """
    postings = whole.select("node", "n", "rare", F.posexplode("prefix").alias("i", "h"))
    often, seldom = (postings.where(c).select("h", "node", "n", "i") for c in ("i >= rare", "i < rare"))
    sizes = often.groupBy("h").agg(F.count(F.lit(1)).alias("size"))
    met = often.join(F.broadcast(sizes), "h").unionByName(seldom.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("h")))).where("size > 1")
    # From the i-th first shingle on (from 0) a set holds n - i others, so a partner that is met there has ``most`` at the most.
    return met.select("h", "node", "n", (F.floor((F.col("n") - F.col("i")) * (100 + pct) / pct) - F.col("n")).alias("most"),
                      F.floor(F.log("n") / _class_width(pct)).cast("int").alias("cls"), "size")


def _allowed(pairs: DataFrame, classes: DataFrame, pct: int) -> DataFrame:
    """Pairs whose bitmaps allow the similarity."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            keep = []
            for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n", "m")), strict=True):
                p, q = _fold([x, y], min(len(x), len(y)) * 8)
                common = int(np.bitwise_count(p & q).sum())
                most = min(n - max(int(np.bitwise_count(p).sum()) - common, 0), m - max(int(np.bitwise_count(q).sum()) - common, 0))
                keep.append(most >= required(n, m, pct))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    nodes = store(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "jaccard-paired")
    held = store(classes.join(nodes, "node").select("node", "n", "bits"), "jaccard-bits")  # bitmaps of others stay where they lie
    left = held.select(F.col("node").alias("a"), F.col("bits").alias("x"), F.col("n"))
    right = held.select(F.col("node").alias("b"), F.col("bits").alias("y"), F.col("n").alias("m"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "n", "m").mapInArrow(run, "a bigint, b bigint")


def _sets_of(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, spot, filter_bits: int) -> DataFrame:
    """(node, shingles) of every node in ``pairs``, from its text again; texts are filtered before they are cut up."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    needed = store(classes.join(nodes, "node").select("node", "id", "k1", "k2"), "jaccard-needed")
    wanted = _filter_of(needed.select(spot.cast("bigint").alias("spot")), filter_bits)
    again = docs.select(spot.cast("bigint").alias("spot"), "text").mapInArrow(_sets(n, wanted), "k1 bigint, k2 bigint, shingles binary")
    return store(again.join(needed, ["k1", "k2"]).groupBy("node").agg(F.first("shingles").alias("shingles")), "jaccard-sets")
