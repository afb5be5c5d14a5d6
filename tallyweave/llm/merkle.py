"""Merkle manifest of a dataset by cogrouped subtree exchange.

Every row is a leaf.  The leaves of a group are cut into superblocks of 2**BITS consecutive ones; a superblock reduces to
one node, the nodes are cut into superblocks again, and so on to one node for each group.  The groups' nodes form a tree
of the same kind, whose last node is the root.  On the way back each superblock is cogrouped with the outer nodes it
needs, one row of siblings from its own node up to the root, and finishes there: the subtree is reduced once more, the
siblings inside it are joined with those outside, and the leaf found now is folded up to the root.

No task holds more than a superblock, and the driver learns two numbers only: the most leaves of a group and the number
of groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import kind, store

#: A superblock has 2**BITS nodes; any number gives the same result.
BITS = 10
#: Sides of a sibling in a path, one byte before its digest; an odd last node has none.
ALONE, LEFT, RIGHT = 0, 1, 2


def parent(children: list[bytes]) -> bytes:
    """SHA-256 of the children's digests as lowercase hex text, concatenated."""
    return sha256("".join(c.hex() for c in children).encode()).digest()


def leaf_digest(columns: list[Column]) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, ``:`` and the value; ``-`` where null."""
    texts = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256))


def depth(n: int) -> int:
    """Levels above n leaves."""
    return max(n - 1, 0).bit_length()


def subtree(digests: list[bytes], levels: int) -> list[list[bytes]]:
    """The digests and so many levels of parents above them."""
    out = [digests]
    for _ in range(levels):
        out.append([parent(out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree: list[list[bytes]], i: int) -> bytes:
    """Path of the i-th leaf to the top of the subtree."""
    steps = []
    for level in tree[:-1]:
        other = i ^ 1
        steps.append(bytes([ALONE]) if other >= len(level) else bytes([LEFT if other < i else RIGHT]) + level[other])
        i >>= 1
    return b"".join(steps)


def steps(path: bytes) -> Iterator[tuple[int, bytes]]:
    """(side, digest) of every level of a path."""
    at = 0
    while at < len(path):
        size = 0 if path[at] == ALONE else 32
        yield path[at], path[at + 1 : at + 1 + size]
        at += 1 + size


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf leads to over its siblings."""
    for side, other in steps(path):
        leaf = parent([leaf] if side == ALONE else [other, leaf] if side == LEFT else [leaf, other])
    return leaf


def _levels_here(n: int, done: int, bits: int) -> int:
    """Levels that the superblocks of one round add in a group of n leaves, after ``done``."""
    return min(bits, max(0, depth(n) - done))


def _placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Add ``pos``, a row's place in its group g, and ``n``, the group's rows.

    Range partitions lie in order, so a place is a row's number in its partition plus what stands in earlier ones; the
    window runs over one row for each group and partition.
    """
    ordered = nodes.repartitionByRange("g", *(F.col(c).asc_nulls_first() for c in order)).sortWithinPartitions("g", *(F.col(c).asc_nulls_first() for c in order))
    ordered = store(ordered.withColumns({"part": F.spark_partition_id(), "k": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "merkle-order")
    runs = ordered.groupBy("g", "part").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("rows"))
    group = Window.partitionBy("g")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("g", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(group).alias("n"))
    return ordered.join(runs, ["g", "part"]).withColumn("pos", F.col("k") + F.col("shift")).drop("part", "k", "shift")


def _reduced(nodes: DataFrame, done: int, bits: int) -> DataFrame:
    """One node for each superblock."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        n = int(rows["n"].iloc[0])
        top = subtree(list(rows["h"]), _levels_here(n, done, bits))[-1]
        return pd.DataFrame({"g": [key[0]], "n": [n], "pos": [key[1]], "h": [top[0]]})

    blocks = nodes.select("g", "n", "pos", "h", F.shiftright("pos", bits).alias("block"))
    return blocks.groupBy("g", "block").applyInPandas(run, "g string, n bigint, pos bigint, h binary")


def _rounds(leaves: DataFrame, most: int, bits: int) -> list[DataFrame]:
    """The leaves, and after each round its nodes, until every group has one."""
    out = [leaves]
    for r in range(max(1, -(-depth(most) // bits))):
        out.append(store(_reduced(out[-1], r * bits, bits), "merkle-nodes"))
    return out


def _exchanged(nodes: DataFrame, outer: DataFrame, done: int, bits: int) -> DataFrame:
    """Give each node its own path: what lies inside its superblock, then the superblock's outer siblings."""
    def run(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        tree = subtree(list(rows["h"]), _levels_here(int(rows["n"].iloc[0]), done, bits))
        rest = above["path"].iloc[0]
        paths = [siblings(tree, i) + rest for i in range(len(rows))]
        return pd.DataFrame({"g": key[0], "pos": rows["pos"].to_numpy(), "h": rows["h"].to_numpy(), "path": paths, "subroot": above["subroot"].iloc[0], "root": above["root"].iloc[0]})

    left, right = _sides(nodes.select("g", "n", "pos", "h"), outer, bits)
    return left.cogroup(right).applyInPandas(run, "g string, pos bigint, h binary, path binary, subroot binary, root binary")


def _sides(nodes: DataFrame, outer: DataFrame, bits: int):
    inner = nodes.withColumn("block", F.shiftright("pos", bits))
    above = outer.select("g", F.col("pos").alias("block"), "path", "subroot", "root")
    return inner.groupBy("g", "block"), above.groupBy("g", "block")


PROOF = "id string, leaf string, subroot string, root string, pos bigint, n bigint, proof array<string>, sides string, folded_root string"


def _finished(leaves: DataFrame, outer: DataFrame, bits: int) -> DataFrame:
    """Local reduction, proof joining and folding of the leaves of each superblock."""
    def run(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        n = int(rows["n"].iloc[0])
        tree = subtree(list(rows["h"]), _levels_here(n, 0, bits))
        rest, subroot, root = (above[c].iloc[0] for c in ("path", "subroot", "root"))
        proofs, sides, roots = [], [], []
        for i, now in enumerate(rows["now"]):
            path = siblings(tree, i) + rest
            proofs.append([h.hex() for side, h in steps(path) if side != ALONE])
            sides.append("".join("-LR"[side] for side, _ in steps(path)))
            roots.append(fold(now, path).hex())
        return pd.DataFrame({
            "id": rows["id"].to_numpy(), "leaf": [h.hex() for h in rows["h"]], "subroot": subroot.hex(), "root": root.hex(), "pos": rows["pos"].to_numpy(), "n": n,
            "proof": proofs, "sides": sides, "folded_root": roots,
        })

    left, right = _sides(leaves.select("g", "n", "pos", "h", "now", "id"), outer, bits)
    return left.cogroup(right).applyInPandas(run, PROOF)


def manifest(df: DataFrame, id_col: str, group_col: str, columns: list[str], now: dict[str, Column] | None = None, bits: int = BITS) -> DataFrame:
    """Every row's leaf, its siblings up to the root, and whether what is found now still leads there.

    Returns id, leaf, subroot, root, pos, n (place in the group and its rows), proof (siblings from the leaf up), sides
    (for each level ``L`` or ``R``, where the sibling stands, ``-`` for an odd last node), folded_root and verified.
    ``now`` gives columns another value than when the leaves were made, as expressions over the row; without it every row
    verifies.  Leaves of a group ascend by id, null first, and rows of one id by their digest; groups ascend by UTF-8
    bytes, null first.  Repeated rows are leaves of their own.  Null values have a digest of their own, unlike that of
    an empty text.  An empty table gives no row.  Columns of other names have no influence.
    """
    value = {c: F.col(f"`{c}`") for c in columns}
    found = value | (now or {})
    same = F.lit(True)
    for c in columns:
        same = same & value[c].eqNullSafe(found[c])
    leaf = leaf_digest(list(value.values()))
    rows = df.select(
        # Null comes before every named group, also before the empty one.
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit("")).alias("g"), F.col(f"`{id_col}`").alias("id"),
        leaf.alias("h"), F.when(~same, leaf_digest(list(found.values()))).alias("changed"), F.monotonically_increasing_id().alias("tie"),
    )
    # Texts are hashed once; identical rows, told apart by ``tie``, need not share a range.
    placed = store(_placed(store(rows, "merkle-leaves"), ["id", "h", "tie"]), "merkle-placed")
    leaves = placed.select("g", "n", "pos", "h", F.coalesce("changed", "h").alias("now"), F.col("id").cast("string").alias("id"))
    size = placed.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    inner = _rounds(leaves, size, bits)

    groups = inner[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "h")
    groups = store(_placed(groups, ["name"]), "merkle-groups")
    outside = _rounds(groups, groups.count(), bits)
    nothing = F.lit(b"")
    outer = outside[-1].select("g", "pos", nothing.alias("path"), nothing.alias("subroot"), F.col("h").alias("root"))
    for r in reversed(range(len(outside) - 1)):
        outer = store(_exchanged(outside[r], outer, r * bits, bits), "merkle-outer")
    outer = groups.select("pos", "name").join(outer, "pos").select(F.col("name").alias("g"), F.lit(0).cast("bigint").alias("pos"), "path", F.col("h").alias("subroot"), "root")
    for r in reversed(range(1, len(inner) - 1)):
        outer = store(_exchanged(inner[r], outer, r * bits, bits), "merkle-outer")
    out = _finished(inner[0], outer, bits)
    return out.select(
        F.col("id").cast(kind(df, id_col)).alias(id_col), "leaf", "subroot", "root", "pos", "n", "proof", "sides", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
