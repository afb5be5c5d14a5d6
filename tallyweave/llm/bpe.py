"""Byte-level BPE encoding and decoding.

A text is cut into chunks that overlap.  Each chunk is pre-tokenised on its own; from the first boundary that a
chunk shares with the one before, both agree for good, since the pattern looks at nothing before a match.  There
the chunks are stitched, and what lies between two stitches is encoded on its own.  A stitch never follows white
space, so the end of a part cannot change how the pattern splits it.  Chunks that share no boundary in the overlap
(one very long piece) are joined before they are encoded.  A text of many chunks is dealt over tasks in portions that
overlap and are stitched in the same way.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from functools import lru_cache
from itertools import chain as chain_in

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import Batches, byte_texts, chain, kind, only, store
from .words import portions

#: Characters of a chunk, of a portion that one task takes, and of the overlap with the next chunk or portion.
CHUNK = 1 << 13
PORTION = 1 << 16
OVERLAP = 512
#: White space for either library that applies the pattern.
_BLANK = regex.compile(r"[\s\x1c-\x1f\x85]")


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The vocabulary of a rank file; each worker reads it once."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def boundaries(text: str, pattern: str, lo: int, hi: int) -> list[int]:
    """Places in [lo, hi) where a pre-token ends that doesn't end in white space, reading ``text`` from its start."""
    out = []
    for m in regex.compile(pattern).finditer(text):
        end = m.end()
        if end >= hi:
            break
        if end >= lo and not _BLANK.match(text[end - 1]):
            out.append(end)
    return out


def regions(text: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The text cut where consecutive chunks share their first boundary; each part may be encoded on its own."""
    cuts, tail = [0], set()
    for at in range(0, len(text), chunk):
        piece = text[at : at + chunk + overlap]
        if tail:
            shared = tail.intersection(boundaries(piece, pattern, 1, overlap))
            cuts.extend([at + min(shared)] if shared else [])
        tail = {x - chunk for x in boundaries(piece, pattern, chunk + 1, chunk + overlap)} if len(piece) > chunk else set()
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def encode_step(path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Callable[[Batches], Batches]:
    """Batches (id, key, part, text) become (id, key, part, ids); each text is encoded by the regions of its chunks."""
    def run(batches: Batches) -> Batches:
        encoding = _encoding(path, pattern)
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            for some in portions([len(t) for t in texts]):
                ids = [list(chain_in.from_iterable(map(encoding.encode_ordinary, regions(t.decode(), pattern, chunk, overlap)))) for t in texts[some]]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in ids])
                array = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                head = batch.slice(some.start, some.stop - some.start)
                yield pa.RecordBatch.from_arrays([head.column(c) for c in ("id", "key", "part")] + [array], names=["id", "key", "part", "ids"])

    return run


def _lists(column: pa.ListArray) -> list[list[int]]:
    """The ids of each row, made Python numbers at once and not one by one."""
    ends = column.offsets.to_numpy().tolist()
    flat = column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


def decode_step(path: str, pattern: str) -> Callable[[Batches], Batches]:
    """Adds ``bytes``: the raw bytes of the ids, concatenated."""
    def run(batches: Batches) -> Batches:
        encoding = _encoding(path, pattern)
        for batch in batches:
            raw = [encoding.decode_bytes(x) for x in _lists(batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, "bytes"])

    return run


def digest_step(batches: Batches) -> Batches:
    """(id, key, part, ids, bytes) become one row per text: id, n_tokens, ids_sha256, decoded_sha256.

    The parts of a text follow one another; only hash states are kept between batches.
    """
    digits = None
    last, state = None, None
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        done = list(zip(*out, strict=True)) if out else [[], [], [], []]
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(done[0], id_type), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string()), pa.array(done[3], pa.string())],
            names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    id_type = None
    for batch in batches:
        id_type = batch.schema.field("id").type
        who_key_raw = (batch.column(c).to_pylist() for c in ("id", "key", "bytes"))
        for who, key, raw, ids in zip(*who_key_raw, _lists(batch.column("ids")), strict=True):
            if digits is None:
                digits = [str(i) for i in range(1 << 16)]
            if key is None or key != last:
                if state:
                    out.append((state[0], state[1], state[2].hexdigest(), state[3].hexdigest()))
                last, state = key, [who, 0, hashlib.sha256(), hashlib.sha256()]
            if ids:
                names = map(digits.__getitem__, ids) if max(ids) < len(digits) else map(str, ids)
                state[2].update((" " * (state[1] > 0) + " ".join(names)).encode())
            state[1] += len(ids)
            state[3].update(raw)
        yield flush()
    if state:
        out.append((state[0], state[1], state[2].hexdigest(), state[3].hexdigest()))
        yield flush()


def _chunks(size: int, overlap: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        n, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            for i, raw in enumerate(byte_texts(batch.column("text"))):
                text, n = raw.decode(), n + 1
                for part in range(-(-len(text) // size)):
                    piece = text[part * size : (part + 1) * size + overlap]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").slice(i, 1), pa.array([f"{task}-{n}"]), pa.array([part], pa.int32()), pa.array([piece])],
                        names=["id", "key", "part", "text"],
                    )

    return run


def _edges(size: int, overlap: int, pattern: str) -> Callable[[Batches], Batches]:
    """Boundaries in a chunk's first characters and, counted from there, in what it shares with the next chunk."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = [t.decode() for t in byte_texts(batch.column("text"))]
            head = [boundaries(t, pattern, 1, overlap) for t in texts]
            # The last piece of a window may go on behind it.
            tail = [[x - size for x in boundaries(t, pattern, size + 1, size + overlap)] if len(t) > size else [] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("part"), pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))],
                names=["key", "part", "head", "tail"],
            )

    return run


def _join_parts(size: int) -> Callable[[Batches], Batches]:
    """Concatenate the pieces of each region; they follow one another."""
    def run(batches: Batches) -> Batches:
        held: list | None = None
        schema = None
        give = lambda: pa.RecordBatch.from_arrays(
            [pa.array([held[0]], schema.field("id").type), pa.array([held[1]]), pa.array([held[2]], pa.int32()), pa.array(["".join(held[3])])],
            names=["id", "key", "part", "text"],
        )
        for batch in batches:
            schema = batch.schema
            for row in batch.to_pylist():
                if held and (row["key"], row["region"]) != (held[1], held[2]):
                    yield give()
                    held = None
                if held is None:
                    held = [row["id"], row["key"], row["region"], []]
                held[3].append(row["text"][row["cut"] or 0 : size + (row["next"] or 0)])
        if held:
            yield give()

    return run


def encoded_parts(df: DataFrame, id_col: str, text_col: str, portion: int = PORTION, overlap: int = OVERLAP, pattern: str = "") -> tuple[DataFrame, DataFrame]:
    """Texts of at most one portion, (id, key, part, text), and the others' pieces, which ``_join_parts`` makes regions.

    Every region is to be encoded on its own.  ``key`` tells texts apart even where ids repeat; it is null for texts
    of one portion.  Long texts are read once, written as portions to the shared folder, and only small boundary lists
    are ordered by text.
    """
    texts = only(df, id=id_col, text=text_col)
    size = F.coalesce(F.length("text"), F.lit(0))
    short = texts.where(size <= portion).select("id", F.lit(None).cast("string").alias("key"), F.lit(0).alias("part"), "text")
    kinds = f"id {kind(texts, 'id')}, key string, part int"
    long = store(texts.where(size > portion).mapInArrow(_chunks(portion, overlap), f"{kinds}, text string"), "bpe-chunks")
    edges = long.select("key", "part", "text").mapInArrow(_edges(portion, overlap, pattern), "key string, part int, head array<int>, tail array<int>")
    order = Window.partitionBy("key").orderBy("part")
    cuts = (
        edges.withColumn("cut", F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
        .withColumn("next", F.lead("cut").over(order))
        .withColumn("region", F.sum(F.when(F.col("cut").isNotNull(), 1).otherwise(0)).over(order).cast("int"))
        .select("key", "part", "cut", "next", "region")
    )
    pieces = long.join(cuts, ["key", "part"]).select("id", "key", "part", "region", "cut", "next", "text")
    return short, pieces.repartition("key", "region").sortWithinPartitions("key", "region", "part")


def encode(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str, portion: int = PORTION, overlap: int = OVERLAP, chunk: int = CHUNK) -> DataFrame:
    """Token ids of every text: (id, key, part, ids), as the rank file's library gives for the whole text.

    A text longer than ``portion`` has several parts with one ``key``; they are consecutive rows of one partition, in
    order.  Others have one row with a null key and are encoded without a shuffle.  Null and empty texts have no
    ids.  Repeated rows stay apart.  The ids of a text are those of its parts, one after the other.
    """
    short, long = encoded_parts(df, id_col, text_col, portion, overlap, pattern)
    kinds = f"id {kind(short, 'id')}, key string, part int, ids array<int>"
    step = encode_step(path, pattern, chunk, overlap)
    ordered = long.mapInArrow(chain(_join_parts(portion), step), kinds).repartition("key").sortWithinPartitions("key", "part")
    return short.mapInArrow(step, kinds).unionByName(ordered)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``bytes`` to what ``encode`` returns."""
    kinds = ", ".join(f"{c} {kind(encoded, c)}" for c in encoded.columns)
    return encoded.mapInArrow(decode_step(path, pattern), f"{kinds}, bytes binary")


def round_trip(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str, portion: int = PORTION, overlap: int = OVERLAP, chunk: int = CHUNK) -> DataFrame:
    """Encode every text, decode its ids, and return id, n_tokens, ids_sha256 and decoded_sha256 of each.

    The steps are those of ``encode`` and ``decode``, run in one pass of Python.
    """
    short, long = encoded_parts(df, id_col, text_col, portion, overlap, pattern)
    id_kind = kind(short, "id")
    kinds = f"id {id_kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    step, back = encode_step(path, pattern, chunk, overlap), decode_step(path, pattern)
    ordered = long.mapInArrow(chain(_join_parts(portion), step), f"id {id_kind}, key string, part int, ids array<int>").repartition("key").sortWithinPartitions("key", "part")
    return short.mapInArrow(chain(step, back, digest_step), kinds).unionByName(ordered.mapInArrow(chain(back, digest_step), kinds)).withColumnRenamed("id", id_col)
