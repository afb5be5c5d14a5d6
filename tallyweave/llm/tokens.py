"""Token counts of documents in flat token files.

A flat file is a run of little-endian 16-bit ids in which an end-of-document id follows each document; nothing says
where documents start.  Blocks of a file are searched for that id as arrays, each on its own; a prefix scan over one
small row for each block then tells how many documents ended before a block and how many tokens the one that is open at
its start has gathered.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import Batches, byte_texts, folder, kind, only, store
from .bpe import _encoding
from .words import portions

#: Tokens of a block.
BLOCK = 1 << 20
WIDTH = 2


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a place in the shared folder."""
    local = re.sub(r"^file:/+", "/", uri)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(uri)


def _write(path: str, vocabulary: str, pattern: str, end: int):
    def run(batches: Batches) -> Batches:
        encoding, out, n = _encoding(vocabulary, pattern), None, 0
        name = f"{uuid.uuid4().hex}.bin"  # of this attempt; only names in the written list count
        try:
            for batch in batches:
                texts = byte_texts(batch.column("text"))
                for some in portions([len(t) for t in texts]):
                    if out is None:
                        system, place = _open(path)
                        system.create_dir(place, recursive=True)
                        out = system.open_output_stream(f"{place}/{name}")
                    for text in texts[some]:
                        out.write(np.asarray([*encoding.encode_ordinary(text.decode()), end], dtype="<u2").tobytes())
                rows = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * rows), pa.array(np.arange(n, n + rows)), batch.column("id")], names=["file", "nth", "id"])
                n += rows
        finally:
            if out is not None:
                out.close()

    return run


def write_files(df: DataFrame, id_col: str, text_col: str, vocabulary: str, pattern: str, end: int, path: str) -> DataFrame:
    """Write each partition's documents to a flat file below ``path``; returns (file, nth, id) of every document.

    The list is written to the shared folder.  A task that runs again writes another file, and only files in the list
    count.  The vocabulary's ids and ``end`` are below 65536.
    """
    docs = only(df, id=id_col, text=text_col)
    return store(docs.mapInArrow(_write(path, vocabulary, pattern, end), f"file string, nth bigint, id {kind(docs, 'id')}"), "token-list")


def _search(end: int):
    """Blocks (place, file, block, offset, size) become their separators: count, lengths up to each, tokens behind the last."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                system, place = _open(row["place"])
                with system.open_input_file(place) as file:
                    ids = np.frombuffer(file.read_at(row["size"], row["offset"]), dtype="<u2")
                at = np.flatnonzero(ids == end)
                lengths = np.diff(at, prepend=-1) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]]), pa.array([row["block"]]), pa.array([len(at)]), pa.array([len(ids) - (int(at[-1]) + 1 if len(at) else 0)]),
                     pa.array([lengths], pa.list_(pa.int64()))],
                    names=["file", "block", "ends", "behind", "lengths"],
                )

    return run


def count_tokens(spark, path: str, end: int, files: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(file, nth, n_tokens, closed) of every document in the flat files below ``path``, or in those that ``files`` names.

    ``n_tokens`` leaves the separator out.  Tokens behind a file's last separator are a last document that isn't
    closed.  Empty documents count; an empty file has none.  A task holds one block.
    """
    found = spark.read.format("binaryFile").load(path).select(F.col("path").alias("place"), F.col("length").alias("bytes"))
    found = found.withColumn("file", F.element_at(F.split("place", "/"), -1)).where("bytes > 0")
    if files is not None:
        found = found.join(files.select("file").distinct(), "file", "left_semi")
    step = block * WIDTH
    blocks = found.select("place", "file", "bytes", F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / step))).alias("block")).select(
        "place", "file", "block", (F.col("block") * step).alias("offset"), F.least(F.lit(step), F.col("bytes") - F.col("block") * step).alias("size")
    )
    scanned = blocks.repartition("file", "block").mapInArrow(_search(end), "file string, block bigint, ends bigint, behind bigint, lengths array<bigint>")
    scanned = store(scanned, "token-blocks")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        scanned.select("file", "block", "ends", "behind")
        .withColumn("gathered", F.coalesce(F.sum("behind").over(before), F.lit(0)))
        .withColumn("base", F.coalesce(F.sum("ends").over(before), F.lit(0)))
        .withColumn("mark", F.last(F.when(F.col("ends") > 0, F.col("gathered")), ignorenulls=True).over(before))
        .withColumn("carry", F.col("gathered") - F.coalesce("mark", F.lit(0)))
        .withColumn("last", F.lead("block").over(order).isNull())
    )
    inside = scanned.join(sums.select("file", "block", "base", "carry"), ["file", "block"]).select("file", "base", "carry", F.posexplode("lengths").alias("i", "n"))
    closed = inside.select("file", (F.col("base") + F.col("i")).alias("nth"), F.when(F.col("i") == 0, F.col("n") + F.col("carry")).otherwise(F.col("n")).alias("n_tokens"), F.lit(True).alias("closed"))
    tail = F.when(F.col("ends") > 0, F.col("behind")).otherwise(F.col("behind") + F.col("carry"))
    left = sums.where("last").select("file", (F.col("base") + F.col("ends")).alias("nth"), tail.alias("n_tokens"), F.lit(False).alias("closed")).where("n_tokens > 0")
    return closed.unionByName(left)


def document_tokens(df: DataFrame, id_col: str, text_col: str, vocabulary: str, pattern: str, end: int, block: int = BLOCK) -> DataFrame:
    """id and n_tokens of every row, counted in flat files written from the texts.

    Null and empty texts have no tokens; repeated rows each have their row; an empty table gives an empty result.
    """
    spark = df.sparkSession
    path = folder(spark, "tokens")
    listed = write_files(df, id_col, text_col, vocabulary, pattern, end, path)
    if listed.isEmpty():
        return listed.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_tokens"))
    counted = count_tokens(spark, path, end, listed, block)
    return listed.join(counted, ["file", "nth"]).select(F.col("id").alias(id_col), "n_tokens")
