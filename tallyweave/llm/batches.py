"""Small helpers for functions from Arrow batches to Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]
#: Bytes of an Arrow batch that goes to Python, so that long texts don't add up to large batches.
BATCH_BYTES = 2 << 20


def bounded(spark) -> None:
    """Set the session's bound on Arrow batches, unless a smaller one is set."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", str(spark.conf.get(name)).strip())
    if not now or not 0 < int(now[1]) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def chain(*steps: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """One function that runs the steps one after the other, so that rows enter and leave Python once."""
    def run(batches: Batches) -> Batches:
        for step in steps:
            batches = step(batches)
        yield from batches

    return run


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    raw = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(raw).to_pylist()]


def rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns.values()], names=list(columns))


def kind(df: DataFrame, column: str) -> str:
    """SQL name of a column's type."""
    return df.schema[column].dataType.simpleString()


def folder(spark, label: str) -> str:
    """A fresh folder below the shared one; see ``tallyweave.session.work_path``."""
    from ..session import work_path

    return work_path(spark, label)


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and saves a second run."""
    from ..session import materialize

    bounded(df.sparkSession)
    return materialize(df, label)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names, whatever else ``df`` holds."""
    bounded(df.sparkSession)
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


__all__ = ["Batches", "bounded", "byte_texts", "chain", "folder", "kind", "only", "rows", "store"]
