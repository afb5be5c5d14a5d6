"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What every operator in this package expects of a session.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Joins back to row level keep their hot keys; the runtime splits them.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows are small once compressed and many operators multiply them: partitions of 8 MB of shuffle and splits of 1 to 32 MB
    # of a file keep a task's memory from growing with the tables, and all cores busy.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # Shuffles are cut this fine before they are put together by size, whatever spark.sql.shuffle.partitions says.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1024",
    "spark.sql.files.openCostInBytes": "1m",
    "spark.sql.files.maxPartitionBytes": "32m",
    # The JIT leaves methods above 8000 bytes uncompiled; wide projections then run from split methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str | None = None, app: str = "tallyweave", **extra: str) -> SparkSession:
    """A session with the package defaults; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; a private one only when all executors are on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    local = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir() or local


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared work folder."""
    return os.path.join(work_root(spark), "tallyweave", f"{label}-{uuid.uuid4().hex[:12]}")


#: Shuffle files of a finished write are deleted at once; the written table stands for them from then on.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class _Scopes(threading.local):
    """Paths written inside each open ``scratch`` of a thread, innermost last; a stream's batches run in another one."""

    def __init__(self):
        self.open: list[list[str]] = []


_scopes = _Scopes()


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(_SHUFFLE_CLEANUP, "false")
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several branches of a plan read the same costly result.  The files
    are on shared storage, so a lost executor costs a re-read and no re-run.  Inside ``scratch`` they go when it ends.
    """
    path = work_path(df.sparkSession, label)
    if _scopes.open:
        _scopes.open[-1].append(path)
    return _write(df, path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` by ``by`` over all shuffle partitions: rows that become many in one task aren't packed into few tasks by their size before."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def kept(df: DataFrame, label: str) -> DataFrame:
    """As ``materialize``, for a result that outlives the innermost ``scratch``."""
    path = work_path(df.sparkSession, label)
    if len(_scopes.open) > 1:
        _scopes.open[-2].append(path)
    return _write(df, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what is materialized inside once its result is ``kept``, or once it has failed."""
    _scopes.open.append([])
    try:
        yield
    finally:
        for path in _scopes.open.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, whatever file system it is on."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
