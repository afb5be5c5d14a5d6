"""Statement files that arrive over time.

The file source hands each path over once.  Every micro-batch is normalised by the batch
operators and written under its own number, so a batch that runs twice replaces itself.  A
row that cannot be read is a row with status ``error``.  A file that cannot be read at all is
skipped by the source (``SOURCE``), and listed as failed afterwards: neither stops the other files.

The source also skips the rest of a file from an error on.  So the rows read of each file are compared with those
it holds (``held``): a short file is ``partial``, and its rows wait in ``out/partial`` until a retry reads it whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import materialize, scratch
from ..sources.sinks import write_partitioned

Normalizer = Callable[[DataFrame], DataFrame]
#: Gives file_id and rows, the number of rows that each file of the source holds; called for every attempt.
Held = Callable[[], DataFrame]
#: Options of the file source with which an unreadable file doesn't end the stream.  Use with ``held`` only.
SOURCE = {"ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}


def file_outcomes(parsed: DataFrame) -> DataFrame:
    """One row per file: rows by outcome and success when at least one transaction came out."""
    ok = F.count_if(F.col("status") == "ok")
    return parsed.groupBy("file_id").agg(
        ok.alias("transactions"), F.count_if(F.col("status") == "error").alias("errors"),
        F.when(ok > 0, "success").otherwise("failed").alias("status"),
    )


def parquet_rows(spark: SparkSession, path: str) -> DataFrame:
    """file_id (the file's name) and rows of Parquet files, from their footers alone; files without a footer are left out."""
    # No column of the file is used, so none is read.
    rows = spark.read.options(**SOURCE).schema("unused int").parquet(path).select(F.col("_metadata.file_name").alias("file_id"))
    return rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("rows"))


def _attempt(rows: DataFrame, normalize: Normalizer, held: Held | None, label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normalised rows of the files that were read whole, those of the others, and the outcome of each file."""
    if held is None:
        parsed = materialize(normalize(rows), label)
        return parsed, parsed.limit(0), file_outcomes(parsed)
    # What is counted must be what is normalised: another read may get further.
    rows = materialize(rows, f"{label}-rows")
    parsed = materialize(normalize(rows), label)
    read = materialize(rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("read")), f"{label}-read")
    there = held().where(F.col("file_id").isin([r.file_id for r in read.collect()]))
    short = materialize(read.join(there, "file_id", "left").where(F.coalesce(F.col("read") < F.col("rows"), F.lit(True))).select("file_id"), f"{label}-short")
    files = file_outcomes(parsed).join(short.withColumn("short", F.lit(True)), "file_id", "left")
    files = files.withColumn("status", F.when(F.col("short"), "partial").otherwise(F.col("status"))).drop("short")
    return parsed.join(short, "file_id", "left_anti"), parsed.join(short, "file_id", "left_semi"), files


def ingest(stream: DataFrame, normalize: Normalizer, out: str, checkpoint: str, once: bool = False, held: Held | None = None) -> StreamingQuery:
    """Start the ingest.  ``stream`` has a file_id column, ``normalize`` keeps it and adds status.

    Writes ``out/transactions`` and ``out/files``, both partitioned by micro-batch, and with ``held`` also
    ``out/partial``, the transactions of files that were not read whole.
    ``once`` takes what is there and stops.  A micro-batch leaves nothing in the work folder once it is written.
    """
    def one_batch(rows: DataFrame, number: int) -> None:
        # Several outputs read the batch: it is normalised once and kept on shared storage until they are written.
        with scratch(rows.sparkSession):
            whole, short, files = (x.withColumn("micro_batch", F.lit(number)) for x in _attempt(rows, normalize, held, "ingest"))
            write_partitioned(whole.where("status = 'ok'"), f"{out}/transactions", "micro_batch")
            if held is not None:
                write_partitioned(short.where("status = 'ok'"), f"{out}/partial", "micro_batch")
            write_partitioned(files, f"{out}/files", "micro_batch")

    writer = stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def record_unread(spark: SparkSession, arrived: DataFrame, out: str) -> None:
    """List the files of ``arrived`` (file_id) that no attempt got a row from as failed, under batch number -1."""
    known = spark.read.parquet(f"{out}/files").where("micro_batch <> -1").select("file_id").distinct()
    unread = arrived.select("file_id").distinct().join(known, "file_id", "left_anti")
    lost = unread.select(
        "file_id", F.lit(0).cast("bigint").alias("transactions"), F.lit(0).cast("bigint").alias("errors"), F.lit("failed").alias("status"), F.lit(-1).alias("micro_batch"))
    with scratch(spark):
        write_partitioned(materialize(lost, "unread"), f"{out}/files", "micro_batch")


def failed_files(spark: SparkSession, out: str) -> DataFrame:
    """Files that no attempt read whole and got a transaction from."""
    files = spark.read.parquet(f"{out}/files")
    best = files.groupBy("file_id").agg(F.max(F.col("status") == "success").alias("done"))
    return best.where(~F.col("done")).select("file_id")


def retry_failed(spark: SparkSession, rows: DataFrame, normalize: Normalizer, out: str, attempt: int, held: Held | None = None) -> None:
    """Run the failed and partial files again, usually with another normaliser, under a negative batch number.

    ``rows`` are the raw rows of any files; only the failed ones are taken.  The attempt is
    recorded only for files that now succeed, with ``held`` those that were now read whole.
    """
    number = F.lit(-1 - abs(attempt))
    with scratch(spark):
        whole, _, files = _attempt(rows.join(failed_files(spark, out), "file_id", "left_semi"), normalize, held, "retry")
        # Which files failed is read from the folder that is written last.
        good = materialize(files.where(F.col("status") == "success"), "retry-files")
        write_partitioned(whole.where("status = 'ok'").withColumn("micro_batch", number), f"{out}/transactions", "micro_batch")
        write_partitioned(good.withColumn("micro_batch", number), f"{out}/files", "micro_batch")
