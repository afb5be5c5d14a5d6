"""From raw documents to token digests: quality, near duplicates, a mix of sources, encoding."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import bpe, jaccard, mixing, quality
from tallyweave.llm.batches import store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.  Rows without words go; repeated rows are judged alike."""
    return quality.keep_rows(docs.select(COLUMNS), "text")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group linked by 80 % of five-word shingles.

    Of equal rows one stays.  Rows of one doc_id with different texts are different documents; a null doc_id comes first.
    """
    named = docs.select(COLUMNS).withColumns({"h1": F.xxhash64(*COLUMNS), "h2": F.xxhash64(F.lit(1), *COLUMNS)})
    groups = jaccard.join(named.select(F.struct("doc_id", "h1", "h2").alias("id"), "text"), "id", "text")
    first = groups.where(F.col("id").eqNullSafe(F.col("component_id"))).select("id.h1", "id.h2").distinct()
    return named.join(first, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its source's share of all words asks for; none drops it, more repeat it."""
    sized = docs.select(*COLUMNS, mixing.words_in(F.col("text")).alias("size"))
    taken = mixing.mix(sized, "source", "size", ["doc_id"], COLUMNS)
    return taken.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document, and digests of its ids and of what they decode to."""
    return bpe.round_trip(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", good), ("near_duplicates", distinct), ("source_mix", mixed), ("byte_bpe", encoded),
]

#: SQL can express neither connected near duplicates at this size, nor the draws, nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each stage's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
