from __future__ import annotations

import hashlib

import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from corpus_pipeline import COLUMNS, STAGES, distinct, encoded, good, mixed
from tallyweave.llm.bpe import _encoding
from .test_jaccard import brute

PATH = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    kept = good(spark, docs, PATH)
    assert kept.columns == COLUMNS and [n for n, _ in STAGES] == ["quality_rules", "near_duplicates", "source_mix", "byte_bpe"]
    labels = spark.read.parquet(f"{PATH}/labels.parquet")
    long = F.size(F.split("text", r"\s+")) > 55
    clean = docs.where(long).join(labels.where("quality = 1"), "doc_id").select("doc_id")
    assert clean.join(kept, "doc_id", "left_anti").count() == 0  # clean documents stay
    assert kept.join(labels.where("quality = 0"), "doc_id").count() == 0

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    one = distinct(spark, kept, PATH)
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, _, c in brute(rows, 5, 80)})

    mix = mixed(spark, one, PATH)
    assert mix.columns == COLUMNS and mix.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3

    library = _encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = sorted(tuple(r) for r in encoded(spark, mix, PATH).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(r.doc_id, len(i := library.encode_ordinary(r.text)), sha(" ".join(map(str, i)).encode()), sha(r.text.encode())) for r in mix.collect()]
    assert got == sorted(want)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, PATH).collect()) == got


def test_awkward_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text), (1, text), (1, text + " more"), (1, "other " + " ".join(f"x{i}" for i in range(80))), (None, text), (2, None), (3, ""), (4, " \n")]
    docs = spark.createDataFrame([(i, t, None, None, None, "x") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, h1 string")
    kept = good(spark, docs, PATH)
    assert kept.count() == 5
    one = distinct(spark, kept, PATH)
    assert sorted((str(r.doc_id), r.text[:2]) for r in one.collect()) == [("1", "ot"), ("None", "w0")]
    assert encoded(spark, mixed(spark, one, PATH), PATH).count() == 2
    for _, stage in STAGES:
        assert stage(spark, docs.limit(0), PATH).count() == 0
