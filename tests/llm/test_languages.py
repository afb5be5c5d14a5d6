from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tallyweave.llm import languages as L
from tallyweave.llm.words import mix

PATH = "/root/testdata/sf0.01"


def plain_profile(text):
    """One n-gram at a time."""
    raw = (" " + text.lower() + " ").encode()
    raw = re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", b" ", raw)
    counts = np.zeros(L.FEATURES)
    for n in L.ORDERS:
        for i in range(len(raw) - n + 1):
            key = 0
            for b in raw[i : i + n]:
                key = (key * 257 + b + 1) % 2**64
            counts[int(mix(np.array([key], dtype=np.uint64))[0]) % L.FEATURES] += 1
    return np.sqrt(counts / counts.sum())


def test_profile(monkeypatch):
    monkeypatch.setattr(L, "SPAN", 16)
    for text in ("", "a", "Ünï côdé, 12 words\n\tand  more; ÉTÉ", "x" * 100, "..."):
        assert np.allclose(L.profile(text), plain_profile(text))
    assert np.allclose(L.profile("A-b  9 c"), L.profile("a b c"))


def test_machine_solves_its_problem():
    """No small step in any direction lowers the objective."""
    pick = np.random.default_rng(3)
    x = pick.normal(size=(60, 5))
    y = np.where(x[:, 0] + 0.5 * pick.normal(size=60) > 0.3, 1.0, -1.0)
    w = L.machine(x, y, passes=400)
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    full = np.hstack([x, np.ones((60, 1))])
    loss = lambda w: 0.5 * w @ w + (0.5 / share * np.maximum(0, 1 - y * (full @ w)) ** 2).sum()
    assert all(loss(w) <= loss(w + 1e-3 * d) for d in pick.normal(size=(200, 6)))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    held = L.remainder(F.col("doc_id"), 4) == 2
    model = L.train(docs.where(~held).select("text", "lang"))
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert set(model.by_family) == {"germanic", "romance"} and set(model.by_pair) == {("de", "en"), ("es", "fr")}
    rows = L.predict(docs.where(held), "doc_id", "text", model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def corpus(spark, languages, n=60):
    pick = random.Random(5)
    rows = []
    for k, lang in enumerate(languages):
        words = ["".join(pick.choice("abcdefghij"[k :] if lang else "z") for _ in range(5)) for _ in range(40)]
        rows += [(i + k * n, " ".join(pick.choice(words) for _ in range(30)), lang, 0.5) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, text string, lang string, score double")


def test_one_machine_for_each_pair_of_a_family(spark):
    docs = corpus(spark, ["da", "no", "sv", "fi", "xx"])
    model = L.train(docs, per_language=40)
    assert set(model.by_pair) == {("da", "no"), ("da", "sv"), ("no", "sv")} and set(model.by_family) == {"germanic", "uralic", "xx"}
    rows = L.predict(docs, "id", "text", model).join(docs.select("id", "lang"), "id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    again = L.predict(docs.repartition(7), "id", "text", L.train(docs.repartition(5), per_language=40)).collect()
    assert sorted((r.id, r.lang_pred, round(r.score, 6)) for r in again) == sorted((r.id, r.lang_pred, round(r.score, 6)) for r in rows)


def test_sample_is_bounded_and_copies_count_once(spark):
    docs = corpus(spark, ["da", "no"], 400).unionByName(corpus(spark, ["da"], 1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("n"))
    rows = L.sample(docs, 50).collect()
    assert sorted((r.lang, r.rank) for r in rows) == [(x, i + 1) for x in ("da", "no") for i in range(50)]
    assert len({r.text for r in rows}) == 100


def test_awkward_rows(spark):
    docs = corpus(spark, ["da", "no"])
    model = L.train(docs.unionByName(spark.createDataFrame([(None, None, "da", None), (1, "abc", None, None), (2, "12", "no", None)], docs.schema)))
    rows = [(1, None), (2, ""), (3, "12 ?!"), (None, docs.first().text), (5, docs.first().text), (5, docs.first().text), (6, "é"), (7, docs.first().text * 3000)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "id bigint, text string, lang_pred string, lettered int")
    got = {}
    for r in L.predict(frame, "id", "text", model).collect():
        got.setdefault(r.id, []).append((r.lang_pred, r.score))
    assert got[1] == got[2] == got[3] == [("und", 0.0)] and got[None] * 2 == got[5] and got[6][0][0] in ("da", "no") and got[7][0][0] == got[5][0][0]
    assert L.predict(frame.limit(0), "id", "text", model).collect() == []
    nothing = L.train(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in L.predict(docs, "id", "text", nothing).collect()} == {("und", 0.0)}
    single = L.train(docs.where("lang = 'da'"))
    assert {(r.lang_pred, r.score) for r in L.predict(docs, "id", "text", single).collect()} == {("da", 1.0)}
