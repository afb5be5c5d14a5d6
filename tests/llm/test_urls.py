from __future__ import annotations

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tallyweave.llm import urls
from tallyweave.llm.urls import RULES, entropy, judge

URLS = [
    None, "", "no scheme", "http://", "http://NET", "http://net/", "https://a.example.net/en/1?x=1&y=2", "http://example.net/en", "http://examplenet/en/",
    "http://www.example.com/de/5#top", "http://x.org/fr/", "http://x.org?/fr/", "http://ORG/fr/a?b", "ftp://É.com/ü", "http://a://b/c", "http://a.com:80/de/",
    "http://example.com/\nx",
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i, c in enumerate(rest) if c in "/?#"] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    end = min([i for i, c in enumerate(tail) if c in "?#"] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def rule(host, path):
    fits = [(len(r), v, r) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return max(fits)[1:] if fits else (None, None)


def test_hosts_paths_rules(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS + URLS[:3])] + [(1, "", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None), (9, 1), (9, 0)], "page_id bigint, bad int")
    got = sorted((r.page_id, r.host, r.path, r.rule or "") for r in judge(pages, labels).collect())
    assert got == sorted((i, *split(u), rule(*split(u))[1] or "") for i, u, _ in rows)
    assert all(r.verdict == (rule(r.host, r.path)[0] or r.verdict) and r.verdict in ("allow", "block") for r in judge(pages, labels).collect())


def test_entropy(spark):
    for u in URLS[1:]:
        counts = Counter(u)
        want = -sum(n / len(u) * math.log2(n / len(u)) for n in counts.values())
        assert abs(spark.range(1).select(entropy(F.lit(u)).alias("e")).first().e - want) < 1e-9


def test_no_labels_and_no_pages(spark):
    none = spark.createDataFrame([], "page_id bigint, bad int")
    pages = spark.createDataFrame([(1, "http://spam.example/1")], "page_id bigint, url string")
    assert [r.verdict for r in judge(pages, none).collect()] == ["allow"]
    assert judge(pages.limit(0), none).count() == 0


def test_held_out_accuracy(spark):
    pick = random.Random(3)
    word = lambda n: "".join(pick.choice("abcdefgh") for _ in range(n))
    rows = []
    for i in range(1200):
        bad = i % 3 == 0
        rows.append((i, f"http://{word(5)}.{'cheap-' if bad else ''}{word(4)}.biz/{pick.randrange(10 ** 9) if bad else word(6)}" + "?a=1&b=2&c=3" * bad, int(bad)))
    df = spark.createDataFrame(rows, "page_id bigint, url string, bad int")
    got = judge(df, df.where("page_id < 800").select("page_id", "bad")).where("page_id >= 800").collect()
    assert sum((r.verdict == "block") == (r.page_id % 3 == 0) for r in got) / len(got) > 0.95


def test_suffix_statistics_of_all_labelled_urls(spark, monkeypatch):
    """The limit bounds what the trees are fitted on, not what the statistics count."""
    rows = [(i, f"http://h{i}.s{i % 4}.biz/{i}", int(i % 4 == 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, bad int")
    seen = {}
    whole = urls.suffixes

    def kept(*frames):
        seen["stats"] = whole(*frames)
        return seen["stats"]

    def fitted(labelled):
        seen["fitted"] = labelled.count()

    monkeypatch.setattr(urls, "suffixes", kept)
    monkeypatch.setattr(urls, "fit", fitted)
    urls.judge(df, df.select("page_id", "bad"), limit=20)
    got = {r.suffix: (r.suffix_count, round(r.suffix_bad, 9)) for r in seen["stats"].collect()}
    assert got == {f"s{k}.biz": (50, round((50 * (k == 1) + 20 * 0.25) / 70, 9)) for k in range(4)} and seen["fitted"] == 20


def test_rates_of_other_folds(spark):
    pick = random.Random(4)
    rows = [(f"s{pick.randrange(6)}", pick.randrange(5), pick.randrange(2)) for _ in range(150)] + [("alone", 2, 1)]
    got = {(r.suffix, r.fold): r.suffix_bad for r in urls.fold_rates(spark.createDataFrame(rows, "suffix string, fold bigint, bad int")).collect()}
    assert got.keys() == {r[:2] for r in rows}
    for (suffix, fold), rate in got.items():
        others = [bad for _, f, bad in rows if f != fold]
        own = [bad for s, f, bad in rows if f != fold and s == suffix]
        assert abs(rate - (sum(own) + urls.PRIOR * sum(others) / len(others)) / (len(own) + urls.PRIOR)) < 1e-9


def test_labels_without_a_pattern_teach_nothing(spark):
    """Each suffix has few URLs and labels are drawn at random: a rate that held the row's own label would look telling."""
    pick = random.Random(8)
    rows = [(i, f"http://h.s{pick.randrange(250)}.biz/{pick.randrange(10 ** 6)}", int(pick.random() < 0.3)) for i in range(1500)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, bad int")
    scores = [r.bad_score for r in judge(df, df.where("page_id < 1000").select("page_id", "bad")).where("page_id >= 1000").collect()]
    assert sum(s > 0.5 for s in scores) / len(scores) < 0.1


def test_salted_statistics(spark):
    df = spark.createDataFrame([(i % 7, f"u{i % 40}", "hot" if i % 3 else "cold") for i in range(200)], "page_id bigint, url string, suffix string")
    stats = spark.createDataFrame([("hot", 1), ("cold", 2), ("none", 3)], "suffix string, suffix_count int")
    plain = df.join(stats, "suffix")
    assert sorted(map(tuple, urls.with_suffix(df, stats).select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
