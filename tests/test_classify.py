from __future__ import annotations

import math
import random
import re
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import classify as C
from tallyweave.operators import similarity as S

GOLDEN = [
    ("expense", "报销", "", "50602", "rule_e032"), ("expense", "电信费", "", "5060216", "rule_e033"),
    ("expense", "团险保费", "", "5060211", "rule_e034"), ("expense", "支付郑炜", "", "5060202", "rule_e035"),
    ("expense", "支付保证金", "", "1022104", "rule_e028"), ("income", "收到退押金", "", "1022104", "rule_i007"),
    ("income", "收到退保证金", "", "1022104", "rule_i007"), ("income", "退回手续费", "", "1022120", "rule_i008"),
    ("income", "小企业短期普通贷款利息收入", "", "1022103", "rule_i009"),
    ("expense", "支付物业管理费", "启胜物业", "5060203", "rule_e001"), ("income", "收到货款", "", "10122", "rule_i001"),
    ("expense", "未知交易类型", "", "", ""), ("expense", "收到退保证金", "", "", ""),
    ("expense", "社会保险", "", "5060210", "rule_e004"), ("expense", "物业费", "别家", "5060203", "rule_e031"),
]


def _texts(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, direction string, description string, counterparty string")


def test_default_rules(spark):
    out = S.classify(_texts(spark, [g[:3] for g in GOLDEN]), C.load_rules(spark)).orderBy("id").collect()
    assert [(r.subject_code, r.rule_id) for r in out] == [g[3:] for g in GOLDEN]
    assert [r.source for r in out] == ["rule" if g[3] else "unmatched" for g in GOLDEN]


def _rule(i, words, **kw):
    base = dict(ord=i, rule_id=f"r{i}", direction="expense", priority=5, keywords=tuple(words), code=f"c{i}", name=f"n{i}")
    return C.Rule(**{**base, **kw})


def test_conditions(spark):
    rules = [
        _rule(0, ["fee"], exclude=("refund",)), _rule(1, ["fee"], priority=1, require=("bank", "wire")),
        _rule(2, ["rent"], counterparty_pattern="Ltd"), _rule(3, [], priority=0), _rule(4, ["rent"], priority=5),
        _rule(5, ["fee"], direction="income", priority=0),
    ]
    rows = [("expense", "fee", None), ("expense", "refund fee", None), ("expense", "bank fee wire", ""), ("expense", "rent", "A Ltd"),
            ("expense", "rent", None), ("income", "fee", ""), ("expense", "FEE", "")]
    texts = _texts(spark, rows)
    want = ["r0", None, "r1", "r2", "r4", "r5", None]
    compiled = C.apply_rules(texts, rules).orderBy("id").collect()
    joined = C.join_rules(texts, C.rules_frame(spark, rules)).orderBy("id").collect()
    assert [r.match and r.match.rule_id for r in compiled] == want
    assert [r.match and r.match.rule_id for r in joined] == want


def test_large_rule_set_joins(spark):
    rnd = random.Random(1)
    rules = [_rule(i, ["".join(rnd.choices("abcd", k=rnd.randint(1, 4)))], priority=rnd.randint(1, 30)) for i in range(C.COMPILED_RULE_LIMIT + 20)]
    rows = [("expense", "".join(rnd.choices("abcd ", k=12)), "") for _ in range(60)]
    out = C.apply_rules(_texts(spark, rows), C.rules_frame(spark, rules)).orderBy("id").collect()
    for row, (_, text, _) in zip(out, rows):
        hits = [(r.priority, r.ord, r.rule_id) for r in rules if any(k in text for k in r.keywords)]
        assert (row.match and row.match.rule_id) == (min(hits)[2] if hits else None)


def test_anchor_index(spark):
    """Keywords of any length, also empty ones; the rarest piece stands for a word, and a word no text can hold has none."""
    rnd = random.Random(8)
    rules = [_rule(i, ["".join(rnd.choices("abcde", k=k % 7)) for k in range(i, i + 2)], priority=rnd.randint(1, 99)) for i in range(1, 60)]
    rules += [_rule(90, ["", "zz"], priority=1000), _rule(91, ["费"], priority=0), _rule(92, ["zzzz"], priority=0)]
    rows = [("expense", "".join(rnd.choices("abcdef ", k=rnd.randint(0, 14))), "") for _ in range(150)] + [("expense", "手续费", ""), ("expense", "", ""), ("expense", None, "")]
    texts = _texts(spark, rows)
    compiled = [r.match for r in C.apply_rules(texts, rules).orderBy("id").collect()]
    assert compiled == [r.match for r in C.join_rules(texts, C.rules_frame(spark, rules)).orderBy("id").collect()]
    words = spark.createDataFrame([("abc",), ("bcd",), ("xyz",), ("",)], "word string")
    pieces = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "bc"), (3, "cd"), (1, "")], "tid int, gram string")
    assert {(r.word, r.gram) for r in C._anchors(words, pieces).collect()} == {("abc", "bc"), ("bcd", "bc"), ("", "")}


def test_keywords_with_common_pieces(spark, monkeypatch):
    """Candidates stay in proportion to texts where all keywords are made of the same few pairs of characters."""
    n = 400
    words = [f"{k % 10}{i:03d}{k % 10}" for i in range(n) for k in range(2)]
    rules = [_rule(i, [w], priority=i % 7) for i, w in enumerate(words)]
    texts = _texts(spark, [("expense", f"pay {w} x", "") for w in words])
    found = []
    pieces = C._pieces
    monkeypatch.setattr(C, "_pieces", lambda *a: found.append((pieces(*a), a[1])) or found[-1][0])
    joined = C.join_rules(texts, C.rules_frame(spark, rules)).orderBy("id").collect()
    assert [r.match.rule_id for r in joined] == [f"r{i}" for i in range(2 * n)]
    keys, anchors = found[0]
    wanted = anchors.select(F.xxhash64(F.lit("expense"), "gram").alias("key"))
    assert keys.join(wanted, "key").count() <= 2 * len(words)


def test_long_keywords_by_their_rarest_piece(spark):
    """Keywords longer than a piece, beside short, single and empty ones, and with a pattern of the counterparty."""
    rnd = random.Random(11)
    rules = [_rule(i, ["".join(rnd.choices("ab", k=rnd.randint(1, 12)))], priority=rnd.randint(1, 9), counterparty_pattern=rnd.choice(["", "z"])) for i in range(80)]
    rules += [_rule(80, [""], priority=50, exclude=("bbb",)), _rule(81, ["aaaaaaaaaaaa"], priority=0)]
    rows = [("expense", "".join(rnd.choices("ab", k=rnd.randint(0, 20))), rnd.choice(["", "xyz", None])) for _ in range(200)]
    texts = _texts(spark, [*rows, ("expense", "b" + "a" * 13, ""), ("income", "ab", "z")])
    compiled = [r.match for r in C.apply_rules(texts, rules).orderBy("id").collect()]
    assert compiled == [r.match for r in C.join_rules(texts, C.rules_frame(spark, rules)).orderBy("id").collect()]


def test_gram_counts_are_spread(spark):
    """Few small texts become many grams: they are counted in all shuffle partitions, not in those their size asks for."""
    texts = spark.createDataFrame([("expense", f"text {i}") for i in range(300)] + [("expense", "aaa")] * 2, "direction string, ct string")
    counts = S.gram_counts(texts, ["direction"])
    assert counts.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [tuple(r) for r in counts.where("ct = 'aaa'").select("gram", "cnt", "total").collect()] == [("aa", 4, 2)]
    assert counts.where("ct = 'text 1'").count() == 5


def test_both_ways_agree_on_null_bearing_rules(spark):
    """Null conditions, priorities and patterns mean the same whether rules are compiled or joined."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abc", k=rnd.randint(1, 3)))
    rows = [
        (i, f"r{i}", rnd.choice(["expense", "income"]), rnd.choice([None, 1, 2, 999]), rnd.choice([None, [], [word()], [word(), None]]), rnd.choice([None, [word()]]),
         rnd.choice([None, [word()]]), rnd.choice([None, "", "b"]), rnd.choice([None, "c"]), None)
        for i in range(60)
    ]
    rules = spark.createDataFrame(rows, C.RULE_SCHEMA)
    texts = [(i, rnd.choice(["expense", "income", None]), rnd.choice([None, "", "".join(rnd.choices("abc ", k=6))]), rnd.choice([None, "", "ab"])) for i in range(80)]
    df = spark.createDataFrame(texts, "id int, direction string, description string, counterparty string")
    compiled = [tuple(r) for r in C.apply_rules(df, rules).orderBy("id").collect()]
    assert compiled == [tuple(r) for r in C.join_rules(df, rules).orderBy("id").collect()]
    assert [r[3] for r in compiled] == [t[3] for t in texts]


def test_repeated_subject_codes_do_not_multiply(spark):
    subjects = spark.createDataFrame([("1", "a", "A"), ("1", "b", "B")], "code string, aux_category string, aux_category_name string")
    assert [tuple(r) for r in C.with_aux(spark.createDataFrame([("1",), ("2",)], "subject_code string"), subjects).orderBy("subject_code").collect()] == [("1", "b", "B"), ("2", "", "")]


def test_missing_rule_file_gives_no_rules(spark):
    assert C.load_rules(spark, "/tmp/no-such-rules.json") == []
    assert C.load_rules(spark, {"expense": {"rules": [{"match": {"keywords": ["x"]}}]}})[0].priority == 999


def test_lint(spark):
    rules = C.rules_frame(spark, [_rule(0, ["a"]), _rule(1, ["a"], rule_id="r0", direction="income"), _rule(2, [], code=""), _rule(3, ["b"], rule_id="")])
    subjects = spark.createDataFrame([("c0",), ("c1",)], "code string")
    found = {(r.ord, r.finding) for r in C.lint_rules(rules, subjects).collect()}
    assert found == {(1, "duplicate id"), (2, "no keywords"), (2, "missing subject"), (3, "missing id"), (3, "unknown subject")}
    assert (3, "unknown subject") not in {(r.ord, r.finding) for r in C.lint_rules(rules, subjects.limit(0)).collect()}


# --- history -----------------------------------------------------------------------------

def _history(spark, rows):
    return spark.createDataFrame(rows, "hid bigint, description string, direction string, code string, name string, confirmed date")


def _grams(text):
    clean = "".join(ch for ch in text if ch.isalnum())
    return Counter([clean]) if len(clean) == 1 else Counter(clean[i:i + 2] for i in range(len(clean) - 1))


def _brute(query, direction, rows, threshold):
    docs = [(h, _grams(h[1])) for h in rows if h[2] == direction]
    df = Counter(g for _, d in docs for g in d)
    idf = {g: math.log(len(docs) / n) + 1 for g, n in df.items()}
    vec = lambda t: {g: n / sum(t.values()) * idf.get(g, 0.0) for g, n in t.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    q, best = vec(_grams(query)), None
    for h, d in docs:
        v = vec(d)
        size = norm(q) * norm(v)
        score = sum(q[g] * v[g] for g in q if g in v) / size if size else 0.0
        if round(score, 12) >= threshold:
            key = (round(score, 12), h[5], -h[0])
            best = max(best, (key, h[0])) if best else (key, h[0])
    return best and best[1]


@pytest.mark.parametrize("alphabet,threshold", [("支付费工资房租", 0.75), ("ab", 0.75), ("支付费工资", 0.3), ("支付费", 0.95)])
def test_exact_against_brute_force(spark, alphabet, threshold):
    rnd = random.Random(len(alphabet))
    word = lambda: "".join(rnd.choices(alphabet, k=rnd.randint(0, 7)))
    rows = [(i, word(), rnd.choice(["expense", "income"]), f"c{i}", "n", date(2024, 1, rnd.randint(1, 9))) for i in range(60)]
    asked = [(rnd.choice(["expense", "income"]), word() + rnd.choice(["", "X", "-"])) for _ in range(80)]
    index = S.index_history(_history(spark, rows), threshold)
    got = {(r.direction, r.ct): r.hid for r in S.similar_history(spark.createDataFrame(asked, "direction string, description string"), index).collect()}
    for way, text in asked:
        clean = "".join(ch for ch in text if ch.isalnum())
        assert got.get((way, clean)) == _brute(text, way, rows, threshold), (way, text)


def _random_case(seed, n, asked):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("支付费工资房租ab1", k=rnd.randint(0, 9)))
    rows = [(i, word(), rnd.choice(["expense", "income", None]), f"c{i}", "n", date(2024, 1, rnd.randint(1, 9)) if rnd.random() < 0.9 else None) for i in range(n)]
    return rows, [(rnd.choice(["expense", "income"]), word()) for _ in range(asked)] + [(None, "支付"), ("expense", None)]


def test_both_searches_agree_over_small_blocks(spark, monkeypatch):
    """Blocks and parts of a list change nothing, and neither does the order in which lists are visited."""
    rows, asked = _random_case(3, 150, 120)
    queries, index = spark.createDataFrame(asked, "direction string, description string"), S.index_history(_history(spark, rows), 0.6)
    want = sorted(map(str, S.similar_history(queries, index).collect()))
    assert want and want == sorted(map(str, S.top1_history(queries, index).collect()))
    monkeypatch.setattr(S, "BLOCK", 3)
    monkeypatch.setattr(S, "ASKED", 2)
    assert want == sorted(map(str, S.similar_history(queries, index).collect()))
    assert want == sorted(map(str, S.top1_history(queries, index).collect()))


def test_bounds_of_few_grams_lose_nothing():
    """Products over a block's heaviest grams and the norm of the rest bound all pairs; chunks of any size give the best text."""
    import numpy as np

    rnd = np.random.default_rng(5)
    texts = [np.sort(rnd.choice(40, rnd.integers(1, 12), replace=False)) for _ in range(90)]
    weights = [rnd.random(len(x)) + 0.1 for x in texts]
    weights = [w / np.sqrt((w * w).sum()) for w in weights]
    flat = lambda lo, hi: (np.array([len(x) for x in texts[lo:hi]]), np.concatenate(texts[lo:hi]), np.concatenate(weights[lo:hi]))
    dense = np.zeros((90, 40))
    for row, x, w in zip(dense, texts, weights, strict=True):
        row[x] = w
    want = np.round(dense[60:] @ dense[:60].T, 12)
    for grams, some in ((1, 2), (7, 5), (40, 30)):
        before = S.DENSE, S.CHUNK, S.SCORED
        S.DENSE, S.CHUNK, S.SCORED = grams, some, some
        try:
            block = S._Block(np.arange(60), np.ones(60), *flat(0, 60))
            parts = list(block.best(np.ones(30), np.full(30, 0.3), *flat(60, 90)))
        finally:
            S.DENSE, S.CHUNK, S.SCORED = before
        found = {int(q): (int(t), round(float(s), 12)) for queries, tids, scores, _ in parts for q, t, s in zip(queries, tids, scores, strict=True) if t >= 0}
        assert found == {q: (int(row.argmax()), row.max()) for q, row in enumerate(want) if row.max() >= 0.3}


@pytest.mark.parametrize("split,worth,wide,cells,bound", [(0, 0, 7, 2**25, 0.3), (5, 0, 64, 900, 0.6), (0, 0, 1, 40, 0.0), (20, 10, 8192, 2**25, 0.85)])
def test_long_lists_are_cut_by_the_next_gram(monkeypatch, split, worth, wide, cells, bound):
    """Queries that can reach many texts of a list meet fewer by the next gram they share, and each still finds its best."""
    import numpy as np

    for name, value in {"SPLIT": split, "WORTH": worth, "WIDE": wide, "CELLS": cells, "CHUNK": 9}.items():
        monkeypatch.setattr(S, name, value)
    rnd = np.random.default_rng(split + wide)
    idf = np.concatenate(([9.0], np.sort(rnd.random(40) + 1)[::-1]))  # gram 0 is the rarest, and all texts have it
    texts = [np.concatenate(([0], np.sort(rnd.choice(np.arange(1, 41), rnd.integers(0, 9), replace=False)))) for _ in range(320)]
    tf = [rnd.integers(1, 3, len(x)) * np.where(x == 0, rnd.random(), 4.0) for x in texts]
    norm = [np.sqrt(((t * idf[x]) ** 2).sum()) for x, t in zip(texts, tf, strict=True)]
    dense = np.zeros((320, 41))
    for row, x, t, n in zip(dense, texts, tf, norm, strict=True):
        row[x] = t * idf[x] / n
    want = np.round(dense[200:] @ dense[:200].T, 12)
    size, ids = np.array([len(x) for x in texts]), np.concatenate(texts)
    w, cut = np.concatenate([row[x] for row, x in zip(dense, texts, strict=True)]), int(size[:200].sum())
    block = S._Block(np.arange(200), np.ones(200), size[:200], ids[:cut], w[:cut], idf[ids[:cut]], 0, bound)
    asked = size[200:], ids[cut:]
    mine = block.weights(*asked, np.concatenate(tf)[cut:], np.array(norm[200:]))
    assert np.allclose(mine, w[cut:])
    known = np.searchsorted(block.vocabulary, asked[1])
    meetings = [int(reach.sum()) for _, reach, _ in block._meetings(np.ones(120), np.full(120, bound), asked[0], known, mine)]
    assert len(meetings) > 1 and (bound < 0.6 or sum(meetings) < 0.5 * 200 * 120)
    found = {int(q): (int(t), round(float(x), 12)) for part in block.best(np.ones(120), np.full(120, bound), *asked, mine) for q, t, x in zip(*part[:3], strict=True) if t >= 0}
    best = {q: (int(row.argmax()), row.max()) for q, row in enumerate(want) if row.max() >= bound}
    assert found.keys() == best.keys()
    assert all(found[q][1] == pytest.approx(x, abs=2e-12) and want[q][found[q][0]] == pytest.approx(x, abs=2e-12) for q, (_, x) in best.items())


def test_grams_of_many_texts_at_once():
    """Null, empty and lone characters, characters beyond 16 bits, grams that repeat; a text's grams end with it."""
    import pyarrow as pa

    texts = ["ab", None, "", "x", "abab", "\U0001f600支", "\U0001f600", "ba", ""]
    size, ids, tf = S._cut(pa.array(texts))
    got = np_split(size, ids, tf)
    name = lambda i: (chr(i >> 21) if i >> 21 else "") + (chr(i & 0x1FFFFF) if i & 0x1FFFFF else "")
    assert [{name(int(i)): float(f) for i, f in row} for row in got] == [{g: n / sum(c.values()) for g, n in c.items()} for c in map(
        lambda t: Counter([t]) if t and len(t) == 1 else Counter((t or "")[i:i + 2] for i in range(len(t or "") - 1)), texts)]
    assert [len(x) for x in (S._cut(pa.array([None, ""], pa.string())))] == [2, 0, 0]


def np_split(size, ids, tf):
    ends = [0, *size.cumsum()]
    return [list(zip(ids[a:b], tf[a:b], strict=True)) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def test_texts_travel_without_vectors_and_not_through_the_driver(spark):
    rows, asked = _random_case(6, 40, 30)
    queries, index = spark.createDataFrame(asked, "direction string, description string"), S.index_history(_history(spark, rows), 0.6)
    assert "w" not in index.texts.columns and {"w", "idf"}.isdisjoint(S._asked(queries, index).columns)
    plan = S.similar_history(queries, index)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(slot" in line]
    assert dealt and not re.search(r"BroadcastHashJoin \[[qt]id#", plan), plan


def test_extended_index_is_the_index_of_all(spark, tmp_path):
    rows, asked = _random_case(4, 120, 100)
    queries = spark.createDataFrame(asked, "direction string, description string")
    grown = S.index_history(_history(spark, rows[:50]), 0.6)
    for part in (rows[50:51], rows[51:]):
        grown = S.extend_index(grown, _history(spark, part))
    whole = S.index_history(_history(spark, rows), 0.6)
    key = lambda i: sorted((str(r.direction), r.id, r.df, r.n, r.idf) for r in i.grams.where("direction IS NOT NULL").collect())
    assert key(grown) == key(whole)
    want = sorted(map(str, S.top1_history(queries, whole).collect()))
    S.save_index(grown, str(tmp_path / "index"))
    kept = S.load_index(spark, str(tmp_path / "index"))
    assert kept.keys == ("direction",) and kept.threshold == 0.6
    assert want == sorted(map(str, S.top1_history(queries, kept).collect()))


def test_few_pairs_are_scored(spark):
    """On templated texts pairs for each query stay few while the history grows, and the rising bound saves some."""
    def effort(n):
        texts = lambda lo, hi: [(i, f"payment order {i * 7919 % 99991:05d} branch {i % 7}", "expense", "c", "n", date(2024, 1, 1)) for i in range(lo, hi)]
        index = S.index_history(_history(spark, texts(0, n)))
        queries = _history(spark, texts(n // 2, n // 2 + 300)).select("direction", "description")
        return S.scored_pairs(queries, index, False) / 300, S.scored_pairs(queries, index, True) / 300

    small, large = effort(600), effort(6000)
    assert large[1] <= large[0] and small[1] <= small[0] and large[1] < 40 and large[1] < 3 * small[1] + 3


def test_history_tier(spark):
    history = _history(spark, [
        (1, "支付AWS云主机托管服务费", "expense", "S1", "云", date(2024, 1, 1)), (2, "支付AWS云主机托管服务费", "expense", "S2", "云二", date(2024, 2, 1)),
        (3, "房屋押金", "income", "S3", "押", date(2024, 1, 1)),
    ])
    rows = [("expense", "支付AWS云主机托管服务费用", ""), ("income", "支付AWS云主机托管服务费用", ""), ("expense", "完全不同", ""), ("expense", "报销", "")]
    subjects = spark.createDataFrame([("S2", "cat", "catname")], "code string, aux_category string, aux_category_name string")
    out = S.classify(_texts(spark, rows), C.load_rules(spark), history, subjects).orderBy("id").collect()
    assert [(r.source, r.subject_code) for r in out] == [("history", "S2"), ("unmatched", ""), ("unmatched", ""), ("rule", "50602")]
    assert out[0].aux_category == "cat" and out[1].aux_category == ""


def test_match_column_needs_no_shuffle(spark):
    texts = spark.range(10).select(F.lit("expense").alias("direction"), F.lit("报销").alias("description"), F.lit("").alias("counterparty"))
    plan = C.apply_rules(texts, C.load_rules(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_most_grams_rare_stay_spread(spark):
    """Grams of one frequency, the largest class of any history, never meet in one window or group."""
    history = spark.createDataFrame([("expense", i, f"u{i:05d}v", "c", "n", date(2024, 1, 1)) for i in range(400)],
                                    "direction string, hid bigint, description string, code string, name string, confirmed date")
    grams, _ = S._counted(S._bags(history, ["direction"]), ["direction"])
    plan = grams._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    got = S.similar_history(history.select("direction", "description"), S.index_history(history)).collect()
    # Some texts hold the same grams as another one, so only the score tells that each was found.
    assert {r.ct for r in got} == {f"u{i:05d}v" for i in range(400)} and all(r.score > 1 - 1e-9 for r in got)


def test_own_tiers(spark):
    """Tiers are functions: each is asked only for what is still open."""
    def fixed(word, code):
        hit = F.struct(F.lit(code).alias("subject_code"), F.lit("").alias("subject_name"), F.lit(word).alias("source"), F.lit("").alias("rule_id"))
        return lambda rows, out: rows.withColumn(out, F.when(F.col("description").contains(word), hit))

    out = S.classify(_texts(spark, [("expense", "ab", ""), ("expense", "b", ""), ("expense", "c", "")]), tiers=[fixed("a", "1"), fixed("b", "2")]).orderBy("id").collect()
    assert [(r.subject_code, r.source) for r in out] == [("1", "a"), ("2", "b"), ("", "unmatched")]
