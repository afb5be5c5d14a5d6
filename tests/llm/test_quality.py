from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tallyweave.llm.quality import Limits, judge, keep_rows, measure
from tallyweave.llm.words import grams, portions, repeated, scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, limits=Limits()):
    """Every window of every length, compared as lists of words."""
    words = WORD.findall(text or "")

    def covered(n):
        places = {}
        for i in range(len(words) - n + 1):
            places.setdefault(tuple(words[i : i + n]), []).append(i)
        return {i + k for at in places.values() if len(at) > 1 for i in at for k in range(n)}

    chars = sum(map(len, words))
    repeats = len(covered(3))
    lines, seen, dup, dup_chars = (text or "").split("\n"), set(), 0, 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            dup_chars += sum(map(len, WORD.findall(line))) * (line in seen)
            seen.add(line)
    parts = [(sum(len(words[i]) for i in covered(n)) / chars if chars else 0, most) for n, most in limits.coverage]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    base = len(words) < limits.min_words or 100 * repeats > limits.repeat_words_pct * len(words)
    line_part = dup_chars / chars if chars else 0
    kept = not (base or any(p > most for p, most in parts) or line_part > limits.line_coverage or symbols > limits.symbols * len(words))
    return len(words), chars, symbols, dup, repeats, base, kept, max(p for p, _ in parts), line_part


def texts():
    pick = random.Random(3)
    some = [None, "", " \t\n", "one", "a b c a b c", "é é x\u0085y \x1cz", "line\nline\n \n \nline ", "w " * 200, "# % & word " * 30, "\x0b\x0cx\ry"]
    for _ in range(60):
        words = [pick.choice("abcdefgh") * pick.randrange(1, 4) for _ in range(pick.randrange(1, 200))]
        text = " ".join(w + pick.choice(["", "", "\n", "é", "  "]) for w in words)
        some.append(text if pick.random() < 0.6 else f"{text}\n{text[: len(text) // 2]}\n{text}")
    return some + some[:2] + ["long " + " ".join(f"w{i % 5000}" for i in range(200_000))]


def test_against_brute_force(spark):
    rows = [(i // 3, t, "x") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept string")
    got = sorted(map(tuple, judge(df, "doc_id", "text").collect()), key=str)
    want = sorted(((i, *brute(t)) for i, t, _ in rows), key=str)
    assert [g[:8] for g in got] == [w[:8] for w in want]
    assert all(abs(g[k] - w[k]) < 1e-12 for g, w in zip(got, want, strict=True) for k in (8, 9))
    assert sorted(r.text for r in keep_rows(df, "text").collect()) == sorted(t for _, t, _ in rows if brute(t)[6])


def test_coverage_limits_decide():
    """A paragraph that stands twice, 45 % of the characters in all, and 38 % in repeats of short lines: no other rule rejects them."""
    words = [f"w{i:03}" for i in range(400)]
    twice = " ".join(words[:45] + words[100:210] + words[:45])
    # Repeats stand between new words, so that no window of three words occurs twice.
    short = "\n".join(f"{words[i]}\nsame line" if i < 80 else words[i] for i in range(260))
    clean = " ".join(words[:20] + words[100:300] + words[:20])
    out = measure([t.encode() for t in (twice, short, clean)], Limits())
    assert out["base_failed"].tolist() == [False] * 3 and not any(out["n_symbols"])
    assert out["gram_coverage"].round(2).tolist() == [0.45, 0.0, 0.17] and out["line_coverage"].round(2).tolist() == [0.0, 0.38, 0.0]
    assert out["kept"].tolist() == [False, False, True]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert judge(df, "doc_id", "text").count() == 0 and keep_rows(df, "text").count() == 0


@pytest.mark.parametrize("lower", [False, True])
def test_hashes_name_words_and_windows(lower):
    raw = [b"", b"a bb  a\nbb", b"\xc3\xa9 A a", b"bb a", b"x" * 5000 + b" " + b"x" * 5000]
    words = scan(raw, lower)
    flat = [(i, w) for i, t in enumerate(raw) for w in (t.lower() if lower else t).split()]
    assert words.doc.tolist() == [i for i, _ in flat]
    assert [words.buffer[a:b] for a, b in zip(words.start, words.end, strict=True)] == [w for _, w in flat]
    names = {}
    for (_, w), h in zip(flat, words.hash.tolist(), strict=True):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    first, key = grams(words, 2)
    assert [(flat[i][0], flat[i][1], flat[i + 1][1]) for i in first] == [(a, x, y) for (a, x), (b, y) in zip(flat, flat[1:], strict=False) if a == b]
    assert len(set(key.tolist())) == len({(flat[i][1], flat[i + 1][1]) for i in first})


def test_portions_and_repeats():
    assert list(portions([5, 5, 20, 1], 10)) == [slice(0, 2), slice(2, 3), slice(3, 4)] and list(portions([], 9)) == []
    assert repeated(np.array([3, 1, 3, 2], dtype=np.uint64)).tolist() == [True, False, True, False]
