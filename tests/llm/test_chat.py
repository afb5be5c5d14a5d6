from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.llm.chat import digests, escape, format_conversations, locate, locate_prefixes, marked, read_turn, unescape, with_control_strings

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()
TEXT = st.text(alphabet="\\#<>/:turn \nhlcé👍", max_size=30)


@given(TEXT)
@settings(max_examples=300)
def test_escape_is_reversible(text):
    assert unescape(escape(text)) == text and "#" not in escape(text) and "<" not in escape(text)


@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
@settings(max_examples=200)
def test_turns_read_back(turns):
    found = locate(marked, turns)
    assert not found.rewrites and found.formatted == marked(turns)
    assert [read_turn(found.formatted[a:b]) for a, b in found.spans] == turns
    assert [unescape(found.formatted[a:b]) for a, b in found.texts] == [t for _, t in turns]


def test_trailer_and_rewriting_templates():
    trailer = lambda turns: "<s>" + "".join(f"[{r}]{t}|" for r, t in turns) + "</s>"
    found = locate(trailer, [("u", "ab"), ("a", "cd")])
    assert [found.formatted[a:b] for a, b in found.spans] == ["[u]ab|", "[a]cd|"] and not found.rewrites
    assert [found.formatted[a:b] for a, b in found.texts] == ["ab", "cd"]
    forgets = lambda turns: "".join(f"[{r}]{t if i == len(turns) - 1 else '..'}|" for i, (r, t) in enumerate(turns))
    assert locate(forgets, [("u", "ab"), ("a", "cd")]).rewrites and not locate(forgets, [("u", "ab")]).rewrites


def templates():
    trailer = lambda turns: "<s>" + "".join(f"[{r}]{t}|" for r, t in turns) + "</s>"
    tricky = lambda turns: "".join(f"<{r}>{t}" for r, t in turns) + "</s>"
    numbered = lambda turns: "".join(f"{i}. {r}: {t}\n" for i, (r, t) in enumerate(turns))
    forgets = lambda turns: "".join(f"[{r}]{t if i == len(turns) - 1 else '..'}|" for i, (r, t) in enumerate(turns))
    drops = lambda turns: marked(turns[-7:])
    return [marked, trailer, tricky, numbered, forgets, drops]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "/s"]), TEXT), max_size=14), st.integers(1, 5))
@settings(max_examples=150, deadline=None)
def test_windows_as_prefixes(turns, window):
    for render in templates():
        assert locate(render, turns, window) == locate_prefixes(render, turns)


def test_long_conversation_costs_its_turns():
    turns, seen = [("user" if i % 2 else "assistant", f"turn {i} " * 5) for i in range(3000)], [0]

    def counted(some):
        seen[0] += len(some)
        return marked(some)

    found = locate(counted, turns)
    assert seen[0] < 50 * len(turns) and found.formatted == marked(turns) and [read_turn(found.formatted[a:b]) for a, b in found.spans] == turns


def test_query_shape(spark):
    rows = [
        (1, 0, "system", "s"), (1, 2, "assistant", "A#<\\"), (1, 1, "user", None), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, 1, None, "x"),
        (3, None, "a: b", "long " * 5000), (3, 1, "assistant", "two"), (3, 2, "user", "u"), (3, 3, "assistant", "three"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, conv string")
    out = {r.conv: r for r in digests(format_conversations(with_control_strings(df), "conv_id", "turn", "role", "text")).collect()}
    convs = {-7: [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((role or "", text or ""))
    assert out.keys() == convs.keys()
    for c, turns in convs.items():
        learn = "".join(t for r, t in turns if r == "assistant")
        assert (out[c].n_turns, out[c].turns_sha256) == (len(turns), SHA("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (out[c].loss_chars, out[c].loss_sha256, out[c].formatted_chars) == (len(learn), SHA(learn), len(marked(turns))) and not out[c].rewrites


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert digests(format_conversations(df, "conv_id", "turn", "role", "text")).count() == 0


def test_common():
    pytest.importorskip("hypothesis")
    from tallyweave.llm.chat import common

    assert [common("abc", "abd"), common("", "a"), common("ab", "abc"), common("x", "y")] == [2, 0, 2, 0]
