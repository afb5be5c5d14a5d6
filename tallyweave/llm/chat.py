"""Chat formatting: turns located by rendering growing prefixes of a conversation with a template seen from outside."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import Batches, kind, only

#: Turns whose prefixes are rendered together.
WINDOW = 32

Turn = tuple[str, str]
Render = Callable[[list[Turn]], str]

_OUT = {"\\": "\\\\", "#": "\\h", "<": "\\l"}
_BACK = {"\\": "\\", "h": "#", "l": "<", "c": ":"}


def escape(text: str) -> str:
    """No ``#`` and no ``<`` is left, so no control string can occur in a text."""
    return re.sub(r"[\\#<]", lambda m: _OUT[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text, flags=re.S)


def marked(turns: list[Turn]) -> str:
    """The template of the registered query: ``### role: text</turn>`` for each turn."""
    return "".join(f"### {escape(role).replace(':', chr(92) + 'c')}: {escape(text)}</turn>\n" for role, text in turns)


def read_turn(span: str) -> Turn:
    """Role and text of one turn as ``marked`` writes it."""
    role, _, rest = span.removeprefix("### ").partition(": ")
    return unescape(role), unescape(rest.removesuffix("</turn>\n"))


def common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


@dataclass
class Located:
    formatted: str
    spans: list[tuple[int, int]]  #: of each turn
    texts: list[tuple[int, int]]  #: of each turn's rendered text
    rewrites: bool  #: some turn changed what was rendered before it


def _grown(old: str, new: str) -> tuple[int, int, bool]:
    """What ``new`` adds to ``old``: a span and whether it only adds.  A constant trailer may follow what is added."""
    at = common(old, new)
    trailer = old[at:]
    if len(new) - at >= len(trailer) and new.endswith(trailer):
        return at, len(new) - len(trailer), True
    return at, len(new), False


def locate(render: Render, turns: list[Turn], window: int = WINDOW) -> Located:
    """As ``locate_prefixes``, at a cost that grows with the turns and not with their square.

    Windows of turns, each with the last turn of the one before, are located by their own prefixes.  Their spans count
    if no window shows a rewrite, if the shared turns look alike in both windows, and if the spans put together are what
    the template renders for all turns.  Else the prefixes of the whole conversation are rendered, as for templates
    that number their turns or rewrite history.  A rewrite that later turns take back, and that no prefix shorter than a
    window shows, isn't noticed.
    """
    first = locate_prefixes(render, turns[:window])
    if len(turns) <= window:
        return first
    at = first.spans[0][0]
    pieces, spans, texts = [first.formatted[:at]], [], []
    found, shared, last = first, 0, None
    for begin in range(0, len(turns), window):
        if begin:
            found, shared = locate_prefixes(render, turns[begin - 1 : begin + window]), 1
            lo, hi = found.spans[0]
            if found.formatted[lo:hi] != last:
                return locate_prefixes(render, turns)
        if found.rewrites:
            return locate_prefixes(render, turns)
        for (lo, hi), (a, b) in list(zip(found.spans, found.texts, strict=True))[shared:]:
            last = found.formatted[lo:hi]
            pieces.append(last)
            spans.append((at, at + hi - lo))
            texts.append((at + a - lo, at + b - lo))
            at += hi - lo
    pieces.append(found.formatted[found.spans[-1][1] :])
    whole = render(turns)
    return Located(whole, spans, texts, False) if "".join(pieces) == whole else locate_prefixes(render, turns)


def locate_prefixes(render: Render, turns: list[Turn]) -> Located:
    """Render each prefix of the turns; consecutive outputs show where a turn stands, a changed past shows a rewrite.

    A turn's text is found by rendering the turn once more without text.  If a template rewrites history the spans of
    earlier turns may not hold in the final output: they are given as first rendered, and ``rewrites`` says so.
    """
    before = render([])
    spans, texts, rewrites = [], [], False
    for i, (role, _) in enumerate(turns):
        now = render(turns[: i + 1])
        start, end, only_adds = _grown(before, now)
        blank = render([*turns[:i], (role, "")])
        lo, hi, _ = _grown(blank, now)
        spans.append((start, end))
        texts.append((max(start, min(lo, end)), max(start, min(hi, end))))
        rewrites |= not only_adds
        before = now
    return Located(before, spans, texts, rewrites)


def _locate_step(render: Render, learn: str) -> Callable[[Batches], Batches]:
    """Rows ordered by conversation and turn become one row for each conversation."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Batches) -> Batches:
        who, turns, key_type, begun = None, [], None, False

        def give() -> pa.RecordBatch:
            found = locate(render, turns)
            pairs = lambda some: pa.array([[{"start": a, "end": b} for a, b in some]], span)
            loss = [t for t, (role, _) in zip(found.texts, turns, strict=True) if role == learn]
            return pa.RecordBatch.from_arrays(
                [pa.array([who], key_type), pa.array([found.formatted], pa.string()), pairs(found.spans), pairs(loss), pa.array([found.rewrites])],
                names=["conv", "formatted", "spans", "loss", "rewrites"],
            )

        for batch in batches:
            key_type = batch.schema.field("conv").type
            done = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
                if begun and conv != who:
                    done.append(give())
                    turns = []
                who, begun = conv, True
                turns.append((role or "", text or ""))
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if begun:
            yield give()

    return run


def format_conversations(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, render: Render = marked,
                         learn: str = "assistant") -> DataFrame:
    """conv, formatted, spans, loss, rewrites: one row per conversation, spans in code points of ``formatted``.

    Turns are ordered by turn (null first), then role and text, so ties and repeated rows have a fixed order; each
    row is a turn.  Null roles and texts count as empty; null conversation ids are one conversation.  ``loss`` has
    the text span of each turn of role ``learn``.  An empty table gives no rows; other columns of ``df`` are not read,
    whatever their names.  Conversations stream through a task in order: memory is that of one conversation, which is one
    value of the result.  Its cost grows with its turns, with their square only for templates that ``locate`` can't
    read by windows.
    """
    rows = only(df, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    span = "array<struct<start:bigint,end:bigint>>"
    return ordered.mapInArrow(_locate_step(render, learn), f"conv {kind(rows, 'conv')}, formatted string, spans {span}, loss {span}, rewrites boolean")


def digests(formatted: DataFrame, read: Callable[[str], Turn] = read_turn, plain: Callable[[str], str] = unescape) -> DataFrame:
    """Read turns and masked text back from ``formatted`` and its spans: counts and digests for each conversation."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                text = row["formatted"]
                turns = [read(text[s["start"] : s["end"]]) for s in row["spans"]]
                masked = "".join(plain(text[s["start"] : s["end"]]) for s in row["loss"])
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                sha = [hashlib.sha256(x.encode()).hexdigest() for x in (whole, masked)]
                out.append((len(turns), sha[0], len(masked), sha[1], len(text), row["rewrites"]))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("conv"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]
    return formatted.mapInArrow(run, f"conv {kind(formatted, 'conv')}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
                                     "formatted_chars bigint, rewrites boolean")


def with_control_strings(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, and one conversation more, -7, whose texts look like the template's marks."""
    said = F.lit("\\### Assistant: </turn> ok")
    session = conversations.sparkSession
    extra = session.range(2, numPartitions=1).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text")
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
