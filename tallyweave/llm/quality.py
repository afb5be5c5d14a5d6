"""Quality rules: how much of a text lies inside repeated word n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import bounded, byte_texts
from .words import SPACES, Words, grams, mix, portions, repeated, scan

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Limits:
    """Above any of these a text is rejected."""

    min_words: int = 50
    #: per cent of words inside 3-word windows that occur twice or more
    repeat_words_pct: int = 50
    #: n-gram length -> part of the words' characters inside windows that occur twice or more; clearly below the base rule
    coverage: tuple[tuple[int, float], ...] = ((5, 0.30), (8, 0.29), (10, 0.28))
    #: part of the characters in lines equal to an earlier line
    line_coverage: float = 0.20
    #: symbols for each word
    symbols: float = 0.30


COLUMNS = (
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("gram_coverage", pa.float64()),
    ("line_coverage", pa.float64()),
)


def _covered(words: Words, n: int, within: np.ndarray | None) -> np.ndarray:
    """Words inside n-word windows that occur twice or more in their text.

    A repeated window repeats each shorter one in it, so only windows wholly ``within`` repeated ones are sorted.
    """
    first, key = grams(words, n)
    if within is not None and len(first):
        inside = np.concatenate(([0], np.cumsum(within)))
        keep = inside[first + n] - inside[first] == n
        first, key = first[keep], key[keep]
    hit = first[repeated(mix(key ^ mix(words.doc[first].astype(np.uint64) + np.uint64(1))))]
    step = np.zeros(len(words.hash) + 1, dtype=np.int64)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(texts: list[bytes], limits: Limits) -> dict[str, list]:
    """The measures and the verdict for each text."""
    n = len(texts)
    words = scan(texts)
    raw = np.frombuffer(words.buffer, dtype=np.uint8)
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    chars = points[words.end] - points[words.start]
    by_text = lambda weights: np.bincount(words.doc, weights, minlength=n)
    n_words = np.bincount(words.doc, minlength=n)
    word_chars = by_text(chars)
    part = lambda x: np.divide(x, word_chars, out=np.zeros(n), where=word_chars > 0)
    threes = _covered(words, 3, None)
    n_repeat = by_text(threes)
    worst, failed = np.zeros(n), np.zeros(n, dtype=bool)
    for length, most in limits.coverage:
        covered = part(by_text(chars * _covered(words, length, threes)))
        worst, failed = np.maximum(worst, covered), failed | (covered > most)
    dup_lines, dup_chars, symbols = np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n, dtype=np.int64)
    for i, text in enumerate(texts):
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            if line in seen:
                dup_lines[i] += 1
                dup_chars[i] += len(line.translate(None, SPACES + _CONTINUATION))
            elif line.strip(SPACES):
                seen.add(line)
        symbols[i] = len(text) - len(text.translate(None, SYMBOLS))
    lines = part(dup_chars)
    base = (n_words < limits.min_words) | (100 * n_repeat > limits.repeat_words_pct * n_words)
    kept = ~(base | failed | (lines > limits.line_coverage) | (symbols > limits.symbols * n_words))
    return {
        "n_words": n_words, "word_chars": word_chars.astype(np.int64), "n_symbols": symbols, "n_dup_lines": dup_lines,
        "n_repeat_words": n_repeat.astype(np.int64), "base_failed": base, "kept": kept, "gram_coverage": worst,
        "line_coverage": lines,
    }


def judge(df: DataFrame, id_col: str, text_col: str, limits: Limits = Limits()) -> DataFrame:
    """One row per row of ``df``: id, measures and verdict.  Map-only; memory is bounded by a batch and the longest text.

    Null and empty texts have no words and fail ``min_words``.  Repeated rows each get their row; other columns are
    not read.  An empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column(1))
            for some in portions([len(t) for t in texts]):
                out = measure(texts[some], limits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(some.start, some.stop - some.start)] + [pa.array(out[c], kind) for c, kind in COLUMNS],
                    names=[id_col] + [c for c, _ in COLUMNS],
                )

    bounded(df.sparkSession)
    picked = df.select(df[id_col], df[text_col].alias("text"))
    kinds = ", ".join(f"{c} {'bigint' if k == pa.int64() else 'boolean' if k == pa.bool_() else 'double'}" for c, k in COLUMNS)
    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[0].dataType.simpleString()}, {kinds}")


def keep_rows(df: DataFrame, text_col: str, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``df`` that the rules keep, with all their columns.  Map-only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column(text_col))
            kept = [measure(texts[some], limits)["kept"] for some in portions([len(t) for t in texts])]
            yield batch.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, dtype=bool)))

    bounded(df.sparkSession)
    return df.mapInArrow(run, df.schema)
