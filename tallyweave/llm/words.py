"""Words and word n-grams of many texts at once, as numpy arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D.  Word and n-gram identities are 64-bit rolling hashes
modulo 2**64, mixed afterwards; two different ones of a text agree with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same words for Spark's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
_SOLID = np.ones(256, dtype=bool)
_SOLID[list(SPACES)] = False
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
#: Bytes hashed at a time; bounds the arrays that hold eight bytes for each byte of text.
SPAN = 1 << 20


class Words(NamedTuple):
    doc: np.ndarray  #: index of the text
    start: np.ndarray  #: place in ``buffer``
    end: np.ndarray
    hash: np.ndarray
    buffer: bytes  #: the texts, each followed by one line feed


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n + 1 of them."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, n + 1)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = (both[0], both[1])
        if size <= 2 * SPAN:
            _POWERS[base] = have
    return have


def _rolling(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, by one prefix sum."""
    power, inverse = _powers(base, len(values))
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return (total[end] - total[start]) * inverse[start]


def scan(texts: list[bytes], lower: bool = False) -> Words:
    """All words of the texts in order; ``lower`` turns A-Z into a-z first."""
    buffer = b"\n".join(texts) + b"\n" if texts else b""
    if lower:
        buffer = buffer.lower()
    raw = np.frombuffer(buffer, dtype=np.uint8)
    solid = np.zeros(len(raw) + 2, dtype=np.int8)
    solid[1:-1] = _SOLID[raw]
    edge = np.flatnonzero(np.diff(solid))
    start, end = edge[::2], edge[1::2]
    offset = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]) if texts else np.zeros(0, dtype=np.int64)
    doc = np.searchsorted(offset, start, side="right") - 1
    hashes = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):  # words that lie within SPAN bytes, one at least
        j = max(i + 1, int(np.searchsorted(end, start[i] + SPAN, side="right")))
        lo, hi = int(start[i]), int(end[j - 1])
        piece = raw[lo:hi].astype(np.uint64) + np.uint64(1)
        hashes[i:j] = _rolling(piece, _BYTE_BASE, start[i:j] - lo, end[i:j] - lo)
        i = j
    return Words(doc, start, end, mix(hashes + (end - start).astype(np.uint64) * np.uint64(_WORD_BASE)), buffer)


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every window of n words that lies in one text."""
    count = len(words.hash)
    if count < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    first = np.flatnonzero(words.doc[: count - n + 1] == words.doc[n - 1 :])
    return first, mix(_rolling(words.hash, _WORD_BASE, first, first + n))


def repeated(key: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    if len(key):
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
    return twice


def portions(sizes: list[int], limit: int = SPAN) -> Iterator[slice]:
    """Runs of neighbouring texts of about ``limit`` bytes together, one text at least."""
    lo, total = 0, 0
    for i, size in enumerate(sizes):
        if i > lo and total + size > limit:
            yield slice(lo, i)
            lo, total = i, 0
        total += size
    if lo < len(sizes):
        yield slice(lo, len(sizes))
