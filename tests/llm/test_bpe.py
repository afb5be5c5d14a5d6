from __future__ import annotations

import hashlib
import random

import public_tokenizers as P
import pytest

from tallyweave.llm.bpe import CHUNK, _encoding, decode, encode, regions, round_trip

PATH = P.path("byte_bpe_50k.tiktoken")
HARD = [
    None, "", " ", "\n\n\n", "a", "it's  we'll\n\n x", "é" * 70, "x" * 500, " " * 300 + "end", "a \n" * 90 + "  ", "word " * 80 + "!!!???",
    " 　 tab\t\x85 \x1c sep " * 20, "漢字かな交じり文。" * 40, "👍🏽" * 60, "12345678" * 30 + " 'tis", "<|endoftext|> " * 20,
]


def texts():
    pick = random.Random(5)
    return HARD + ["".join(pick.choice(["ab", " ", "  ", "\n", "'s", "9", "é", "!", "\t", " the"]) for _ in range(pick.randrange(400))) for _ in range(60)]


@pytest.mark.parametrize("portion,overlap,chunk", [(1 << 16, 512, 1 << 13), (1 << 16, 8, 20), (1 << 16, 3, 7), (64, 16, 24), (32, 8, 8), (7, 3, 5)])
def test_as_the_library(spark, portion, overlap, chunk):
    rows = [(i // 2, t, "x") for i, t in enumerate(texts() + ["word " * 80 + "!!!???"] * 3)]  # ids repeat, rows repeat
    df = spark.createDataFrame(rows, "doc_id bigint, text string, part string")
    got = sorted(map(tuple, round_trip(df, "doc_id", "text", PATH, P.PATTERN, portion, overlap, chunk).collect()))
    library = _encoding(PATH, P.PATTERN)
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_parts_and_bytes(spark):
    df = spark.createDataFrame([(1, "some words, more of them. " * 20), (2, None)], "id bigint, text string")
    rows = decode(encode(df, "id", "text", PATH, P.PATTERN, 64, 16), PATH, P.PATTERN).collect()
    parts = sorted((r for r in rows if r.id == 1), key=lambda r: r.part)
    assert len(parts) > 3 and b"".join(bytes(r.bytes) for r in parts).decode() == "some words, more of them. " * 20
    assert [x for r in parts for x in r.ids] == _encoding(PATH, P.PATTERN).encode_ordinary("some words, more of them. " * 20)
    assert [(r.ids, bytes(r.bytes)) for r in rows if r.id == 2] == [([], b"")]


def test_regions_of_ordinary_texts():
    """A text of some chunks has as many regions; one without a boundary in the overlap stays whole."""
    text = "some words, more of them. " * 2000
    parts = regions(text, P.PATTERN)
    assert "".join(parts) == text and len(parts) == -(-len(text) // CHUNK)
    assert regions("x" * 5 * CHUNK, P.PATTERN) == ["x" * 5 * CHUNK] and regions("", P.PATTERN) == [""]


def test_empty_table(spark):
    assert round_trip(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text", PATH, P.PATTERN).count() == 0
