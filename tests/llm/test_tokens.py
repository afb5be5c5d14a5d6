from __future__ import annotations

import numpy as np
import public_tokenizers as P
import pytest

from tallyweave.llm.batches import folder
from tallyweave.llm.bpe import _encoding
from tallyweave.llm.tokens import _open, count_tokens, document_tokens

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize("block", [1, 3, 7, 64, 1 << 20])
def test_blocks(spark, block):
    path = folder(spark, "flat")
    system, place = _open(path)
    system.create_dir(place, recursive=True)
    draw = np.random.default_rng(block)
    want = set()
    for name, lengths, tail in (("a", [0, 5, 0, 0, 40, 1], 0), ("b", [], 9), ("c", [100], 3), ("d", draw.integers(0, 12, 50).tolist(), 0), ("e", [], 0)):
        ids = [x for n in lengths for x in [*draw.integers(0, 9, n).tolist(), 9]] + [1] * tail
        with system.open_output_stream(f"{place}/{name}") as out:
            out.write(np.asarray(ids, dtype="<u2").tobytes())
        want |= {(name, i, n, True) for i, n in enumerate(lengths)} | ({(name, len(lengths), tail, False)} if tail else set())
    assert {tuple(r) for r in count_tokens(spark, path, 9, block=block).collect()} == want


def test_documents(spark):
    rows = [(1, "some text"), (1, "some text"), (2, None), (None, ""), (3, "word " * 100_000), (4, "<|endoftext|> as text")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, nth bigint").repartition(3)
    library = _encoding(VOCABULARY, P.PATTERN)
    got = document_tokens(df, "doc_id", "text", VOCABULARY, P.PATTERN, 50256, block=1000).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, len(library.encode_ordinary(t or "")))) for i, t in rows)
    assert document_tokens(df.limit(0), "doc_id", "text", VOCABULARY, P.PATTERN, 50256).count() == 0
