"""The beam of a shard follows the recall that is measured on it."""

from __future__ import annotations

import numpy as np

from tallyweave.llm import neighbours as N


def _fitted(x):
    points = N.comparable(x.astype(np.float32))
    graph, starts = N.build_graph(points)
    return N.fit_beam(points, graph, starts, N.SEARCH_BEAM)


def test_beam_of_easy_and_hard_shards():
    draw = np.random.default_rng(5)
    easy = draw.normal(size=(40, 16))[draw.integers(0, 40, 3000)] + 0.1 * draw.normal(size=(3000, 16))
    assert _fitted(easy) < N.SEARCH_BEAM
    assert _fitted(draw.normal(size=(8192, 64))) == N.SEARCH_BEAM
    assert _fitted(draw.normal(size=(15, 4))) == N.SEARCH_BEAM
    points = N.comparable(easy.astype(np.float32))
    graph, starts = N.build_graph(points)
    assert N.fit_beam(points, graph, starts, 40) == 40
