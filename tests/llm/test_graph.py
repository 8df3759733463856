"""Components of paths and stars, and how many rounds they take."""

import collections

import numpy as np
import pytest

from tarnlake.llm import graph, shared

import brute


def rounds_of(monkeypatch):
    made = collections.Counter()
    staged = shared.staged

    def counted(df, folder, name):
        made[name.split("-")[1].rstrip("0123456789")] += 1
        return staged(df, folder, name)

    monkeypatch.setattr(shared, "staged", counted)
    return made


N = 4096
_ORDER = np.random.default_rng(7).permutation(N) + 1
SHAPES = {
    "descending": [1, *range(N, 1, -1)],
    "random": _ORDER.tolist(),
}


@pytest.mark.parametrize("shape", [*SHAPES, "star"])
def test_rounds(spark, monkeypatch, shape):
    made = rounds_of(monkeypatch)
    edges = [(N, i) for i in range(1, N)] if shape == "star" else list(zip(SHAPES[shape][:-1], SHAPES[shape][1:], strict=True))
    found = graph.components(spark.createDataFrame(edges, "a long, b long"), shared.shared_dir(spark), shape).collect()
    assert len(found) == N and {r.comp for r in found} == {1}
    assert made["up"] <= 2 * np.log2(N) + 4


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))]
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long"), shared.shared_dir(spark), "some").collect()}
    want = brute.components(edges)
    assert got == {i: c for i, c in want.items() if any(i in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long"), shared.shared_dir(spark), "none").count() == 0
