"""The tree forest's splits: blocks split again, equal projections, copies in other lengths."""

import numpy as np
import pytest

from racelab.llm import tree_forest
from racelab.llm.common import Scratch, mix64

from .test_vectors import brute_links, clusters, frame


def keys(n):
    return mix64(np.arange(n, dtype=np.uint64))


def test_blocks_are_split_again(spark, monkeypatch):
    """4000 vectors, blocks of 100 at most and a first deal of one block: three levels more."""
    x = clusters(4000, 16, 5, 0.1)
    x[200:320] = x[3] * np.linspace(0.5, 3, 120)[:, None]
    levels, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name="t": levels.append(name) or save(self, df, name))
    points = frame(spark, list(x))
    got = {r.vec_id: r for r in tree_forest.near_duplicates(points, trees=6, leaf=50, block=100, sample=40, tile=64).collect()}
    assert sum(n.startswith("trees") for n in levels) >= 2
    links, comp = brute_links(x, 0.9)
    assert sum(got[i].n_links for i in range(len(x))) >= 0.97 * links.sum()
    assert all(got[i].n_links <= links[i] for i in range(len(x)))
    assert np.mean([got[i].component_id == comp[i] for i in range(len(x))]) >= 0.97


def test_ten_thousand_scaled_copies(spark):
    """Equal projections everywhere: rows don't multiply and all copies are joined."""
    one = np.random.default_rng(1).normal(size=8)
    x = one * np.linspace(1, 50, 10_000)[:, None]
    assert len(np.unique(x.astype(np.float32)[:, 0])) == 10_000
    got = tree_forest.near_duplicates(frame(spark, x.astype(np.float32).tolist()), trees=4, block=2000, sample=300).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(9999, 0)} and len(got) == 10_000


@pytest.mark.parametrize("same", [0, 500, 1000])
def test_sides_get_smaller(same):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1000, 8))
    x[:same] = x[0]
    left, right = tree_forest.sides(x, np.arange(1000), tree_forest.split(x, rng, 0.04), keys(1000))
    assert max(len(left), len(right)) < 850 and set(left) | set(right) == set(range(1000))
    parts = list(tree_forest.leaves(x, keys(1000), rng, 50, 0.04))
    assert max(map(len, parts)) <= 50 and set(np.concatenate(parts)) == set(range(1000)) and sum(map(len, parts)) < 4000


def test_lengths_and_repeated_ids(spark):
    rows = [[1.0, 2.0], [2.0, 4.1], [1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [1.0, 0.0, 0.0], [1.0, 0.0, 0.1], [1.0, 0.0, 0.0]]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in tree_forest.near_duplicates(frame(spark, rows, [7, 8, 3, 4, 5, 5, 6])).collect())
    assert got == [(3, 1, 3, True), (4, 1, 3, False), (5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False), (7, 1, 7, True), (8, 1, 7, False)]
