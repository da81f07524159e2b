"""Vector operators against brute force."""

import math

import numpy as np

from racelab.llm import learned_partitions, tree_forest
from racelab.llm import queries as q

SF = "/root/testdata/sf0.001"


def frame(spark, vectors, ids=None):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "a") for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, node string")


ODD = [None, [0.0] * 8, [None] + [1.0] * 7, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1.0] * 3]


def clusters(n, d, seed, spread=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, d))
    return (centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, d))).astype(np.float32)


def brute_links(x, threshold):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    comp = np.arange(len(x))
    while True:
        new = np.minimum(comp, np.where(near, comp[None, :], len(x)).min(1))
        if (new == comp).all():
            return near.sum(1), comp
        comp = new


def test_forest_finds_the_links(spark):
    x = clusters(900, 16, 1, 0.25)
    x[100:140] = x[7]
    links, comp = brute_links(x, 0.9)
    got = {r.vec_id: r for r in tree_forest.near_duplicates(frame(spark, list(x)), leaf=32, block=200, sample=300, tile=16).collect()}
    found = sum(got[i].n_links for i in range(len(x)))
    assert found >= 0.97 * links.sum() and all(got[i].n_links <= links[i] for i in range(len(x)))
    assert np.mean([got[i].component_id == comp[i] for i in range(len(x))]) >= 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_forest_edges(spark):
    got = {r.vec_id: r for r in tree_forest.near_duplicates(frame(spark, [*ODD, [1.0] * 8, [2.0] * 8, [1.0] * 8])).collect()}
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(len(ODD)))
    assert [(got[i].n_links, got[i].component_id) for i in (6, 7, 8)] == [(2, 6)] * 3
    assert tree_forest.near_duplicates(frame(spark, [])).count() == 0


def brute_nearest(x, ids, i, k):
    s = x.astype(float) @ x[i].astype(float)
    order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
    return [ids[j] for j in order]


def test_search_recall(spark):
    for x in (clusters(3000, 16, 2), np.random.default_rng(3).normal(size=(3000, 16)).astype(np.float32)):
        ids = np.arange(len(x))
        rows = learned_partitions.search(frame(spark, list(x)), part_rows=256, sample=1500, block=100).collect()
        got = {}
        for r in sorted(rows, key=lambda r: r["rank"]):
            got.setdefault(r.query_id, []).append(r)
        hit = total = 0
        for i in range(0, len(x), 20):
            want = brute_nearest(x, ids, i, 20)
            assert [r["rank"] for r in got[i]] == list(range(1, 21))
            hit += len(set(want) & {r.vec_id for r in got[i]})
            total += 20
            for r in got[i]:
                assert math.isclose(r.score, float(x[i].astype(float) @ x[r.vec_id].astype(float)), rel_tol=1e-9, abs_tol=1e-9)
        assert hit / total >= 0.9


def test_search_query_on_a_small_table(spark):
    """500 vectors without structure in 8 parts: recall of the registered query."""
    t = q.table(spark, SF, "embeddings").toPandas()
    x, ids = np.stack(t.embedding).astype(np.float32), t.vec_id.to_numpy()
    got = {}
    for r in sorted(q.op1_learned_partitions(spark, SF).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {ids[i]: brute_nearest(x, ids, i, 20) for i in np.flatnonzero(ids % 20 == 0)}
    assert set(got) == set(want) and all(len(got[i]) == 20 for i in want)
    assert np.mean([len(set(got[i]) & set(want[i])) / 20 for i in want]) >= 0.9


def test_search_prunes_where_there_is_structure():
    """Clustered vectors: few of the learned parts are visited."""
    x = clusters(4000, 16, 6, 0.05).astype(float)
    router, probes = learned_partitions.fit(x, 32, 0.95)
    near = learned_partitions.neighbour_graph(x, 20)
    order = router.order(x)
    hit = (order[:, :probes, None] == order[near, 0][:, None, :]).any(1).mean()
    assert hit >= 0.94 and probes <= 16


def test_search_repeated_query_ids(spark):
    """Each row of an id is a query with its own vector; rows with that id are never its answer."""
    x = np.random.default_rng(8).normal(size=(300, 8)).astype(np.float32)
    ids = [20, 20, *range(21, 319)]
    got = {}
    for r in learned_partitions.search(frame(spark, list(x), ids), least_parts=1, part_rows=10_000).collect():
        if r.query_id == 20:
            got.setdefault(r["rank"], []).append(r.vec_id)
    want = [brute_nearest(x, np.array(ids), i, 20) for i in (0, 1)]
    assert {k: sorted(v) for k, v in got.items()} == {k + 1: sorted(w[k] for w in want) for k in range(20)}


def test_search_ties_and_edges(spark):
    same = [[1.0] * 8] * 30
    rows = learned_partitions.search(frame(spark, [*ODD, *same], [*range(100, 106), *range(30)])).collect()
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in rows)
    assert [v for i, _, v in got if i == 0] == list(range(1, 21)) and [v for i, _, v in got if i == 20] == list(range(20))
    assert {i for i, *_ in got} == {0, 20}
    assert learned_partitions.search(frame(spark, [])).count() == 0
    few = learned_partitions.search(frame(spark, same[:3], [0, 1, 2])).collect()
    assert sorted((r["rank"], r.vec_id) for r in few) == [(1, 1), (2, 2)]
