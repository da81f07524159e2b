"""Centroid clustering by kd-tree filtering against plain Lloyd rounds in Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from racelab.llm import kd_means

from .test_vectors import ODD, clusters, frame


def brute(rows, k, rounds, dim, scale=1024):
    """rows: (vec_id, vector); sorted (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * float(np.float32(x))) for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [x for _, x in order[:k]]
    for turn in range(rounds + 1):
        owner, far = [], []
        for _, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, z)) for z in c]
            owner.append(d.index(min(d)))
            far.append(min(d))
        if turn < rounds:
            for z in range(len(c)):
                mine = [x for (_, x), o in zip(kept, owner) if o == z]
                if mine:
                    c[z] = [sum(col) // len(mine) for col in zip(*mine)]
    of = [sum(d for d, o in zip(far, owner) if o == z) for z in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, z)).encode()).hexdigest() for z in c]
    return sorted((-1 if i is None else i, o, d, of[o], sum(far), sha[o]) for (i, _), o, d in zip(kept, owner, far))


def plain(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("block, leaf", [(4096, 32), (50, 4), (7, 1)])
def test_against_plain_rounds(spark, block, leaf):
    x = clusters(400, 8, 3, 0.3)
    x[50:90] = x[3]
    rows = list(enumerate(x.tolist()))
    got = plain(kd_means.cluster(frame(spark, x.tolist()), k=8, rounds=5, dim=8, block=block, leaf=leaf))
    assert got == brute(rows, 8, 5, 8)


def test_ties_repeats_and_odd_rows(spark):
    """Equal distances go to the smaller number, equal starts leave centroids empty, ids repeat or are null."""
    grid = [[float(a), float(b), 0.0] for a in range(-3, 4) for b in range(-3, 4)]
    vectors = [*grid, *grid[:9], *[None, [], [1.0], [None, 1.0, 2.0], [float("nan"), 1.0, 2.0], [float("inf")] * 3], *[[0.0] * 3] * 6]
    ids = [k % 40 for k in range(len(vectors))]
    got = plain(kd_means.cluster(frame(spark, vectors, ids), k=6, rounds=4, dim=3, scale=1, leaf=2))
    assert got == brute(list(zip(ids, vectors)), 6, 4, 3, 1)
    nulls = spark.createDataFrame([(None, [1.0, 2.0]), (None, [3.0, 4.0]), (1, [9.0, 9.0])], "vec_id long, embedding array<float>")
    assert plain(kd_means.cluster(nulls, k=2, dim=2)) == brute([(None, [1.0, 2.0]), (None, [3.0, 4.0]), (1, [9.0, 9.0])], 2, 10, 2)


def test_few_and_none(spark):
    assert plain(kd_means.cluster(frame(spark, [[1.0, -2.0], [1.0, -2.0]]), dim=2)) == brute([(0, [1.0, -2.0]), (1, [1.0, -2.0])], 8, 10, 2)
    for rows in ([], ODD):
        out = kd_means.cluster(frame(spark, rows))
        assert out.count() == 0 and "centroid_sha256" in out.columns


def test_large_components(spark):
    """Beyond exact doubles: Python's integers; a distance above a long is null, too large a component an error."""
    big = np.random.default_rng(4).normal(size=(60, 4)) * 5e4
    rows = [(i, v.tolist()) for i, v in enumerate(big.astype(np.float32))]
    assert max(abs(x) for _, v in rows for x in v) * 1024 > (2**51 / 4) ** 0.5
    assert plain(kd_means.cluster(frame(spark, [v for _, v in rows]), k=4, dim=4, leaf=3)) == brute(rows, 4, 10, 4)
    far = kd_means.cluster(frame(spark, [[1e14], [-1e14], [0.0]]), k=1, rounds=0, dim=1).collect()
    assert sorted(r.distance is None for r in far)[-1] and {r.inertia for r in far} == {None}
    with pytest.raises(Exception, match="10\\^18"):
        kd_means.cluster(frame(spark, [[1e18]]), dim=1).collect()


def test_filtering_prunes_and_assigns_nodes_whole():
    """Tight groups: hardly a vector is compared on its own; strict domination keeps ties open."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-20000, 20000, (8, 16))
    x = centres[rng.integers(0, 8, 4000)] + rng.integers(-50, 50, (4000, 16))
    tree, order = kd_means.build(x.astype(np.int64), 32)
    got = kd_means.search(tree.cast(float), centres.astype(float))
    assert len(got.points) < 400
    owner = np.full(4000, -1)
    for n, o in zip(got.nodes, got.node_owner):
        owner[tree.start[n] : tree.end[n]] = o
    owner[got.points] = got.point_owner
    assert (owner == kd_means.squared(x[order].astype(float), centres.astype(float)).argmin(1)).all()
    assert (tree.total[0] == x.sum(0)).all()
    line, _ = kd_means.build(np.array([[0], [5], [10]]), 1)
    tied = kd_means.search(line.cast(float), np.array([[10.0], [0.0]]))
    assert dict(zip([*line.x[line.start[tied.nodes], 0], *line.x[tied.points, 0]], [*tied.node_owner, *tied.point_owner])) == {0: 1, 5: 0, 10: 0}
