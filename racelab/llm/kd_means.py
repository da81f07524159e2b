"""Centroid clustering (Lloyd's rounds in exact integers) by kd-tree filtering.

Every task cuts its vectors into blocks of bounded size and builds a kd-tree over each: a node holds its
vectors' count, sum and bounding box. The blocks are written once. A round sends the centroids down each
tree: of a node's candidates the one nearest to the middle of the box is kept, and those that are strictly
farther from every corner of the box are pruned. A node with one candidate left is assigned whole, by its
count and sum; the rest is resolved in the leaves, vector by vector. Blocks give one row a cluster, so a
round moves (blocks x clusters) sums to the aggregation and (clusters x components) numbers to the driver;
vectors are never shuffled, and a lost task only searches its blocks again.

Components are integers floor(scale * x). Up to about 2^21 in size all products and sums of a distance are
exact in double precision and go through matrix products; blocks with larger ones take Python's integers.

Vectors that are null, of another length or that hold null or non-finite components are left out. Equal
vectors and repeated ids are vectors of their own; a null id hashes as the empty string. Fewer vectors than
clusters give fewer centroids, no vectors no rows. A component's integer must be below 10^18 in size
(an error names this); a squared distance that doesn't fit a long is null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import Scratch, col, only


def whole(e: Column, dim: int) -> Column:
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(e) == dim) & good, F.lit(False))


def integers(rows: DataFrame, dim: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, x array<long>) of the vectors that count."""
    own = only(rows, vec_id="long", embedding="array<double>").where(whole(F.col("embedding"), dim))
    size = F.array_max(F.transform("embedding", lambda x: F.abs(x)))
    own = own.where(F.when(size * scale < 1e18, True).otherwise(F.raise_error(F.lit("a component's integer is 10^18 or more in size"))))
    return own.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale)).alias("x"))


def first_centroids(points: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors of smallest sha256 of ``salt:vec_id``; rows of one id in order of their vectors."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.x for r in points.select(key.alias("h"), "x").orderBy("h", "x").limit(k).collect()], object)


# -------------------------------------------------------------------- trees


def work_type(dim: int, *arrays: np.ndarray) -> type:
    """float64 where matrix products of these integers are exact, else Python's integers."""
    least = 2.0 ** 51 / max(dim, 1)
    return float if all(not a.size or float(np.abs(a).max()) ** 2 < least for a in arrays) else object


@dataclass
class Tree:
    """Points in tree order and, level by level, the nodes: ranges of points, children, boxes, sums."""

    x: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray  # first of two children, 0 in a leaf
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray

    def cast(self, kind: type) -> Tree:
        return Tree(*[a.astype(kind) if n in ("x", "low", "high", "total") else a for n, a in vars(self).items()])


def build(x: np.ndarray, leaf: int) -> tuple[Tree, np.ndarray]:
    """The tree of int64 rows and their order in it. Nodes are halved at the median of their widest
    component until they have ``leaf`` points or all points are equal."""
    order = np.arange(len(x))
    spans, child, low, high = [(0, len(x))], [], [], []
    at = 0
    while at < len(spans):
        s, e = spans[at]
        part = x[order[s:e]]
        lo, hi = part.min(0), part.max(0)
        low.append(lo)
        high.append(hi)
        wide = int(np.argmax(hi - lo))
        if e - s > leaf and hi[wide] > lo[wide]:
            half = (e - s) // 2
            order[s:e] = order[s:e][np.argpartition(part[:, wide], half)]
            child.append(len(spans))
            spans += [(s, s + half), (s + half, e)]
        else:
            child.append(0)
        at += 1
    x = x[order]
    start, end = (np.array(v) for v in zip(*spans))
    exact = x if float(np.abs(x).max()) * len(x) < 2.0**62 else x.astype(object)
    run = np.vstack([np.zeros((1, x.shape[1]), exact.dtype), np.cumsum(exact, 0)])
    return Tree(x, start, end, np.array(child), np.array(low), np.array(high), run[end] - run[start]), order


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


@dataclass
class Found:
    """Nodes assigned whole and points resolved one by one, each with its centroid."""

    nodes: np.ndarray
    node_owner: np.ndarray
    points: np.ndarray
    point_owner: np.ndarray


def _spread(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    sizes = end - start
    return np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def search(tree: Tree, c: np.ndarray) -> Found:
    """Filter the centroids through the tree, level by level; ``tree`` and ``c`` are of one work type."""
    norms = (c * c).sum(1)
    nodes, candidates = np.zeros(1, int), np.ones((1, len(c)), bool)
    alone, owner, leaves, masks = [], [], [], []
    while len(nodes):
        lo, hi = tree.low[nodes], tree.high[nodes]
        # any candidate may stand for the rest; one near the middle prunes most
        middle = squared(lo + hi, 2 * c)
        best = np.where(candidates, middle, middle.max() + 1).argmin(1)
        for z in np.unique(best):
            here = np.flatnonzero(best == z)
            u = c - c[z]
            # at the corner of the box that lies farthest in the direction of each other centroid
            reach = hi[here] @ np.maximum(u, 0).T + lo[here] @ np.minimum(u, 0).T
            farther = (norms - norms[z])[None, :] - 2 * reach  # |v - c|^2 - |v - c_z|^2
            candidates[here] &= ~(farther > 0).astype(bool)
        done = candidates.sum(1) == 1
        leaf = ~done & (tree.child[nodes] == 0)
        alone.append(nodes[done])
        owner.append(best[done])
        leaves.append(nodes[leaf])
        masks.append(candidates[leaf])
        down = ~done & ~leaf
        first = tree.child[nodes[down]]
        nodes, candidates = np.concatenate([first, first + 1]), np.concatenate([candidates[down], candidates[down]])
    last = np.concatenate(leaves)
    points = _spread(tree.start[last], tree.end[last])
    if len(points):
        d = squared(tree.x[points], c)
        mask = np.repeat(np.concatenate(masks), tree.end[last] - tree.start[last], 0)
        nearest = np.where(mask, d, d.max() + 1).argmin(1)  # ties: the smaller number
    else:
        nearest = np.zeros(0, int)
    return Found(np.concatenate(alone), np.concatenate(owner), points, nearest)


# --------------------------------------------------------------- over Spark

_BLOCK = "ids array<long>, kind string, x binary, start binary, finish binary, child binary, low binary, high binary, total_kind string, total binary"


def _pack(ids: pa.Array, x: np.ndarray, leaf: int) -> pa.RecordBatch:
    t, order = build(x, leaf)
    kind = "<i4" if -(1 << 31) < min(x.min(), 0) and x.max() < 1 << 31 else "<i8"
    if t.total.dtype == object:
        total_kind, total = "text", ",".join(map(str, t.total.ravel())).encode()
    else:
        total_kind, total = "<i8", t.total.astype("<i8").tobytes()
    held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order)))
    raw = [a.astype("<i4").tobytes() for a in (t.start, t.end, t.child)]
    cols = [held, pa.array([kind]), pa.array([t.x.astype(kind).tobytes()]), *[pa.array([r]) for r in raw]]
    cols += [pa.array([t.low.astype(kind).tobytes()]), pa.array([t.high.astype(kind).tobytes()]), pa.array([total_kind]), pa.array([total])]
    return pa.record_batch(cols, ["ids", "kind", "x", "start", "finish", "child", "low", "high", "total_kind", "total"])


def _unpack(b: pa.RecordBatch, dim: int) -> Iterator[tuple[Tree, pa.Array]]:
    for i in range(b.num_rows):
        row = {n: b.column(j)[i] for j, n in enumerate(b.schema.names)}
        kind, total = row["kind"].as_py(), row["total"].as_py()
        ints = [np.frombuffer(row[n].as_py(), "<i4").astype(np.int64) for n in ("start", "finish", "child")]
        x, low, high = (np.frombuffer(row[n].as_py(), kind).astype(np.int64).reshape(-1, dim) for n in ("x", "low", "high"))
        sums = np.frombuffer(total, "<i8") if row["total_kind"].as_py() == "<i8" else np.array([int(v) for v in total.split(b",")], object)
        yield Tree(x, *ints, low, high, sums.reshape(-1, dim)), row["ids"].values


def trees(points: DataFrame, dim: int, block: int, leaf: int) -> DataFrame:
    """One row for each block of at most ``block`` vectors of a task: its kd-tree and the ids in tree order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs, held = [], [], 0
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                x = np.asarray(col(part, "x").flatten(), np.int64).reshape(-1, dim)
                if held + len(x) > block:
                    yield _pack(pa.concat_arrays(ids), np.concatenate(xs), leaf)
                    ids, xs, held = [], [], 0
                ids.append(col(part, "vec_id"))
                xs.append(x)
                held += len(x)
        if held:
            yield _pack(pa.concat_arrays(ids), np.concatenate(xs), leaf)

    return points.mapInArrow(run, _BLOCK)


def sums(blocks: DataFrame, c: np.ndarray) -> DataFrame:
    """(cluster, n, at, total): the vectors nearest to each centroid, counted and summed by component."""
    dim = c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(c), np.int64), np.zeros(c.shape, object)
        for b in batches:
            for tree, _ in _unpack(b, dim):
                kind = work_type(dim, tree.low, tree.high, c)
                got = search(tree.cast(kind), c.astype(kind))
                sizes = tree.end - tree.start
                for k in range(len(c)):
                    whole_, single = got.nodes[got.node_owner == k], got.points[got.point_owner == k]
                    n[k] += int(sizes[whole_].sum()) + len(single)
                    for part in (tree.total[whole_], tree.x[single] if kind is float else tree.x[single].astype(object)):
                        if len(part):
                            total[k] += part.sum(0).astype(object)
        used = np.flatnonzero(n)
        values = [Decimal(int(v)) for k in used for v in total[k]]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * dim, pa.int32()), pa.array(values, pa.decimal128(38, 0)))
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(n[used]), lists], ["cluster", "n", "total"])

    each = blocks.mapInArrow(run, "cluster int, n long, total array<decimal(38,0)>")
    return each.select("cluster", "n", F.posexplode("total").alias("at", "v")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("total"))


def moved(blocks: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of every component, empty ones unchanged."""
    out = c.copy()
    for r in sums(blocks, c).collect():  # clusters x components rows
        out[r.cluster, r["at"]] = int(r.total) // r.n
    return out


def assigned(blocks: DataFrame, c: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    dim = c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tree, ids in _unpack(b, dim):
                kind = work_type(dim, tree.low, tree.high, c)
                got = search(tree.cast(kind), c.astype(kind))
                owner = np.zeros(len(tree.x), np.int32)
                sizes = (tree.end - tree.start)[got.nodes]
                owner[_spread(tree.start[got.nodes], tree.end[got.nodes])] = np.repeat(got.node_owner, sizes)
                owner[got.points] = got.point_owner
                away = tree.x.astype(kind) - c.astype(kind)[owner]
                d = (away * away).sum(1)
                far = pa.array(d.astype(np.int64)) if kind is float else pa.array([int(v) if v < 1 << 63 else None for v in d], pa.int64())
                yield pa.record_batch([ids, pa.array(owner), far], ["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3", dim: int = 64, scale: int = 1024, block: int = 4096, leaf: int = 32) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that counts."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "kd-means")
    points = integers(rows, dim, scale)
    c = first_centroids(points, k, salt)
    if not len(c):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    blocks = scratch.save(trees(points, dim, block, leaf), "trees")
    for _ in range(rounds):
        c = moved(blocks, c)
    out = scratch.save(assigned(blocks, c), "assigned")
    exact = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    found = {r.cluster: r.inertia for r in out.groupBy("cluster").agg(exact.alias("inertia")).collect()}  # k rows
    sizes = [None if v is None or v >= 1 << 63 else int(v) for v in found.values()]
    whole_ = None if None in sizes or sum(sizes) >= 1 << 63 else sum(sizes)
    named = [Row(cluster=z, cluster_inertia=v, inertia=whole_, centroid_sha256=hashlib.sha256(",".join(str(int(x)) for x in c[z]).encode()).hexdigest()) for z, v in zip(found, sizes)]
    each = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 8, rounds: int = 10, salt: str = "3", dim: int = 64, scale: int = 1024) -> str:
    """The same rows by comparing every vector with every centroid in each round."""

    def nearest(z: int) -> str:
        far = "list_sum(list_transform(list_zip(p.x, c.x), lambda v: (v[1] - v[2]) * (v[1] - v[2])))::BIGINT"
        return f"a{z} AS MATERIALIZED (SELECT id, x, cluster, distance FROM (SELECT p.id, p.x, c.cluster, {far} AS distance FROM kept p, c{z} c) QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, cluster) = 1)"

    def mean(z: int) -> str:
        floors = f"(SELECT cluster, list(m ORDER BY i) AS x FROM (SELECT cluster, i, CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END AS m FROM (SELECT cluster, i, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS v, unnest(range(1, {dim + 1})) AS i FROM a{z}) GROUP BY 1, 2)) GROUP BY 1)"
        return f"c{z + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{z} c LEFT JOIN {floors} m ON m.cluster = c.cluster)"

    rounds_ = ",\n".join(f"{nearest(z)},\n{mean(z)}" for z in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda v: floor({scale} * v::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {dim}),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{salt}:' || coalesce(vec_id::VARCHAR, '')), x) - 1)::INTEGER AS cluster, x FROM kept ORDER BY cluster LIMIT {k}),
{rounds_},
{nearest(rounds)},
sums AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY cluster)
SELECT p.vec_id, a.cluster, a.distance, s.cluster_inertia, (SELECT sum(distance)::BIGINT FROM a{rounds}) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept p ON p.id = a.id JOIN sums s ON s.cluster = a.cluster JOIN c{rounds} c ON c.cluster = a.cluster
"""
