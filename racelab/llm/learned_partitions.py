"""Approximate nearest neighbours on learned partitions.

Fit, on a bounded hash sample: the sample's neighbour graph (largest inner products) is cut into
balanced parts by growing parts over edges and then moving points to their neighbours' part while
sizes allow; a small network (one hidden layer, softmax) learns a vector's part. Every row of the
table is put into its most probable part. A query goes to its most probable parts: so many that, on
sample queries, the wanted share of true neighbours lies in them (vectors without structure need
many parts, clustered ones few). There all rows are compared by exact inner product in double
precision, in blocks of bounded size of rows and of queries, so a part of any size is spread over
tasks; each block keeps its best rows, and the best of all blocks are the answer.

The number of parts follows the table, from ``least_parts`` to ``most_parts``; a table with more than
``most_parts`` * ``part_rows`` rows has longer parts, in more blocks.

Vectors that are null, zero, hold null or non-finite components, or are not as long as most take no
part, as query or candidate, nor do null ids. Equal scores rank by vec_id. Repeated rows are
candidates of their own, but a row with the query's vec_id is never its neighbour; each row of a
repeated query id is a query with its own vector and its own ranks. An empty table gives no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, col
from .vectors import hash_sample, matrix, read_vectors


def neighbour_graph(x: np.ndarray, k: int, block: int = 256) -> np.ndarray:
    """The k rows of largest inner product with each row, itself left out."""
    out = []
    k = min(k, len(x) - 1)
    for at in range(0, len(x), block):
        s = x[at : at + block] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.zeros((len(s), 0), np.int64))
    return np.concatenate(out)


def balanced_parts(near: np.ndarray, parts: int, rng: np.random.Generator, slack: float = 1.1, rounds: int = 8) -> np.ndarray:
    """A part for each point, sizes at most ``slack`` times the mean, few graph edges between parts."""
    n = len(near)
    most = int(np.ceil(slack * n / parts))
    part = np.full(n, -1)
    # grow parts from seeds along edges, the smallest part first
    fronts = [deque([int(s)]) for s in rng.permutation(n)[:parts]]
    left = iter(rng.permutation(n).tolist())
    size = np.zeros(parts, int)
    for _ in range(n):
        k = int(size.argmin())
        while fronts[k] and part[fronts[k][0]] >= 0:
            fronts[k].popleft()
        i = fronts[k].popleft() if fronts[k] else next(j for j in left if part[j] < 0)
        part[i] = k
        size[k] += 1
        fronts[k] += [int(j) for j in near[i] if part[j] < 0]
    votes_of = np.concatenate([np.stack([np.repeat(np.arange(n), near.shape[1]), near.ravel()]), np.stack([near.ravel(), np.repeat(np.arange(n), near.shape[1])])], 1)
    for _ in range(rounds):
        votes = np.bincount(votes_of[0] * parts + part[votes_of[1]], minlength=n * parts).reshape(n, parts)
        gain = votes.max(1) - votes[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            k = int(votes[i].argmax())
            if size[k] < most:
                size[part[i]] -= 1
                size[k] += 1
                part[i] = k
                moved += 1
        if moved < n // 1000:
            break
    return part


@dataclass
class Router:
    """x to part probabilities: softmax(relu(x w + b) v + c)."""

    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: np.ndarray
    scale: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x * self.scale @ self.w + self.b, 0) @ self.v + self.c

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts from most to least probable."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")


def fit_router(x: np.ndarray, part: np.ndarray, parts: int, rng: np.random.Generator, hidden: int = 128, epochs: int = 20, batch: int = 256) -> Router:
    d = x.shape[1]
    scale = 1.0 / max(float(np.sqrt((x * x).sum(1).mean())), 1e-300) * np.sqrt(d) ** 0.5
    par = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]
    step = 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            xx = x[at] * scale
            h = np.maximum(xx @ par[0] + par[1], 0)
            z = h @ par[2] + par[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), part[at]] -= 1
            p /= len(at)
            dh = (p @ par[2].T) * (h > 0)
            step += 1
            for k, g in enumerate((xx.T @ dh, dh.sum(0), h.T @ p, p.sum(0))):
                g = g + 1e-4 * par[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                par[k] = par[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Router(*par, scale)


def probes_needed(router: Router, x: np.ndarray, near: np.ndarray, share: float) -> int:
    """The fewest most probable parts that hold the share of the points' graph neighbours."""
    order = router.order(x)
    rank = np.argsort(order, axis=1)
    home = order[:, 0]
    ranks = rank[np.repeat(np.arange(len(x)), near.shape[1]), home[near.ravel()]]
    return int(np.searchsorted(np.cumsum(np.bincount(ranks, minlength=order.shape[1])) / max(1, len(ranks)), share) + 1)


def fit(sample: np.ndarray, parts: int, share: float, seed: int = 29, graph: int = 20) -> tuple[Router, int]:
    rng = np.random.default_rng(seed)
    parts = min(parts, len(sample) // 8)
    if parts < 2 or len(sample) <= graph:
        d = sample.shape[1] if sample.ndim == 2 else 0
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 1
    near = neighbour_graph(sample, graph)
    router = fit_router(sample, balanced_parts(near, parts, rng), parts, rng)
    return router, min(parts, probes_needed(router, sample, near, share))


def nearest(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of each query's k rows of largest inner product; ids in ascending order."""
    out = []
    scores = queries @ x.T
    for query, mine, row in zip(queries, own, scores):
        row[ids == mine] = -np.inf
        top = min(k, len(row))
        least = np.partition(row, len(row) - top)[len(row) - top]
        best = np.flatnonzero((row >= least - 1e-9 * (1 + abs(least))) & (row > -np.inf))
        # once more by one product at a time: equal vectors get equal scores
        exact = (x[best] * query).sum(1)
        order = np.lexsort((ids[best], -exact))[:k]
        out.append((ids[best][order], exact[order]))
    return out


def search(rows: DataFrame, k: int = 20, every: int = 20, share: float = 0.95, part_rows: int = 4096, least_parts: int = 8, most_parts: int = 256, sample: int = 8192, block: int = 8192, queries: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id ``every`` divides."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "partitions")
    vectors, dim = read_vectors(rows)
    points = vectors.where("x is not null and vec_id is not null").withColumn("row", F.monotonically_increasing_id())
    points = scratch.save(points, "points")
    total = points.count()
    parts = int(min(most_parts, max(least_parts, 2 ** round(np.log2(max(1, total / part_rows))))))
    router, probes = fit(hash_sample(points, "vec_id", total, sample, dim), parts, share)
    shared = spark.sparkContext.broadcast(router)
    kinds = points.schema["x"].dataType.simpleString()

    def assign(top: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                order = shared.value.order(matrix(col(b, "x"), dim))[:, :top]
                rows = pa.array(np.repeat(np.arange(b.num_rows), order.shape[1]))
                yield pa.record_batch([*(col(b, c).take(rows) for c in ("row", "vec_id", "x")), pa.array(order.ravel().astype(np.int32))], ["row", "vec_id", "x", "part"])

        return run

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        """How many blocks each part has; at most ``most_parts`` rows."""
        return scratch.save(df.groupBy("part").count().select("part", F.ceil(F.col("count") / size).cast("int").alias(name)), name)

    schema = f"row long, vec_id long, x {kinds}, part int"
    stored = scratch.save(points.mapInArrow(assign(1), schema), "index")
    asked = scratch.save(points.where(F.col("vec_id") % every == 0).mapInArrow(assign(probes), schema), "asked")
    sizes = blocks(stored, block, "blocks").join(F.broadcast(blocks(asked, queries, "groups")), "part")
    sizes = F.broadcast(scratch.save(sizes, "sizes"))
    # every block of a part's rows meets every block of its queries
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    stored = stored.join(sizes, "part").withColumn("block", one("blocks")).withColumn("group", each("groups"))
    asked = asked.join(sizes, "part").withColumn("group", one("groups")).withColumn("block", each("blocks"))

    def local(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            c = c.sort_values("vec_id", kind="stable")
            ids, x = c["vec_id"].to_numpy(), np.stack(c["x"].to_numpy()).astype(float)
            for at in range(0, len(q), 512):
                part = q.iloc[at : at + 512]
                found = nearest(x, ids, np.stack(part["x"].to_numpy()).astype(float), part["vec_id"].to_numpy(), k)
                n = [len(i) for i, _ in found]
                out.append(pd.DataFrame({"row": np.repeat(part["row"].to_numpy(), n), "query_id": np.repeat(part["vec_id"].to_numpy(), n), "vec_id": np.concatenate([i for i, _ in found]), "score": np.concatenate([s for _, s in found])}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []})

    keys = ["part", "block", "group"]
    left, right = (df.select(*keys, "row", "vec_id", "x").groupBy(*keys) for df in (asked, stored))
    found = left.cogroup(right).applyInPandas(local, "row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
