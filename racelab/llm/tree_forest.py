"""Embedding near-duplicates by a forest of random-projection trees with spill.

Equal vectors are one class. Each tree splits classes by projections on random directions at the
median; a margin around the median goes to both sides (spill), and so on until leaves are small.
The first levels deal rows to blocks: they are fitted on a bounded hash sample, and a block that is
still too large for one task is split again, on a bounded sample of its own, until all fit. Inside
a block the splitting goes on at exact medians. Within a leaf all classes are compared by cosine in
double precision; each leaf gives the links of a spanning forest, and the trees' links are united.

The verified links make components. Direct links are then counted by comparing the members of each
component with each other, a large component in square tiles of bounded size: counts leave the
tasks, never pairs, and no group is a hot task.

Where many projections are equal, so that the margin would hold far more than its share, its rows go
to one side only, by a hash: blocks get smaller whatever the vectors. Should a block still be too large after
60 levels, the job fails and says so, rather than lose links. Classes are named by a 64-bit hash of the vector.

Vectors that are null, zero or hold null or non-finite components link with nothing: no links, their
own component. Vectors of different lengths don't link; each length has a forest of its own. Rows
with the same vec_id count as vectors of their own: one row each, and n_links counts rows. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, components, mix64, salted
from .vectors import hash_sample, matrix, read_all, unit


def split(x: np.ndarray, rng: np.random.Generator, spill: float) -> np.ndarray:
    """A random direction, the lower and upper end of the margin around the median, and whether the
    margin holds too much to go both ways (many equal projections)."""
    direction = rng.normal(size=x.shape[1])
    direction /= np.linalg.norm(direction)
    if not len(x):
        return np.append(direction, [0.0, 0.0, 1.0])
    p = x @ direction
    low, high = np.quantile(p, [0.5 - spill, 0.5 + spill])
    return np.append(direction, [low, high, float(np.mean((p >= low) & (p <= high)) > 2 * spill + 0.25)])


def sides(x: np.ndarray, at: np.ndarray, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows on the two sides; those in a crowded margin go to one of them by their key."""
    p = x[at] @ node[:-3]
    low, high = p <= node[-2], p >= node[-3]
    if node[-1]:
        bit = (mix64(key[at] ^ np.frombuffer(node[:1].tobytes(), np.uint64)[0]) & np.uint64(1)).astype(bool)
        low, high = low & ~(high & bit), high & ~(low & ~bit)
    return at[low], at[high]


def subtree(x: np.ndarray, key: np.ndarray, depth: int, rng: np.random.Generator, spill: float) -> np.ndarray:
    """Splits of ``depth`` levels fitted on x, in breadth-first order."""
    out, level = [], [np.arange(len(x))]
    for _ in range(depth):
        below = []
        for at in level:
            out.append(split(x[at] if len(at) > 1 else x, rng, spill))
            below += sides(x, at, out[-1], key)
        level = below
    return np.array(out)


def descend(x: np.ndarray, at: np.ndarray, key: np.ndarray, tree: np.ndarray) -> list[np.ndarray]:
    """Row numbers in each block below a subtree."""
    level, k = [at], 0
    while k < len(tree):
        below = []
        for rows in level:
            below += sides(x, rows, tree[k], key)
            k += 1
        level = below
    return level


def leaves(x: np.ndarray, key: np.ndarray, rng: np.random.Generator, leaf: int, spill: float) -> Iterator[np.ndarray]:
    """Row numbers of the leaves of one tree over x, split at exact medians."""
    todo = [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            yield at
            continue
        left, right = sides(x, at, split(x[at], rng, spill), key)
        if max(len(left), len(right)) > 0.9 * len(at):  # chance has put nearly all on one side
            left, right = at[: len(at) // 2], at[len(at) // 2 :]
        todo += [left, right]


def spanning(x: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links (i, j) with cosine at or above the threshold that join up each component of the rows."""
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    open_rows, out = near.any(1), []
    for i in np.flatnonzero(open_rows):
        if not open_rows[i]:
            continue
        open_rows[i] = False
        front = [int(i)]
        while front:
            j = front.pop()
            new = np.flatnonzero(near[j] & open_rows)
            open_rows[new] = False
            out += [(j, int(k)) for k in new]
            front += new.tolist()
    return out


def _deal(points: DataFrame, dim: int, total: int, trees: int, spill: float, block: int, sample: int, seed: int, scratch: Scratch) -> DataFrame:
    """(block, node, x): every point in its blocks of every tree, no block above ``block`` rows."""
    depth = int(min(8, max(0, np.ceil(np.log(max(total, 1) / block) / np.log(1 / (0.5 + spill))))))
    fitted = unit(hash_sample(points, "node", total, sample, dim)) if depth else np.zeros((0, dim))
    keys = mix64(np.arange(len(fitted), dtype=np.uint64))
    top = points.sparkSession.sparkContext.broadcast([subtree(fitted, keys, depth, np.random.default_rng([seed, t]), spill) for t in range(trees)])
    width = 1 << depth
    kinds = points.schema["x"].dataType.simpleString()
    schema = f"block long, node long, x {kinds}"

    def blocks_of(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each tree: block numbers and the rows in them."""
        vectors, key = unit(matrix(col(b, "x"), dim)), np.asarray(col(b, "node")).view(np.uint64)
        for t, tree in enumerate(top.value):
            parts = descend(vectors, np.arange(len(vectors)), key, tree)
            yield np.repeat(np.arange(len(parts), dtype=np.int64) + t * width, [len(p) for p in parts]), np.concatenate(parts)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for names, rows in blocks_of(b) if b.num_rows else ():
                yield pa.record_batch([pa.array(names), col(b, "node").take(pa.array(rows)), col(b, "x").take(pa.array(rows))], ["block", "node", "x"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(trees * width, np.int64)
        for b in batches:
            for names, _ in blocks_of(b) if b.num_rows else ():
                held += np.bincount(names, minlength=len(held))
        used = np.flatnonzero(held)
        yield pa.record_batch([pa.array(used), pa.array(held[used])], ["block", "n"])

    own = points.select("node", "x")
    dealt, depth, base = own.mapInArrow(route, schema), 3, trees * width
    counts = own.mapInArrow(tally, "block long, n long").groupBy("block").agg(F.sum("n").alias("count"))
    level = 0
    while (counts := scratch.save(counts.where(F.col("count") > block), f"large{level}")).limit(1).count():
        # an input of more than block * 256 rows, or a lopsided sample: split the large blocks again
        level += 1
        if level > 60:
            raise RuntimeError("blocks of the forest don't get smaller")
        if level == 1:
            dealt = scratch.save(dealt, "dealt0")
        large = dealt.join(F.broadcast(counts) if level == 1 else counts, "block")  # at most trees * 256 rows at first
        picked = large.where(F.pmod(F.xxhash64(F.lit(level), "node"), F.lit(1 << 30)).cast("double") * F.col("count") <= float(sample << 30))

        def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:  # runs in this turn, before level moves on
            x = unit(np.stack(rows["x"].to_numpy()).astype(float))
            tree = subtree(x, rows["node"].to_numpy().view(np.uint64), depth, np.random.default_rng([seed, level, key[0] & (2**63 - 1)]), spill)
            return pd.DataFrame({"block": [key[0]], "tree": [tree.tobytes()]})

        fits = scratch.save(picked.groupBy("block").applyInPandas(fit, "block long, tree binary"), f"trees{level}")

        def again(batches: Iterator[pa.RecordBatch], base: int = base) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names = np.asarray(col(b, "block"))
                if not len(names):
                    continue
                vectors, key = unit(matrix(col(b, "x"), dim)), np.asarray(col(b, "node")).view(np.uint64)
                for k in np.unique(names):
                    at = np.flatnonzero(names == k)
                    tree = np.frombuffer(col(b, "tree")[int(at[0])].as_py()).reshape(-1, dim + 3)
                    parts = descend(vectors, at, key, tree)
                    rows = pa.array(np.concatenate(parts))
                    below = mix64(np.array([k], np.int64).view(np.uint64) * np.uint64(1 << depth) + np.arange(len(parts), dtype=np.uint64)).view(np.int64) | np.int64(-(2**63))
                    yield pa.record_batch([pa.array(np.repeat(below, [len(p) for p in parts])), col(b, "node").take(rows), col(b, "x").take(rows)], ["block", "node", "x"])

        split_up = scratch.save(large.drop("count").join(fits, "block").mapInArrow(again, schema), f"dealt{level}")
        counts = split_up.groupBy("block").count()
        dealt = dealt.join(F.broadcast(fits.select("block")) if level == 1 else fits.select("block"), "block", "left_anti").unionByName(split_up)
    return dealt


def _count(members: DataFrame, dim: int, threshold: float, tile: int) -> DataFrame:
    """(node, near): how many vectors of its component, repeats counted, are near each class."""
    sizes = members.groupBy("comp").agg(F.count("*").alias("size"))
    rows = salted(members, sizes, "comp", "node", "inner").withColumn("tiles", F.ceil(F.col("size") / tile).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    # a tile pair (i, j) holds rows of both; small components share a cell of several
    other = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    rows = rows.withColumn("own", own).withColumn("cell", F.explode(other))
    shared = max(1, members.count() // tile)  # as many cells as tiles of the table
    cell = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("comp"), F.lit(shared))).otherwise(F.xxhash64("comp", "cell.i", "cell.j"))
    rows = rows.select(cell.alias("cell"), F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "own", "comp", "node", "n", "x")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, i, j), part in rows.groupby(["comp", "i", "j"], sort=False):
            x = unit(np.stack(part["x"].to_numpy()).astype(float))
            n, node, tile_of = part["n"].to_numpy(), part["node"].to_numpy(), part["own"].to_numpy()
            a, b = np.flatnonzero(tile_of == i), np.flatnonzero(tile_of == j)
            near = x[a] @ x[b].T >= threshold
            if i == j:
                np.fill_diagonal(near, False)
                out.append(pd.DataFrame({"node": node[a], "near": near @ n[b]}))
            else:
                out += [pd.DataFrame({"node": node[a], "near": near @ n[b]}), pd.DataFrame({"node": node[b], "near": near.T @ n[a]})]
        return pd.concat(out)

    return rows.groupBy("cell").applyInPandas(run, "node long, near long").groupBy("node").agg(F.sum("near").alias("near"))


def near_duplicates(rows: DataFrame, threshold: float = 0.9, trees: int = 20, leaf: int = 256, spill: float = 0.04, block: int = 16384, sample: int = 16384, tile: int = 512, seed: int = 17) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of (vec_id, embedding)."""
    scratch = Scratch(rows.sparkSession, "forest")
    vectors = scratch.save(read_all(rows).withColumn("node", F.when(F.col("x").isNotNull(), F.xxhash64("x"))), "vectors")
    good = vectors.where("node is not null")
    lengths = [r.k for r in good.groupBy(F.size("x").alias("k")).count().orderBy("k").collect()]
    lone = vectors.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = reduce(DataFrame.unionByName, [_same_length(good.where(F.size("x") == k), k, scratch, threshold, trees, leaf, spill, block, sample, tile, seed) for k in lengths], lone)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _same_length(good: DataFrame, dim: int, scratch: Scratch, threshold: float, trees: int, leaf: int, spill: float, block: int, sample: int, tile: int, seed: int) -> DataFrame:
    """(vec_id, n_links, component_id) of usable vectors of one length."""
    points = scratch.save(good.groupBy("node").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.min("x").alias("x")), "classes")
    total = points.count()
    dealt = _deal(points, dim, total, trees, spill, block, sample, seed, scratch)

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        node = rows["node"].to_numpy()
        x = unit(np.stack(rows["x"].to_numpy()).astype(float))
        rng = np.random.default_rng([seed, 9, key[0] & (2**63 - 1)])
        found = [(at[i], at[j]) for at in leaves(x, node.view(np.uint64), rng, leaf, spill) for i, j in spanning(x[at], threshold)]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": np.minimum(node[pairs[:, 0]], node[pairs[:, 1]]), "b": np.maximum(node[pairs[:, 0]], node[pairs[:, 1]])})

    links = scratch.save(dealt.groupBy("block").applyInPandas(compare, "a long, b long").distinct(), "links")
    comps = components(links, scratch)
    members = scratch.save(points.join(comps, "node"), "members")
    near = _count(members, dim, threshold, tile)
    least = members.groupBy("comp").agg(F.min("least").alias("component_id"))
    linked = salted(members.select("node", "comp").join(near, "node"), least, "comp", "node", "inner")
    linked = scratch.save(linked.select("node", "near", "component_id"), "linked")
    known = scratch.save(points.select("node", "n", "least").join(linked, "node", "left").select("node", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), "known")
    return good.select("vec_id", "node").join(known, "node").select("vec_id", "n_links", "component_id")


#: The same rows in SQL, by comparing all vectors (for small tables).
ORACLE_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
), r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id)::BIGINT AS n_links,
  least(vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = vec_id), vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = vec_id), vec_id)) AS kept
FROM embeddings
"""
