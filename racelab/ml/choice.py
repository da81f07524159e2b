"""Conditional logit over candidate sets: which of a race's candidates came true.

A race is a row: its candidates' features as one array and the place of the one that came true. Newton's
method sums each task's log-likelihood, gradient and curvature over its races and adds up the tasks' rows in
Spark: an iteration moves d + d^2 numbers a task, and no race leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def choice_sets(candidates: DataFrame, key: str, features: list[str], chosen: str) -> DataFrame:
    """(key, x, pick): candidates of each key in order of ``features``' columns; keys without exactly one
    chosen candidate, or with a feature missing, are left out. ``pick`` is the place of the chosen one, which
    is put first."""
    x = F.array(*[F.col(c).cast("double") for c in features])
    good = ~F.exists(x, lambda v: v.isNull() | F.isnan(v))
    each = candidates.select(key, F.struct((1 - F.col(chosen).cast("int")).alias("other"), F.when(good, x).alias("x")).alias("c"))
    sets = each.groupBy(key).agg(F.sort_array(F.collect_list("c")).alias("c"))
    whole = (F.size(F.filter("c", lambda c: c["other"] == 0)) == 1) & ~F.exists("c", lambda c: c["x"].isNull())
    return sets.where(whole).select(key, F.flatten(F.transform("c", lambda c: c["x"])).alias("x"))


def _race_sums(x: np.ndarray, sizes: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and negative Hessian over races laid end to end, the chosen one first."""
    start = np.cumsum(sizes) - sizes
    s = x @ w
    top = np.maximum.reduceat(s, start)
    e = np.exp(s - np.repeat(top, sizes))
    z = np.add.reduceat(e, start)
    p = e / np.repeat(z, sizes)
    mean = np.add.reduceat(p[:, None] * x, start)
    like = float((s[start] - top - np.log(z)).sum())
    return like, x[start].sum(0) - mean.sum(0), (x * p[:, None]).T @ x - mean.T @ mean


def derivatives(sets: DataFrame, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
    """(log-likelihood, gradient, negative Hessian, races) at ``w``."""
    d = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        like, grad, curve, n = 0.0, np.zeros(d), np.zeros((d, d)), 0
        for b in batches:
            column = b.column(b.schema.get_field_index("x"))
            sizes = np.diff(np.asarray(column.offsets)) // d
            if not len(sizes):
                continue
            x = np.asarray(column.flatten(), float).reshape(-1, d)
            one = _race_sums(x, sizes, w)
            like, grad, curve, n = like + one[0], grad + one[1], curve + one[2], n + len(sizes)
        values = np.concatenate([[like, n], grad, curve.ravel()])
        yield pa.record_batch([pa.array(np.arange(len(values))), pa.array(values)], ["k", "v"])

    rows = sets.select("x").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(2 + d + d * d)
    for r in rows:
        v[r.k] = r.v
    return v[0], v[2 : 2 + d], v[2 + d :].reshape(d, d), int(v[1])


@dataclass
class ConditionalLogit:
    features: list[str]
    weights: np.ndarray
    likelihood: float
    races: int

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        terms = [F.col(c).cast("double") * float(w) for c, w in zip(self.features, self.weights)]
        return df.withColumn(out, sum(terms[1:], terms[0]))


def fit(sets: DataFrame, features: list[str], l2: float = 1e-3, rounds: int = 25, tolerance: float = 1e-8) -> ConditionalLogit:
    """Newton's method with halved steps, penalty ``l2`` times the races; ``sets`` should be a stored table."""
    w = np.zeros(len(features))

    def at(w):
        like, g, h, n = derivatives(sets, w)
        return like - l2 * n / 2 * w @ w, g - l2 * n * w, h + l2 * n * np.eye(len(w)), n

    value, g, h, n = at(w)
    for _ in range(rounds):
        if n == 0 or np.abs(g).max() <= tolerance * n:
            break
        step = np.linalg.solve(h + 1e-12 * np.eye(len(w)), g)
        for _ in range(20):
            new = at(w + step)
            if new[0] >= value:
                break
            step = step / 2
        else:
            break
        w = w + step
        value, g, h, n = new
    return ConditionalLogit(features, w, value, n)
