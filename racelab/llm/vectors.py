"""What the vector operators share: usable vectors, bounded samples, packing into numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only


def usable(e: Column) -> Column:
    """Whether an array is a vector with a direction: no null or non-finite component, not all zero."""
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(e.isNotNull() & good & F.exists(e, lambda x: x != 0), F.lit(False))


def read_all(rows: DataFrame) -> DataFrame:
    """(vec_id, x) of all rows, x null unless usable."""
    kind = "array<float>" if "array<float>" in dict(rows.dtypes).get("embedding", "") else "array<double>"
    own = only(rows, vec_id="long", embedding=kind)
    return own.select("vec_id", F.when(usable(F.col("embedding")), F.col("embedding")).alias("x"))


def read_vectors(rows: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, x) of all rows, x null unless usable and as long as most usable vectors; that length."""
    own = read_all(rows)
    sizes = own.where("x is not null").groupBy(F.size("x").alias("k")).count().orderBy(F.desc("count"), "k").limit(1).collect()
    dim = sizes[0].k if sizes else 0
    return own.withColumn("x", F.when(F.size("x") == dim, F.col("x"))), dim


def matrix(column, dim: int) -> np.ndarray:
    """An Arrow list column without nulls as float64 rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length, without overflow for large components."""
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def hash_sample(points: DataFrame, key: str, total: int, rows: int, dim: int) -> np.ndarray:
    """About ``rows`` vectors (never above twice that) chosen by a hash of their key, on the driver."""
    part = min(1.0, rows / max(total, 1))
    got = points.where(F.pmod(F.xxhash64(F.lit(7), key), F.lit(1 << 30)) < int(part * (1 << 30)) + 1).select("x").limit(2 * rows).toArrow()
    return matrix(got.column("x"), dim) if got.num_rows else np.zeros((0, dim))
