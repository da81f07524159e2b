"""Bootstrap over races with reproducible integer weights.

Each race gets a Poisson(1) weight in each replicate from integer arithmetic on its number, so
replicates need no index draw, no join and no shuffle beyond one partial aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Poisson(1) cumulative probabilities on a scale of 2**31.
_CUTS = (790015084, 1580030169, 1975037711, 2106706892, 2139624187, 2146207646)


def weight(number: Column, replicate: Column) -> Column:
    u = (number * 1103515245 + replicate * 12345 + (number % 65521) * (replicate * 2654435 + 7919)) % 2147483647
    return sum(((u >= c).cast("int") for c in _CUTS), F.lit(0))


def _weights(number: np.ndarray, replicate: np.ndarray) -> np.ndarray:
    """``weight`` of each number (rows) in each replicate (columns)."""
    n = number[:, None]
    u = np.fmod(n * 1103515245 + replicate * 12345 + np.fmod(n, 65521) * (replicate * 2654435 + 7919), 2147483647)
    out = np.zeros(u.shape, np.int8)
    for c in _CUTS:
        out += u >= c
    return out.astype(float)


#: Up to this number the products of ``weight`` stay within 63 bits.
_LARGEST = 8_000_000_000
_MODULUS = 2147483647
#: Races whose weights are drawn together: they stay in a core's cache.
_BLOCK = 8192


def _add_draws(total: np.ndarray, number: np.ndarray, values: list[np.ndarray]) -> None:
    """Adds to ``total`` (replicates by columns and weight) the weighted sums of a block of races. A race's
    draws are an arithmetic progression modulo a prime, so that the next one is a sum, taken off once if too large."""
    rest = number % 65521
    u = ((number * 1103515245 + rest * 7919) % _MODULUS).astype(np.uint32)
    step = ((12345 + rest * 2654435) % _MODULUS).astype(np.uint32)
    less, hit = np.empty_like(u), np.empty(u.shape, bool)
    w, weights = np.empty(u.shape, np.int8), np.empty(u.shape)
    columns = [*values, np.ones(len(u))]
    for row in total:
        np.greater_equal(u, _CUTS[0], out=w.view(bool))
        for c in _CUTS[1:]:
            np.greater_equal(u, c, out=hit)
            np.add(w, hit.view(np.int8), out=w)
        weights[:] = w
        for k, v in enumerate(columns):
            row[k] += weights @ v
        np.add(u, step, out=u)
        # below the modulus the difference wraps around and is larger
        np.subtract(u, _MODULUS, out=less)
        np.minimum(u, less, out=u)


def replicates(races: DataFrame, number: str, sums: list[str], count: int) -> DataFrame:
    """(replicate, sums): weighted sums of each replicate. A task draws the weights of a block of its races at a
    time and hands on one row for each replicate; a null adds nothing."""
    whole = [dict(races.dtypes)[c] in ("int", "bigint") for c in sums]
    rows = races.select(F.col(number).cast("long").alias("number"), *[F.col(c).cast("double").alias(c) for c in sums])
    # races are few bytes, but much work: their number of tasks is not left to the size of their shuffle (by number, Spark would drop the exchange)
    rows = rows.repartition(int(races.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    step = max(1, (1 << 18) // count)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replicate, total = np.arange(count), np.zeros((count, len(sums) + 1))
        for b in batches:
            numbers = b.column(0).to_numpy()
            columns = [b.column(i + 1).fill_null(0.0).to_numpy() for i in range(len(sums))]
            if not len(numbers):
                continue
            if numbers.min() >= 0 and numbers.max() <= _LARGEST:
                for part in np.array_split(np.arange(len(numbers)), -(-len(numbers) // _BLOCK)):
                    _add_draws(total, numbers[part], [c[part] for c in columns])
                continue
            values = np.column_stack([*columns, np.ones(len(numbers))])
            for at in range(0, len(numbers), step):
                total += _weights(numbers[at : at + step], replicate).T @ values[at : at + step]
        yield pa.record_batch([pa.array(replicate), *(pa.array(x) for x in total.T)], ["replicate", *sums, "weight"])

    schema = ", ".join(["replicate long", *(f"`{c}` double" for c in sums), "weight double"])
    found = rows.mapInArrow(drawn, schema).groupBy("replicate")
    # sums of whole numbers are exact in a double
    return found.agg(*[F.sum(c).cast("long" if w else "double").alias(c) for c, w in zip([*sums, "weight"], [*whole, True])])


def roi_interval(races: DataFrame, number: str, count: int = 5000, least: int = 20, level: float = 0.95) -> DataFrame:
    """One row: the interval of the return on (stake, payout) races over all replicates that stake
    something. With fewer than ``least`` races there are no bounds, only the status."""
    roi = F.col("payout") / F.nullif(F.col("stake"), F.lit(0)) - 1
    tail = (1 - level) / 2
    got = replicates(races, number, ["stake", "payout"], count).agg(
        F.count(roi).alias("n"),
        F.round(F.percentile(roi, F.lit(tail)), 7).alias("low"),
        F.round(F.percentile(roi, F.lit(1 - tail)), 7).alias("high"),
        F.round(F.avg((roi > 0).cast("double")), 9).alias("positive"),
    )
    got = got.crossJoin(F.broadcast(races.agg(F.count("*").alias("clusters"))))
    few, none = F.col("clusters") < least, F.col("n") == 0
    status = F.when(few, "insufficient_race_clusters").when(none, "unavailable").otherwise("available")
    bounds = [F.when(~few & ~none, F.col(c)).alias(c) for c in ("low", "high", "positive")]
    return got.select(status.alias("status"), F.when(few | none, F.lit(count).cast("long")).otherwise(F.col("n")).alias("replicates"), *bounds, "clusters")


def delta_intervals(races: DataFrame, number: str, ratios: dict[str, tuple[str, str | None]], count: int = 1000) -> DataFrame:
    """For each named ratio (weighted sum of a column over that of another, or over the races): its
    observed value, the 5 % and 95 % quantiles over all replicates, and how often it is below zero.
    One row a name; the replicates of all names come from one aggregation."""
    sums = sorted({c for pair in ratios.values() for c in pair if c})
    reps = replicates(races, number, sums, count)
    whole = races.agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("weight"))
    both = reps.select("replicate", *sums, "weight").unionByName(whole.select(F.lit(-1).cast("long").alias("replicate"), *sums, "weight"))
    # rounded: a sum that is zero but for the order of its terms is not below zero
    value = lambda pair: F.round(F.col(pair[0]) / F.nullif(F.col(pair[1] or "weight").cast("double"), F.lit(0.0)), 12)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), value(pair).alias("delta")) for name, pair in ratios.items()]))
    rows = both.select("replicate", each.alias("m")).select("replicate", "m.*")
    drawn = F.when(F.col("replicate") >= 0, F.col("delta"))
    return rows.groupBy("metric").agg(
        F.max(F.when(F.col("replicate") < 0, F.col("delta"))).alias("observed"),
        F.percentile(drawn, F.lit(0.05)).alias("low"),
        F.percentile(drawn, F.lit(0.95)).alias("high"),
        F.avg((drawn < 0).cast("double")).alias("below_zero"),
        F.count(drawn).alias("replicates"),
    )
