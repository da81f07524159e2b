"""Scores of probabilities, band reports and threshold reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from racelab.functions.safe import clip, ratio

EPS = 1e-12


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y, 2))


def log_loss(p: Column, y: Column) -> Column:
    q = clip(p, EPS, 1 - EPS)
    return F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))


def winner_log_loss(df: DataFrame, p: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over races of -ln of the winners' summed probability (dead heats add up)."""
    races = df.where("is_winner = 1").groupBy(*by, "race_id").agg(F.sum(p).alias("_p"))
    return races.groupBy(*by).agg(F.avg(-F.log(clip(F.col("_p"), EPS, 1.0))).alias("winner_log_loss"), F.count("*").alias("races"))


def flat_return(odds: str = "win_odds") -> list[Column]:
    """Rows, wins and the return of one unit on each row."""
    back = F.sum(F.when(F.col("is_winner") == 1, F.col(odds)).otherwise(0.0))
    return [F.count("*").alias("rows"), F.sum("is_winner").cast("long").alias("wins"), back.alias("returned"), (back / F.count("*") - 1).alias("flat_roi")]


def band(value: Column, edges: list[float]) -> Column:
    """The half-open band [low, high) a value is in, as its low edge; null outside."""
    out = F.lit(None).cast("double")
    for lo, hi in zip(edges, edges[1:]):
        out = F.when((value >= lo) & (value < hi), F.lit(lo)).otherwise(out)
    return out


def band_report(df: DataFrame, value: Column, edges: list[float], p: str = "predicted_win_probability") -> DataFrame:
    """Calibration and flat return of each band; empty bands are left out."""
    rows = df.withColumn("band", band(value, edges)).where("band IS NOT NULL")
    return rows.groupBy("band").agg(
        *flat_return(),
        F.avg(p).alias("mean_probability"),
        F.avg("is_winner").alias("win_rate"),
        (F.avg(p) - F.avg("is_winner")).alias("calibration_error"),
        F.avg("win_odds").alias("mean_odds"),
        F.avg(F.col(p) * F.col("win_odds")).alias("mean_value"),
    )


def sweep(df: DataFrame, grid: DataFrame, keep: Column, by: list[str], keep_empty: bool = True) -> DataFrame:
    """Every grid row evaluated in one pass: rows join the small grid where the rule holds, then one
    aggregation; grid rows without any selection stay with null metrics."""
    picked = df.join(F.broadcast(grid), keep)
    got = picked.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_distinct("race_id").alias("races"),
        F.sum("is_winner").cast("long").alias("wins"),
        F.avg("is_winner").alias("hit_rate"),
        F.avg("predicted_win_probability").alias("mean_probability"),
        F.avg("market_implied_probability").alias("mean_market"),
        F.avg(F.col("predicted_win_probability") * F.col("win_odds")).alias("mean_value"),
        (F.sum(F.when(F.col("is_winner") == 1, F.col("win_odds")).otherwise(0.0)) / F.count("*") - 1).alias("flat_roi"),
    )
    if not keep_empty:
        return got
    full = grid.select(*by).distinct().join(got, by, "left")
    return full.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("rows", "races", "wins")})


def best(df: DataFrame, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(1)


__all__ = ["band", "band_report", "best", "brier", "flat_return", "log_loss", "ratio", "sweep", "winner_log_loss"]
