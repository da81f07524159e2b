"""Running totals over one long sequence without a one-task window.

A sequence is split by day: windows run inside each day, and prefixes over the small table of days
carry totals and peaks across days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, value: str, day: str, order: list[str]) -> DataFrame:
    """Adds total (running sum) and peak (largest total so far, 0 at least)."""
    inside = Window.partitionBy(day).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_in", F.sum(value).over(inside))
    rows = rows.withColumn("_top", F.max("_in").over(inside))
    days = rows.groupBy(day).agg(F.sum(value).alias("_sum"), F.max("_in").alias("_max"))
    before = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    days = days.withColumn("_peak", F.greatest(F.lit(0), F.coalesce(F.max(F.col("_base") + F.col("_max")).over(before), F.lit(0))))
    rows = rows.join(F.broadcast(days.select(day, "_base", "_peak")), day)
    out = rows.withColumns({"total": F.col("_base") + F.col("_in"), "peak": F.greatest(F.col("_peak"), F.col("_base") + F.col("_top"))})
    return out.drop("_in", "_top", "_base", "_peak")


def streaks(df: DataFrame, win: str, day: str, order: list[str]) -> DataFrame:
    """(longest, current): losing streaks; an island is the losses after one and the same win."""
    rows = running(df, win, day, order)
    islands = rows.groupBy("total").agg(F.count_if(F.col(win) == 0).alias("losses"))
    return islands.agg(F.max("losses").alias("longest"), F.max_by("losses", "total").alias("current"))


def extremes(df: DataFrame, value: str, win: str, day: str, order: list[str]) -> DataFrame:
    """One row: (max_drawdown, longest_losing_streak), 0 without rows, as ``running`` and ``streaks`` give them,
    from one window: a day is summed up by what a drawdown or a streak that began before it needs."""
    inside = Window.partitionBy(day).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({"_in": F.sum(value).over(inside), "_island": F.sum(win).over(inside)})
    rows = rows.withColumn("_down", F.max("_in").over(inside) - F.col("_in"))
    islands = rows.groupBy(day, "_island").agg(F.count_if(F.col(win) == 0).alias("_losses"), F.sum(value).alias("_sum"), F.max("_in").alias("_max"), F.min("_in").alias("_min"), F.max("_down").alias("_down"))
    days = islands.groupBy(day).agg(
        F.sum("_sum").alias("_sum"), F.max("_max").alias("_max"), F.min("_min").alias("_min"), F.max("_down").alias("_down"), F.max("_losses").alias("_longest"),
        F.coalesce(F.max(F.when(F.col("_island") == 0, F.col("_losses"))), F.lit(0)).alias("_first"), F.max_by("_losses", "_island").alias("_last"), (F.max("_island") > 0).cast("int").alias("_won"),
    )
    before = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumns({"_base": F.coalesce(F.sum("_sum").over(before), F.lit(0)), "_since": F.sum("_won").over(upto)})
    days = days.withColumn("_peak", F.greatest(F.lit(0), F.coalesce(F.max(F.col("_base") + F.col("_max")).over(before), F.lit(0))))
    # losses since the last win, at the end of each day
    days = days.withColumn("_open", F.sum("_last").over(Window.partitionBy("_since").orderBy(day).rowsBetween(Window.unboundedPreceding, 0)))
    days = days.withColumn("_open", F.coalesce(F.lag("_open").over(Window.orderBy(day)), F.lit(0)))
    worst = F.greatest(F.col("_down"), F.col("_peak") - F.col("_base") - F.col("_min"))
    streak = F.greatest(F.col("_longest"), F.col("_open") + F.col("_first"))
    return days.agg(F.coalesce(F.max(worst), F.lit(0)).alias("max_drawdown"), F.coalesce(F.max(streak), F.lit(0)).alias("longest_losing_streak"))


def budget_caps(df: DataFrame, desired: str, group: list[str], order: list, budget: int) -> DataFrame:
    """Greedy filling of a budget: each row gets what is left before it, at most what it wants."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget) - F.coalesce(F.sum(desired).over(before), F.lit(0))
    return df.withColumn("stake", F.least(F.greatest(left, F.lit(0)), F.col(desired)).cast("long"))
