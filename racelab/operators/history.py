"""Leakage-safe features: what was known strictly before the day of a race.

Races of one day share one history. Range frames over day numbers end one day before, so there is no
self-join: one exchange and sort for each key set. Null keys form a group of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from racelab.functions.safe import category, clip, ratio


def finish_percentile(df: DataFrame) -> DataFrame:
    """(finish - 1) / (field - 1) within [0, 1]; null for a field of one or no finish."""
    x = ratio(F.col("finish_position") - 1, F.col("field_size") - 1)
    return df.withColumn("finish_percentile", clip(x, 0.0, 1.0))


def position_ratios(df: DataFrame) -> DataFrame:
    """Mean of the known early (1, 2) and late (3, 4) corner positions over the field size."""

    def mean(a: str, b: str):
        known = F.filter(F.array(a, b), lambda x: x.isNotNull())
        total = F.aggregate(known, F.lit(0.0), lambda s, x: s + x)
        return ratio(ratio(total, F.size(known)), F.col("field_size"))

    return df.withColumns({"early_ratio": mean("corner_1", "corner_2"), "late_ratio": mean("corner_3", "corner_4")})


def distance_bucket(df: DataFrame, width: int = 200) -> DataFrame:
    return df.withColumn("distance_bucket", category((F.floor(F.col("distance_m") / width) * width).cast("bigint")))


def outcomes(df: DataFrame) -> DataFrame:
    f = F.col("finish_position")
    return df.withColumns({"is_winner": F.coalesce((f == 1).cast("int"), F.lit(0)), "is_top3": F.coalesce((f <= 3).cast("int"), F.lit(0))})


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("_day", F.datediff("race_date", F.lit("1970-01-01").cast("date")))


#: Least common multiple of 1 to 22: shares of fields of up to 23 are whole numbers of its parts.
_PARTS = 232_792_560


def _exact_mean(share: Column, window: WindowSpec) -> Column:
    """Mean of shares k/m, the double nearest to the true one whatever the order of rows: parts are summed as
    whole numbers, so that a mean halfway between two rounded values is rounded as such. Other values are
    summed as doubles."""
    parts = share * _PARTS
    whole = F.abs(parts - F.round(parts)) < 1e-6
    total = F.coalesce(F.sum(F.when(whole, F.round(parts).cast("long"))).over(window), F.lit(0))
    rest = F.coalesce(F.sum(F.when(~whole, parts)).over(window), F.lit(0.0))
    return (total + rest) / F.nullif(F.count(share).over(window) * _PARTS, F.lit(0))


def prior_history(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Starts, win rate, mean finish and percentile before the day, and days since the last start."""
    past = Window.partitionBy(*keys).orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
    f = F.col("finish_position")
    out = _day(df).withColumns(
        {
            f"{prefix}_past_starts": F.count("*").over(past),
            f"{prefix}_past_win_rate": F.avg("is_winner").over(past),
            f"{prefix}_past_finish_mean": F.avg(f).over(past),
            f"{prefix}_past_percentile_mean": _exact_mean(F.col("finish_percentile"), past),
            f"{prefix}_days_since": (F.col("_day") - F.max("_day").over(past)).cast("long"),
        }
    )
    return out.drop("_day")


RECENT = ("finish", "win", "top3", "last_3f", "early", "late", "percentile")


def recent_form(df: DataFrame, key: str = "horse_name") -> DataFrame:
    """Means over the last 3 and 5 race days (a day's value is the mean of its races), best last_3f
    of 5 days, and the trend (3 less 5). Frames count days; null values in them are skipped."""
    days = df.groupBy(key, "race_date").agg(
        F.avg("finish_position").alias("finish"),
        F.avg("is_winner").alias("win"),
        F.avg("is_top3").alias("top3"),
        F.avg("last_3f").alias("last_3f"),
        F.avg("early_ratio").alias("early"),
        F.avg("late_ratio").alias("late"),
        F.avg("finish_percentile").alias("percentile"),
    )
    order = Window.partitionBy(key).orderBy("race_date")
    last = {w: order.rowsBetween(-w, -1) for w in (3, 5)}
    out = days.select(
        key,
        "race_date",
        *[F.avg(c).over(last[w]).alias(f"recent_{c}_{w}") for w in (3, 5) for c in RECENT],
        F.min("last_3f").over(last[5]).alias("recent_best_last_3f_5"),
    )
    return out.withColumns({f"recent_{c}_trend": F.col(f"recent_{c}_3") - F.col(f"recent_{c}_5") for c in RECENT})


def attach_recent_form(df: DataFrame, key: str = "horse_name") -> DataFrame:
    form = recent_form(df, key).withColumnsRenamed({key: "_k", "race_date": "_d"})
    return df.join(form, F.col(key).eqNullSafe(F.col("_k")) & (F.col("race_date") == F.col("_d")), "left").drop("_k", "_d")


def race_relative(df: DataFrame) -> DataFrame:
    """Post position over the field, and weights against the race's mean."""
    race = Window.partitionBy("race_id")
    out = {"relative_post": ratio(F.col("post_position"), F.count("*").over(race))}
    for c in ("carried_weight", "horse_weight"):
        out[f"{c}_vs_field"] = F.col(c) - F.avg(c).over(race)
    return df.withColumns(out)
