"""Merging and checking incoming tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from racelab.operators.checks import blank


def single_winner(df: DataFrame, is_winner: Column) -> DataFrame:
    """Rows with their race's number of winners; races without exactly one are quarantined."""
    n = F.sum(is_winner.cast("int")).over(Window.partitionBy("race_id"))
    return df.withColumn("winners", n.cast("long")).withColumn("quarantined", F.col("winners") != 1)


def multi_runner(df: DataFrame, least: int = 2) -> DataFrame:
    """Rows of races with at least ``least`` rows: a race that came in part replaces nothing."""
    n = F.count("*").over(Window.partitionBy("race_id"))
    return df.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")


def starters(df: DataFrame) -> DataFrame:
    """Runners that start: no abnormal code (blank or 0), a post position and a name."""
    code = F.trim(F.coalesce(F.col("abnormal").cast("string"), F.lit("")))
    return df.where(code.isin("", "0") & F.col("post_position").isNotNull() & ~blank(F.col("horse_name")))


def from_training_start(df: DataFrame, start: str) -> DataFrame:
    """Rows from a day on; fails if no row is left, when the rows are read."""
    rows = df.where(F.col("race_date") >= F.lit(start).cast("date"))
    left = F.broadcast(rows.agg(F.count("*").alias("_left")))
    message = f"no rows from the start of training {start} on"
    checked = left.select(F.assert_true(F.col("_left") > 0, message).cast("string").alias("_ok"))
    return checked.join(rows, F.col("_ok").isNull(), "left").drop("_ok")


def after_base(df: DataFrame, base: DataFrame) -> DataFrame:
    """Rows later than the last day of the base: a one-row table, broadcast."""
    last = F.broadcast(base.agg(F.max("race_date").alias("_last")))
    return df.join(last, F.col("race_date") > F.col("_last")).drop("_last")


def replace_races(base: DataFrame, increment: DataFrame) -> DataFrame:
    """Whole races of the increment replace those of the base."""
    ids = increment.select("race_id").distinct()
    return base.join(ids, "race_id", "left_anti").unionByName(increment, allowMissingColumns=True)


def unique_only(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once; all copies of others go."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def checks(df: DataFrame, base: DataFrame, keys: list[str], today: str) -> DataFrame:
    """One row of counts, the failed checks and the status, in one pass and one key join."""
    overlap = df.select(*keys).distinct().join(base.select(*keys).distinct(), keys, "left_semi").agg(F.count("*").alias("overlapping_keys"))
    dup = df.groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias("duplicate_keys"))
    counts = df.agg(
        F.count("*").alias("rows"),
        F.count_distinct("race_id").alias("races"),
        F.count_if(F.col("race_date").isNull()).alias("missing_dates"),
        F.count_if(F.coalesce(F.col("win_odds") <= 1, F.lit(True))).alias("bad_odds"),
        F.count_if(F.col("race_date") > F.lit(today).cast("date")).alias("future_rows"),
    )
    out = counts.crossJoin(F.broadcast(dup)).crossJoin(F.broadcast(overlap))  # one row each
    names = ["missing_dates", "bad_odds", "future_rows", "duplicate_keys", "overlapping_keys"]
    errors = F.concat_ws(",", *[F.when(F.col(c) > 0, c) for c in names])
    return out.withColumn("errors", errors).withColumn("status", F.when(errors == "", "ready").otherwise("blocked"))


def review(base: DataFrame, supplement: DataFrame, approved: bool, redistributable: bool = False, most_gap_days: int = 14, allow_gap: bool = False) -> DataFrame:
    """One row on a supplement (race_id, horse_name, race_date, finish_position, win_odds) to a base: counts,
    the errors of ten rules, warnings, and ``ready`` or ``blocked``. Keys are race and name, null being a value.

    One aggregation by key, one by race, and one over all for each table; what meets are single rows.
    """
    if most_gap_days < 0:
        raise ValueError("the gap must not be negative")
    keys = ["race_id", "horse_name"]
    finish, odds = F.col("finish_position").cast("double"), F.col("win_odds").cast("double")
    bad = lambda x, least: F.count_if(x.isNull() | F.isnan(x) | least)
    rows = supplement.agg(
        F.count("*").alias("rows"), F.min("race_date").alias("start"), F.max("race_date").alias("end"),
        bad(finish, finish < 1).alias("invalid_result_rows"), bad(odds, odds <= 1).alias("invalid_odds_rows"),
    )
    day = F.coalesce(F.col("race_date").cast("string"), F.lit("missing"))
    races = supplement.groupBy("race_id").agg(F.count_distinct(day).alias("days"), F.count_if(finish == 1).alias("w"))
    races = races.agg(F.count("*").alias("races"), F.count_if(F.col("days") > 1).alias("race_date_conflicts"), F.count_if(F.col("w") != 1).alias("winner_conflicts"))
    tagged = supplement.select(*keys, F.lit(1).alias("_s")).unionByName(base.select(*keys, F.lit(0).alias("_s"))).groupBy(*keys).agg(F.sum("_s").alias("s"), F.count_if(F.col("_s") == 0).alias("b"))
    both = tagged.agg(F.coalesce(F.sum(F.greatest(F.col("s") - 1, F.lit(0))), F.lit(0)).alias("duplicate_keys"), F.coalesce(F.sum(F.when(F.col("b") > 0, F.col("s"))), F.lit(0)).alias("overlapping_keys"))
    one = base.agg(F.count("*").alias("base_rows"), F.max("race_date").alias("base_end"))
    for part in (rows, races, both):  # one row each
        one = one.crossJoin(F.broadcast(part))
    one = one.withColumn("gap_days", F.datediff("start", "base_end").cast("long"))
    wide = F.coalesce(F.col("gap_days") > most_gap_days, F.lit(False))
    rules = {
        "empty_base": F.col("base_rows") == 0,
        "empty_supplement": F.col("rows") == 0,
        "not_after_base": F.coalesce(F.col("gap_days") <= 0, F.lit(False)),
        "history_gap": wide & F.lit(not allow_gap),
        "duplicate_keys": F.col("duplicate_keys") > 0,
        "overlapping_keys": F.col("overlapping_keys") > 0,
        "invalid_results": F.col("invalid_result_rows") > 0,
        "invalid_odds": F.col("invalid_odds_rows") > 0,
        "race_date_conflicts": F.col("race_date_conflicts") > 0,
        "winner_conflicts": F.col("winner_conflicts") > 0,
        "not_approved": F.lit(not approved),
    }
    notes = {"history_gap": wide & F.lit(allow_gap), "not_redistributable": F.lit(not redistributable)}
    named = lambda found: F.concat_ws(",", *[F.when(rule, name) for name, rule in found.items()])
    out = one.withColumns({"errors": named(rules), "warnings": named(notes)})
    return out.withColumn("status", F.when(F.col("errors") == "", "ready").otherwise("blocked"))
