"""The current history: an approved base and what a feed has after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racelab.operators import intake, ledger


def current_history(base: DataFrame, parsed: DataFrame, source: str, reference: str, acquired: str, most_gap_days: int = 14, allow_gap: bool = True) -> tuple[DataFrame, DataFrame]:
    """(history, report). The history is the base and, with their provenance, the races of ``parsed`` that are
    later than the base and have exactly one winner. The report is one row: its status is ``no_base``,
    ``no_races_after_base``, ``no_single_winner_races``, ``blocked_history_gap``, ``ready_recent_history_gap`` or
    ``ready``; the history is of use only if it is ready."""
    end = base.agg(F.max("race_date").alias("base_end"), F.count("*").alias("base_rows"))
    later = intake.single_winner(intake.after_base(parsed, base), F.col("finish_position") == 1)
    history = ledger.merged_history(base, later.where("NOT quarantined").drop("winners", "quarantined"), source, reference, acquired)
    # one row a race of the feed, then one row
    rows = parsed.crossJoin(F.broadcast(end))  # one row
    after = F.col("race_date") > F.col("base_end")
    races = rows.groupBy("race_id").agg(
        F.count("*").alias("n"), F.count_if(after).alias("later"), F.count_if(after & (F.col("finish_position") == 1)).alias("w"),
        F.min(F.when(after, F.col("race_date"))).alias("lo"), F.max(F.when(after, F.col("race_date"))).alias("hi"),
    )
    has, one, none, many = F.col("later") > 0, F.col("w") == 1, F.col("w") == 0, F.col("w") > 1
    counts = races.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("parsed_rows"), F.count("*").alias("parsed_races"),
        F.coalesce(F.sum(F.when(has & one, F.col("later"))), F.lit(0)).alias("supplemental_rows"), F.count_if(has & one).alias("supplemental_races"),
        F.count_if(has & none).alias("zero_winner_races"), F.count_if(has & many).alias("multiple_winner_races"), F.coalesce(F.sum(F.when(has & ~one, F.col("later"))), F.lit(0)).alias("excluded_rows"),
        F.min(F.when(one, F.col("lo"))).alias("supplemental_start"), F.max(F.when(one, F.col("hi"))).alias("supplemental_end"), F.count_if(has).alias("_later"),
    )
    report = F.broadcast(end).crossJoin(F.broadcast(counts)).withColumn("gap_days", F.datediff("supplemental_start", "base_end"))
    status = (
        F.when(F.col("base_rows") == 0, "no_base")
        .when(F.col("_later") == 0, "no_races_after_base")
        .when(F.col("supplemental_races") == 0, "no_single_winner_races")
        .when((F.col("gap_days") > most_gap_days) & F.lit(not allow_gap), "blocked_history_gap")
        .when(F.col("gap_days") > most_gap_days, "ready_recent_history_gap")
        .otherwise("ready")
    )
    history_rows = F.col("base_rows") + F.col("supplemental_rows")
    return history, report.select(
        status.alias("status"), "base_end", "base_rows", "parsed_rows", "parsed_races", "supplemental_rows", "supplemental_races", "zero_winner_races", "multiple_winner_races", "excluded_rows",
        "supplemental_start", "supplemental_end", "gap_days", history_rows.alias("history_rows"), F.coalesce("supplemental_end", "base_end").alias("history_end"),
    )
