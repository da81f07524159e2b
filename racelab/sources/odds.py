"""Strict sources of odds: every row of a file is a quote or a fault with its row number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from racelab.functions.times import iso_instant
from racelab.operators.checks import blank

from . import feed

REQUIRED = ("race_id", "horse_id", "horse_name", "decimal_odds", "observed_at", "scheduled_post_time")
QUOTE = ("race_id", "horse_id", "horse_name", "decimal_odds", "observed_at", "scheduled_post_time", "source", "source_reference")


def judged(rows: DataFrame, default_source: str = "manual_csv") -> DataFrame:
    """Rows of text columns with their typed quote and ``reason``, the first rule that a row breaks (null:
    none). Extra columns go; ``malformed`` is the text of a row that has another number of fields."""
    if missing := sorted(set(REQUIRED) - set(rows.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    have = lambda c: F.trim(F.col(c)) if c in rows.columns else F.lit(None).cast("string")
    text = {c: have(c) for c in ("race_id", "horse_id", "horse_name")}
    odds = F.trim("decimal_odds").try_cast("double")
    seen, post = iso_instant(F.col("observed_at")), iso_instant(F.col("scheduled_post_time"))
    source = F.coalesce(F.nullif(have("source"), F.lit("")), F.lit(default_source))
    bad = F.col("malformed").isNotNull() if "malformed" in rows.columns else F.lit(False)
    reason = F.when(bad, "malformed")
    for c, x in text.items():
        reason = reason.when(blank(x), f"blank_{c}")
    reason = reason.when(odds.isNull(), "odds_not_a_number").when(F.isnan(odds) | (odds <= 1) | (odds == float("inf")), "odds_not_above_one")
    reason = reason.when(seen.isNull(), "bad_observed_at").when(post.isNull(), "bad_post_time").when(seen >= post, "observed_after_post")
    typed = {**text, "decimal_odds": odds, "observed_at": seen, "scheduled_post_time": post, "source": source, "source_reference": F.coalesce(have("source_reference"), F.lit(""))}
    at = [c for c in ("file", "member", "start", "line") if c in rows.columns]
    return rows.select(*at, *[x.alias(c) for c, x in typed.items()], reason.alias("reason"))


def strict(found: DataFrame) -> DataFrame:
    """The quotes; the first fault fails the job and is named with its row."""
    at = [F.col(c).cast("string") for c in ("file", "line") if c in found.columns]
    message = F.concat_ws(" ", F.lit("invalid odds row:"), F.col("reason"), *at)
    checked = F.when(F.col("reason").isNotNull(), F.raise_error(message).cast("string")).otherwise(F.col("race_id"))
    return found.withColumn("race_id", checked).select(*QUOTE)


def read_odds(spark: SparkSession, path: str, default_source: str = "manual_csv", **options) -> tuple[DataFrame, DataFrame]:
    """(quotes, faults) of delimited files, plain or in ZIP archives; a fault has its file and row, counted
    from the header's 1. A record is a line."""
    lines = feed.read(spark, path, members="table", **options)
    found = judged(feed.from_lines(lines, "UTF-8", feed.first_lines(spark, path, **options)), default_source)
    faults = feed.line_numbers(lines, found.where("reason IS NOT NULL").select("file", "member", "start", "line", "reason"))
    return found.where("reason IS NULL").select(*QUOTE), faults.select("file", "member", F.col("line").alias("row"), "reason")


def strict_odds(spark: SparkSession, path: str, default_source: str = "manual_csv", **options) -> DataFrame:
    """The quotes of files that must not hold a fault."""
    return strict(judged(feed.csv_table(spark, path, **options), default_source))


def race_quotes(quotes: DataFrame, race_id: str) -> DataFrame:
    """A race's quotes in order of horse and time; of several sources too."""
    return quotes.where(F.col("race_id") == race_id).orderBy("horse_id", "observed_at")
