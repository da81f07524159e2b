"""Operators over the field of a race: market probabilities, ranks, softmax, certainty.

All share the partitioning by race_id, so a chain of them needs one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from racelab.functions.safe import clip, ratio

def race() -> WindowSpec:
    return Window.partitionBy("race_id")


def normalise(df: DataFrame, column: str, out: str) -> DataFrame:
    """Share of the race's sum; 0 where that is null or zero."""
    return df.withColumn(out, F.coalesce(ratio(F.col(column), F.sum(column).over(race())), F.lit(0.0)))


def market_probability(df: DataFrame, odds: str = "win_odds") -> DataFrame:
    """Implied probabilities with the margin taken out; odds of 1 or less, or null, count as 0."""
    df = df.withColumn("implied", F.when(F.col(odds) > 1, 1 / F.col(odds)).otherwise(0.0))
    return normalise(df, "implied", "market_implied_probability")


def softmax(df: DataFrame, score: str, out: str) -> DataFrame:
    df = df.withColumn("_top", F.max(score).over(race()))
    df = df.withColumn("_e", F.exp(F.col(score) - F.col("_top")))
    return df.withColumn(out, F.col("_e") / F.sum("_e").over(race())).drop("_top", "_e")


def temperature(df: DataFrame, p: str, t: float | Column, out: str) -> DataFrame:
    """p ** (1 / T), normalised over the race."""
    t = F.lit(t) if isinstance(t, float) else t
    return softmax(df.withColumn("_log", F.log(clip(F.col(p), 1e-12, 1.0)) / t), "_log", out).drop("_log")


def market_context(df: DataFrame) -> DataFrame:
    """Log probability, rank (ties in input order: by post position) and gap to the favourite."""
    p = F.col("market_implied_probability")
    return df.withColumns(
        {
            "market_log_probability": F.log(F.greatest(p, F.lit(1e-12))),
            "market_probability_rank": F.row_number().over(race().orderBy(F.desc("market_implied_probability"), "post_position")).cast("long"),
            "market_gap_to_favourite": F.max(p).over(race()) - p,
        }
    )


def race_certainty(df: DataFrame, p: str, out: str) -> DataFrame:
    """1 - entropy / ln(runners with p > 0), within [0, 1]; 1 for a single such runner."""
    x = F.col(p)
    entropy = F.sum(F.when(x > 0, -x * F.log(x)).otherwise(0.0)).over(race())
    n = F.sum((x > 0).cast("int")).over(race())
    return df.withColumn(out, F.when(n <= 1, 1.0).otherwise(clip(1 - entropy / F.log(F.when(n > 1, n).otherwise(2).cast("double")), 0.0, 1.0)))


def rank_share(column: str, descending: bool = True, of_size: bool = False) -> Column:
    """Average rank as a share of the ranked rows (or of all rows of the race); null for null. A field is
    small: ranks are counted in an array of its values, so that all columns share one window and one sort."""
    x = F.col(column)
    values = F.collect_list(x).over(race())
    ahead = F.size(F.filter(values, lambda y: y > x if descending else y < x))
    same = F.size(F.filter(values, lambda y: y == x))
    n = F.count("*").over(race()) if of_size else F.size(values)
    return F.when(x.isNotNull(), (ahead + (same + 1) / 2) / n)


def field_interactions(df: DataFrame, sources: list[str]) -> DataFrame:
    """Of each source: race mean, difference from it, sample deviation (0 for one runner), rank share."""
    out = df
    for s in sources:
        x = F.col(s)
        out = out.withColumns(
            {
                f"{s}_field_mean": F.avg(x).over(race()),
                f"{s}_vs_field": x - F.avg(x).over(race()),
                f"{s}_field_std": F.coalesce(F.stddev_samp(x).over(race()), F.lit(0.0)),
                f"{s}_rank_share": rank_share(s),
            }
        )
    p = F.col("market_implied_probability")
    return out.withColumns(
        {
            "favourite_probability": F.max(p).over(race()),
            "market_std": F.coalesce(F.stddev_samp(p).over(race()), F.lit(0.0)),
            "market_entropy": F.sum(F.when(p > 0, -p * F.log(p)).otherwise(0.0)).over(race()),
            "top3_share": F.sum(F.when(F.col("market_probability_rank") <= 3, p).otherwise(0.0)).over(race()),
        }
    )


def intrusion_features(df: DataFrame, sources: list[str]) -> DataFrame:
    """A runner against the favourite and the three most fancied."""
    rank, p = F.col("market_probability_rank"), F.col("market_implied_probability")
    of_favourite = lambda c: F.max(F.when(rank == 1, c)).over(race())
    of_top3 = lambda c: F.avg(F.when(rank <= 3, c)).over(race())
    out = df.withColumns({"market_rank_share": rank_share("market_implied_probability"), "p_over_favourite": ratio(p, of_favourite(p)), "p_vs_top3": p - of_top3(p)})
    for s in sources:
        out = out.withColumns({f"{s}_vs_favourite": F.col(s) - of_favourite(F.col(s)), f"{s}_vs_top3": F.col(s) - of_top3(F.col(s))})
    return out


def residual_overlay(df: DataFrame, baseline: str) -> DataFrame:
    """A baseline probability against the race and the market; rank share of the race's size."""
    b, p = F.col(baseline), F.col("market_implied_probability")
    return df.withColumns(
        {
            "baseline_vs_field": b - F.avg(b).over(race()),
            "baseline_rank_share": rank_share(baseline, of_size=True),
            "baseline_over_market": clip(ratio(b, p), 0.0, 20.0),
        }
    )


def top1(df: DataFrame, *order: Column) -> DataFrame:
    """The first runner of each race in this order; post position breaks ties."""
    rank = F.row_number().over(race().orderBy(*order, F.col("post_position")))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")
