"""Selection rules: measured on all parts of a table in one pass, fitted on one part, judged on another.

A rule selects runners whose score reaches a threshold: all of them or the best of a race, within a range of
odds. The grid of rules is small; a row of the table meets each rule once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRID = "family string, policy string, segment string, threshold double, odds_min double, odds_max double"
#: Thresholds and segments of odds of the rule families.
EV = (1.0, 1.05, 1.1, 1.15, 1.25, 1.5, 2.0)
EDGE = (0.0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3)
SEGMENTS = (("short", 1.0, 5.0), ("middle", 5.0, 10.0), ("long", 10.0, 20.0), ("extreme", 20.0, None))
POLICIES = ("all_candidates", "top1_per_race")


def grid(spark: SparkSession, longshot: float = 20.0) -> DataFrame:
    rows = [("ev", p, "all", t, 1.0, None) for p in POLICIES for t in EV]
    rows += [("edge", p, "all", t, 1.0, None) for p in POLICIES for t in EDGE]
    rows += [("edge_segment", p, s, t, lo, hi) for p in POLICIES for t in EDGE for s, lo, hi in SEGMENTS]
    rows += [("longshot", POLICIES[0], "longshot", t, longshot, None) for t in EDGE]
    return spark.createDataFrame(rows, GRID)


def measured(rows: DataFrame, rules: DataFrame, part: Column, least_p: float = 0.03) -> DataFrame:
    """(rule, part, rows, races, wins, flat_roi) of rows with p, m (market probability), odds, won, race_id,
    post_position; rules that select nothing in a part have no row there."""
    ev, edge = F.round(F.col("p") * F.col("odds"), 9), F.round(F.col("p") / F.nullif(F.col("m"), F.lit(0.0)) - 1, 9)
    pool = rows.withColumns({"part": part, "ev": ev, "edge": edge}).where((F.col("p") >= least_p) & (F.col("odds") > 1) & F.col("part").isNotNull())
    # the best of a race by a score is its best above any threshold too
    best = lambda c: F.row_number().over(Window.partitionBy("race_id").orderBy(F.desc_nulls_last(c), "post_position"))
    pool = pool.withColumns({"by_ev": best("ev"), "by_edge": best("edge")})
    is_ev = F.col("family") == "ev"
    score, rank = F.when(is_ev, F.col("ev")).otherwise(F.col("edge")), F.when(is_ev, F.col("by_ev")).otherwise(F.col("by_edge"))
    keep = (score >= F.col("threshold")) & ((F.col("policy") == POLICIES[0]) | (rank == 1)) & (F.col("odds") >= F.col("odds_min")) & (F.col("odds") < F.coalesce("odds_max", F.lit(float("inf"))))
    by = ["family", "policy", "segment", "threshold", "odds_min"]
    picked = pool.select("race_id", "part", "ev", "edge", "by_ev", "by_edge", "odds", "won").join(F.broadcast(rules), keep)
    # races are counted by two steps of partial sums, without sets of ids
    races = picked.groupBy(*by, "part", "race_id").agg(F.count("*").alias("n"), F.sum("won").alias("w"), F.sum(F.when(F.col("won") == 1, F.col("odds")).otherwise(0.0)).alias("paid"))
    out = races.groupBy(*by, "part").agg(F.sum("n").alias("rows"), F.count("*").alias("races"), F.sum("w").cast("long").alias("wins"), F.sum("paid").alias("paid"))
    return out.withColumn("flat_roi", F.round(F.col("paid") / F.col("rows") - 1, 9)).drop("paid")


def fitted(found: DataFrame, learn: str, judge: str, least_rows: int = 100, least_races: int = 50) -> DataFrame:
    """One row a family: the rule chosen on ``learn`` and its measures on ``judge``. Rules need enough rows and
    races; ``ev`` and ``edge`` take the best return, ``edge_broad`` the most races of those that return more
    than they cost, as do ``edge_segment`` (segments of the chosen edge rule) and ``longshot``."""
    by = ["family", "policy", "segment", "threshold", "odds_min"]
    at = lambda p: found.where(F.col("part") == p).drop("part")
    good = at(learn).where((F.col("rows") >= least_rows) & (F.col("races") >= least_races))
    broad = good.where("family = 'edge' AND flat_roi > 0").withColumn("as", F.lit("edge_broad"))
    pool = good.where("family <> 'edge_segment'").where("family IN ('ev', 'edge') OR flat_roi > 0").withColumn("as", F.col("family")).unionByName(broad)
    most = F.col("as").isin("ev", "edge")
    order = Window.partitionBy("as").orderBy(F.when(most, F.col("flat_roi")).desc(), F.when(F.col("as") != "ev", F.col("races")).desc(), F.desc("rows"), "threshold", "policy")
    chosen = pool.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
    base = F.broadcast(chosen.where("`as` = 'edge'").select("policy", "threshold"))
    of_base = good.where("family = 'edge_segment' AND flat_roi > 0").join(base, ["policy", "threshold"]).withColumn("as", F.lit("edge_segment"))
    first = Window.partitionBy("as").orderBy(F.desc("races"), F.desc("rows"), "odds_min")
    chosen = chosen.unionByName(of_base.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k"))
    later = at(judge).select(*by, *[F.col(c).alias(f"judged_{c}") for c in ("rows", "races", "wins", "flat_roi")])
    names = found.sparkSession.createDataFrame([(f,) for f in ("ev", "edge", "edge_broad", "edge_segment", "longshot")], "rule string")
    got = F.broadcast(names).join(chosen.join(later, by, "left"), F.col("rule") == F.col("as"), "left")
    counts = [F.when(F.col("family").isNotNull(), F.coalesce(f"judged_{c}", F.lit(0))).alias(f"judged_{c}") for c in ("rows", "races", "wins")]
    return got.select("rule", F.when(F.col("family").isNull(), "no_eligible_rule").otherwise("fitted").alias("status"), "policy", "segment", "threshold", "rows", "races", "wins", "flat_roi", *counts, "judged_flat_roi")
