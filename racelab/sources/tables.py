"""Contest tables: the canonical runner table, and its mapping from order and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each runner of each race: an order is a race, its line items are the runners.

    The dimensions of a race are joined to the races first, those of a runner to the runners; the two
    meet last, by race_id, so that the runners are shuffled by it once: race windows, here and in what
    is built on this, reuse that partitioning.
    """
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("race_id"), "o_custkey", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    li = table(spark, sf_dir, "lineitem").withColumn("race_id", F.col("l_orderkey").cast("string"))
    races = o.join(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey"))
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(races, "race_id")
    race = Window.partitionBy("race_id")
    tie = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    rows = rows.select(
        "*",
        F.row_number().over(race.orderBy(*tie, "l_extendedprice")).cast("long").alias("post_position"),
        F.row_number().over(race.orderBy(F.desc("l_extendedprice"), *tie)).cast("long").alias("finish_position"),
        F.count("*").over(race).alias("field_size"),
    )
    qty = F.col("l_quantity").cast("long")
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    corner = lambda k: (1 + (F.col("post_position") * k + cents("l_discount")) % F.col("field_size")).cast("double")
    rows = rows.select(
        "race_id",
        F.col("o_orderdate").cast("date").alias("race_date"),
        "post_position",
        F.col("finish_position").cast("double").alias("finish_position"),
        "field_size",
        F.concat(F.lit("H"), F.col("l_partkey").cast("string")).alias("horse_name"),
        F.concat(F.lit("J"), F.col("l_suppkey").cast("string")).alias("jockey"),
        F.col("p_brand").alias("trainer"),
        F.col("l_returnflag").alias("surface"),
        F.col("l_linestatus").alias("track_condition"),
        F.col("o_orderpriority").alias("race_class"),
        F.col("p_type").alias("sex"),
        F.col("n_name").alias("racecourse"),
        (1000 + 50 * F.col("p_size")).cast("double").alias("distance_m"),
        (2 + F.col("l_partkey") % 6).cast("double").alias("age"),
        (48 + F.col("l_quantity") / 5).alias("carried_weight"),
        (400 + F.col("l_suppkey")).cast("double").alias("horse_weight"),
        ((11 + (qty * 37 + F.col("l_partkey") * 13 + F.col("l_suppkey")) % 400) / 10).alias("win_odds"),
        (33 + cents("l_tax") / 10).alias("last_3f"),
        *[corner(k).alias(f"corner_{k}") for k in (1, 2, 3, 4)],
        ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 3) % 11 / 20).alias("form"),
        (0.5 + (F.col("l_partkey") * 3 + F.col("post_position")) % 50 / 100).alias("confidence"),
    )
    return rows


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runners with a deterministic model: probabilities by softmax over the race of a linear score."""
    from racelab.operators.market import market_probability, softmax

    rows = market_probability(runners(spark, sf_dir))
    rows = rows.withColumn("model_score", -0.9 * F.log("win_odds") + F.col("form"))
    rows = softmax(rows, "model_score", "predicted_win_probability")
    return rows.withColumn("is_winner", F.coalesce((F.col("finish_position") == 1).cast("int"), F.lit(0)))


#: The same two tables in SQL.
RUNNERS = """
base AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS race_id, CAST(o_orderdate AS DATE) AS race_date,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS post_position,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS DOUBLE) AS finish_position,
    count(*) OVER (PARTITION BY l_orderkey) AS field_size,
    CAST(round(l_tax * 100) AS BIGINT) AS tax, CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(l_quantity AS BIGINT) AS qty, *
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), runners AS (
  SELECT race_id, race_date, post_position, finish_position, field_size, 'H' || l_partkey AS horse_name, 'J' || l_suppkey AS jockey,
    p_brand AS trainer, l_returnflag AS surface, l_linestatus AS track_condition, o_orderpriority AS race_class, p_type AS sex,
    n_name AS racecourse, CAST(1000 + 50 * p_size AS DOUBLE) AS distance_m, CAST(2 + l_partkey % 6 AS DOUBLE) AS age,
    48 + l_quantity / 5 AS carried_weight, CAST(400 + l_suppkey AS DOUBLE) AS horse_weight,
    (11 + (qty * 37 + l_partkey * 13 + l_suppkey) % 400) / 10.0e0 AS win_odds, 33 + tax / 10.0e0 AS last_3f,
    CAST(1 + (post_position * 1 + disc) % field_size AS DOUBLE) AS corner_1, CAST(1 + (post_position * 2 + disc) % field_size AS DOUBLE) AS corner_2,
    CAST(1 + (post_position * 3 + disc) % field_size AS DOUBLE) AS corner_3, CAST(1 + (post_position * 4 + disc) % field_size AS DOUBLE) AS corner_4,
    (l_partkey * 7 + l_suppkey * 3) % 11 / 20.0e0 AS form, 0.5e0 + (l_partkey * 3 + post_position) % 50 / 100.0e0 AS confidence
  FROM base
)"""

SCORED = RUNNERS + """, priced AS (
  SELECT *, CASE WHEN win_odds > 1 THEN 1.0e0 / win_odds ELSE 0.0e0 END AS implied, -0.9e0 * ln(win_odds) + form AS model_score FROM runners
), peaked AS (
  SELECT *, max(model_score) OVER (PARTITION BY race_id) AS top_score,
    coalesce(implied / nullif(sum(implied) OVER (PARTITION BY race_id), 0), 0) AS market_implied_probability FROM priced
), scored AS (
  SELECT *, exp(model_score - top_score) / sum(exp(model_score - top_score)) OVER (PARTITION BY race_id) AS predicted_win_probability,
    CASE WHEN finish_position = 1 THEN 1 ELSE 0 END AS is_winner FROM peaked
)"""
