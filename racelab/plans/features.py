"""Registered feature queries, each with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racelab.functions import betting
from racelab.operators import history, market
from racelab.sources.tables import RUNNERS, SCORED, runners, scored

KEYS = ("race_id", "post_position")


def _out(df: DataFrame, *columns: str, places: int = 9, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Keys and result columns; doubles rounded, counts as long."""
    kinds = dict(df.dtypes)
    cast = lambda c: F.round(c, places).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "bigint") else F.col(c)
    return df.select(*keys, *[cast(c) for c in columns])


def _sql(ctes: str, body: str) -> str:
    return f"WITH {ctes}{body}"


def _r(*columns: str, places: int = 9) -> str:
    return ", ".join(f"round({c}, {places}) AS {c.split('.')[-1]}" for c in columns)


QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@register("market_probability", _sql(SCORED, f" SELECT race_id, post_position, {_r('implied', 'market_implied_probability')} FROM scored"))
def market_probability(spark, d):
    return _out(scored(spark, d), "implied", "market_implied_probability")


_CONTEXT = """, context AS (
  SELECT *, ln(greatest(market_implied_probability, 1e-12)) AS market_log_probability,
    row_number() OVER (PARTITION BY race_id ORDER BY market_implied_probability DESC, post_position) AS market_probability_rank,
    max(market_implied_probability) OVER (PARTITION BY race_id) - market_implied_probability AS market_gap_to_favourite FROM scored
)"""


@register("market_context", _sql(SCORED + _CONTEXT, f" SELECT race_id, post_position, market_probability_rank, {_r('market_log_probability', 'market_gap_to_favourite')} FROM context"))
def market_context(spark, d):
    return _out(market.market_context(scored(spark, d)), "market_probability_rank", "market_log_probability", "market_gap_to_favourite")


@register("race_softmax", _sql(SCORED, f" SELECT race_id, post_position, {_r('predicted_win_probability')} FROM scored"))
def race_softmax(spark, d):
    return _out(scored(spark, d), "predicted_win_probability")


@register(
    "temperature_scale",
    _sql(
        SCORED,
        """, t AS (SELECT *, ln(greatest(least(predicted_win_probability, 1.0e0), 1e-12)) / 1.5e0 AS z FROM scored),
u AS (SELECT *, exp(z - max(z) OVER (PARTITION BY race_id)) AS e FROM t)
SELECT race_id, post_position, round(e / sum(e) OVER (PARTITION BY race_id), 9) AS calibrated FROM u""",
    ),
)
def temperature_scale(spark, d):
    return _out(market.temperature(scored(spark, d), "predicted_win_probability", 1.5, "calibrated"), "calibrated")


_CERTAINTY = """, h AS (
  SELECT *, sum(CASE WHEN predicted_win_probability > 0 THEN -predicted_win_probability * ln(predicted_win_probability) ELSE 0 END) OVER (PARTITION BY race_id) AS entropy,
    sum(CASE WHEN predicted_win_probability > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY race_id) AS alive FROM scored
), certain AS (
  SELECT *, CASE WHEN alive <= 1 THEN 1.0e0 ELSE least(greatest(1 - entropy / ln(CASE WHEN alive > 1 THEN alive ELSE 2 END), 0.0e0), 1.0e0) END AS certainty FROM h
)"""


@register("race_certainty", _sql(SCORED + _CERTAINTY, f" SELECT race_id, post_position, {_r('certainty')} FROM certain"))
def race_certainty(spark, d):
    return _out(market.race_certainty(scored(spark, d), "predicted_win_probability", "certainty"), "certainty")


@register(
    "certainty_quantiles",
    _sql(SCORED + _CERTAINTY, ", one AS (SELECT race_id, min(certainty) AS c FROM certain GROUP BY race_id) SELECT q, round(quantile_cont(c, q), 9) AS certainty FROM one, (SELECT unnest([0.0e0, 0.1e0, 0.25e0, 0.5e0, 0.75e0, 0.9e0, 0.95e0, 0.99e0, 1.0e0]) AS q) GROUP BY q")
    .replace("quantile_cont(c, q)", "CASE q WHEN 0.0e0 THEN quantile_cont(c, 0.0) WHEN 0.1e0 THEN quantile_cont(c, 0.1) WHEN 0.25e0 THEN quantile_cont(c, 0.25) WHEN 0.5e0 THEN quantile_cont(c, 0.5) WHEN 0.75e0 THEN quantile_cont(c, 0.75) WHEN 0.9e0 THEN quantile_cont(c, 0.9) WHEN 0.95e0 THEN quantile_cont(c, 0.95) WHEN 0.99e0 THEN quantile_cont(c, 0.99) ELSE quantile_cont(c, 1.0) END"),
)
def certainty_quantiles(spark, d):
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]
    rows = market.race_certainty(scored(spark, d), "predicted_win_probability", "certainty")
    one = rows.groupBy("race_id").agg(F.min("certainty").alias("c"))
    got = one.agg(F.percentile("c", F.array(*map(F.lit, shares))).alias("v"))
    return got.select(F.posexplode("v").alias("i", "c")).select(F.element_at(F.array(*map(F.lit, shares)), F.col("i") + 1).alias("q"), F.round("c", 9).alias("certainty"))


def _prepared(spark, d):
    return history.outcomes(history.finish_percentile(runners(spark, d)))


_PAST = """, prepared AS (
  SELECT *, CASE WHEN field_size > 1 THEN least(greatest((finish_position - 1) / (field_size - 1), 0.0e0), 1.0e0) END AS finish_percentile,
    CASE WHEN finish_position = 1 THEN 1 ELSE 0 END AS is_winner, CASE WHEN finish_position <= 3 THEN 1 ELSE 0 END AS is_top3,
    CASE WHEN distance_m IS NULL THEN 'UNKNOWN' ELSE CAST(CAST(floor(distance_m / 200) * 200 AS BIGINT) AS VARCHAR) END AS distance_bucket
  FROM runners
)"""


def _history(name: str, keys: list[str]) -> None:
    past = f"(PARTITION BY {', '.join(keys)} ORDER BY race_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"
    sql = _sql(
        RUNNERS + _PAST,
        f""" SELECT race_id, post_position, count(*) OVER w AS past_starts, round(avg(is_winner) OVER w, 9) AS past_win_rate,
  round(avg(finish_position) OVER w, 9) AS past_finish_mean, round(avg(finish_percentile) OVER w, 9) AS past_percentile_mean,
  datediff('day', max(race_date) OVER w, race_date) AS days_since FROM prepared WINDOW w AS {past}""",
    )

    @register(name, sql)
    def query(spark, d):
        rows = history.distance_bucket(_prepared(spark, d))
        got = history.prior_history(rows, keys, "k")
        names = ("past_starts", "past_win_rate", "past_finish_mean", "past_percentile_mean", "days_since")
        return _out(got.withColumnsRenamed({f"k_{c}": c for c in names}), *names)


for _name, _keys in {
    "horse_history": ["horse_name"],
    "jockey_history": ["jockey"],
    "trainer_history": ["trainer"],
    "horse_surface_history": ["horse_name", "surface"],
    "horse_distance_history": ["horse_name", "distance_bucket"],
    "horse_course_history": ["horse_name", "racecourse"],
    "jockey_course_history": ["jockey", "racecourse"],
    "jockey_trainer_history": ["jockey", "trainer"],
    "horse_jockey_history": ["horse_name", "jockey"],
    "horse_condition_history": ["horse_name", "track_condition"],
    "jockey_surface_history": ["jockey", "surface"],
    "trainer_course_history": ["trainer", "racecourse"],
    "trainer_surface_history": ["trainer", "surface"],
    "horse_class_history": ["horse_name", "race_class"],
}.items():
    _history(_name, _keys)


_RATIOS = """, ratios AS (
  SELECT *, (coalesce(corner_1, 0) + coalesce(corner_2, 0)) / nullif((corner_1 IS NOT NULL)::INT + (corner_2 IS NOT NULL)::INT, 0) / nullif(field_size, 0) AS early_ratio,
    (coalesce(corner_3, 0) + coalesce(corner_4, 0)) / nullif((corner_3 IS NOT NULL)::INT + (corner_4 IS NOT NULL)::INT, 0) / nullif(field_size, 0) AS late_ratio FROM prepared
)"""


@register("position_ratios", _sql(RUNNERS + _PAST + _RATIOS, f" SELECT race_id, post_position, {_r('early_ratio', 'late_ratio')} FROM ratios"))
def position_ratios(spark, d):
    return _out(history.position_ratios(_prepared(spark, d)), "early_ratio", "late_ratio")


@register("finish_percentile", _sql(RUNNERS + _PAST, f" SELECT race_id, post_position, is_winner, is_top3, distance_bucket, {_r('finish_percentile')} FROM prepared"))
def finish_percentile(spark, d):
    return _out(history.distance_bucket(_prepared(spark, d)), "is_winner", "is_top3", "distance_bucket", "finish_percentile")


def _recent_sql() -> str:
    source = {"finish": "finish_position", "win": "is_winner", "top3": "is_top3", "last_3f": "last_3f", "early": "early_ratio", "late": "late_ratio", "percentile": "finish_percentile"}
    days = ", ".join(f"avg({s}) AS {c}" for c, s in source.items())
    last = ", ".join(f"round(avg({c}) OVER w{w}, 9) AS recent_{c}_{w}" for w in (3, 5) for c in source)
    trend = ", ".join(f"round(avg({c}) OVER w3 - avg({c}) OVER w5, 9) AS recent_{c}_trend" for c in source)
    return _sql(
        RUNNERS + _PAST + _RATIOS,
        f""", days AS (SELECT horse_name, race_date, {days} FROM ratios GROUP BY 1, 2)
SELECT horse_name, race_date, {last}, round(min(last_3f) OVER w5, 9) AS recent_best_last_3f_5, {trend} FROM days
WINDOW w3 AS (PARTITION BY horse_name ORDER BY race_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
  w5 AS (PARTITION BY horse_name ORDER BY race_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
    )


@register("recent_form_3_5", _recent_sql())
def recent_form_3_5(spark, d):
    got = history.recent_form(history.position_ratios(_prepared(spark, d)))
    return _out(got, *got.columns[2:], keys=("horse_name", "race_date"))


@register(
    "race_relative",
    _sql(
        RUNNERS,
        """ SELECT race_id, post_position, field_size, round(CAST(post_position AS DOUBLE) / count(*) OVER w, 9) AS relative_post,
  round(carried_weight - avg(carried_weight) OVER w, 9) AS carried_weight_vs_field, round(horse_weight - avg(horse_weight) OVER w, 9) AS horse_weight_vs_field
FROM runners WINDOW w AS (PARTITION BY race_id)""",
    ),
)
def race_relative(spark, d):
    return _out(history.race_relative(runners(spark, d)), "field_size", "relative_post", "carried_weight_vs_field", "horse_weight_vs_field")


def _rank_share(c: str, n: str, table: str = "context") -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY race_id ORDER BY {c} DESC NULLS LAST) + (count({c}) OVER (PARTITION BY race_id, {c}) - 1) / 2.0e0) / {n} OVER (PARTITION BY race_id) END"


_SOURCES = ["horse_weight", "carried_weight", "last_3f", "form"]


@register(
    "field_interactions",
    _sql(
        SCORED + _CONTEXT,
        " SELECT race_id, post_position, "
        + ", ".join(
            f"round(avg({s}) OVER w, 9) AS {s}_field_mean, round({s} - avg({s}) OVER w, 9) AS {s}_vs_field, round(coalesce(stddev_samp({s}) OVER w, 0), 7) AS {s}_field_std, round({_rank_share(s, f'count({s})')}, 9) AS {s}_rank_share"
            for s in _SOURCES
        )
        + """, round(max(market_implied_probability) OVER w, 9) AS favourite_probability, round(coalesce(stddev_samp(market_implied_probability) OVER w, 0), 7) AS market_std,
  round(sum(CASE WHEN market_implied_probability > 0 THEN -market_implied_probability * ln(market_implied_probability) ELSE 0 END) OVER w, 9) AS market_entropy,
  round(sum(CASE WHEN market_probability_rank <= 3 THEN market_implied_probability ELSE 0 END) OVER w, 9) AS top3_share
FROM context WINDOW w AS (PARTITION BY race_id)""",
    ),
)
def field_interactions(spark, d):
    got = market.field_interactions(market.market_context(scored(spark, d)), _SOURCES)
    names = [f"{s}_{k}" for s in _SOURCES for k in ("field_mean", "vs_field", "rank_share")] + ["favourite_probability", "market_entropy", "top3_share"]
    std = [f"{s}_field_std" for s in _SOURCES] + ["market_std"]
    return _out(got, *names, *std).select(*KEYS, *names, *[F.round(c, 7).alias(c) for c in std])


@register(
    "intrusion_features",
    _sql(
        SCORED + _CONTEXT,
        f""" SELECT race_id, post_position, round({_rank_share('market_implied_probability', 'count(market_implied_probability)')}, 9) AS market_rank_share,
  round(market_implied_probability / max(CASE WHEN market_probability_rank = 1 THEN market_implied_probability END) OVER w, 9) AS p_over_favourite,
  round(market_implied_probability - avg(CASE WHEN market_probability_rank <= 3 THEN market_implied_probability END) OVER w, 9) AS p_vs_top3, """
        + ", ".join(
            f"round({s} - max(CASE WHEN market_probability_rank = 1 THEN {s} END) OVER w, 9) AS {s}_vs_favourite, round({s} - avg(CASE WHEN market_probability_rank <= 3 THEN {s} END) OVER w, 9) AS {s}_vs_top3"
            for s in ("form", "last_3f")
        )
        + " FROM context WINDOW w AS (PARTITION BY race_id)",
    ),
)
def intrusion_features(spark, d):
    got = market.intrusion_features(market.market_context(scored(spark, d)), ["form", "last_3f"])
    return _out(got, "market_rank_share", "p_over_favourite", "p_vs_top3", *[f"{s}_vs_{k}" for s in ("form", "last_3f") for k in ("favourite", "top3")])


@register(
    "residual_overlay",
    _sql(
        SCORED + _CONTEXT,
        f""" SELECT race_id, post_position, round(predicted_win_probability - avg(predicted_win_probability) OVER w, 9) AS baseline_vs_field,
  round({_rank_share('predicted_win_probability', 'count(*)')}, 9) AS baseline_rank_share,
  round(least(greatest(predicted_win_probability / nullif(market_implied_probability, 0), 0.0e0), 20.0e0), 9) AS baseline_over_market
FROM context WINDOW w AS (PARTITION BY race_id)""",
    ),
)
def residual_overlay(spark, d):
    return _out(market.residual_overlay(market.market_context(scored(spark, d)), "predicted_win_probability"), "baseline_vs_field", "baseline_rank_share", "baseline_over_market")


@register(
    "standardized_residual",
    _sql(
        SCORED,
        """, r AS (SELECT *, (is_winner - market_implied_probability) / sqrt(greatest(market_implied_probability * (1 - market_implied_probability), 1e-4)) AS z FROM scored),
s AS (SELECT *, ln(greatest(market_implied_probability, 1e-12)) + 4.0e0 * 0.05e0 * (form - 0.25e0) AS adj FROM r), t AS (SELECT *, exp(adj - max(adj) OVER (PARTITION BY race_id)) AS e FROM s)
SELECT race_id, post_position, round(z, 9) AS standard_residual, round(e / sum(e) OVER (PARTITION BY race_id), 9) AS adjusted_probability FROM t""",
    ),
)
def standardized_residual(spark, d):
    rows = scored(spark, d)
    m = F.col("market_implied_probability")
    rows = rows.withColumn("standard_residual", (F.col("is_winner") - m) / betting.residual_scale(m))
    rows = rows.withColumn("_adj", F.log(F.greatest(m, F.lit(1e-12))) + 4.0 * 0.05 * (F.col("form") - 0.25))
    return _out(market.softmax(rows, "_adj", "adjusted_probability"), "standard_residual", "adjusted_probability")


@register(
    "kelly_stakes",
    _sql(
        SCORED,
        """, k AS (SELECT *, CASE WHEN win_odds > 1 AND predicted_win_probability > 0 AND predicted_win_probability < 1
    THEN least(greatest((predicted_win_probability * win_odds - 1) / nullif(win_odds - 1, 0), 0.0e0), 1.0e0) ELSE 0.0e0 END AS kelly FROM scored),
s AS (SELECT *, CAST(floor(greatest(0.0e0, least(100000 * kelly * 0.25e0, 100000 * 0.05e0, 5000.0e0)) / 100) * 100 AS BIGINT) AS raw FROM k)
SELECT race_id, post_position, round(kelly, 9) AS kelly, CASE WHEN raw >= 100 THEN raw ELSE 0 END AS stake, round(1 / predicted_win_probability, 9) AS fair_odds,
  round(predicted_win_probability * win_odds, 9) AS expected_return, round(predicted_win_probability * win_odds - 1, 9) AS edge,
  CAST(CASE WHEN finish_position = 1 THEN round_even((CASE WHEN raw >= 100 THEN raw ELSE 0 END) * win_odds, 0) ELSE 0 END AS BIGINT) AS payout FROM s""",
    ),
)
def kelly_stakes(spark, d):
    p, odds = F.col("predicted_win_probability"), F.col("win_odds")
    rows = scored(spark, d).withColumns({"kelly": betting.kelly_fraction(p, odds), "stake": betting.rounded_stake(F.lit(100000.0), p, odds), "fair_odds": betting.fair_odds(p), "expected_return": betting.expected_return(p, odds), "edge": betting.edge(p, odds)})
    rows = rows.withColumn("payout", F.when(F.col("finish_position") == 1, betting.payout(F.col("stake"), odds)).otherwise(F.lit(0)))
    return _out(rows, "kelly", "stake", "fair_odds", "expected_return", "edge", "payout")
