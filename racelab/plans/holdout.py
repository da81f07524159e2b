"""Registered queries on parameters chosen on some years and judged on others, and on the whole of a
prediction set's diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racelab.operators import parameters
from racelab.sources.scratch import Scratch
from racelab.sources.tables import SCORED, scored

from .evaluation import _m, _p, _win
from .features import _sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


_GRID = ", ".join(f"('{f}', {v}e0)" for f in parameters.GRIDS for v in parameters.values(f))
_RAW = ", ".join(f"('{f}', {v}e0)" for f, v in parameters.RAW.items())
_LOSSES = SCORED + f""", g(family, v) AS (VALUES {_GRID}), raw(family, raw) AS (VALUES {_RAW}),
z AS (SELECT family, v, race_id, year(race_date) AS year, is_winner, CASE family WHEN 'temperature' THEN ln(greatest(least(predicted_win_probability, 1.0e0), 1e-12)) / v WHEN 'blend' THEN ln(greatest(v * predicted_win_probability + (1 - v) * market_implied_probability, 1e-12))
  ELSE ln(greatest(market_implied_probability, 1e-12)) + v * (predicted_win_probability - market_implied_probability) END AS s FROM scored, g),
e AS (SELECT *, exp(s - max(s) OVER w) / sum(exp(s)) OVER w * exp(max(s) OVER w) AS q FROM z WINDOW w AS (PARTITION BY family, v, race_id)),
r AS (SELECT family, v, race_id, year, count(*) AS n, max(is_winner) AS has, CASE WHEN max(is_winner) = 1 THEN -ln(greatest(sum(CASE WHEN is_winner = 1 THEN q ELSE 0 END), 1e-12)) ELSE 0 END AS loss, sum((q - is_winner) ** 2) AS brier FROM e GROUP BY 1, 2, 3, 4),
y AS (SELECT family, v AS parameter, year, CAST(sum(has) AS BIGINT) AS races, CAST(sum(n) AS BIGINT) AS runners, sum(loss) AS loss, sum(brier) AS brier FROM r GROUP BY 1, 2, 3)"""


def _losses(spark, d) -> DataFrame:
    rows = scored(spark, d).select("race_id", F.year("race_date").alias("year"), _p().alias("p"), _m().alias("m"), _win().alias("won"))
    return Scratch(spark, "parameters").save(parameters.losses(rows), "losses")


@register("holdout_parameters", _sql(_LOSSES, """, p AS (SELECT family, parameter, year <= 1999 AS learn, sum(races) AS races, round(sum(loss) / nullif(CAST(sum(races) AS DOUBLE), 0), 9) AS log_loss, round(sum(brier) / sum(runners), 9) AS brier FROM y GROUP BY 1, 2, 3),
c AS (SELECT family, parameter AS fitted FROM p WHERE learn AND NOT (family = 'temperature' AND parameter = 1) QUALIFY row_number() OVER (PARTITION BY family ORDER BY log_loss, parameter) = 1), b AS (SELECT * FROM p JOIN c USING (family) JOIN raw USING (family)),
o AS (SELECT family, fitted AS parameter, max(log_loss) FILTER (learn AND parameter = fitted) AS learn_log_loss, max(brier) FILTER (learn AND parameter = fitted) AS learn_brier, max(log_loss) FILTER (learn AND parameter = raw) AS learn_log_loss_raw, max(brier) FILTER (learn AND parameter = raw) AS learn_brier_raw,
  max(log_loss) FILTER (NOT learn AND parameter = fitted) AS judge_log_loss, max(brier) FILTER (NOT learn AND parameter = fitted) AS judge_brier, max(log_loss) FILTER (NOT learn AND parameter = raw) AS judge_log_loss_raw, max(brier) FILTER (NOT learn AND parameter = raw) AS judge_brier_raw,
  CAST(max(races) FILTER (NOT learn AND parameter = fitted) AS BIGINT) AS judge_races FROM b GROUP BY 1, 2)
SELECT *, coalesce(judge_log_loss < judge_log_loss_raw AND judge_brier < judge_brier_raw, false) AS beats_raw FROM o"""))
def holdout_parameters(spark, d):
    """Temperature, blend and residual scale, chosen on years up to 1999 and judged on later ones."""
    return parameters.held_out(_losses(spark, d), F.col("year") <= 1999)


@register("rolling_parameters", _sql(_LOSSES, """, c AS (SELECT family, parameter, year, round(loss / nullif(CAST(races AS DOUBLE), 0), 9) AS log_loss, sum(loss) OVER w AS l, sum(races) OVER w AS n, row_number() OVER (PARTITION BY family, parameter ORDER BY year) - 1 AS before FROM y WINDOW w AS (PARTITION BY family, parameter ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT * FROM c WHERE before >= 2 AND NOT (family = 'temperature' AND parameter = 1) QUALIFY row_number() OVER (PARTITION BY family, year ORDER BY round(l / nullif(CAST(n AS DOUBLE), 0), 9), parameter) = 1), s AS (SELECT family, parameter AS static_parameter FROM k WHERE before = 2)
SELECT k.family, CAST(k.year AS INTEGER) AS year, k.parameter, k.log_loss, s.static_parameter, a.log_loss AS static_log_loss, b.log_loss AS raw_log_loss FROM k JOIN s USING (family) JOIN raw USING (family) JOIN c a ON a.family = k.family AND a.year = k.year AND a.parameter = s.static_parameter JOIN c b ON b.family = k.family AND b.year = k.year AND b.parameter = raw.raw"""))
def rolling_parameters(spark, d):
    """Each year with the parameters that the years before it give, beside those of the first two years."""
    return parameters.rolling(_losses(spark, d))


_QUANTILES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)


@register("confidence_quantiles", _sql(SCORED, f""", c AS (SELECT race_id, year(race_date) AS year, arg_min(confidence, post_position) AS confidence, count(*) AS n FROM scored WHERE win_odds > 1 GROUP BY 1, 2)
SELECT CASE WHEN grouping(year) = 1 THEN 'all' ELSE CAST(year AS VARCHAR) END AS period, count(*) AS races, CAST(sum(n) AS BIGINT) AS rows, {", ".join(f"round(quantile_cont(confidence, {q}), 9) AS q{int(q * 100)}" for q in _QUANTILES)} FROM c GROUP BY GROUPING SETS ((), (year))"""))
def confidence_quantiles(spark, d):
    """Nine quantiles of the races' confidence, over all years and in each."""
    races = scored(spark, d).where("win_odds > 1").groupBy("race_id", F.year("race_date").alias("year")).agg(F.min_by("confidence", "post_position").alias("c"), F.count("*").alias("n"))
    got = races.rollup("year").agg(F.count("*").alias("races"), F.sum("n").alias("rows"), F.percentile("c", F.array(*[F.lit(q) for q in _QUANTILES])).alias("q"))
    return got.select(F.coalesce(F.col("year").cast("string"), F.lit("all")).alias("period"), "races", "rows", *[F.round(F.col("q")[i], 9).alias(f"q{int(q * 100)}") for i, q in enumerate(_QUANTILES)])
