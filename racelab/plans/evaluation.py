"""Registered evaluation queries: quality, bands, sweeps, rules, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from racelab.functions import betting
from racelab.operators import folds, market, quality
from racelab.sources.tables import SCORED, scored, table

from .features import _CERTAINTY, _CONTEXT, _out, _sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _p() -> Column:
    return F.col("predicted_win_probability")


def _m() -> Column:
    return F.col("market_implied_probability")


def _odds() -> Column:
    return F.col("win_odds")


def _win() -> Column:
    return F.col("is_winner")


def _value() -> Column:
    return _p() * _odds()


def grid(spark, **columns: list) -> DataFrame:
    """The product of a few short lists, as a table."""
    rows = [()]
    for values in columns.values():
        rows = [(*r, v) for r in rows for v in values]
    kind = lambda v: "string" if isinstance(v[0], str) else "double"
    return spark.createDataFrame(rows, ", ".join(f"{c} {kind(v)}" for c, v in columns.items()))


def values(name: str, column: str, items: list) -> str:
    text = ", ".join(f"'{i}'" if isinstance(i, str) else f"{i}e0" if "e" not in repr(i) else repr(i) for i in items)
    return f"{name} AS (SELECT unnest([{text}]) AS {column})"


_METRICS = """count(race_id) AS rows, count(DISTINCT race_id) AS races, CAST(coalesce(sum(is_winner), 0) AS BIGINT) AS wins, round(avg(is_winner), 9) AS hit_rate,
  round(avg(predicted_win_probability), 9) AS mean_probability, round(avg(market_implied_probability), 9) AS mean_market,
  round(avg(predicted_win_probability * win_odds), 9) AS mean_value, round(sum(is_winner * win_odds) / nullif(count(race_id), 0) - 1, 9) AS flat_roi"""
_NAMES = ("rows", "races", "wins", "hit_rate", "mean_probability", "mean_market", "mean_value", "flat_roi")

_EV = [1.0, 1.05, 1.1, 1.15, 1.2, 1.25, 1.3, 1.5, 1.75, 2.0, 3.0, 9.0]


@register("ev_threshold_sweep", _sql(SCORED, f", {values('g', 'threshold', _EV)} SELECT threshold, {_METRICS} FROM g LEFT JOIN scored ON predicted_win_probability * win_odds >= threshold GROUP BY threshold"))
def ev_threshold_sweep(spark, d):
    return _out(quality.sweep(scored(spark, d), grid(spark, threshold=_EV), _value() >= F.col("threshold"), ["threshold"]), *_NAMES, keys=("threshold",))


def _bands(name: str, value: str, edges: list[float], extra: str = "", rows=None) -> None:
    pairs = ", ".join(f"({lo!r}e0, {hi!r}e0)" for lo, hi in zip(edges, edges[1:]))
    sql = _sql(
        SCORED + extra,
        f""", b(lo, hi) AS (VALUES {pairs}) SELECT lo AS band, count(*) AS rows, CAST(sum(is_winner) AS BIGINT) AS wins, round(sum(is_winner * win_odds), 6) AS returned,
  round(sum(is_winner * win_odds) / count(*) - 1, 9) AS flat_roi, round(avg(predicted_win_probability), 9) AS mean_probability, round(avg(is_winner), 9) AS win_rate,
  round(avg(predicted_win_probability) - avg(is_winner), 9) AS calibration_error, round(avg(win_odds), 9) AS mean_odds, round(avg(predicted_win_probability * win_odds), 9) AS mean_value
FROM scored JOIN b ON {value} >= lo AND {value} < hi GROUP BY lo""",
    )

    @register(name, sql)
    def query(spark, d):
        got = quality.band_report(scored(spark, d), F.expr(value), edges)
        got = got.withColumn("returned", F.round("returned", 6))
        return _out(got, "rows", "wins", "returned", "flat_roi", "mean_probability", "win_rate", "calibration_error", "mean_odds", "mean_value", keys=("band",))


_bands("ev_bands", "predicted_win_probability * win_odds", [0.0, 0.5, 0.85, 1.0, 1.15, 1.25, 1.5, 2.0, 3.0, 99.0])
_bands("odds_bands", "win_odds", [1.0, 2.0, 4.0, 6.0, 10.0, 20.0, 30.0, 999.0])
_bands("confidence_bands", "confidence", [0.5, 0.6, 0.7, 0.8, 0.9, 1.01])
_bands("edge_bands", "predicted_win_probability - market_implied_probability", [-1.0, -0.1, -0.05, 0.0, 0.05, 0.1, 1.01])

_CLIP = "greatest(least({p}, 1 - 1e-12), 1e-12)"


def _loss(p: str) -> str:
    c = _CLIP.format(p=p)
    return f"round(avg(-(is_winner * ln({c}) + (1 - is_winner) * ln(1 - {c}))), 9)"


@register(
    "brier_logloss",
    _sql(
        SCORED,
        f""" SELECT count(*) AS rows, round(avg((predicted_win_probability - is_winner) ** 2), 9) AS brier, {_loss('predicted_win_probability')} AS log_loss,
  round(avg((market_implied_probability - is_winner) ** 2), 9) AS market_brier, {_loss('market_implied_probability')} AS market_log_loss FROM scored""",
    ),
)
def brier_logloss(spark, d):
    got = scored(spark, d).agg(F.count("*").alias("rows"), *[f(p, _win()).alias(f"{m}{n}") for m, p in (("", _p()), ("market_", _m())) for n, f in (("brier", quality.brier), ("log_loss", quality.log_loss))])
    return _out(got, "rows", "brier", "log_loss", "market_brier", "market_log_loss", keys=())


@register("winner_log_loss", _sql(SCORED, ", w AS (SELECT race_id, sum(predicted_win_probability) AS p FROM scored WHERE is_winner = 1 GROUP BY 1) SELECT round(avg(-ln(greatest(least(p, 1.0e0), 1e-12))), 9) AS winner_log_loss, count(*) AS races FROM w"))
def winner_log_loss(spark, d):
    return _out(quality.winner_log_loss(scored(spark, d), "predicted_win_probability"), "winner_log_loss", "races", keys=())


_T = [round(0.4 * (3.0 / 0.4) ** (i / 48), 6) for i in range(49)]


@register(
    "temperature_fit",
    _sql(
        SCORED,
        f""", {values('g', 't', _T)}, z AS (SELECT t, race_id, is_winner, ln(greatest(least(predicted_win_probability, 1.0e0), 1e-12)) / t AS z FROM scored, g),
s AS (SELECT t, race_id, sum(exp(z)) AS total, sum(CASE WHEN is_winner = 1 THEN exp(z) ELSE 0 END) AS won FROM z GROUP BY 1, 2),
l AS (SELECT t AS temperature, round(avg(-ln(greatest(won / total, 1e-12))), 9) AS winner_log_loss FROM s GROUP BY 1)
SELECT temperature, winner_log_loss FROM l ORDER BY winner_log_loss, temperature LIMIT 1""",
    ),
)
def temperature_fit(spark, d):
    """One pass: the grid joins the rows, then a partial sum for each (temperature, race)."""
    rows = scored(spark, d).select("race_id", "is_winner", F.log(F.greatest(F.least(_p(), F.lit(1.0)), F.lit(1e-12))).alias("log_p"))
    e = F.exp(F.col("log_p") / F.col("t"))
    races = rows.join(F.broadcast(grid(spark, t=_T))).groupBy("t", "race_id").agg(F.sum(e).alias("total"), F.sum(F.when(_win() == 1, e).otherwise(0.0)).alias("won"))
    fit = races.groupBy(F.col("t").alias("temperature")).agg(F.round(F.avg(-F.log(F.greatest(F.col("won") / F.col("total"), F.lit(1e-12)))), 9).alias("winner_log_loss"))
    return quality.best(fit, F.col("winner_log_loss"), F.col("temperature"))


_ALPHA = [round(0.05 * i, 2) for i in range(21)]


@register(
    "blend_alpha_fit",
    _sql(
        SCORED,
        f""", {values('g', 'alpha', _ALPHA)}, w AS (SELECT alpha, race_id, sum(alpha * predicted_win_probability + (1 - alpha) * market_implied_probability) AS p FROM scored, g WHERE is_winner = 1 GROUP BY 1, 2),
l AS (SELECT alpha, round(avg(-ln(greatest(least(p, 1.0e0), 1e-12))), 9) AS winner_log_loss FROM w GROUP BY 1) SELECT * FROM l ORDER BY winner_log_loss, alpha LIMIT 1""",
    ),
)
def blend_alpha_fit(spark, d):
    rows = scored(spark, d).join(F.broadcast(grid(spark, alpha=_ALPHA))).withColumn("blended", betting.blend(_p(), _m(), F.col("alpha")))
    fit = quality.winner_log_loss(rows, "blended", ("alpha",)).select("alpha", F.round("winner_log_loss", 9).alias("winner_log_loss"))
    return quality.best(fit, F.col("winner_log_loss"), F.col("alpha"))


_GAMMA = [0.0, 0.25, 0.5, 1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0]


@register(
    "residual_gamma_fit",
    _sql(
        SCORED,
        f""", {values('g', 'gamma', _GAMMA)}, z AS (SELECT gamma, race_id, is_winner, ln(greatest(market_implied_probability, 1e-12)) + gamma * (predicted_win_probability - market_implied_probability) AS z FROM scored, g),
s AS (SELECT gamma, race_id, sum(exp(z)) AS total, sum(CASE WHEN is_winner = 1 THEN exp(z) ELSE 0 END) AS won FROM z GROUP BY 1, 2),
l AS (SELECT gamma, round(avg(-ln(greatest(won / total, 1e-12))), 9) AS winner_log_loss FROM s GROUP BY 1) SELECT * FROM l ORDER BY winner_log_loss, gamma LIMIT 1""",
    ),
)
def residual_gamma_fit(spark, d):
    rows = scored(spark, d).select("race_id", "is_winner", F.log(F.greatest(_m(), F.lit(1e-12))).alias("m"), (_p() - _m()).alias("r"))
    e = F.exp(F.col("m") + F.col("gamma") * F.col("r"))
    races = rows.join(F.broadcast(grid(spark, gamma=_GAMMA))).groupBy("gamma", "race_id").agg(F.sum(e).alias("total"), F.sum(F.when(_win() == 1, e).otherwise(0.0)).alias("won"))
    fit = races.groupBy("gamma").agg(F.round(F.avg(-F.log(F.greatest(F.col("won") / F.col("total"), F.lit(1e-12)))), 9).alias("winner_log_loss"))
    return quality.best(fit, F.col("winner_log_loss"), F.col("gamma"))


_REASON = """CASE WHEN predicted_win_probability < 0.1e0 THEN 'probability_below_minimum' WHEN confidence < 0.6e0 THEN 'confidence_below_minimum'
  WHEN predicted_win_probability * win_odds < 1.15e0 THEN 'expected_value_below_minimum' ELSE 'eligible' END"""


@register("selection_reasons", _sql(SCORED, f", r AS (SELECT {_REASON} AS reason FROM scored), n AS (SELECT unnest(['eligible', 'probability_below_minimum', 'confidence_below_minimum', 'expected_value_below_minimum', 'no_quote']) AS reason) SELECT n.reason, count(r.reason) AS rows FROM n LEFT JOIN r ON r.reason = n.reason GROUP BY 1"))
def selection_reasons(spark, d):
    names = grid(spark, reason=["eligible", "probability_below_minimum", "confidence_below_minimum", "expected_value_below_minimum", "no_quote"])
    got = scored(spark, d).groupBy(betting.decision_reason(_p(), F.col("confidence"), _value(), 0.1, 0.6, 1.15).alias("reason")).agg(F.count("*").alias("rows"))
    return names.join(got, "reason", "left").select("reason", F.coalesce("rows", F.lit(0)).alias("rows"))


def _top1_sql(order: str) -> str:
    return f", ranked AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY {order}, post_position) AS rn FROM scored), picked AS (SELECT * FROM ranked WHERE rn = 1)"


for _name, _order, _cols in (
    ("policy_top1_ev", "round(predicted_win_probability * win_odds, 9) DESC", lambda: F.desc(F.round(_value(), 9))),
    ("policy_top1_prob", "round(predicted_win_probability, 9) DESC", lambda: F.desc(F.round(_p(), 9))),
    ("policy_top1_edge", "round(predicted_win_probability - market_implied_probability, 9) DESC", lambda: F.desc(F.round(_p() - _m(), 9))),
):

    def _policy(cols):
        return lambda spark, d: _out(market.top1(scored(spark, d), cols()), "is_winner", "win_odds")

    register(_name, _sql(SCORED + _top1_sql(_order), " SELECT race_id, post_position, is_winner, round(win_odds, 9) AS win_odds FROM picked"))(_policy(_cols))

_THR = [1.0, 1.1, 1.2, 1.35, 1.5]


@register(
    "policy_sweep",
    _sql(
        SCORED,
        f""", {values('g', 'threshold', _THR)}, ranked AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY round(predicted_win_probability * win_odds, 9) DESC, post_position) AS by_value,
  row_number() OVER (PARTITION BY race_id ORDER BY round(predicted_win_probability, 9) DESC, post_position) AS by_probability FROM scored),
c AS (SELECT 'all' AS policy, * FROM ranked UNION ALL SELECT 'top_value', * FROM ranked WHERE by_value = 1 UNION ALL SELECT 'top_probability', * FROM ranked WHERE by_probability = 1),
p AS (SELECT unnest(['all', 'top_value', 'top_probability']) AS policy)
SELECT p.policy, threshold, {_METRICS} FROM p CROSS JOIN g LEFT JOIN c ON c.policy = p.policy AND predicted_win_probability * win_odds >= threshold GROUP BY 1, 2""",
    ),
)
def policy_sweep(spark, d):
    rank = lambda c: F.row_number().over(market.race().orderBy(F.desc(F.round(c, 9)), "post_position"))
    rows = scored(spark, d).withColumns({"by_value": rank(_value()), "by_probability": rank(_p())})
    keep = (F.col("policy") == "all") | ((F.col("policy") == "top_value") & (F.col("by_value") == 1)) | ((F.col("policy") == "top_probability") & (F.col("by_probability") == 1))
    got = quality.sweep(rows, grid(spark, policy=["all", "top_value", "top_probability"], threshold=_THR), keep & (_value() >= F.col("threshold")), ["policy", "threshold"])
    return _out(got, *_NAMES, keys=("policy", "threshold"))


def _sweep_query(name: str, column: str, expr: str, thresholds: list[float], where: str = "TRUE", pre=None, ctes: str = "") -> None:
    sql = _sql(SCORED + ctes, f", {values('g', column, thresholds)}, pool AS (SELECT * FROM {'certain' if ctes else 'scored'} WHERE {where}) SELECT {column}, {_METRICS} FROM g LEFT JOIN pool ON {expr} >= {column} GROUP BY 1")

    @register(name, sql)
    def query(spark, d):
        rows = scored(spark, d)
        rows = (pre(rows) if pre else rows).where(F.expr(where.replace("::DOUBLE", "")))
        return _out(quality.sweep(rows, grid(spark, **{column: thresholds}), F.expr(expr) >= F.col(column), [column]), *_NAMES, keys=(column,))


_CONF = [round(0.5 + 0.05 * i, 2) for i in range(10)]
_sweep_query("confidence_sweep", "least_confidence", "confidence", _CONF, "predicted_win_probability * win_odds >= 1.15")
_sweep_query("certainty_sweep", "least_certainty", "round(certainty, 9)", [0.0, 0.05, 0.1, 0.2, 0.4], pre=lambda r: market.race_certainty(r, "predicted_win_probability", "certainty"), ctes=_CERTAINTY)
_sweep_query("overlay_sweep", "least_overlay", "round(predicted_win_probability / greatest(market_implied_probability, 1e-12) - 1, 9)", [0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0])
_sweep_query("market_edge_sweep", "least_edge", "round(predicted_win_probability - market_implied_probability, 9)", [0.0, 0.01, 0.02, 0.05, 0.1, 0.2])
_sweep_query("longshot_sweep", "threshold", "predicted_win_probability * win_odds", _EV, "win_odds >= 6.0")
_sweep_query("direct_value_rule", "least_return", "predicted_win_probability * win_odds - 1", [0.0], "win_odds > 1")

_PERIODS = [("early", "1995-01-01", "1997-12-31"), ("middle", "1998-01-01", "1999-12-31"), ("late", "2000-01-01", "2001-12-31")]


@register(
    "confidence_sweep_by_period",
    _sql(
        SCORED,
        f""", {values('g', 'least_confidence', _CONF)}, p(period, lo, hi) AS (VALUES {', '.join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in _PERIODS)})
SELECT period, least_confidence, {_METRICS} FROM g CROSS JOIN p LEFT JOIN scored ON confidence >= least_confidence AND race_date BETWEEN lo AND hi AND predicted_win_probability * win_odds >= 1.15e0 GROUP BY 1, 2""",
    ),
)
def confidence_sweep_by_period(spark, d):
    periods = spark.createDataFrame(_PERIODS, "period string, lo string, hi string").select("period", F.col("lo").cast("date").alias("lo"), F.col("hi").cast("date").alias("hi"))
    both = grid(spark, least_confidence=_CONF).crossJoin(periods)
    keep = (F.col("confidence") >= F.col("least_confidence")) & F.col("race_date").between(F.col("lo"), F.col("hi")) & (_value() >= 1.15)
    return _out(quality.sweep(scored(spark, d), both, keep, ["period", "least_confidence"]), *_NAMES, keys=("period", "least_confidence"))


_SEGMENTS = [("short", 1.0, 4.0), ("mid", 4.0, 10.0), ("long", 10.0, 20.0), ("extreme", 20.0, 1e9)]


@register(
    "odds_segment_sweep",
    _sql(
        SCORED,
        f""", {values('g', 'threshold', _THR)}, p(segment, lo, hi) AS (VALUES {', '.join(f"('{n}', {a!r}e0, {b!r})" if 'e' in repr(b) else f"('{n}', {a!r}e0, {b!r}e0)" for n, a, b in _SEGMENTS)})
SELECT segment, threshold, {_METRICS} FROM g CROSS JOIN p LEFT JOIN scored ON win_odds >= lo AND win_odds < hi AND predicted_win_probability * win_odds >= threshold GROUP BY 1, 2""",
    ),
)
def odds_segment_sweep(spark, d):
    segments = spark.createDataFrame(_SEGMENTS, "segment string, lo double, hi double")
    both = grid(spark, threshold=_THR).crossJoin(segments)
    keep = (_odds() >= F.col("lo")) & (_odds() < F.col("hi")) & (_value() >= F.col("threshold"))
    return _out(quality.sweep(scored(spark, d), both, keep, ["segment", "threshold"]), *_NAMES, keys=("segment", "threshold"))


_SPLIT = "1998-06-01"


@register(
    "stable_longshot_sweep",
    _sql(
        SCORED,
        f""", {values('g', 'threshold', _EV)}, l AS (SELECT threshold, count(*) FILTER (race_date < DATE '{_SPLIT}') AS early_rows, count(*) FILTER (race_date >= DATE '{_SPLIT}') AS late_rows,
  round(sum(is_winner * win_odds) FILTER (race_date < DATE '{_SPLIT}') / nullif(count(*) FILTER (race_date < DATE '{_SPLIT}'), 0) - 1, 9) AS early_roi,
  round(sum(is_winner * win_odds) FILTER (race_date >= DATE '{_SPLIT}') / nullif(count(*) FILTER (race_date >= DATE '{_SPLIT}'), 0) - 1, 9) AS late_roi
  FROM g JOIN scored ON predicted_win_probability * win_odds >= threshold AND win_odds >= 6 GROUP BY 1)
SELECT *, coalesce(early_rows >= 20 AND late_rows >= 20 AND early_roi > 0 AND late_roi > 0, FALSE) AS stable FROM l""",
    ),
)
def stable_longshot_sweep(spark, d):
    early = F.col("race_date") < F.lit(_SPLIT).cast("date")
    rows = scored(spark, d).where(_odds() >= 6).join(F.broadcast(grid(spark, threshold=_EV)), _value() >= F.col("threshold"))
    back = F.when(_win() == 1, _odds()).otherwise(0.0)
    aggs = []
    for name, when in (("early", early), ("late", ~early)):
        n = F.count_if(when)
        aggs += [n.alias(f"{name}_rows"), F.round(F.sum(F.when(when, back)) / F.nullif(n.cast("double"), F.lit(0.0)) - 1, 9).alias(f"{name}_roi")]
    got = rows.groupBy("threshold").agg(*aggs)
    stable = (F.col("early_rows") >= 20) & (F.col("late_rows") >= 20) & (F.col("early_roi") > 0) & (F.col("late_roi") > 0)
    return got.withColumn("stable", F.coalesce(stable, F.lit(False)))


_RULE = f"""l AS (SELECT threshold, count(*) AS rows, count(DISTINCT race_id) AS races, round(sum(is_winner * win_odds) / count(*) - 1, 9) AS flat_roi
  FROM g JOIN scored ON predicted_win_probability * win_odds >= threshold GROUP BY 1)"""


def _rule_rows(spark, d) -> DataFrame:
    got = quality.sweep(scored(spark, d), grid(spark, threshold=_EV), _value() >= F.col("threshold"), ["threshold"], keep_empty=False)
    return got.select("threshold", "rows", "races", F.round("flat_roi", 9).alias("flat_roi"))


@register("ev_rule_fit", _sql(SCORED, f", {values('g', 'threshold', _EV)}, {_RULE} SELECT * FROM l WHERE rows >= 100 AND races >= 50 ORDER BY flat_roi DESC, rows DESC, threshold LIMIT 1"))
def ev_rule_fit(spark, d):
    return quality.best(_rule_rows(spark, d).where("rows >= 100 AND races >= 50"), F.desc("flat_roi"), F.desc("rows"), F.col("threshold"))


@register("broad_rule", _sql(SCORED, f", {values('g', 'threshold', _EV)}, {_RULE} SELECT * FROM l WHERE flat_roi > 0 ORDER BY races DESC, rows DESC, threshold LIMIT 1"))
def broad_rule(spark, d):
    return quality.best(_rule_rows(spark, d).where("flat_roi > 0"), F.desc("races"), F.desc("rows"), F.col("threshold"))


_FOLDS = """, days AS (SELECT race_date, row_number() OVER (ORDER BY race_date) - 1 AS day FROM (SELECT DISTINCT race_date FROM runners)),
n AS (SELECT max(day) + 1 AS n FROM days), folds AS (
  SELECT k AS fold, 600 + k * 210 AS train_days, 600 + k * 210 + 10 AS test_start, least(600 + k * 210 + 210, n) AS test_end FROM n, range(0, 1000) t(k) WHERE 600 + k * 210 + 10 < n
)"""


def _folds(spark, d):
    """(scored runners, days, folds). Days and folds are bounded by the calendar: they are read once, from the
    races alone, and are local tables from then on."""
    starts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    races = table(spark, d, "orders").join(starts, "o_orderkey", "left_semi").select(F.col("o_orderdate").cast("date").alias("race_date"))
    days = spark.createDataFrame(folds.day_numbers(races).collect(), "race_date date, day long")
    plan = folds.walk_forward(days, 600, 200, 10)
    return scored(spark, d), days, spark.createDataFrame(plan.collect(), plan.schema)


@register(
    "walk_forward_folds",
    _sql(
        SCORED + _FOLDS,
        """ SELECT fold, train_days, test_start, test_end, a.race_date AS train_end_date, b.race_date AS test_start_date, c.race_date AS test_end_date
FROM folds JOIN days a ON a.day = train_days - 1 JOIN days b ON b.day = test_start JOIN days c ON c.day = test_end - 1""",
    ),
)
def walk_forward_folds(spark, d):
    return _folds(spark, d)[2]


@register(
    "fold_quality",
    _sql(SCORED + _FOLDS, f" SELECT fold, count(*) AS rows, round(avg((predicted_win_probability - is_winner) ** 2), 9) AS brier, {_loss('predicted_win_probability')} AS log_loss FROM scored JOIN days USING (race_date) JOIN folds ON day >= test_start AND day < test_end GROUP BY 1"),
)
def fold_quality(spark, d):
    rows, days, f = _folds(spark, d)
    got = folds.attach_folds(rows, days, f).groupBy("fold").agg(F.count("*").alias("rows"), quality.brier(_p(), _win()).alias("brier"), quality.log_loss(_p(), _win()).alias("log_loss"))
    return _out(got, "rows", "brier", "log_loss", keys=("fold",))


@register("annual_oof_folds", _sql(SCORED, ", y AS (SELECT DISTINCT year(race_date) AS y FROM scored) SELECT y AS year, count(*) FILTER (year(race_date) < y) AS train_rows, count(*) FILTER (year(race_date) = y) AS validation_rows FROM scored, y GROUP BY 1"))
def annual_oof_folds(spark, d):
    """Training rows are those of earlier years: a running sum over a handful of years."""
    from pyspark.sql import Window

    years = scored(spark, d).groupBy(F.year("race_date").cast("long").alias("year")).agg(F.count("*").alias("validation_rows"))
    before = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    return years.select("year", F.coalesce(F.sum("validation_rows").over(before), F.lit(0)).alias("train_rows"), "validation_rows")


@register("calibration_split", _sql(SCORED + ", d AS (SELECT race_date, dense_rank() OVER (ORDER BY race_date DESC) AS back FROM (SELECT DISTINCT race_date FROM scored))", " SELECT CASE WHEN back <= 60 THEN 'calibration' ELSE 'fit' END AS part, count(*) AS rows, min(race_date) AS first_date, max(race_date) AS last_date FROM scored JOIN d USING (race_date) GROUP BY 1"))
def calibration_split(spark, d):
    from pyspark.sql import Window

    rows = scored(spark, d)
    days = rows.select("race_date").distinct().withColumn("back", F.dense_rank().over(Window.orderBy(F.desc("race_date"))))
    return rows.join(F.broadcast(days), "race_date").groupBy(F.when(F.col("back") <= 60, "calibration").otherwise("fit").alias("part")).agg(F.count("*").alias("rows"), F.min("race_date").alias("first_date"), F.max("race_date").alias("last_date"))


_FORWARD = (
    SCORED
    + _FOLDS
    + f""", {values('g', 'threshold', _THR)}, tested AS (SELECT * FROM scored JOIN days USING (race_date) JOIN folds ON day >= test_start AND day < test_end),
pf AS (SELECT f.fold, threshold, count(race_id) AS rows, coalesce(sum(is_winner * win_odds), 0) AS returned FROM folds f CROSS JOIN g LEFT JOIN tested t ON t.fold = f.fold AND predicted_win_probability * win_odds >= threshold GROUP BY 1, 2),
seen AS (SELECT *, coalesce(sum(rows) OVER w, 0) AS prior_rows, round(sum(returned) OVER w / nullif(sum(rows) OVER w, 0) - 1, 9) AS prior_roi FROM pf WINDOW w AS (PARTITION BY threshold ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ok AS (SELECT *, coalesce(prior_rows >= 50 AND prior_roi > 1e-12, FALSE) AS good FROM seen),
pick AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY CASE WHEN good THEN 0 ELSE 1 END, CASE WHEN good THEN -prior_roi END, threshold) AS rn FROM ok),
chosen AS (SELECT fold, CASE WHEN good THEN threshold END AS threshold, CASE WHEN good THEN prior_roi END AS prior_roi, CASE WHEN good THEN rows ELSE 0 END AS bets, CASE WHEN good THEN returned ELSE 0 END AS returned FROM pick WHERE rn = 1)"""
)


def _chosen(spark, d):
    rows, days, f = _folds(spark, d)
    g = grid(spark, threshold=_THR)
    hit = folds.attach_folds(rows, days, f).join(F.broadcast(g), _value() >= F.col("threshold"))
    got = hit.groupBy("fold", "threshold").agg(F.count("*").alias("rows"), F.sum(F.when(_win() == 1, _odds()).otherwise(0.0)).alias("returned"))
    full = f.select("fold").crossJoin(g).join(got, ["fold", "threshold"], "left").select("fold", "threshold", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("returned", F.lit(0.0)).alias("returned"))
    return folds.forward_selection(full, 50)


@register("forward_ev_selection", _sql(_FORWARD, " SELECT fold, threshold, prior_roi, CAST(bets AS BIGINT) AS bets, round(returned, 6) AS returned FROM chosen"))
def forward_ev_selection(spark, d):
    return _chosen(spark, d).withColumn("returned", F.round("returned", 6))


@register("forward_selection_summary", _sql(_FORWARD, " SELECT count(*) AS folds, CAST(count(threshold) AS BIGINT) AS active_folds, CAST(sum(bets) AS BIGINT) AS bets, round(sum(returned) / nullif(sum(bets), 0) - 1, 9) AS roi, round(1 - count(threshold) / CAST(count(*) AS DOUBLE), 9) AS abstain_rate FROM chosen"))
def forward_selection_summary(spark, d):
    got = _chosen(spark, d).agg(F.count("*").alias("folds"), F.count("threshold").alias("active_folds"), F.sum("bets").alias("bets"), (F.sum("returned") / F.nullif(F.sum("bets").cast("double"), F.lit(0.0)) - 1).alias("roi"), (1 - F.count("threshold") / F.count("*")).alias("abstain_rate"))
    return _out(got, "folds", "active_folds", "bets", "roi", "abstain_rate", keys=())


@register(
    "promotion_gate",
    _sql(
        SCORED,
        f""", q AS (SELECT round(avg((predicted_win_probability - is_winner) ** 2), 9) AS brier, {_loss('predicted_win_probability')} AS log_loss, round(avg((market_implied_probability - is_winner) ** 2), 9) AS market_brier, {_loss('market_implied_probability')} AS market_log_loss FROM scored)
SELECT *, brier < market_brier AND log_loss < market_log_loss AS promoted, concat_ws(',', CASE WHEN brier >= market_brier THEN 'brier_not_better' END, CASE WHEN log_loss >= market_log_loss THEN 'log_loss_not_better' END) AS reasons FROM q""",
    ),
)
def promotion_gate(spark, d):
    got = brier_logloss(spark, d).drop("rows")
    worse = lambda c, r: F.when(F.col(c) >= F.col(f"market_{c}"), r)
    return got.withColumns({"promoted": (F.col("brier") < F.col("market_brier")) & (F.col("log_loss") < F.col("market_log_loss")), "reasons": F.concat_ws(",", worse("brier", "brier_not_better"), worse("log_loss", "log_loss_not_better"))})


@register(
    "ranking_quality",
    _sql(
        SCORED + _CONTEXT,
        """, r AS (SELECT race_id, is_winner, market_probability_rank AS m, row_number() OVER (PARTITION BY race_id ORDER BY round(predicted_win_probability, 9) DESC, post_position) AS p FROM context),
w AS (SELECT race_id, min(CASE WHEN is_winner = 1 THEN m END) AS m, min(CASE WHEN is_winner = 1 THEN p END) AS p FROM r GROUP BY 1)
SELECT count(*) AS races, round(avg(coalesce(1.0e0 / p, 0)), 9) AS mrr, round(avg(CASE WHEN p = 1 THEN 1.0e0 ELSE 0 END), 9) AS top1, round(avg(coalesce(1.0e0 / m, 0)), 9) AS market_mrr, round(avg(CASE WHEN m = 1 THEN 1.0e0 ELSE 0 END), 9) AS market_top1 FROM w""",
    ),
)
def ranking_quality(spark, d):
    rows = market.market_context(scored(spark, d)).withColumn("p", F.row_number().over(market.race().orderBy(F.desc(F.round(_p(), 9)), "post_position")))
    first = lambda c: F.min(F.when(_win() == 1, F.col(c)))
    races = rows.groupBy("race_id").agg(first("market_probability_rank").alias("m"), first("p").alias("p"))
    aggs = [F.count("*").alias("races")]
    for c, name in (("p", ""), ("m", "market_")):
        aggs += [F.avg(F.coalesce(1.0 / F.col(c), F.lit(0.0))).alias(f"{name}mrr"), F.avg(F.when(F.col(c) == 1, 1.0).otherwise(0.0)).alias(f"{name}top1")]
    return _out(races.agg(*aggs), "races", "mrr", "top1", "market_mrr", "market_top1", keys=())
