"""Registered queries on paired evidence: role-aware triples, segments, bootstraps, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from racelab.functions.safe import clip
from racelab.operators import bootstrap, checks, combos, quality
from racelab.sources.tables import SCORED, scored

from .features import _sql
from .ledgers import _WEIGHT

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def _frame(spark, d) -> DataFrame:
    """Runners of fields of four and more with two top-three probabilities: the model's and the market's."""
    top3 = lambda c: clip(3 * F.col(c), 1e-6, 0.95)
    rows = scored(spark, d).where("field_size >= 4")
    return rows.withColumns({"q": top3("predicted_win_probability"), "b": top3("market_implied_probability"), "top3": (F.col("finish_position") <= 3).cast("int"), "rid": F.col("race_id").cast("long")})


_FRAME = SCORED + """, fr AS (SELECT *, CAST(race_id AS BIGINT) AS rid, least(greatest(3 * predicted_win_probability, 1e-6), 0.95e0) AS q, least(greatest(3 * market_implied_probability, 1e-6), 0.95e0) AS b,
  CASE WHEN finish_position <= 3 THEN 1 ELSE 0 END AS top3 FROM scored WHERE field_size >= 4)"""

# ------------------------------------------------------------ triples


def _role(name: str, q: str) -> str:
    """One race a row with the placed runners' strengths s and market shares w, then the closed forms."""
    order = lambda a, b, c: f"w{a} / w * s{b} / (s - s{a}) * s{c} / (s - s{a} - s{b})"
    orders = [order(*o) for o in ((1, 2, 3), (1, 3, 2), (2, 1, 3), (2, 3, 1), (3, 1, 2), (3, 2, 1))]
    place = ", ".join(f"max({q} / (1 - {q})) FILTER (finish_position = {k}) AS s{k}, max(greatest(market_implied_probability, 1e-12)) FILTER (finish_position = {k}) AS w{k}" for k in (1, 2, 3))
    once = " AND ".join(f"count(*) FILTER (finish_position = {k}) = 1" for k in (1, 2, 3))
    return f"""{name}0 AS (SELECT race_id, rid, {place}, sum({q} / (1 - {q})) AS s, sum(greatest(market_implied_probability, 1e-12)) AS w,
  max(CASE WHEN finish_position <= 3 AND win_odds >= 6 THEN 1 ELSE 0 END) AS longshot FROM fr GROUP BY 1, 2 HAVING {once}),
{name} AS (SELECT race_id, rid, longshot, {orders[0]} AS trifecta, least({' + '.join(orders)}, 1.0e0) AS trio, w1 / (w1 + w2 + w3) * w2 / (w2 + w3) AS order_in_set FROM {name}0)"""


_PAIR = _FRAME + ", " + _role("ch", "q") + ", " + _role("ba", "b") + """, pair AS (SELECT ch.race_id, ch.rid, ch.longshot, -ln(ch.trifecta) AS c3, -ln(ba.trifecta) AS b3, -ln(ch.trio) AS ct, -ln(ba.trio) AS bt FROM ch JOIN ba USING (race_id))"""


def _pair(spark, d) -> DataFrame:
    """Challenger's and baseline's evidence of a race side by side, joined one to one."""
    rows = _frame(spark, d)
    one, two = (combos.role_aware(rows, c, "market_implied_probability") for c in ("q", "b"))
    two = two.select("race_id", F.col("trifecta").alias("_t"), F.col("trio").alias("_s"))
    loss = lambda c, name: (-F.log(c)).alias(name)
    return one.join(two, "race_id").select("race_id", F.col("race_id").cast("long").alias("rid"), "longshot", loss("trifecta", "c3"), loss("_t", "b3"), loss("trio", "ct"), loss("_s", "bt"))


@register("role_aware_triples", _sql(_FRAME + ", " + _role("ch", "q"), " SELECT race_id, round(ln(trifecta), 6) AS log_trifecta, round(ln(trio), 6) AS log_trio, round(order_in_set, 9) AS order_in_set, CAST(longshot AS BIGINT) AS longshot FROM ch"))
def role_aware_triples(spark, d):
    """First place by the market, the others by top-three strengths; order inside the realised set."""
    got = combos.role_aware(_frame(spark, d), "q", "market_implied_probability")
    return got.select("race_id", F.round(F.log("trifecta"), 6).alias("log_trifecta"), F.round(F.log("trio"), 6).alias("log_trio"), F.round("order_in_set", 9).alias("order_in_set"), F.col("longshot").cast("long").alias("longshot"))


@register("triple_segments", _sql(_PAIR, """, seg AS (SELECT 'overall' AS segment, * FROM pair UNION ALL SELECT 'longshot', * FROM pair WHERE longshot = 1)
SELECT segment, count(*) AS races, round(avg(b3), 7) AS baseline_trifecta, round(avg(c3), 7) AS challenger_trifecta, round(avg(c3 - b3), 7) AS trifecta_delta, round(avg(bt), 7) AS baseline_trio, round(avg(ct), 7) AS challenger_trio, round(avg(ct - bt), 7) AS trio_delta, round(exp(-avg(c3)), 9) AS geometric_mean FROM seg GROUP BY 1"""))
def triple_segments(spark, d):
    """Baseline and challenger over all races and over those with a long shot among the three."""
    segments = F.explode(F.filter(F.array(F.lit("overall"), F.when(F.col("longshot") == 1, "longshot")), lambda x: x.isNotNull()))
    mean = lambda e, name, n=7: F.round(e, n).alias(name)
    c3, b3, ct, bt = (F.avg(c) for c in ("c3", "b3", "ct", "bt"))
    return _pair(spark, d).withColumn("segment", segments).groupBy("segment").agg(
        F.count("*").alias("races"), mean(b3, "baseline_trifecta"), mean(c3, "challenger_trifecta"), mean(F.avg(F.col("c3") - F.col("b3")), "trifecta_delta"),
        mean(bt, "baseline_trio"), mean(ct, "challenger_trio"), mean(F.avg(F.col("ct") - F.col("bt")), "trio_delta"), mean(F.exp(-c3), "geometric_mean", 9),
    )


@register("realised_evidence", _sql(_PAIR, " SELECT race_id, round(ct - bt, 6) AS trio_delta, ct < bt AS better FROM pair WHERE abs(ct - bt) > 1e-9"))
def realised_evidence(spark, d):
    """Race by race: whose set probability was larger."""
    delta = F.col("ct") - F.col("bt")
    return _pair(spark, d).where(F.abs(delta) > 1e-9).select("race_id", F.round(delta, 6).alias("trio_delta"), (delta < 0).alias("better"))


# ------------------------------------------------------------ bootstraps


def _intervals(source: str, number: str, ratios: dict[str, tuple[str, str | None]]) -> str:
    """The SQL of ``bootstrap.delta_intervals`` over the table ``source``."""
    sums = sorted({c for p in ratios.values() for c in p if c})
    drawn = ", ".join(f"sum({_WEIGHT} * {c}) AS {c}" for c in sums)
    plain = ", ".join(f"sum({c}) AS {c}" for c in sums)
    legs = " UNION ALL ".join(f"SELECT '{m}' AS metric, b, round({n} / nullif(CAST({k or 'weight'} AS DOUBLE), 0), 12) AS delta FROM reps" for m, (n, k) in ratios.items())
    return f""", src AS (SELECT {number} AS rid, * EXCLUDE ({number}) FROM {source}), reps AS (SELECT b, {drawn}, sum({_WEIGHT}) AS weight FROM src, range(0, 1000) t(b) GROUP BY 1
  UNION ALL SELECT -1, {plain}, count(*) FROM src), m AS ({legs})
SELECT metric, round(max(delta) FILTER (b < 0), 6) AS observed, round(quantile_cont(delta, 0.05) FILTER (b >= 0), 6) AS low, round(quantile_cont(delta, 0.95) FILTER (b >= 0), 6) AS high,
  round(avg(CASE WHEN delta < 0 THEN 1.0e0 ELSE 0 END) FILTER (b >= 0), 6) AS below_zero, count(delta) FILTER (b >= 0) AS replicates FROM m GROUP BY 1"""


def _rounded(got: DataFrame) -> DataFrame:
    return got.select("metric", *[F.round(c, 6).alias(c) for c in ("observed", "low", "high", "below_zero")], "replicates")


_LOSSES = """sum(-(top3 * ln(q) + (1 - top3) * ln(1 - q)) + (top3 * ln(b) + (1 - top3) * ln(1 - b))) AS loss, sum((q - top3) ** 2 - (b - top3) ** 2) AS brier, count(*) AS runners"""


def _losses():
    y, q, b = F.col("top3"), F.col("q"), F.col("b")
    nll = lambda p: -(y * F.log(p) + (1 - y) * F.log(1 - p))
    return [F.sum(nll(q) - nll(b)).alias("loss"), F.sum(F.pow(q - y, 2) - F.pow(b - y, 2)).alias("brier"), F.count("*").alias("runners")]


_BINARY = {"brier": ("brier", "runners"), "log_loss": ("loss", "runners")}
_JOINT = {"trifecta": ("d3", None), "trio": ("dt", None)}
_INTRUSION = {**_BINARY, "top_pick_hit": ("hit", None)}
_RANKING = {"mrr": ("mrr", None), "top1": ("top1", None)}


@register("binary_bootstrap", _sql(_FRAME, f", per AS (SELECT rid AS number, {_LOSSES} FROM fr GROUP BY 1)" + _intervals("per", "number", _BINARY)))
def binary_bootstrap(spark, d):
    """Top-three quality, challenger less baseline, over resampled races."""
    races = _frame(spark, d).groupBy("rid").agg(*_losses())
    return _rounded(bootstrap.delta_intervals(races, "rid", _BINARY))


@register("joint_bootstrap", _sql(_PAIR, ", per AS (SELECT rid AS number, c3 - b3 AS d3, ct - bt AS dt FROM pair)" + _intervals("per", "number", _JOINT)))
def joint_bootstrap(spark, d):
    """Loss of the realised order and of the realised set."""
    races = _pair(spark, d).select("rid", (F.col("c3") - F.col("b3")).alias("d3"), (F.col("ct") - F.col("bt")).alias("dt"))
    return _rounded(bootstrap.delta_intervals(races, "rid", _JOINT))


_LONG = _FRAME + """, lo AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY round(q, 9) DESC, post_position) AS kq, row_number() OVER (PARTITION BY rid ORDER BY round(b, 9) DESC, post_position) AS kb FROM fr WHERE win_odds >= 6)"""


def _longshots(spark, d) -> DataFrame:
    """Long shots with their ranks by both probabilities; the first post position among equals."""
    rank = lambda c: F.row_number().over(Window.partitionBy("rid").orderBy(F.desc(F.round(c, 9)), "post_position"))
    return _frame(spark, d).where("win_odds >= 6").withColumns({"kq": rank("q"), "kb": rank("b")})


@register("intrusion_bootstrap", _sql(_LONG, f", per AS (SELECT rid AS number, {_LOSSES}, sum(CASE WHEN kq = 1 THEN top3 ELSE 0 END) - sum(CASE WHEN kb = 1 THEN top3 ELSE 0 END) AS hit FROM lo GROUP BY 1)" + _intervals("per", "number", _INTRUSION)))
def intrusion_bootstrap(spark, d):
    """Long shots among the first three: losses, and hits of each side's top pick."""
    hit = lambda k: F.sum(F.when(F.col(k) == 1, F.col("top3")).otherwise(0))
    races = _longshots(spark, d).groupBy("rid").agg(*_losses(), (hit("kq") - hit("kb")).alias("hit"))
    return _rounded(bootstrap.delta_intervals(races, "rid", _INTRUSION))


@register("ranking_bootstrap", _sql(_LONG, """, per AS (SELECT rid AS number, sum(CASE WHEN kq = 1 THEN top3 ELSE 0 END) - sum(CASE WHEN kb = 1 THEN top3 ELSE 0 END) AS top1,
  coalesce(1.0e0 / min(CASE WHEN top3 = 1 THEN kq END), 0) - coalesce(1.0e0 / min(CASE WHEN top3 = 1 THEN kb END), 0) AS mrr FROM lo GROUP BY 1)""" + _intervals("per", "number", _RANKING)))
def ranking_bootstrap(spark, d):
    """How high the first long shot that was placed ranks: reciprocal rank and first rank."""
    hit = lambda k: F.sum(F.when(F.col(k) == 1, F.col("top3")).otherwise(0))
    first = lambda k: F.coalesce(1.0 / F.min(F.when(F.col("top3") == 1, F.col(k))), F.lit(0.0))
    races = _longshots(spark, d).groupBy("rid").agg((hit("kq") - hit("kb")).alias("top1"), (first("kq") - first("kb")).alias("mrr"))
    return _rounded(bootstrap.delta_intervals(races, "rid", _RANKING))


# ------------------------------------------------------------ diagnostics

_INF = float("inf")
#: The edges of the diagnostic bands.
BANDS = {
    "ev": ("predicted_win_probability * win_odds", [0.0, 0.8, 1.0, 1.05, 1.1, 1.15, 1.25, 1.5, 2.0, 3.0, _INF]),
    "odds": ("win_odds", [1.0, 2.0, 3.0, 5.0, 10.0, 20.0, 50.0, 100.0, _INF]),
    "confidence": ("confidence", [0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 1.000001]),
    "model_minus_market": ("predicted_win_probability - market_implied_probability", [-_INF, -0.1, -0.05, -0.02, 0.0, 0.02, 0.05, 0.1, _INF]),
}


def _edge(x: float) -> str:
    return "CAST('inf' AS DOUBLE)" if x == _INF else "CAST('-inf' AS DOUBLE)" if x == -_INF else f"{x!r}e0"


_BAND_ROWS = ", ".join(f"('{k}', {_edge(lo)}, {_edge(hi)})" for k, (_, e) in BANDS.items() for lo, hi in zip(e, e[1:]))
_BAND_CASE = "CASE report " + " ".join(f"WHEN '{k}' THEN {v}" for k, (v, _) in BANDS.items()) + " END"


@register("oos_diagnostics", _sql(SCORED, f""", e(report, lo, hi) AS (VALUES {_BAND_ROWS}), j AS (SELECT * FROM scored, e WHERE win_odds > 1 AND round({_BAND_CASE}, 9) >= lo AND round({_BAND_CASE}, 9) < hi)
SELECT report, greatest(lo, -9.0e0) AS band, count(*) AS rows, CAST(sum(is_winner) AS BIGINT) AS wins, round(sum(is_winner * win_odds) / count(*) - 1, 9) AS flat_roi, round(avg(predicted_win_probability), 9) AS mean_probability, round(avg(is_winner), 9) AS win_rate FROM j GROUP BY 1, 2"""))
def oos_diagnostics(spark, d):
    """All band reports of a prediction set in one pass: a row takes part in each report once."""
    rows = scored(spark, d).where("win_odds > 1 AND predicted_win_probability IS NOT NULL")
    parts = [F.struct(F.lit(k).alias("report"), quality.band(F.round(F.expr(v), 9), edges).alias("band")) for k, (v, edges) in BANDS.items()]
    rows = rows.withColumn("_e", F.explode(F.array(*parts))).select("*", "_e.report", "_e.band").where("band IS NOT NULL")
    each = rows.groupBy("report", "band").agg(*quality.flat_return(), F.avg("predicted_win_probability").alias("p"), F.avg("is_winner").alias("w"))
    return each.select("report", F.greatest("band", F.lit(-9.0)).alias("band"), "rows", "wins", F.round("flat_roi", 9).alias("flat_roi"), F.round("p", 9).alias("mean_probability"), F.round("w", 9).alias("win_rate"))


_REASONS = ["probability_below_threshold", "confidence_below_threshold", "ev_below_threshold", "eligible", "no_quote"]


@register("prediction_diagnostics", _sql(SCORED, f""", r AS (SELECT CASE WHEN predicted_win_probability < 0.05e0 THEN 'probability_below_threshold' WHEN confidence < 0.6e0 THEN 'confidence_below_threshold'
  WHEN round(predicted_win_probability * win_odds, 9) < 1.15e0 THEN 'ev_below_threshold' ELSE 'eligible' END AS reason FROM scored WHERE win_odds > 1 AND finish_position IS NOT NULL),
c AS (SELECT race_id, arg_min(confidence, post_position) AS confidence FROM scored WHERE win_odds > 1 GROUP BY 1)
SELECT 'reason' AS section, k AS key, CAST(count(reason) AS DOUBLE) AS value FROM (SELECT unnest({_REASONS!r}) AS k) LEFT JOIN r ON k = reason GROUP BY 2
UNION ALL SELECT 'confidence', '0.1', round(quantile_cont(confidence, 0.1), 9) FROM c
UNION ALL SELECT 'confidence', '0.5', round(quantile_cont(confidence, 0.5), 9) FROM c UNION ALL SELECT 'confidence', '0.9', round(quantile_cont(confidence, 0.9), 9) FROM c
UNION ALL SELECT 'size', 'rows', count(*) FROM scored WHERE win_odds > 1 UNION ALL SELECT 'size', 'races', count(*) FROM c
UNION ALL SELECT 'period', 'days', date_diff('day', min(race_date), max(race_date)) FROM scored WHERE win_odds > 1"""))
def prediction_diagnostics(spark, d):
    """Reasons with defaults, quantiles of the race's confidence, sizes and period, as (section, key, value)."""
    rows = scored(spark, d).where("win_odds > 1 AND finish_position IS NOT NULL")
    p = F.col("predicted_win_probability")
    reason = F.when(p < 0.05, _REASONS[0]).when(F.col("confidence") < 0.6, _REASONS[1]).when(F.round(p * F.col("win_odds"), 9) < 1.15, _REASONS[2]).otherwise(_REASONS[3])
    counts = checks.counts_with_defaults(rows.select(reason.alias("key")), "key", _REASONS).select(F.lit("reason").alias("section"), "key", F.col("rows").cast("double").alias("value"))
    races = rows.groupBy("race_id").agg(F.min_by("confidence", "post_position").alias("c"), F.count("*").alias("n"), F.min("race_date").alias("lo"), F.max("race_date").alias("hi"))
    one = races.agg(F.percentile("c", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"), F.sum("n").alias("rows"), F.count("*").alias("races"), F.datediff(F.max("hi"), F.min("lo")).alias("days"))
    item = lambda section, key, value: F.struct(F.lit(section).alias("section"), F.lit(key).alias("key"), value.cast("double").alias("value"))
    items = [item("confidence", k, F.round(F.col("q")[i], 9)) for i, k in enumerate(("0.1", "0.5", "0.9"))] + [item("size", "rows", F.col("rows")), item("size", "races", F.col("races")), item("period", "days", F.col("days"))]
    return counts.unionByName(one.select(F.explode(F.array(*items)).alias("i")).select("i.*"))
