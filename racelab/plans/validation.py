"""Registered queries on keys, codes, validation and key sets, each with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from racelab.functions import betting
from racelab.operators import checks
from racelab.sources.tables import RUNNERS, SCORED, runners, scored, table

from .features import _sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


@register("horse_ids", _sql(RUNNERS, """, k AS (SELECT *, race_id || '-' || CASE WHEN age > 3 THEN post_position ELSE row_number() OVER (PARTITION BY race_id ORDER BY finish_position) END AS horse_id FROM runners)
SELECT race_id, horse_name, finish_position, horse_id, CAST(split_part(horse_id, '-', 2) AS BIGINT) AS post FROM k"""))
def horse_ids(spark, d):
    """Identifiers, with a fallback where the post position is hidden, and back again."""
    rows = runners(spark, d).withColumn("n", F.col("finish_position").cast("long"))
    rows = rows.withColumn("horse_id", checks.horse_id(F.col("race_id"), F.when(F.col("age") > 3, F.col("post_position")), F.col("n")))
    return rows.select("race_id", "horse_name", "finish_position", "horse_id", checks.post_of(F.col("horse_id"), F.col("race_id")).alias("post"))


@register("code_maps", """SELECT CASE WHEN p_partkey % 70 BETWEEN 10 AND 22 THEN 'TURF' WHEN p_partkey % 70 BETWEEN 23 AND 29 THEN 'DIRT' WHEN p_partkey % 70 BETWEEN 51 AND 59 THEN 'JUMP' ELSE 'UNKNOWN' END AS surface,
  coalesce(CASE WHEN p_size % 3 = 0 THEN lpad(CAST(p_size AS VARCHAR), 3, '0') END, CASE WHEN p_size % 2 = 0 THEN 'A' || p_size END) AS class_code,
  CASE WHEN p_size <> 9 THEN CASE WHEN p_partkey % 2 = 0 THEN -p_size ELSE p_size END END AS delta, CASE WHEN p_size NOT IN (10, 11) THEN p_size END AS weight, count(*) AS parts FROM part GROUP BY 1, 2, 3, 4""")
def code_maps(spark, d):
    """Track codes, class slots, signed deltas and weight sentinels."""
    size = F.col("p_size").cast("long")
    text = size.cast("string")
    slots = [F.when(size % 3 == 0, F.lpad(text, 3, "0")).otherwise(" "), F.lit("000"), F.when(size % 2 == 0, F.concat(F.lit("A"), text))]
    delta = checks.signed_delta(F.when(F.col("p_partkey") % 2 == 0, "-").otherwise("+"), F.when(size == 9, 999).otherwise(size))
    weight = checks.weight_of(F.when(size == 10, 0).when(size == 11, 999).otherwise(size))
    p = table(spark, d, "part")
    return p.groupBy(checks.surface_of(F.col("p_partkey") % 70).alias("surface"), checks.first_code(*slots).alias("class_code"), delta.alias("delta"), weight.alias("weight")).agg(F.count("*").alias("parts"))


@register("completed_rows", _sql(RUNNERS, """, f AS (SELECT *, count(*) OVER (PARTITION BY race_id) AS n FROM runners WHERE win_odds > 3 AND race_date <= DATE '2000-06-01')
SELECT race_id, n AS runners, round(sum(win_odds), 9) AS odds FROM f WHERE n >= 3 GROUP BY 1, 2"""))
def completed_rows(spark, d):
    rows = runners(spark, d).withColumn("win_odds", F.when(F.col("win_odds") > 3, F.col("win_odds")))
    return checks.completed(rows, "2000-06-01").groupBy("race_id", "runners").agg(F.round(F.sum("win_odds"), 9).alias("odds"))


@register("safe_races", _sql(RUNNERS, """, s AS (SELECT race_id, CASE WHEN age > 2 THEN post_position % 6 END AS post FROM runners WHERE surface <> 'A')
SELECT race_id, count(*) AS starters FROM s GROUP BY 1 HAVING count(*) >= 2 AND count(post) = count(*) AND count(DISTINCT post) = count(*)"""))
def safe_races(spark, d):
    """Starters are the runners that are not scratched; hidden or shared posts make a race unsafe."""
    starters = runners(spark, d).where("surface <> 'A'").withColumn("post", F.when(F.col("age") > 2, F.col("post_position") % 6))
    return checks.safe_races(starters, "post")


@register("paired_evidence", _sql(SCORED, """, e AS (SELECT race_id, sum(is_winner * -ln(greatest(predicted_win_probability, 1e-12))) AS a FROM scored WHERE field_size >= 3 GROUP BY 1),
b AS (SELECT race_id, sum(is_winner * -ln(greatest(market_implied_probability, 1e-12))) AS b FROM scored WHERE race_class <> '5-LOW' GROUP BY 1)
SELECT race_id, round(a, 9) AS loss_challenger, round(b, 9) AS loss_baseline, round(b - a, 9) AS gain FROM e JOIN b USING (race_id)"""))
def paired_evidence(spark, d):
    """Challenger and baseline evidence, one row a race each, joined one to one."""
    rows = scored(spark, d)
    loss = lambda p: F.round(F.sum(F.col("is_winner") * -F.log(F.greatest(F.col(p), F.lit(1e-12)))), 12)
    one = rows.where("field_size >= 3").groupBy("race_id").agg(loss("predicted_win_probability").alias("a"))
    two = rows.where("race_class <> '5-LOW'").groupBy("race_id").agg(loss("market_implied_probability").alias("b"))
    return one.join(two, "race_id").select("race_id", F.round("a", 9).alias("loss_challenger"), F.round("b", 9).alias("loss_baseline"), F.round(F.col("b") - F.col("a"), 9).alias("gain"))


@register("reason_counts", _sql(SCORED, """, r AS (SELECT CASE WHEN win_odds <= 2 THEN 'short_odds' WHEN predicted_win_probability * win_odds < 1 THEN 'no_edge' WHEN field_size < 2 THEN 'small_field' ELSE 'selected' END AS reason FROM scored),
k AS (SELECT unnest(['short_odds', 'no_edge', 'small_field', 'selected', 'no_market', 'budget']) AS reason)
SELECT k.reason, count(r.reason) AS rows FROM k LEFT JOIN r ON k.reason = r.reason GROUP BY 1"""))
def reason_counts(spark, d):
    value = F.col("predicted_win_probability") * F.col("win_odds")
    reason = F.when(F.col("win_odds") <= 2, "short_odds").when(value < 1, "no_edge").when(F.col("field_size") < 2, "small_field").otherwise("selected")
    rows = scored(spark, d).select(reason.alias("reason"))
    return checks.counts_with_defaults(rows, "reason", ["short_odds", "no_edge", "small_field", "selected", "no_market", "budget"])


@register("date_conflicts", _sql(RUNNERS, """, k AS (SELECT horse_name, coalesce(CAST(CASE WHEN age > 3 THEN race_date END AS VARCHAR), 'missing') AS day FROM runners)
SELECT horse_name, count(DISTINCT day) AS "values", count(*) AS rows FROM k GROUP BY 1 HAVING count(DISTINCT day) > 1"""))
def date_conflicts(spark, d):
    rows = runners(spark, d).select("horse_name", F.when(F.col("age") > 3, F.col("race_date")).alias("day"))
    return checks.conflicts(rows, "horse_name", "day")


@register("duplicate_keys", _sql(RUNNERS, " SELECT race_id, jockey, count(*) AS copies FROM runners GROUP BY 1, 2 HAVING count(*) > 1"))
def duplicate_keys(spark, d):
    """Counted apart from the joins' sorts, in parts of a million runners: most keys are their own group."""
    keys = ["race_id", "jockey"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, d, "lineitem").count() // 1_000_000))
    return checks.duplicate_keys(runners(spark, d).select(*keys).repartition(parts, *keys), keys)


@register("record_type_counts", "SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def record_type_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"))


@register("key_sets", _sql(RUNNERS, """, a AS (SELECT DISTINCT race_id FROM runners WHERE surface = 'N'), b AS (SELECT DISTINCT race_id FROM runners WHERE win_odds >= 6)
SELECT (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either, (SELECT count(*) FROM a SEMI JOIN b USING (race_id)) AS both, (SELECT count(*) FROM a ANTI JOIN b USING (race_id)) AS only_a, (SELECT count(*) FROM b ANTI JOIN a USING (race_id)) AS only_b"""))
def key_sets(spark, d):
    rows = runners(spark, d)
    return checks.key_sets(rows.where("surface = 'N'"), rows.where("win_odds >= 6"), ["race_id"])


@register("all_quoted", _sql(RUNNERS, " SELECT race_id, count(*) AS runners, count(*) FILTER (win_odds >= 6) AS quoted, count(*) = count(*) FILTER (win_odds >= 6) AS complete FROM runners GROUP BY 1"))
def all_quoted(spark, d):
    rows = runners(spark, d)
    return checks.all_quoted(rows, rows.where("win_odds >= 6"), ["race_id", "post_position"])


@register("snapshot_conflicts", _sql(RUNNERS, """, o AS (SELECT race_id, post_position, win_odds FROM runners WHERE surface <> 'R'), n AS (SELECT race_id, post_position, CASE WHEN age = 4 THEN win_odds + 1 ELSE win_odds END AS win_odds FROM runners WHERE track_condition = 'O' OR age > 3)
SELECT CASE WHEN o.race_id IS NULL THEN 'new' WHEN o.win_odds = n.win_odds THEN 'identical' ELSE 'conflict' END AS status, count(*) AS rows FROM n LEFT JOIN o USING (race_id, post_position) GROUP BY 1"""))
def snapshot_conflicts(spark, d):
    """Records that arrive again: appended, left alone, or refused."""
    rows = runners(spark, d)
    old = rows.where("surface <> 'R'")
    new = rows.where("track_condition = 'O' or age > 3").select("race_id", "post_position", F.when(F.col("age") == 4, F.col("win_odds") + 1).otherwise(F.col("win_odds")).alias("win_odds"))
    return checks.against_recorded(new, old, ["race_id", "post_position"], ["win_odds"]).groupBy("status").agg(F.count("*").alias("rows"))


@register("snapshot_faults", _sql(RUNNERS, """, s AS (SELECT race_id, post_position, CASE WHEN age = 2 THEN ' ' WHEN age <> 7 THEN horse_name END AS horse_name, CASE WHEN age = 3 THEN 1.0e0 WHEN post_position <> 6 THEN win_odds END AS win_odds, CASE WHEN post_position <> 5 THEN race_id || '-' || post_position END AS horse_id,
  CASE WHEN surface = 'A' AND age = 5 THEN '' ELSE 'feed' END AS source, CASE WHEN age <> 4 THEN post_position * 2 END AS seen, CASE WHEN age <> 6 THEN field_size END AS post FROM runners),
f AS (SELECT race_id, post_position, concat_ws(',', CASE WHEN trim(coalesce(race_id, '')) = '' THEN 'blank_race' END, CASE WHEN trim(coalesce(horse_id, '')) = '' THEN 'blank_horse' END, CASE WHEN trim(coalesce(horse_name, '')) = '' THEN 'blank_name' END, CASE WHEN trim(coalesce(source, '')) = '' THEN 'blank_source' END,
  CASE WHEN coalesce(win_odds <= 1 OR isnan(win_odds) OR isinf(win_odds), true) THEN 'bad_odds' END, CASE WHEN seen IS NULL OR post IS NULL THEN 'no_time' END, CASE WHEN coalesce(seen >= post, false) THEN 'too_late' END) AS faults FROM s)
SELECT * FROM f WHERE faults <> ''"""))
def snapshot_faults(spark, d):
    """Blank ids, names (a full-width space is blank) and sources, odds, missing and late times."""
    minutes = lambda c: F.timestamp_seconds(c * 60)
    age, post = F.col("age"), F.col("post_position")
    rows = runners(spark, d).select(
        "race_id", "post_position", F.when(post != 5, F.concat_ws("-", "race_id", post.cast("string"))).alias("horse_id"), F.when(age == 2, checks.WIDE_SPACE).when(age != 7, F.col("horse_name")).alias("horse_name"),
        F.when((F.col("surface") == "A") & (age == 5), "").otherwise("feed").alias("source"), F.when(age == 3, 1.0).when(post != 6, F.col("win_odds")).alias("win_odds"),
        F.when(age != 4, minutes(post * 2)).alias("observed_at"), F.when(age != 6, minutes(F.col("field_size"))).alias("post_time"),
    )
    return checks.snapshot_faults(rows).select("race_id", "post_position", "faults")


@register("probability_sums", _sql(SCORED, """, p AS (SELECT race_id, CASE WHEN age = 2 AND post_position = 1 THEN NULL WHEN age = 3 THEN predicted_win_probability + 0.01e0 ELSE predicted_win_probability END AS p FROM scored)
SELECT race_id, round(sum(p), 6) AS total, count(*) FILTER (p IS NULL) AS missing FROM p GROUP BY 1 HAVING abs(sum(p) - 1) > 1e-9 OR count(*) FILTER (p IS NULL) > 0 OR sum(p) IS NULL"""))
def probability_sums(spark, d):
    p = F.col("predicted_win_probability")
    rows = scored(spark, d).withColumn("p", F.when((F.col("age") == 2) & (F.col("post_position") == 1), None).when(F.col("age") == 3, p + 0.01).otherwise(p))
    return checks.bad_sums(rows, "p").select("race_id", F.round("total", 6).alias("total"), "missing")


@register("history_staleness", _sql(RUNNERS, " SELECT horse_name, max(race_date) AS last_day, CAST(date_diff('day', max(race_date), DATE '2001-06-01') AS INTEGER) AS gap_days, date_diff('day', max(race_date), DATE '2001-06-01') > 14 AS stale FROM runners WHERE race_date < DATE '2001-06-01' GROUP BY 1"))
def history_staleness(spark, d):
    return checks.staleness(runners(spark, d), "horse_name", "2001-06-01")


@register("resume_time", _sql(RUNNERS, " SELECT strftime(max(race_date) - INTERVAL 7 DAY, '%Y%m%d') || '000000' AS from_time FROM runners"))
def resume_time(spark, d):
    return checks.resume_from(runners(spark, d))


@register("top_picks", _sql(SCORED, ", r AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY round(predicted_win_probability, 9) DESC, post_position) AS k FROM scored) SELECT race_id, post_position, round(predicted_win_probability, 9) AS p, CAST(is_winner AS BIGINT) AS is_winner FROM r WHERE k = 1"))
def top_picks(spark, d):
    rows = scored(spark, d).withColumn("p", F.round("predicted_win_probability", 9))
    return checks.top_pick(rows, "p").withColumn("is_winner", F.col("is_winner").cast("long"))


@register("fair_odds", _sql(SCORED, " SELECT race_id, post_position, round(1 / predicted_win_probability, 6) AS fair, round(predicted_win_probability * win_odds - 1, 9) AS edge, win_odds > 1 / predicted_win_probability AS value FROM scored WHERE predicted_win_probability > 0"))
def fair_odds(spark, d):
    rows = scored(spark, d)
    fair = betting.fair_odds(F.col("predicted_win_probability"))
    return rows.select("race_id", "post_position", F.round(fair, 6).alias("fair"), F.round(F.col("predicted_win_probability") * F.col("win_odds") - 1, 9).alias("edge"), (F.col("win_odds") > fair).alias("value"))


@register("longshot_quality", _sql(SCORED, """, t AS (SELECT *, CASE WHEN finish_position <= 3 THEN 1 ELSE 0 END AS top3, least(greatest(predicted_win_probability, 1e-6), 1 - 1e-6) AS q FROM scored)
SELECT win_odds >= 20 AS longshot, count(*) AS rows, CAST(sum(top3) AS BIGINT) AS top3, round(avg((q - top3) ** 2), 9) AS brier, round(avg(-(top3 * ln(q) + (1 - top3) * ln(1 - q))), 9) AS log_loss FROM t GROUP BY 1"""))
def longshot_quality(spark, d):
    """Top-three quality of long shots and of the rest."""
    rows = scored(spark, d).withColumn("top3", (F.col("finish_position") <= 3).cast("int")).withColumn("q", F.least(F.greatest("predicted_win_probability", F.lit(1e-6)), F.lit(1 - 1e-6)))
    q, y = F.col("q"), F.col("top3")
    loss = -(y * F.log(q) + (1 - y) * F.log(1 - q))
    return rows.groupBy((F.col("win_odds") >= 20).alias("longshot")).agg(F.count("*").alias("rows"), F.sum("top3").alias("top3"), F.round(F.avg(F.pow(q - y, 2)), 9).alias("brier"), F.round(F.avg(loss), 9).alias("log_loss"))
