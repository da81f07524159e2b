"""Registered queries on ledger rules. Both sides are derived from the runner table with planted faults
and nulls; their SQL derives the same two sides and applies the rules to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from racelab.operators import ledger
from racelab.sources.tables import RUNNERS, SCORED, runners, scored

from .features import _sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def _keyed(spark, d):
    n = F.col("race_id").cast("long") * 100 + F.col("post_position")
    return runners(spark, d).withColumns({"n": n, "horse_id": F.concat_ws("-", "race_id", F.col("post_position").cast("string"))})


_KEYED = RUNNERS + ", k AS (SELECT *, CAST(race_id AS BIGINT) * 100 + post_position AS n, race_id || '-' || post_position AS horse_id FROM runners)"


@register("prediction_links", _sql(_KEYED, """, p AS (SELECT n AS snapshot_id, CASE WHEN n % 19 <> 0 THEN race_id END AS race_id, horse_id, CASE WHEN n % 17 <> 0 THEN 10 * (n % 9) END AS predicted_at, CASE WHEN n % 23 <> 0 THEN win_odds END AS odds FROM k),
s AS (SELECT n AS snapshot_id, CASE WHEN n % 13 = 0 THEN 'X' ELSE race_id END AS race_id, CASE WHEN n % 7 = 0 THEN 'X' ELSE horse_id END AS horse_id, CASE WHEN n % 29 <> 0 THEN 20 END AS observed_at, CASE WHEN n % 31 <> 0 THEN 70 END AS post_time, CASE WHEN n % 5 = 0 THEN win_odds + 1 WHEN n % 37 <> 0 THEN win_odds END AS odds FROM k WHERE n % 11 <> 0),
t AS (SELECT CASE WHEN s.snapshot_id IS NULL THEN 'no_snapshot'
  WHEN p.race_id IS NULL OR p.horse_id IS NULL OR p.predicted_at IS NULL OR p.odds IS NULL OR s.race_id IS NULL OR s.horse_id IS NULL OR s.observed_at IS NULL OR s.post_time IS NULL OR s.odds IS NULL THEN 'missing_value'
  WHEN p.race_id <> s.race_id THEN 'race_mismatch' WHEN p.horse_id <> s.horse_id THEN 'horse_mismatch' WHEN predicted_at < observed_at THEN 'before_observation' WHEN predicted_at >= post_time THEN 'after_post_time'
  WHEN abs(p.odds - s.odds) <= 1e-12 THEN 'ok' ELSE 'odds_mismatch' END AS status FROM p LEFT JOIN s ON s.snapshot_id = p.snapshot_id)
SELECT status, count(*) AS rows FROM t GROUP BY 1"""))
def prediction_links(spark, d):
    """Predictions joined to the snapshots that they name; each side lacks values here and there."""
    n, at = F.col("n"), lambda s: F.timestamp_seconds(F.lit(s) if isinstance(s, int) else s)
    unless = lambda k, c: F.when(n % k != 0, c)
    rows = _keyed(spark, d)
    predictions = rows.select(n.alias("snapshot_id"), unless(19, F.col("race_id")).alias("race_id"), "horse_id", unless(17, at(10 * (n % 9))).alias("predicted_at"), unless(23, F.col("win_odds")).alias("odds"))
    quoted = F.when(n % 5 == 0, F.col("win_odds") + 1).when(n % 37 != 0, F.col("win_odds"))
    snapshots = rows.where("n % 11 <> 0").select(n.alias("snapshot_id"), F.when(n % 13 == 0, "X").otherwise(F.col("race_id")).alias("race_id"), F.when(n % 7 == 0, "X").otherwise(F.col("horse_id")).alias("horse_id"), unless(29, at(20)).alias("observed_at"), unless(31, at(70)).alias("post_time"), quoted.alias("odds"))
    return ledger.linked(predictions, snapshots).groupBy("status").agg(F.count("*").alias("rows"))


@register("bet_links", _sql(_KEYED, """, e AS (SELECT n AS prediction_id, CASE WHEN n % 17 <> 0 THEN race_id END AS race_id, horse_id, CASE WHEN n % 19 <> 0 THEN win_odds END AS odds FROM k WHERE surface <> 'N'),
b AS (SELECT n AS prediction_id, race_id, CASE WHEN n % 9 = 0 THEN 'X' WHEN n % 23 <> 0 THEN horse_id END AS horse_id, CASE WHEN n % 10 = 0 THEN 0 WHEN n % 29 <> 0 THEN 100 END AS stake, CASE WHEN n % 8 = 0 THEN win_odds + 0.1e0 ELSE win_odds END AS odds FROM k)
SELECT prediction_id, CASE WHEN e.prediction_id IS NULL THEN 'no_evidence' WHEN coalesce(stake <= 0, true) THEN 'bad_stake' WHEN coalesce(b.race_id <> e.race_id OR b.horse_id <> e.horse_id, true) THEN 'identity_mismatch'
  WHEN coalesce(NOT abs(b.odds - e.odds) <= 1e-12, true) THEN 'odds_mismatch' ELSE 'ok' END AS status FROM b LEFT JOIN e USING (prediction_id)"""))
def bet_links(spark, d):
    rows, n = _keyed(spark, d), F.col("n")
    evidence = rows.where("surface <> 'N'").select(n.alias("prediction_id"), F.when(n % 17 != 0, F.col("race_id")).alias("race_id"), "horse_id", F.when(n % 19 != 0, F.col("win_odds")).alias("odds"))
    bets = rows.select(n.alias("prediction_id"), "race_id", F.when(n % 9 == 0, "X").when(n % 23 != 0, F.col("horse_id")).alias("horse_id"), F.when(n % 10 == 0, 0).when(n % 29 != 0, 100).alias("stake"), (F.col("win_odds") + F.when(n % 8 == 0, 0.1).otherwise(0.0)).alias("odds"))
    return ledger.bet_status(bets, evidence).select("prediction_id", "status")


@register("settlement_rules", _sql(_KEYED, """, f AS (SELECT n AS bet_id, race_id, horse_id, finish_position, win_odds AS odds, finish_position = 1 AS won, CASE WHEN finish_position = 1 THEN 100 ELSE 0 END AS payout, n, surface, track_condition FROM k),
w AS (SELECT bet_id, race_id, CASE WHEN n % 11 = 0 THEN 'X' ELSE horse_id END AS horse_id, CASE WHEN n % 31 <> 0 THEN finish_position END AS finish_position, CASE WHEN n % 29 <> 0 THEN odds END AS odds, CASE WHEN n % 17 <> 0 THEN won END AS won, CASE WHEN n % 13 = 0 THEN -1 WHEN n % 19 <> 0 THEN payout END AS payout FROM f),
b AS (SELECT bet_id, race_id, horse_id FROM f WHERE NOT (track_condition = 'O' AND n % 3 = 0)), o AS (SELECT bet_id, finish_position, CASE WHEN n % 4 = 0 THEN odds + 1 ELSE odds END AS odds, won, payout FROM f WHERE surface <> 'N'),
t AS (SELECT w.payout, CASE WHEN w.won IS NULL OR coalesce(w.finish_position <= 0, true) OR coalesce(w.payout < 0, true) OR (w.won AND (NOT coalesce(w.odds > 1, false) OR coalesce(w.payout <= 0, true))) OR (NOT w.won AND w.payout <> 0) THEN 'bad_values'
  WHEN b.bet_id IS NULL THEN 'no_bet' WHEN coalesce(w.race_id <> b.race_id OR w.horse_id <> b.horse_id, true) THEN 'identity_mismatch' WHEN o.bet_id IS NULL THEN 'new'
  WHEN w.finish_position IS NOT DISTINCT FROM o.finish_position AND w.odds IS NOT DISTINCT FROM o.odds AND w.won IS NOT DISTINCT FROM o.won AND w.payout IS NOT DISTINCT FROM o.payout THEN 'repeated' ELSE 'conflict' END AS status
  FROM w LEFT JOIN b USING (bet_id) LEFT JOIN o USING (bet_id))
SELECT status, count(*) AS rows, CAST(sum(payout) AS BIGINT) AS payout FROM t GROUP BY 1"""))
def settlement_rules(spark, d):
    rows, n = _keyed(spark, d), F.col("n")
    won = F.col("finish_position") == 1
    full = rows.select(n.alias("bet_id"), "race_id", "horse_id", "finish_position", F.col("win_odds").alias("odds"), won.alias("won"), F.when(won, 100).otherwise(0).alias("payout"), "n", "surface", "track_condition")
    unless = lambda k, c: F.when(n % k != 0, F.col(c))
    faults = {"payout": F.when(n % 13 == 0, -1).when(n % 19 != 0, F.col("payout")), "horse_id": F.when(n % 11 == 0, "X").otherwise(F.col("horse_id")), "won": unless(17, "won"), "odds": unless(29, "odds"), "finish_position": unless(31, "finish_position")}
    new = full.withColumns(faults).drop("n", "surface", "track_condition")
    bets = full.where("NOT (track_condition = 'O' AND n % 3 = 0)")
    recorded = full.where("surface <> 'N'").withColumn("odds", F.when(n % 4 == 0, F.col("odds") + 1).otherwise(F.col("odds")))
    return ledger.settlement_status(new, bets, recorded).groupBy("status").agg(F.count("*").alias("rows"), F.sum("payout").alias("payout"))


@register("shadow_results", _sql(_KEYED, """, o AS (SELECT race_id, post_position, n, CASE WHEN n % 2 = 0 THEN finish_position + CASE WHEN n % 12 = 0 THEN 1 ELSE 0 END END AS old FROM k),
a AS (SELECT race_id, post_position, CASE WHEN n % 17 <> 0 THEN finish_position END AS finish_position FROM k, range(1, 3) t(copy) WHERE (n % 3 <> 0 OR n % 12 = 0) AND (copy = 1 OR n % 7 = 0)),
r AS (SELECT race_id, post_position, max(finish_position) AS new FROM a WHERE finish_position IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1)
SELECT n, CASE WHEN new IS NULL THEN CASE WHEN old IS NULL THEN 'pending' ELSE 'kept' END WHEN old IS NULL THEN 'updated' WHEN old = new THEN 'kept' ELSE 'conflict' END AS status, coalesce(old, new) AS finish_position FROM o LEFT JOIN r USING (race_id, post_position)"""))
def shadow_results(spark, d):
    """Every seventh result arrives twice, and counts for nothing then; some arrive without a position."""
    rows, n = _keyed(spark, d), F.col("n")
    old = rows.select("race_id", "post_position", "n", F.when(n % 2 == 0, F.col("finish_position") + F.when(n % 12 == 0, 1).otherwise(0)).alias("finish_position"))
    copies = F.explode(F.when(n % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    new = rows.where("n % 3 <> 0 OR n % 12 = 0").select("race_id", "post_position", F.when(n % 17 != 0, F.col("finish_position")).alias("finish_position"), copies.alias("copy"))
    return ledger.with_results(old, new).select("n", "status", "finish_position")


_BLANK = "trim(replace(replace(coalesce({0}, ''), '　', ' '), chr(9), ' ')) = ''"


@register("paper_input_faults", _sql(_KEYED, f""", i AS (SELECT CASE WHEN n % 37 <> 0 THEN race_id END AS race_id, horse_id, CASE WHEN n % 11 = 0 THEN '　 ' WHEN n % 29 <> 0 THEN horse_name END AS horse_name, CASE n % 17 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'v7' END AS model_version,
  CASE WHEN n % 5 = 0 THEN 1.5e0 WHEN n % 19 = 0 THEN CAST('nan' AS DOUBLE) WHEN n % 23 <> 0 THEN 0.5e0 END AS probability, CASE WHEN n % 7 <> 0 THEN 0.5e0 END AS confidence FROM k, range(1, 3) t(copy) WHERE copy = 1 OR n % 13 = 0),
d AS (SELECT race_id, horse_id FROM i GROUP BY 1, 2 HAVING count(*) > 1),
f AS (SELECT concat_ws(',', CASE WHEN coalesce(NOT probability BETWEEN 0 AND 1 OR isnan(probability), true) THEN 'probability' END, CASE WHEN coalesce(NOT confidence BETWEEN 0 AND 1, true) THEN 'confidence' END,
  {", ".join(f"CASE WHEN {_BLANK.format(f'i.{c}')} THEN 'blank_{c}' END" for c in ("race_id", "horse_id", "horse_name", "model_version"))}, CASE WHEN d.horse_id IS NOT NULL THEN 'duplicate' END) AS faults FROM i LEFT JOIN d ON d.race_id = i.race_id AND d.horse_id = i.horse_id)
SELECT faults, count(*) AS rows FROM f WHERE faults <> '' GROUP BY 1"""))
def paper_input_faults(spark, d):
    n = F.col("n")
    copies = F.explode(F.when(n % 13 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    rows = _keyed(spark, d).select(
        F.when(n % 37 != 0, F.col("race_id")).alias("race_id"), "horse_id", F.when(n % 11 == 0, "　 ").when(n % 29 != 0, F.col("horse_name")).alias("horse_name"), F.when(n % 17 == 0, " ").when(n % 17 != 1, "v7").alias("model_version"),
        F.when(n % 5 == 0, 1.5).when(n % 19 == 0, float("nan")).when(n % 23 != 0, 0.5).alias("probability"), F.when(n % 7 != 0, F.lit(0.5)).alias("confidence"), copies.alias("copy"),
    )
    return ledger.paper_input_faults(rows).groupBy("faults").agg(F.count("*").alias("rows"))


@register("odds_evidence", _sql(SCORED, """, e AS (SELECT ['pre_race_snapshot', 'final_win_odds', 'estimated_odds', 'rumour'][1 + post_position % 4] AS kind, is_winner, win_odds FROM scored)
SELECT kind, CAST(CASE WHEN kind <> 'rumour' THEN kind = 'pre_race_snapshot' END AS BIGINT) AS verified, CASE kind WHEN 'pre_race_snapshot' THEN 'verified_pre_race_odds' WHEN 'final_win_odds' THEN 'research_only_final_odds' WHEN 'estimated_odds' THEN 'research_only_estimated_odds' END AS label, count(*) AS rows FROM e GROUP BY 1"""))
def odds_evidence(spark, d):
    kinds = F.array(*[F.lit(k) for k in (*ledger.EVIDENCE, "rumour")])
    rows = scored(spark, d).groupBy(F.get(kinds, (F.col("post_position") % 4).cast("int")).alias("kind")).agg(F.count("*").alias("rows"))
    verified, label = ledger.odds_evidence(F.col("kind"))
    return rows.select("kind", verified.cast("int").cast("long").alias("verified"), label.alias("label"), "rows")


@register("merged_history", _sql(RUNNERS, """ SELECT CASE WHEN race_date < DATE '2000-01-01' THEN 'historical_base' ELSE 'feed' END AS source, CASE WHEN race_date < DATE '2000-01-01' THEN 'historical_research' ELSE 'supplement' END AS kind, count(*) AS rows, count(DISTINCT race_id) AS races FROM runners GROUP BY 1, 2"""))
def merged_history(spark, d):
    rows = runners(spark, d)
    got = ledger.merged_history(rows.where("race_date < '2000-01-01'"), rows.where("race_date >= '2000-01-01'"), "feed", "file:1", "2000-01-01")
    return got.groupBy(F.col("_source_name").alias("source"), F.col("_source_kind").alias("kind")).agg(F.count("*").alias("rows"), F.count_distinct("race_id").alias("races"))
