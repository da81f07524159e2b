"""A paper session over a day's or many days' predictions: guards, quotes as of the prediction, decisions,
exposure limits, and records that may be run again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from racelab.functions import betting
from racelab.operators import asof, ledger
from racelab.sources.ledger_table import LedgerTable
from racelab.sources.scratch import Scratch
from racelab.streaming import exposure


@dataclass(frozen=True)
class Config:
    min_p: float = 0.1
    min_confidence: float = 0.0
    min_value: float = 1.15
    share: float = 0.25
    race: float = 0.05
    day: float = 0.2
    cap: int = 5000
    unit: int = 100
    least: int = 100
    most_age_minutes: int = 10

    @property
    def limits(self) -> exposure.Limits:
        return exposure.Limits(self.day, self.race, self.unit, self.least)


def with_quotes(predictions: DataFrame, quotes: DataFrame, most_age_minutes: int = 10) -> DataFrame:
    """Predictions with the last quote at or before them and ``quote_status``: no_quote, stale (older than
    ``most_age_minutes``), after_post or ok. Quotes: race_id, horse_id, observed_at, decimal_odds,
    scheduled_post_time."""
    marks = quotes.select("race_id", "horse_id", F.col("observed_at").alias("predicted_at"), "decimal_odds", "scheduled_post_time")
    got = asof.latest_before(predictions, marks, ["race_id", "horse_id"], "predicted_at", ["decimal_odds", "scheduled_post_time"])
    age = F.unix_micros("predicted_at") - F.unix_micros("quoted_at")
    status = F.when(F.col("quoted_at").isNull(), "no_quote").when(age > most_age_minutes * 60_000_000, "stale").when(F.coalesce(F.col("predicted_at") >= F.col("scheduled_post_time"), F.lit(True)), "after_post").otherwise("ok")
    return got.withColumn("quote_status", status)


def evaluations(predictions: DataFrame, quotes: DataFrame, bankroll: float, config: Config = Config(), evaluated: DataFrame | None = None, exposed: DataFrame | None = None) -> DataFrame:
    """Every prediction with its quote, stake and reason.

    predictions: race_id, horse_id, horse_name, model_version, probability, confidence, predicted_at, sequence
    (the order in which they are taken). Races that ``evaluated`` (model_version, race_id) holds are skipped.
    A prediction that breaks a guard or has no usable quote stakes nothing, for that reason. ``exposed``: bets
    on record (day, race_id, sequence, stake), which count against the limits.
    """
    if bankroll <= 0:
        raise ValueError("the bankroll must be positive")
    rows = predictions
    if evaluated is not None:
        rows = rows.join(evaluated.select("model_version", "race_id").distinct(), ["model_version", "race_id"], "left_anti")
    # rows of one key share their faults: no join, the windows are sorted once
    rows = ledger.with_input_faults(rows).withColumn("faults", F.max("faults").over(Window.partitionBy("race_id", "horse_id")))
    quoted = with_quotes(rows, quotes, config.most_age_minutes)
    p, odds = F.col("probability"), F.col("decimal_odds")
    value = betting.expected_return(p, odds)
    why = F.when(F.col("faults").isNotNull(), F.concat(F.lit("invalid: "), "faults")).when(F.col("quote_status") != "ok", F.col("quote_status")).otherwise(betting.decision_reason(p, F.col("confidence"), value, config.min_p, config.min_confidence, config.min_value))
    fraction = F.when(why == "eligible", F.least(betting.kelly_fraction(p, odds) * config.share, F.lit(config.race))).otherwise(0.0)
    asked = quoted.withColumns({"expected_return": value, "why": why, "fraction": fraction, "day": F.coalesce(F.to_date("scheduled_post_time"), F.to_date("predicted_at"), F.lit("1970-01-01").cast("date"))})
    # asked for the requests, then for all rows
    asked = Scratch(predictions.sparkSession, "paper").save(asked, "asked")
    seed = None if exposed is None else exposure.seeded(exposed.withColumn("bankroll", F.lit(float(bankroll))), config.limits)
    stakes = exposure.exposures(asked.where("why = 'eligible'"), config.limits, seed, bankroll=float(bankroll), cap=config.cap)
    # only requests meet their stakes, other rows stay where they are
    eligible = F.col("why").eqNullSafe("eligible")
    got = asked.where(eligible).join(stakes.select("sequence", "day", "stake", "reason"), ["day", "sequence"], "left").unionByName(asked.where(~eligible), allowMissingColumns=True)
    reason = F.when(F.col("why") != "eligible", F.col("why")).when(F.col("reason") == "not_asked", "kelly_non_positive_or_below_unit").otherwise(F.col("reason"))
    stake = F.coalesce("stake", F.lit(0)).cast("long")
    return got.select(*predictions.columns, "day", F.col("quoted_at").alias("observed_at"), "decimal_odds", "scheduled_post_time", "expected_return", stake.alias("stake"), reason.alias("reason"), (stake > 0).alias("accepted"))


def summary(rows: DataFrame) -> DataFrame:
    """(reason, rows, races, stake) of evaluations."""
    return rows.groupBy("reason").agg(F.count("*").alias("rows"), F.count_distinct("race_id").alias("races"), F.sum("stake").alias("stake"))


def run(predictions: DataFrame, quotes: DataFrame, table: LedgerTable, bankroll: float, config: Config = Config(), writer: str = "paper", batch: int | None = None) -> int:
    """Evaluate what the ledger lacks and record it in one commit; gives the rows recorded. The ledger's own
    stakes count against the limits, so that runs of a day go on where the last one ended. The same batch
    again, or the same races in another one, records nothing."""
    state = table.state()
    if batch is not None and state.batches.get(writer, -1) >= batch:
        return 0
    recorded = table.read(state)
    exposed = None if recorded is None else recorded.where("stake > 0").select(F.col("race_date").alias("day"), "race_id", "sequence", "stake")
    rows = evaluations(predictions, quotes, bankroll, config, recorded, exposed).withColumnRenamed("day", "race_date")
    keys = ["model_version", "race_id", "horse_id"]
    return table.append_immutable(rows, keys, ["probability", "confidence", "stake", "reason"], writer if batch is not None else None, batch)


def settle(table: LedgerTable, bets: DataFrame, results: DataFrame, writer: str | None = None, batch: int | None = None) -> dict:
    """Settle accepted bets (bet_id, race_id, horse_id, race_date, decimal_odds, stake) by results (race_id,
    horse_id, finish_position) into a table of settlements, each once. Gives rows by status: settled now,
    settled before, race_pending (its race has no result), runner_missing."""
    races = results.groupBy("race_id").agg(F.map_from_entries(F.collect_list(F.struct("horse_id", "finish_position"))).alias("_of"))
    got = bets.join(races, "race_id", "left").withColumn("finish_position", F.try_element_at("_of", "horse_id").cast("long"))
    won = F.col("finish_position") == 1
    got = got.withColumns({"won": won, "payout": F.when(won, betting.payout(F.col("stake"), F.col("decimal_odds"))).otherwise(F.lit(0)).cast("long")})
    status = F.when(F.col("_of").isNull(), "race_pending").when(F.col("finish_position").isNull(), "runner_missing").otherwise("settleable")
    got = got.withColumn("status", status).drop("_of")
    counts = {r.status: r.n for r in got.groupBy("status").agg(F.count("*").alias("n")).collect()}
    done = got.where("status = 'settleable'").select("bet_id", "race_id", "horse_id", "race_date", "finish_position", "won", "stake", "payout")
    new = table.append_immutable(done, ["bet_id"], ["finish_position", "won", "payout"], writer, batch)
    return {"settled": new, "settled_before": counts.get("settleable", 0) - new, "race_pending": counts.get("race_pending", 0), "runner_missing": counts.get("runner_missing", 0)}
