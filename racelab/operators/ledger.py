"""Rules of an append-only ledger, as statuses of rows: nothing is written for a row that breaks one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from racelab.operators.checks import blank

TOLERANCE = 1e-12
#: Kinds of odds evidence, whether returns on them count as verified, and their label.
EVIDENCE = {"pre_race_snapshot": (True, "verified_pre_race_odds"), "final_win_odds": (False, "research_only_final_odds"), "estimated_odds": (False, "research_only_estimated_odds")}


def _breaks(rule: Column) -> Column:
    """A rule that can't be decided is broken."""
    return F.coalesce(rule, F.lit(True))


def link_status(p: str = "p", s: str = "s") -> Column:
    """The first rule that a prediction (struct ``p``) breaks against the quote ``s`` it claims to use;
    a null id, time or price on either side is ``missing_value``."""
    a, b = (lambda c: F.col(f"{p}.{c}")), (lambda c: F.col(f"{s}.{c}"))
    needed = [a(c) for c in ("race_id", "horse_id", "predicted_at", "odds")] + [b(c) for c in ("race_id", "horse_id", "observed_at", "post_time", "odds")]
    missing = F.lit(False)
    for c in needed:
        missing = missing | c.isNull()
    return (
        F.when(F.col(s).isNull(), "no_snapshot")
        .when(missing, "missing_value")
        .when(a("race_id") != b("race_id"), "race_mismatch")
        .when(a("horse_id") != b("horse_id"), "horse_mismatch")
        .when(a("predicted_at") < b("observed_at"), "before_observation")
        .when(a("predicted_at") >= b("post_time"), "after_post_time")
        .when(_breaks(~(F.abs(a("odds") - b("odds")) <= TOLERANCE)), "odds_mismatch")
        .otherwise("ok")
    )


def linked(predictions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Predictions with the status of their link: a left join by the snapshot that they name."""
    quote = F.struct(*[c for c in snapshots.columns if c != "snapshot_id"]).alias("_s")
    got = predictions.select("*", F.struct("race_id", "horse_id", "predicted_at", "odds").alias("_p")).join(snapshots.select("snapshot_id", quote), "snapshot_id", "left")
    return got.withColumn("status", link_status("_p", "_s")).drop("_p", "_s")


def bet_status(bets: DataFrame, evidence: DataFrame) -> DataFrame:
    """Bets against the predictions with evidence that they name: a left join by prediction_id."""
    known = evidence.select("prediction_id", F.struct("race_id", "horse_id", "odds").alias("_e"))
    got = bets.join(known, "prediction_id", "left")
    same = ~_breaks((F.col("race_id") != F.col("_e.race_id")) | (F.col("horse_id") != F.col("_e.horse_id")))
    status = (
        F.when(F.col("_e").isNull(), "no_evidence")
        .when(_breaks(F.col("stake") <= 0), "bad_stake")
        .when(~same, "identity_mismatch")
        .when(_breaks(~(F.abs(F.col("odds") - F.col("_e.odds")) <= TOLERANCE)), "odds_mismatch")
        .otherwise("ok")
    )
    return got.withColumn("status", status).drop("_e")


def settlement_status(new: DataFrame, bets: DataFrame, recorded: DataFrame) -> DataFrame:
    """New settlements against the bets and what is settled already: one row each with its status.

    new: bet_id, race_id, horse_id, finish_position, odds, won, payout. A settlement that is there with the
    same values is ``repeated``, with others a ``conflict``: settlements don't change.
    """
    values = ("finish_position", "odds", "won", "payout")
    own = bets.select("bet_id", F.struct("race_id", "horse_id").alias("_b"))
    old = recorded.select("bet_id", F.struct(*values).alias("_o"))
    rows = new.join(own, "bet_id", "left").join(old, "bet_id", "left")
    bad_win = F.col("won") & (_breaks(~(F.col("odds") > 1)) | _breaks(F.col("payout") <= 0))
    bad_value = F.col("won").isNull() | _breaks(F.col("finish_position") <= 0) | _breaks(F.col("payout") < 0) | bad_win | (~F.col("won") & (F.col("payout") != 0))
    status = (
        F.when(bad_value, "bad_values")
        .when(F.col("_b").isNull(), "no_bet")
        .when(_breaks((F.col("race_id") != F.col("_b.race_id")) | (F.col("horse_id") != F.col("_b.horse_id"))), "identity_mismatch")
        .when(F.col("_o").isNull(), "new")
        .when(F.struct(*values).eqNullSafe(F.col("_o")), "repeated")
        .otherwise("conflict")
    )
    return rows.withColumn("status", status).drop("_b", "_o")


def with_results(rows: DataFrame, results: DataFrame) -> DataFrame:
    """A shadow ledger's rows with the results that arrived: keys that repeat in the results are left
    out, a result that is there stays, another one for it is a conflict."""
    once = results.where("finish_position IS NOT NULL").groupBy("race_id", "post_position").agg(F.max("finish_position").alias("_r"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    got = rows.join(once, ["race_id", "post_position"], "left")
    old, new = F.col("finish_position"), F.col("_r")
    status = F.when(new.isNull(), F.when(old.isNull(), "pending").otherwise("kept")).when(old.isNull(), "updated").when(old == new, "kept").otherwise("conflict")
    return got.withColumn("status", status).withColumn("finish_position", F.coalesce(old, new)).drop("_r")


def with_input_faults(rows: DataFrame) -> DataFrame:
    """Each prediction with ``faults``: the guards that it breaks, comma-joined, null if none. Columns: race_id,
    horse_id, horse_name, model_version, probability, confidence. Repeated keys are seen in one window."""
    same = Window.partitionBy("race_id", "horse_id")
    outside = lambda c: _breaks(~F.col(c).between(0.0, 1.0) | F.isnan(c))
    again = F.col("race_id").isNotNull() & F.col("horse_id").isNotNull() & (F.count("*").over(same) > 1)
    rules = {"probability": outside("probability"), "confidence": outside("confidence"), **{f"blank_{c}": blank(F.col(c)) for c in ("race_id", "horse_id", "horse_name", "model_version")}, "duplicate": again}
    return rows.withColumn("faults", F.nullif(F.concat_ws(",", *[F.when(rule, name) for name, rule in rules.items()]), F.lit("")))


def paper_input_faults(rows: DataFrame) -> DataFrame:
    """The predictions that break a guard, with ``faults``."""
    return with_input_faults(rows).where("faults IS NOT NULL")


def odds_evidence(kind: Column) -> tuple[Column, Column]:
    """(returns are verified, label) of a kind of odds evidence; null for an unknown kind."""
    verified, text = F.lit(None).cast("boolean"), F.lit(None).cast("string")
    for name, (good, label) in EVIDENCE.items():
        verified, text = F.when(kind == name, F.lit(good)).otherwise(verified), F.when(kind == name, label).otherwise(text)
    return verified, text


def merged_history(base: DataFrame, supplement: DataFrame, source: str, reference: str, acquired: str) -> DataFrame:
    """Base and supplement with their provenance; what the base says of its own source stays."""
    given = {"_source_name": "historical_base", "_source_kind": "historical_research", "_source_reference": "", "_source_acquired_at": ""}
    base = base.withColumns({c: F.lit(v) for c, v in given.items() if c not in base.columns})
    stamp = dict(zip(given, (source, "supplement", reference, acquired)))
    return base.unionByName(supplement.withColumns({c: F.lit(v) for c, v in stamp.items()}), allowMissingColumns=True)
