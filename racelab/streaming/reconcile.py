"""Pending bets and the results that arrive for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racelab.operators import ledger


def reconciled(bets: DataFrame, results: DataFrame, wait: str = "7 days", late: str = "1 hour") -> DataFrame:
    """Streams of bets (bet_id, race_id, post_position, post_time) and results (race_id, post_position,
    finish_position, result_at): each bet once, ``settled`` with its result or, when the watermarks have passed
    its post by ``wait``, ``expired`` without one. A left outer join bounded in time: a bet is held for at
    most ``wait`` and ``late``, a result as long as a bet for it may still come."""
    b = bets.withWatermark("post_time", late).alias("b")
    r = results.withWatermark("result_at", late).alias("r")
    near = F.expr(f"b.race_id = r.race_id AND b.post_position = r.post_position AND r.result_at >= b.post_time AND r.result_at <= b.post_time + INTERVAL {wait}")
    status = F.when(F.col("r.result_at").isNull(), "expired").otherwise("settled")
    return b.join(r, near, "left_outer").select("b.bet_id", "b.race_id", "b.post_position", "b.post_time", "r.finish_position", "r.result_at", status.alias("status"))


def reconciliation(rows: DataFrame, results: DataFrame) -> DataFrame:
    """One row on a ledger's rows (race_id, post_position, finish_position) and results that arrived: the
    status, results taken, conflicts, and races that miss a result before and after. A race is pending while
    any of its runners misses one."""
    got = ledger.with_results(rows.withColumn("_had", F.col("finish_position").isNotNull()), results)
    races = got.groupBy("race_id").agg(
        F.count_if(~F.col("_had")).alias("before"), F.count_if(F.col("finish_position").isNull()).alias("after"),
        F.count_if(F.col("status") == "updated").alias("new"), F.count_if(F.col("status") == "conflict").alias("conflicts"),
    )
    one = races.agg(
        F.coalesce(F.sum("new"), F.lit(0)).alias("new_result_rows"), F.coalesce(F.sum("conflicts"), F.lit(0)).alias("conflicts"),
        F.count_if(F.col("before") > 0).alias("pending_races_before"), F.count_if(F.col("after") > 0).alias("pending_races_after"),
        F.count_if((F.col("before") > 0) & (F.col("after") == 0)).alias("reconciled_races"),
    )
    before, after, done = (F.col(c) for c in ("pending_races_before", "pending_races_after", "reconciled_races"))
    status = F.when(before == 0, "no_pending_results").when(after == 0, "reconciled_all").when(done > 0, "partially_reconciled").otherwise("pending_results")
    return one.select(status.alias("status"), "new_result_rows", "conflicts", "pending_races_before", "pending_races_after", "reconciled_races")
