"""Full bootstraps against numpy."""

import numpy as np
from pyspark.sql import functions as F

from racelab.operators import bootstrap
from racelab.plans import ledgers, registry
from racelab.plans.evaluation import _m, _p, _win
from racelab.sources.tables import scored

SF = "/root/testdata/sf0.001"


def weights(rid, count):
    b = np.arange(count, dtype=np.int64)[:, None]
    u = (rid * 1103515245 + b * 12345 + (rid % 65521) * (b * 2654435 + 7919)) % 2147483647
    return sum((u >= c).astype(np.int64) for c in bootstrap._CUTS)


def test_paired_bootstrap_has_1000_replicates(spark):
    gain = F.sum(F.pow(_m() - _win(), 2) - F.pow(_p() - _win(), 2)).alias("gain")
    races = scored(spark, SF).groupBy(F.col("race_id").cast("long").alias("rid")).agg(gain).toPandas()
    w = weights(races.rid.to_numpy(), 1000)
    total = w @ races.gain.to_numpy()
    mean = total / w.sum(1)
    got = registry.QUERIES["paired_bootstrap_1000"](spark, SF).first()
    assert got.replicates == 1000 and np.isclose(got.support, (total > 0).mean())
    assert np.allclose([got.low, got.high], np.quantile(mean, [0.05, 0.95]), atol=2e-7)


def test_roi_bootstrap_has_5000_replicates(spark):
    races = ledgers.bets(spark, SF).groupBy("rid").agg(F.sum("stake").alias("stake"), F.sum("payout").alias("payout")).toPandas()
    w = weights(races.rid.to_numpy(), 5000)
    roi = (w @ races.payout.to_numpy()) / (w @ races.stake.to_numpy()) - 1
    got = registry.QUERIES["roi_bootstrap_5000"](spark, SF).first()
    assert (got.status, got.replicates, got.clusters) == ("available", 5000, len(races))
    assert np.allclose([got.low, got.high, got.positive], [*np.quantile(roi, [0.025, 0.975]), (roi > 0).mean()], atol=2e-7)


def test_few_races_have_no_bounds(spark):
    for n in (0, 1, 19, 20):
        races = spark.createDataFrame([(k + 1, 100, 90 + k) for k in range(n)], "rid long, stake long, payout long")
        got = bootstrap.roi_interval(races, "rid", 50).first()
        assert got.clusters == n and (got.low is None) == (got.high is None) == (n < 20)
        assert got.status == ("available" if n >= 20 else "insufficient_race_clusters")
