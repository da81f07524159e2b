"""Fitted queries against the fold table."""

import pytest
from pyspark.sql import functions as F

from racelab.plans import evaluation, registry
from racelab.plans import models as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def wanted(spark):
    """(race, runner): fold, of every runner on a test day."""
    rows, days, plan = evaluation._folds(spark, SF)
    bounds = plan.collect()
    out = {}
    for r in rows.join(days, "race_date").select("race_id", "post_position", "day").collect():
        for f in bounds:
            if f.test_start <= r.day < f.test_end:
                out[r.race_id, r.post_position] = f.fold
    assert len(bounds) > 1
    return out


def test_every_fold_is_fitted_on_the_days_before_it(spark, wanted):
    seen = []

    def predict(train, test):
        seen.append((train.agg(F.min("day"), F.max("day")).first(), test.agg(F.min("day"), F.max("day")).first()))
        return test.select("race_id", "post_position")

    got = plans._walk_forward(spark, SF, predict).collect()
    assert {(r.race_id, r.post_position): r.fold for r in got} == wanted and len(got) == len(wanted)
    bounds = evaluation._folds(spark, SF)[2].orderBy("fold").collect()
    assert [(tuple(a), tuple(b)) for a, b in seen] == [((0, f.train_days - 1), (f.test_start, f.test_end - 1)) for f in bounds]


@pytest.mark.parametrize("name", ["logistic_walk_forward", "gbt_walk_forward", "pairwise_ranker", "residual_model"])
def test_predictions_cover_every_fold(spark, wanted, name):
    got = registry.QUERIES[name](spark, SF).collect()
    assert {(r.race_id, r.post_position): r["fold"] for r in got} == wanted and len(got) == len(wanted)
