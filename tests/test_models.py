"""Frozen models, future frames, conditional logit, stacking, lineage and gates."""

import datetime as dt
import json
import os

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from racelab.ml import artifacts, choice, forward, models, stacking
from racelab.operators import gates, history, intake, lineage, market
from racelab.sources import current
from racelab.sources.scratch import Scratch

D = dt.date


def runners(spark, n=60, years=1):
    rng = np.random.default_rng(3)
    rows = []
    for r in range(n):
        skill = rng.normal(size=4)
        order = np.argsort(-skill - rng.gumbel(size=4))
        for k in range(4):
            rows.append((f"R{r}", 2000 + r % years, D(2000 + r % years, 1 + r % 12, 1 + r % 28), k + 1, float(skill[k]), None if r % 9 == 0 else float(k), "ab"[k % 2] if k else None, int(order[0] == k), int(k in order[:3]), 0.25))
    return spark.createDataFrame(rows, "race_id string, year int, race_date date, post_position long, form double, age double, surface string, is_winner int, top3 int, market_implied_probability double")


# --------------------------------------------------------------- artifacts


@pytest.fixture(scope="module")
def frozen(spark, tmp_path_factory):
    rows = runners(spark)
    path = str(tmp_path_factory.mktemp("artifact") / "v1")
    model = models.fit_logistic(rows, ["form", "age"], ["surface"])
    manifest = artifacts.save(model, artifacts.Manifest("v1", "e1", ("form", "age"), ("surface",), "2000-01-01", "2000-12-28", rows.count()), path)
    return path, manifest, model


def test_a_frozen_model_predicts_the_same(spark, frozen):
    path, manifest, model = frozen
    rows = runners(spark)
    got = artifacts.load(spark, path, manifest).predict(rows)
    want = {(r.race_id, r.post_position): r.fitted_probability for r in models.predict(model, rows).collect()}
    for r in got.collect():
        assert r.predicted_win_probability == pytest.approx(want[r.race_id, r.post_position], abs=1e-12) and r.model_version == "v1" and 0 <= r.confidence <= 1
    with pytest.raises(artifacts.Refused, match="missing features: age"):
        artifacts.load(spark, path, manifest).predict(rows.drop("age"))


@pytest.mark.parametrize("field, value", [("numbers", ("age", "form")), ("categories", ()), ("train_end", "2001-01-01"), ("train_rows", 1), ("model_version", "v2"), ("digest", "x"), ("parameters", ())])
def test_another_definition_is_refused(spark, frozen, field, value):
    path, manifest, _ = frozen
    with pytest.raises(artifacts.Refused, match=field):
        artifacts.load(spark, path, artifacts.Manifest(**{**vars(manifest), field: value}))


def test_changed_files_and_overwriting_are_refused(spark, frozen, tmp_path):
    path, manifest, model = frozen
    with pytest.raises(Exception, match="already exists"):
        artifacts.save(model, manifest, path)
    copy = str(tmp_path / "copy")
    artifacts.save(model, manifest, copy)
    for folder, _, names in os.walk(f"{copy}/model"):
        for n in names:
            if n.startswith("part-") and "metadata" in folder and "LogisticRegression" in folder:
                with open(f"{folder}/{n}", "a") as f:
                    f.write(" ")
                if os.path.exists(f"{folder}/.{n}.crc"):
                    os.remove(f"{folder}/.{n}.crc")
    with pytest.raises(artifacts.Refused):
        artifacts.load(spark, copy, artifacts.Manifest.read(artifacts._text(spark, f"{copy}/manifest")))
    with pytest.raises(ValueError, match="fields"):
        artifacts.Manifest.read(json.dumps({"model_version": "v1"}))


# ------------------------------------------------------------------ forward

HISTORY = "race_id string, race_date date, post_position long, horse_name string, jockey string, finish_position double, win_odds double, field_size long"


def frames(spark, day):
    old = spark.createDataFrame([("A", D(2020, 1, 1), 1, "x", "J", 1.0, 2.0, 2), ("A", D(2020, 1, 1), 2, "y", "K", 2.0, 3.0, 2)], HISTORY)
    new = spark.createDataFrame([("F", day, 1, "x", "J", 2), ("F", day, 2, "y", "K", 2)], "race_id string, race_date date, post_position long, horse_name string, jockey string, field_size long")
    return old, new


def features(df):
    return history.prior_history(history.outcomes(history.finish_percentile(df)), ["jockey"], "jockey")


def test_future_entries_see_the_history_only(spark):
    got = {r.post_position: r for r in forward.future_frame(*frames(spark, D(2020, 1, 10)), features, ["jockey_past_win_rate"]).collect()}
    assert got[1].jockey_past_win_rate == 1.0 and got[2].jockey_past_win_rate == 0.0 and got[1].finish_position is None and got[1].history_cutoff == D(2020, 1, 1)


@pytest.mark.parametrize("day, options, fault", [(D(2020, 1, 1), {}, "later than the history"), (D(2020, 1, 16), {}, "stale: 15 days"), (D(2020, 1, 15), {}, None), (D(2020, 1, 16), {"allow_stale": True}, None)])
def test_future_dates(spark, day, options, fault):
    got = forward.future_frame(*frames(spark, day), features, [], **options)
    if fault:
        with pytest.raises(Exception, match=fault):
            got.collect()
    else:
        assert got.count() == 2
    with pytest.raises(ValueError, match="missing features: nothing"):
        forward.future_frame(*frames(spark, day), features, ["nothing"])


@pytest.mark.parametrize("p, good", [([0.5, 0.5], True), ([0.5, 0.4], False), ([0.5, None], False), ([float("nan"), 1.0], False)])
def test_sums_are_checked_where_rows_are_made(spark, p, good):
    rows = spark.createDataFrame([("A", v) for v in p] + [("B", 1.0)], "race_id string, p double")
    checked = forward.normalised(rows, "p")
    if good:
        assert checked.count() == 3
    else:
        with pytest.raises(Exception, match="p of race A sums to"):
            checked.collect()


def test_filters_of_intake(spark):
    rows = spark.createDataFrame([("A", 1, "x", None), ("A", 2, "　", ""), ("A", None, "y", "0"), ("B", 1, "z", "1"), ("A", 3, "w", " 0 ")], "race_id string, post_position long, horse_name string, abnormal string")
    assert sorted(r.horse_name for r in intake.starters(rows).collect()) == ["w", "x"]
    assert {r.race_id for r in intake.multi_runner(rows).collect()} == {"A"}
    dated = spark.createDataFrame([(D(2020, 1, 1),), (D(2020, 1, 2),), (None,)], "race_date date")
    assert [r.race_date for r in intake.from_training_start(dated, "2020-01-02").collect()] == [D(2020, 1, 2)]
    with pytest.raises(Exception, match="no rows from the start"):
        intake.from_training_start(dated, "2021-01-01").collect()


@pytest.mark.parametrize("parsed, status", [([], "no_races_after_base"), ([("B", 1, D(2020, 1, 1), 1.0)], "no_races_after_base"), ([("B", 1, D(2020, 1, 5), 2.0)], "no_single_winner_races"), ([("B", 1, D(2020, 1, 5), 1.0)], "ready"), ([("B", 1, D(2020, 2, 5), 1.0), ("C", 1, D(2020, 2, 6), None)], "ready_recent_history_gap")])
def test_current_history(spark, parsed, status):
    kind = "race_id string, post_position long, race_date date, finish_position double"
    base = spark.createDataFrame([("A", 1, D(2020, 1, 1), 1.0)], kind)
    got, report = current.current_history(base, spark.createDataFrame(parsed, kind), "feed", "x", "y")
    said = report.first()
    assert said.status == status and said.history_rows == got.count()
    strict = current.current_history(base, spark.createDataFrame(parsed, kind), "feed", "x", "y", allow_gap=False)[1].first()
    assert strict.status == ("blocked_history_gap" if status.endswith("gap") else status)
    assert current.current_history(base.limit(0), spark.createDataFrame(parsed, kind), "feed", "x", "y")[1].first().status == "no_base"


SUPPLEMENT = "race_id string, horse_name string, race_date date, finish_position double, win_odds double"


@pytest.mark.parametrize("rows, options, errors, warnings", [
    ([("B", "x", D(2020, 1, 5), 1.0, 2.0), ("B", "y", D(2020, 1, 5), 2.0, 3.0)], {"redistributable": True}, "", ""),
    ([], {}, "empty_supplement", "not_redistributable"),
    ([("B", "x", D(2020, 1, 1), 1.0, 2.0)], {"approved": False}, "not_after_base,not_approved", "not_redistributable"),
    ([("B", "x", D(2020, 2, 1), 1.0, 2.0)], {}, "history_gap", "not_redistributable"),
    ([("B", "x", D(2020, 2, 1), 1.0, 2.0)], {"allow_gap": True}, "", "history_gap,not_redistributable"),
    ([("A", "a", D(2020, 1, 5), 1.0, 2.0), ("A", "a", D(2020, 1, 6), None, 2.0)], {}, "duplicate_keys,overlapping_keys,invalid_results,race_date_conflicts", "not_redistributable"),
    ([("B", None, D(2020, 1, 5), 0.0, 1.0), ("B", None, None, 3.0, None)], {}, "duplicate_keys,invalid_results,invalid_odds,race_date_conflicts,winner_conflicts", "not_redistributable"),
])
def test_review_of_an_intake(spark, rows, options, errors, warnings):
    base = spark.createDataFrame([("A", "a", D(2020, 1, 1), 1.0, 2.0)], SUPPLEMENT)
    got = intake.review(base, spark.createDataFrame(rows, SUPPLEMENT), **{"approved": True, **options}).first()
    assert (got.errors, got.warnings, got.status) == (errors, warnings, "blocked" if errors else "ready")
    empty = intake.review(base.limit(0), spark.createDataFrame(rows, SUPPLEMENT), True).first()
    assert "empty_base" in empty.errors and empty.gap_days is None


# ------------------------------------------------------------------- choice


def candidates(spark):
    rng = np.random.default_rng(7)
    w = np.array([1.5, -0.7, 0.3])
    rows = []
    for r in range(300):
        x = rng.normal(size=(rng.integers(2, 7), 3))
        pick = int(np.argmax(x @ w + rng.gumbel(size=len(x))))
        rows += [(r, *map(float, v), int(k == pick)) for k, v in enumerate(x)]
    rows += [(1000, 1.0, 1.0, 1.0, 0), (1001, 1.0, 1.0, 1.0, 1), (1001, 2.0, 1.0, 1.0, 1), (1002, 1.0, None, 1.0, 1), (1002, 1.0, 1.0, 1.0, 0)]
    return spark.createDataFrame(rows, "race_id long, a double, b double, c double, hit int"), rows


def test_conditional_logit(spark):
    """Derivatives against numpy at a point, and by differences; the fit against numpy's own Newton."""
    df, rows = candidates(spark)
    sets = Scratch(spark, "choice-test").save(choice.choice_sets(df.repartition(5), "race_id", ["a", "b", "c"], "hit"), "sets")
    assert sets.count() == 300
    groups = [[(np.array(r[1:4]), r[4]) for r in rows if r[0] == k] for k in range(300)]

    def plain(w):
        like, g, h = 0.0, np.zeros(3), np.zeros((3, 3))
        for race in groups:
            x = np.array([v for v, _ in race])
            p = np.exp(x @ w - (x @ w).max())
            p /= p.sum()
            pick = [hit for _, hit in race].index(1)
            like += np.log(p[pick])
            g += x[pick] - p @ x
            h += (x * p[:, None]).T @ x - np.outer(p @ x, p @ x)
        return like, g, h

    w = np.array([0.3, -0.2, 0.9])
    like, g, h, n = choice.derivatives(sets, w)
    want = plain(w)
    assert n == 300 and np.isclose(like, want[0]) and np.allclose(g, want[1]) and np.allclose(h, want[2])
    step = 1e-5
    assert np.allclose([(plain(w + step * e)[0] - plain(w - step * e)[0]) / 2 / step for e in np.eye(3)], g, atol=1e-4)
    fitted = choice.fit(sets, ["a", "b", "c"], l2=0.0)
    at = np.zeros(3)
    for _ in range(30):
        _, g, h = plain(at)
        at = at + np.linalg.solve(h, g)
    assert np.allclose(fitted.weights, at, atol=1e-5) and fitted.races == 300
    top = fitted.score(df.limit(1)).first()
    assert np.isclose(top.score, np.dot(fitted.weights, [top.a, top.b, top.c]))


def test_choice_without_races(spark):
    df, _ = candidates(spark)
    sets = choice.choice_sets(df.where("race_id >= 1000"), "race_id", ["a", "b", "c"], "hit")
    assert sets.count() == 0 and (choice.fit(sets, ["a", "b", "c"]).weights == 0).all()


# ----------------------------------------------------------------- stacking


def test_no_model_predicts_a_year_that_it_saw(spark, monkeypatch):
    rows = runners(spark, 120, 5)
    seen = []

    def watched(inner, level):
        def predict(train, test):
            a = {r.year for r in train.select("year").distinct().collect()}
            b = {r.year for r in test.select("year").distinct().collect()}
            seen.append((level, a, b))
            return inner(train, test)

        return predict

    first = {"plain": watched(stacking.binary(["form"], ["surface"], "top3", "plain"), 1), "aged": watched(stacking.binary(["form", "age"], [], "top3", "aged"), 1)}
    second = stacking.second_level
    monkeypatch.setattr(stacking, "second_level", lambda *a: watched(second(*a), 2))
    got = stacking.stacked(rows, first, "top3", "market_implied_probability", Scratch(spark, "stack-test"), F.col("post_position") <= 3).collect()
    assert all(max(a) < min(b) for _, a, b in seen)
    assert {y for level, _, b in seen for y in b if level == 1} == {2001, 2002, 2003, 2004} and {y for level, _, b in seen for y in b if level == 2} == {2002, 2003, 2004}
    assert min(min(a) for level, a, _ in seen if level == 2) == 2001  # the first year has no first-level prediction
    assert {r.year for r in got} == {2002, 2003, 2004} and all(r.first_trained_until < r.year and r.stacked_trained_until < r.year for r in got)
    assert all(0 < r.stacked < 1 and r.post_position <= 3 for r in got)
    assert stacking.stacked(rows.where("year = 2000"), first, "top3", "market_implied_probability", Scratch(spark, "stack-test")).count() == 0


def test_what_a_first_level_leaves(spark):
    """The remainder is learned from earlier years only and held within its bound."""
    rows = runners(spark, 160, 4).withColumn("base", F.lit(0.75))
    level = stacking.residual_level(["form"], "base", "top3", "adjusted", rounds=5, depth=2, step=0.3, bound=0.2)
    got = level(rows.where("year < 2003"), rows.where("year = 2003")).collect()
    assert got and all(0.55 - 1e-9 <= r.adjusted <= 0.95 + 1e-9 for r in got)
    best, worst = (np.mean([r.adjusted for r in got if f(r.form)]) for f in (lambda x: x > 1, lambda x: x < -1))
    assert best > worst


def test_missing_categories_take_the_mode(spark):
    rows = runners(spark)
    assert models.modes(rows, ["surface"]) == {"surface": "b"}
    model = models.fit_logistic(rows, ["form", "age"], ["surface"])
    filled = model.transform(rows.where("surface IS NULL"))
    assert {r.surface_m for r in filled.select("surface_m").collect()} == {"b"}
    means = np.mean([r.scaled.toArray() for r in model.transform(rows).select("scaled").collect()], axis=0)
    assert np.allclose(means, 0, atol=1e-9)


# ------------------------------------------------------------------ lineage


def test_lineage_finds_an_outcome_three_steps_up(spark):
    rows = frames(spark, D(2020, 2, 1))[0]
    a = rows.withColumn("speed", 1 / F.col("finish_position")).withColumn("harmless", F.col("speed") * 2 + F.col("field_size"))
    b = a.groupBy("race_id").agg(F.avg("harmless").alias("race_strength")).withColumnRenamed("race_strength", "innocent")
    c = rows.join(b, "race_id").unionByName(rows.withColumn("innocent", F.lit(0.0)))
    found = lineage.audit(c.withColumn("log_odds", F.log("win_odds")), ["innocent", "log_odds", "field_size"], {"finish_position"}, {"win_odds"})
    assert found == [("innocent", "finish_position", "leak"), ("log_odds", "win_odds", "needs_asof")]
    with pytest.raises(ValueError, match="innocent: leak from finish_position"):
        lineage.assert_safe(c, ["innocent"], {"finish_position"})


def test_outcomes_of_the_past_are_no_leak(spark):
    rows = frames(spark, D(2020, 2, 1))[0]
    past = Window.partitionBy("jockey").orderBy("race_date").rowsBetween(Window.unboundedPreceding, -1)
    now = Window.partitionBy("jockey").orderBy("race_date").rowsBetween(Window.unboundedPreceding, 0)
    df = features(rows).withColumns({"mean": F.avg("finish_position").over(past), "last": F.lag("finish_position").over(Window.partitionBy("jockey").orderBy("race_date")), "cheat": F.avg("finish_position").over(now), "rank": F.row_number().over(Window.partitionBy("race_id").orderBy("finish_position"))})
    found = lineage.audit(df, ["mean", "last", "cheat", "rank", "jockey_past_starts", "jockey_past_win_rate", "jockey"], {"finish_position"})
    assert [f for f, *_ in found] == ["cheat", "rank"]
    assert ("finish_position", "past") in lineage.lineage(df)["jockey_past_win_rate"]
    exploded = rows.select("race_id", F.explode(F.array("finish_position", "win_odds")).alias("v"))
    assert [s for _, s, _ in lineage.audit(exploded, ["v"], {"finish_position"}, {"win_odds"})] == ["finish_position", "win_odds"]
    mapped = rows.mapInArrow(lambda b: b, rows.schema)
    assert lineage.audit(mapped, ["jockey"], {"finish_position"})  # a Python function may have used it
    safe = market.market_probability(rows)
    assert lineage.audit(safe, ["market_implied_probability"], {"finish_position"}, {"win_odds"}) == [("market_implied_probability", "win_odds", "needs_asof")]
    with pytest.raises(ValueError, match="no such columns"):
        lineage.audit(rows, ["nothing"], set())


# -------------------------------------------------------------------- gates


def test_gates(spark):
    rows = spark.createDataFrame([("a", 0.5, 10, -0.1), ("b", None, 10, 0.0), ("c", 0.0, 1, float("nan")), ("d", 9.0, None, None)], "k string, roi double, n long, delta double")
    rules = [gates.Gate("roi", "roi", support=(("n", 5),)), gates.Gate("delta", "delta", below=True), gates.Gate("least", "roi", 0.5, inclusive=True)]
    got = {(r.k, r.gate): r.status for r in gates.table(rows, rules, ["k"]).collect()}
    assert [got[k, "roi"] for k in "abcd"] == ["passed", "unavailable", "insufficient", "insufficient"]
    assert [got[k, "delta"] for k in "abcd"] == ["passed", "failed", "unavailable", "unavailable"]
    assert [got[k, "least"] for k in "abcd"] == ["passed", "unavailable", "failed", "passed"]
    said = {r.k: r for r in gates.verdict(gates.table(rows, rules, ["k"]), ["k"]).collect()}
    assert said["a"].passed and said["a"].reasons == "" and said["c"].reasons == "delta:unavailable,least:failed,roi:insufficient" and said["d"].gates_passed == 1


# ------------------------------------------------------ forward paper runs


def test_forward_paper_run(spark, tmp_path):
    """A frozen model on entries with a quote each: recorded once, starters only, sums checked."""
    from racelab.sources.ledger_table import LedgerTable
    from racelab.streaming import forward_paper

    rows = runners(spark).withColumns({"horse_name": F.concat(F.lit("H"), F.col("post_position").cast("string")), "finish_position": F.when(F.col("is_winner") == 1, 1.0).otherwise(2.0), "win_odds": F.lit(4.0)})
    path = str(tmp_path / "model")
    manifest = artifacts.save(models.fit_logistic(rows, ["form", "age"], ["surface"]), artifacts.Manifest("v9", "e", ("form", "age"), ("surface",), "2000-01-01", "2000-12-28", rows.count()), path)
    model = artifacts.load(spark, path, manifest)
    history_ = rows.drop("is_winner", "top3", "year", "market_implied_probability")
    last = rows.agg(F.max("race_date")).first()[0]
    day = last + dt.timedelta(days=3)
    entries = spark.createDataFrame([("F1", day, k, 2.0 if k == 1 else -1.0, 3.0, "a", f"H{k}", "0" if k < 4 else "1") for k in (1, 2, 3, 4)], "race_id string, race_date date, post_position long, form double, age double, surface string, horse_name string, abnormal string")
    at = F.to_timestamp(F.lit(f"{day} 10:00:00"))
    post = dt.datetime.combine(day, dt.time(10, 30))
    quotes = spark.createDataFrame([("F1", f"F1-{k}", post - dt.timedelta(minutes=35), 4.0, post) for k in (1, 2, 3, 4)], "race_id string, horse_id string, observed_at timestamp, decimal_odds double, scheduled_post_time timestamp")
    got = forward_paper.predictions(model, history_, entries, lambda df: df, at).collect()
    assert sorted(r.horse_id for r in got) == ["F1-1", "F1-2", "F1-3"] and sum(r.probability for r in got) == pytest.approx(1.0) and {r.history_cutoff for r in got} == {last}
    table = LedgerTable(spark, str(tmp_path / "ledger"))
    assert forward_paper.run(model, history_, entries, lambda df: df, quotes, table, 100_000, at, batch=0) == 3
    assert forward_paper.run(model, history_, entries, lambda df: df, quotes, table, 100_000, at, batch=0) == 0
    assert forward_paper.run(model, history_, entries, lambda df: df, quotes, table, 100_000, at, batch=1) == 0
    held = {r.horse_id: r for r in table.read().collect()}
    assert held["F1-1"].stake > 0 and held["F1-1"].model_version == "v9" and held["F1-2"].stake == 0
    with pytest.raises(Exception, match="stale"):
        forward_paper.run(model, history_, entries.withColumn("race_date", F.date_add("race_date", 40)), lambda df: df, quotes, table, 100_000, at)


def test_complete_fits_take_categories_of_unequal_size(spark):
    rows = runners(spark).withColumn("kind", F.concat(F.lit("k"), (F.col("post_position") % 3).cast("string")))
    lacking = models.missing(rows, ["form", "age"])
    both = [fit.transform(rows) for fit in (models.fit_complete(rows, ["form", "age"], ["surface", "kind"], lacking, "is_winner"), models.fit_logistic(rows, ["form", "age"], ["surface", "kind"]))]
    got, want = ({(r.race_id, r.post_position): r.probability[1] for r in df.collect()} for df in both)
    assert lacking == ["age"] and got == pytest.approx(want, abs=1e-9)
