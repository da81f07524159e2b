"""What larger tables showed: shared steps that ran several times, and keys beyond the smallest tables' range."""

import datetime as dt
import math
import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from racelab.functions.times import iso_instant
from racelab.ml import models
from racelab.operators import bootstrap, history, ledger, parameters, sequences, strategy
from racelab.plans import models as plans
from racelab.plans import ledgers, raw, validation
from racelab.sources import feed, records
from racelab.sources.ledger_table import LedgerTable, incremental
from racelab.streaming.exposure import Exposure, Limits

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_records_come_from_one_pass_and_are_cut_once(spark):
    texts = raw._texts(spark, SF)
    assert plan(texts).count("l_shipdate") and plan(texts).count("Union") == 0
    rows = records.strict(records.records(texts)).where("fault IS NULL AND record_type = 'SE'").where(F.col("course").isin("01"))
    assert plan(records.runner_rows(rows)).count("MapInArrow") == 1


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """The smallest tables with keys of jockeys past 598 and 599."""
    out = str(tmp_path_factory.mktemp("shifted"))
    for f in os.listdir(SF):
        columns = {"lineitem.parquet": "l_suppkey", "supplier.parquet": "s_suppkey"}
        change = f"REPLACE ({columns[f]} * 199 + 2 AS {columns[f]})" if f in columns else ""
        duckdb.sql(f"COPY (SELECT * {change} FROM '{SF}/{f}') TO '{out}/{f}' (FORMAT parquet)")
    return out


def test_weights_of_four_digits(spark, shifted):
    con = duckdb.connect()
    for f in os.listdir(shifted):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{shifted}/{f}'")
    key = ["race_id", "post_position"]
    want = con.sql(f"SELECT race_id, post_position, horse_weight FROM ({raw.ORACLE_SQL['raw_runners']})").df().sort_values(key)
    got = raw.raw_runners(spark, shifted).select(*key, "horse_weight").toPandas().sort_values(key)
    assert want.horse_weight.max() > 999
    assert got.fillna(-1).values.tolist() == want.fillna(-1).values.tolist()


def test_grids_multiply_no_rows(spark):
    rows = spark.createDataFrame([("a", 1, 0.5, 0.4, 1), ("a", 1, 0.5, 0.6, 0), ("b", 1, 1.0, 1.0, 0), ("c", None, 1.0, 1.0, 1)], "race_id string, year int, p double, m double, won int")
    found = parameters.losses(rows, ("blend",))
    assert plan(found).count("Generate") == 0
    got = {(r.year, r.parameter): (r.races, r.runners, round(r.loss, 9), round(r.brier, 9)) for r in found.collect()}
    assert got[1, 1.0] == (1, 3, 0.693147181, 1.5) and got[1, 0.0] == (1, 3, 0.916290732, 1.72) and got[None, 0.0] == (1, 1, 0.0, 0.0)
    assert len(got) == 2 * len(parameters.values("blend"))


def test_replicates_are_drawn_by_many_tasks(spark):
    races = spark.range(1000).select("id", F.lit(2).cast("long").alias("stake"), F.when(F.col("id") % 2 == 0, 0.5).alias("gain"))
    found = bootstrap.replicates(races.coalesce(1), "id", ["stake", "gain"], 7)
    assert "Generate" not in plan(found) and "Repartition" in plan(found)
    drawn = races.crossJoin(spark.range(7).withColumnRenamed("id", "r")).withColumn("w", bootstrap.weight(F.col("id"), F.col("r")))
    want = drawn.groupBy("r").agg(F.sum(F.col("w") * F.col("stake")).alias("stake"), F.sum(F.col("w") * F.col("gain")).alias("gain"), F.sum("w").alias("weight"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_means_of_percentiles_are_exact(spark):
    """906 sixths and 118 noughts: 151/1024, halfway between two values of nine places."""
    past = spark.range(1024).select(F.lit("2020-01-01").cast("date").alias("race_date"), F.when(F.col("id") < 906, F.lit(1 / 6)).otherwise(0.0).alias("finish_percentile"))
    last = spark.range(1).select(F.lit("2020-01-02").cast("date").alias("race_date"), F.lit(None).cast("double").alias("finish_percentile"))
    rows = past.union(last).withColumns({"t": F.lit("a"), "finish_position": F.lit(1.0), "is_winner": F.lit(1)})
    got = history.prior_history(rows, ["t"], "k").where("race_date = '2020-01-02'").first()
    assert got.k_past_percentile_mean == 151 / 1024
    # a field of 38, and no percentile at all
    odd = rows.withColumn("finish_percentile", F.when(F.col("finish_percentile") > 0, F.lit(5 / 37)))
    assert abs(history.prior_history(odd, ["t"], "k").where("race_date = '2020-01-02'").first().k_past_percentile_mean - 5 / 37) < 1e-12
    none = rows.withColumn("finish_percentile", F.lit(None).cast("double"))
    assert history.prior_history(none, ["t"], "k").where("race_date = '2020-01-02'").first().k_past_percentile_mean is None


def test_folds_share_the_exchange_of_races(spark):
    found = plans.residual_model(spark, SF)
    text = plan(found)
    assert text.count("Union") == 1 and text.count("RepartitionByExpression") == 1
    # windows stand above the union of the folds, none in a fold
    assert text.index("Window") < text.index("Union") and "Window" not in text[text.index("Union") :]
    assert spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b") in ("134217728", "128MB")


def test_keys_are_counted_apart_from_the_joins(spark):
    text = plan(validation.duplicate_keys(spark, SF))
    assert text.index("Aggregate") < text.index("RepartitionByExpression") < text.index("Join")


def test_medians_and_modes_only_where_values_lack(spark):
    """One pass gives classes, modes and categories; the fit is that of the whole pipeline."""
    rows = spark.range(400).select(F.col("id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("k'"), (F.col("id") % 3).cast("string"))).alias("c"), (F.col("id") * 7 % 13 < 5).cast("int").alias("is_winner"))
    holes = rows.withColumn("b", F.when(F.col("id") % 9 > 0, F.col("b")))
    for df, lacking in ((rows, []), (holes, ["b"]), (rows.withColumn("b", F.nanvl(F.lit(float("nan")), F.lit(float("nan")))).limit(0), [])):
        assert models.missing(df, ["a", "b"]) == lacking
    for df, lacking in ((rows, []), (holes, ["b"])):
        fitted = models.fit_complete(df, ["a", "b"], ["c"], lacking, "is_winner")
        assert sum(type(s).__name__ == "ImputerModel" for s in fitted.stages) == len(lacking)
        want = {r.id: r.probability[1] for r in models.fit_logistic(df, ["a", "b"], ["c"]).transform(df).collect()}
        assert all(abs(want[r.id] - r.probability[1]) < 1e-9 for r in fitted.transform(df).collect())


def test_a_re_read_is_judged_once(spark, tmp_path, monkeypatch):
    taken = []
    monkeypatch.setattr(LedgerTable, "replace_races", lambda self, update, *rest: taken.append(plan(update)) or {})
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 0), ("b", 1, 1), ("b", 2, 1)], "race_id string, post_position long, won int")
    assert incremental(LedgerTable(spark, str(tmp_path)), rows, F.col("won") == 1) == {"excluded_races": 1}
    assert "Window" not in taken[0]


def test_appended_rows_are_made_once(spark, tmp_path, monkeypatch):
    taken, write = [], LedgerTable._write
    monkeypatch.setattr(LedgerTable, "_write", lambda self, rows, version: taken.append(plan(rows)) or write(self, rows, version))
    rows = spark.createDataFrame([("a", "2020-01-01", 1), ("a", "2020-01-01", 1), ("b", "2020-02-01", 2)], "k string, race_date string, v long")
    table = LedgerTable(spark, str(tmp_path))
    assert table.append_immutable(rows, ["k"], ["v"]) == 2 and "Aggregate" not in taken[0]
    assert sorted((r.k, r.v) for r in table.read().collect()) == [("a", 1), ("b", 2)]


class _State:
    """State of one key that counts its calls."""

    def __init__(self):
        self.calls, self.now = 0, None

    def exists(self):
        return self.now is not None

    def get(self):
        self.calls += 1
        return iter(list(self.now)) if isinstance(self.now, list) else self.now

    def put(self, values):
        self.calls, self.now = self.calls + 1, list(values)

    update = put

    def appendList(self, values):
        self.calls, self.now = self.calls + 1, [*(self.now or []), *values]


def test_exposure_state_is_read_and_written_by_day(spark):
    day, races = _State(), _State()
    day.update = lambda v: setattr(day, "now", tuple(v))

    class Handle:
        getValueState = staticmethod(lambda *a: day)
        getListState = staticmethod(lambda *a: races)

    fold = Exposure(Limits(day=0.5, race=0.1), None, None)
    fold.init(Handle)
    stakes = []
    for batch in range(4):
        asked = pd.DataFrame([(f"r{k}", 100 * batch + k, 400, 10000.0) for k in range(50)], columns=["race_id", "sequence", "desired", "bankroll"])
        stakes += list(pd.concat(list(fold.handleInputRows((1,), iter([asked]), None))).stake)
    # a race's limit is 1000, the day's 5000
    assert stakes[:13] == [400] * 12 + [200] and sum(stakes) == 5000
    assert races.calls <= 2 * 4 and len(races.now) <= 2 * 50
    assert {r: u for r, _, u in races.now} == {f"r{k}": 400 if k < 12 else 200 if k == 12 else 0 for k in range(50)}


def test_headers_are_found_without_reading_tables(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("x,y\n" + "1,2\n" * 3000)
    lines = feed.first_lines(spark, str(tmp_path), split_bytes=4000)
    assert 2 <= lines.count() < 20 and lines.where("offset = 0").count() == 2
    assert feed.csv_table(spark, str(tmp_path), split_bytes=4000).count() == 6000
    (tmp_path / "b.csv").write_text("x,z\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        feed.csv_table(spark, str(tmp_path))


def test_instants_take_one_match(spark):
    texts = {"2020-01-01T10:00:00Z": 1577872800, " 2020-01-01 19:00+0900 ": 1577872800, "2020-01-01T10:00:00.5+00:00": 1577872800.5, "2020-01-01T10:00Z": 1577872800, "2020-01-01 05:30:00-04:30": 1577872800}
    texts |= dict.fromkeys(["2020-01-01T10:00:00", "2020-02-30T10:30:00Z", "2020-01-01T25:00Z", "2020-01-01T10:00+1900", "2020-01-01", "", None, "2020-01-01T10:00:00ZZ"])
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", iso_instant(F.col("t")).alias("at"))
    assert "regexp_" not in plan(got)
    assert {r.t: r.s for r in got.select("t", (F.unix_micros("at") / 1e6).alias("s")).collect()} == texts


def test_guards_take_no_join(spark):
    rows = spark.createDataFrame([("a", "x", 0.5), ("a", "x", 2.0), (None, "y", 0.5), (None, "y", 0.5), ("b", "z", 0.5)], "race_id string, horse_id string, probability double")
    rows = rows.withColumns({"horse_name": F.lit("n"), "model_version": F.lit("v"), "confidence": F.lit(0.5)})
    found = ledger.with_input_faults(rows)
    assert "Join" not in plan(found)
    assert sorted((r.horse_id, r.faults) for r in found.where("faults IS NOT NULL").collect()) == [("x", "duplicate"), ("x", "probability,duplicate"), ("y", "blank_race_id"), ("y", "blank_race_id")]


def test_bankroll_goes_on_from_stretch_to_stretch(spark):
    """Stretches that cut days but no race, with and without races that take their whole cap; the tie goes by post."""
    rng = random.Random(5)
    rows = [(dt.date(2020, 1, 1 + k // 60), k // 3, rng.choice((0.3, 0.5)), rng.choice((2.2, 4.0, 9.0)), int(rng.random() < 0.4), k % 3) for k in range(600)]
    candidates = spark.createDataFrame(rows, "race_date date, rid long, p double, win_odds double, is_winner int, post int").repartition(5)
    names = spark.createDataFrame([("low", 0.0), ("high", 0.5)], "s string, least double")
    got = strategy.simulate(candidates, "s", deal=lambda r: r.join(F.broadcast(names), F.col("p") >= F.col("least")), ties=("post",), stretch=70)
    assert len(set(f.rsplit("/", 1)[0] for f in got.inputFiles())) >= 8
    found = sorted((r.s, r.race_date, r.rid, r.bankroll, r.stake, r.payout, round(r.drawdown, 12)) for r in got.collect())
    want = []
    for name, least in (("low", 0.0), ("high", 0.5)):
        money = peak = 100_000.0
        day, day_left, race, race_left, pending = None, 0, None, 0, []
        mine = sorted((r for r in rows if r[2] >= least), key=lambda r: (r[0], r[1], -(r[2] * r[3] - 1), -r[2], r[5]))
        for r in [*mine, None]:
            if r is None or (r[0], r[1]) != race:
                for stake, paid in pending:
                    money += paid - stake
                    peak = max(peak, money)
                    want.append((name, *race, money, stake, paid, round(1 - money / peak, 12)))
                if r is None:
                    break
                if r[0] != day:
                    day, day_left = r[0], math.floor(money * 0.2 / 100) * 100
                race, pending = (r[0], r[1]), []
                race_left = min(day_left, math.floor(min(money * 0.05, 5000) / 100) * 100)
            kelly = max(0.0, min(1.0, (r[2] * r[3] - 1) / (r[3] - 1)))
            stake = int(min(math.floor(money * kelly * 0.25 / 100) * 100, race_left))
            if stake >= 100:
                race_left, day_left = race_left - stake, day_left - stake
                pending.append((stake, round(stake * r[3]) if r[4] else 0))
    assert found == sorted(want) and {s for *_, s, _, _ in want} > {5000}


def test_draws_take_no_product_for_each_replicate():
    """The same weights as by the products, up to the largest number; beyond it the products are used."""
    number = np.array([0, 1, 65520, 65521, 65522, 2147483647, bootstrap._LARGEST - 1, bootstrap._LARGEST] + list(range(7, 90_000_000, 1_234_567)))
    value = np.arange(len(number)) + 1.0
    total = np.zeros((5000, 2))
    bootstrap._add_draws(total, number, [value])
    weights = bootstrap._weights(number, np.arange(5000))
    assert (total[:, 0] == value @ weights).all() and (total[:, 1] == weights.sum(0)).all()


def test_negative_numbers_weigh_nothing(spark):
    races = spark.createDataFrame([(-5, 3), (4, 2), (6, 7)], "id long, stake long")
    both = [sorted(map(tuple, bootstrap.replicates(r.coalesce(1), "id", ["stake"], 50).collect())) for r in (races, races.where("id >= 0"))]
    assert both[0] == both[1]


def test_settlement_computes_the_runners_once(spark):
    reads = [plan(df).count("Relation") for df in (ledgers.bets(spark, SF), ledgers._settled(spark, SF))]
    assert 0 < reads[0] == reads[1]


def test_extremes_are_those_of_running_totals(spark):
    rng = random.Random(3)
    for wins in (0.0, 0.05, 0.4, 1.0):
        rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=k // 4), k, int(rng.random() < wins)) for k in range(200) if k // 4 % 5]
        df = spark.createDataFrame([(*r, 150 if r[2] else -100) for r in rows], "day date, id long, won int, profit long")
        run = sequences.running(df, "profit", "day", ["id"]).agg(F.max(F.col("peak") - F.col("total"))).first()[0]
        longest = sequences.streaks(df, "won", "day", ["id"]).first().longest
        assert tuple(sequences.extremes(df, "profit", "won", "day", ["id"]).first()) == (run, longest)
    assert tuple(sequences.extremes(df.where("id < 0"), "profit", "won", "day", ["id"]).first()) == (0, 0)
