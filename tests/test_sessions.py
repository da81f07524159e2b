"""Sessions with state, reconciliation, and the ledger table."""

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from racelab.sources import ledger_table as lt
from racelab.streaming import exposure, reconcile

D, T = dt.date, dt.datetime
ASK = "day date, race_id string, sequence long, desired long, bankroll double, asked_at timestamp"
LIMITS = exposure.Limits(day=0.1, race=0.04, unit=100, least=200)


def ask(day, race, sequence, desired, bankroll=20000.0, hour=10):
    return (D(2020, 1, day), race, sequence, desired, bankroll, T(2020, 1, day, hour))


def brute(rows, limits=LIMITS):
    """{sequence: (stake, reason)} by a plain loop."""
    down = lambda v: int(max(0.0, v) // limits.unit * limits.unit)
    days, races, out = {}, {}, {}
    for day, race, sequence, desired, bankroll, _ in sorted(rows, key=lambda r: r[2]):
        if desired <= 0:
            out[sequence] = (0, "not_asked")
            continue
        d = days.setdefault(day, [down(bankroll * limits.day), 0])
        r = races.setdefault((day, race), [down(bankroll * limits.race), 0])
        stake = down(min(desired, bankroll, max(0, d[0] - d[1]), max(0, r[0] - r[1])))
        stake = stake if stake >= limits.least else 0
        d[1] += stake
        r[1] += stake
        out[sequence] = (stake, "selected" if stake == desired else "selected_budget_capped" if stake else "race_or_day_budget_exhausted")
    return out


FIRST = [ask(1, "A", 1, 500), ask(1, "A", 2, 700, 90000.0), ask(1, "B", 3, 0), ask(1, "B", 4, 800), ask(2, "A", 5, 300)]
SECOND = [ask(1, "A", 6, 400), ask(1, "C", 7, 900), ask(1, "D", 8, 300, 500.0), ask(2, "E", 9, 1000), ask(3, "A", 10, 150)]


class Session:
    def __init__(self, spark, tmp_path, name):
        self.spark, self.at = spark, tmp_path / name
        self.n = 0

    def run(self, rows, seed=None, **options):
        self.n += 1
        df = self.spark.createDataFrame(rows, ASK)
        df.coalesce(1).write.mode("append").parquet(str(self.at / "in"))
        stream = self.spark.readStream.schema(df.schema).parquet(str(self.at / "in"))
        got = exposure.exposures(stream, LIMITS, seed, **options)
        schema, got = got.schema, got.writeStream.format("parquet").option("path", str(self.at / "out")).option("checkpointLocation", str(self.at / "c"))
        if options.get("event_time", "asked_at") is None:  # such a query has always another batch to run
            self.query = got.trigger(processingTime="1 second").start()
            for _ in range(120):
                if sum(p.numInputRows for p in self.query.recentProgress) >= len(rows):
                    break
                time.sleep(0.5)
            self.query.stop()
        else:
            self.query = got.trigger(availableNow=True).start()
            self.query.awaitTermination(180)
        return {r.sequence: (r.stake, r.reason) for r in self.spark.read.schema(schema).parquet(str(self.at / "out")).collect()}


def test_two_batches_share_state(spark, tmp_path):
    one = Session(spark, tmp_path, "a")
    assert one.run(FIRST, late="3 days") == brute(FIRST)
    assert one.run(SECOND, late="3 days") == brute(FIRST + SECOND)


def test_restart_from_the_ledger_gives_the_same_stakes(spark, tmp_path):
    stakes = brute(FIRST)
    rows = [(r[0], r[1], r[2], stakes[r[2]][0], r[4]) for r in FIRST]
    recorded = spark.createDataFrame(rows, "day date, race_id string, sequence long, stake long, bankroll double")
    got = Session(spark, tmp_path, "b").run(SECOND, exposure.seeded(recorded, LIMITS))
    want = brute(FIRST + SECOND)
    assert got == {r[2]: want[r[2]] for r in SECOND}


def test_a_past_day_leaves_the_state(spark, tmp_path):
    one = Session(spark, tmp_path, "c")
    one.run(FIRST, late="10 minutes", grace_hours=1)
    one.run([ask(9, "Z", 20, 100)], late="10 minutes", grace_hours=1)
    one.run([ask(9, "Z", 21, 100)], late="10 minutes", grace_hours=1)
    held = [json.loads(p.json)["stateOperators"][0]["customMetrics"] for p in one.query.recentProgress if json.loads(p.json)["stateOperators"]]
    left = spark.read.format("statestore").option("stateVarName", "day").load(str(one.at / "c")).select("key.day").collect()
    assert held and [r.day for r in left] == [D(2020, 1, 9)]


def test_without_event_time_entries_have_a_time_to_live(spark, tmp_path):
    one = Session(spark, tmp_path, "d")
    assert one.run(FIRST, event_time=None, ttl_hours=1) == brute(FIRST)
    assert one.run(SECOND, event_time=None, ttl_hours=1) == brute(FIRST + SECOND)


def test_stakes_of_a_table(spark):
    got = exposure.exposures(spark.createDataFrame(FIRST + SECOND, ASK), LIMITS).collect()
    assert {r.sequence: (r.stake, r.reason) for r in got} == brute(FIRST + SECOND)
    assert exposure.exposures(spark.createDataFrame([], ASK), LIMITS).count() == 0


# ----------------------------------------------------------- reconciliation


def test_unmatched_bets_leave_after_the_watermark(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    bets = "bet_id long, race_id string, post_position long, post_time timestamp"
    results = "race_id string, post_position long, finish_position long, result_at timestamp"

    def run():
        b = spark.readStream.schema(bets).parquet(str(tmp_path / "b"))
        r = spark.readStream.schema(results).parquet(str(tmp_path / "r"))
        q = reconcile.reconciled(b, r, "2 days", "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        rows = spark.read.schema("bet_id long, status string, finish_position long").parquet(str(tmp_path / "out")).collect()
        return {x.bet_id: (x.status, x.finish_position) for x in rows}, q

    write("b", [(1, "A", 1, T(2020, 1, 1, 10)), (2, "A", 2, T(2020, 1, 1, 10)), (3, "B", 1, T(2020, 1, 1, 11))], bets)
    write("r", [("A", 1, 4, T(2020, 1, 1, 12)), ("A", 9, 1, T(2020, 1, 1, 12)), ("B", 1, 2, T(2020, 1, 1, 9))], results)
    assert run()[0] == {1: ("settled", 4)}
    write("b", [(4, "C", 1, T(2020, 1, 9, 10))], bets)
    write("r", [("C", 1, 1, T(2020, 1, 9, 12)), ("A", 2, 1, T(2020, 1, 2, 9))], results)
    got, _ = run()
    write("b", [(5, "D", 1, T(2020, 1, 9, 11))], bets)
    write("r", [("X", 1, 1, T(2020, 1, 9, 13))], results)
    got, q = run()
    assert got == {1: ("settled", 4), 2: ("settled", 1), 3: ("expired", None), 4: ("settled", 1)}
    assert sum(s["numRowsTotal"] for s in json.loads(q.lastProgress.json)["stateOperators"]) <= 6


@pytest.mark.parametrize("results, status, done", [([], "pending_results", 0), ([("A", 2, 5)], "partially_reconciled", 1), ([("A", 2, 5), ("B", 1, 1)], "reconciled_all", 2), ([("B", 1, None), ("C", 1, 1)], "pending_results", 0), ([("B", 1, 1), ("B", 1, 1)], "pending_results", 0)])
def test_reconciliation_status(spark, results, status, done):
    rows = spark.createDataFrame([("A", 1, 1), ("A", 2, None), ("B", 1, None)], "race_id string, post_position long, finish_position long")
    got = reconcile.reconciliation(rows, spark.createDataFrame(results, rows.schema)).first()
    assert (got.status, got.reconciled_races, got.pending_races_before) == (status, done, 2)


def test_reconciliation_of_nothing(spark):
    rows = spark.createDataFrame([("A", 1, 1)], "race_id string, post_position long, finish_position long")
    assert reconcile.reconciliation(rows, rows.limit(0)).first().status == "no_pending_results"
    assert reconcile.reconciliation(rows.limit(0), rows).first().status == "no_pending_results"
    clash = reconcile.reconciliation(rows, spark.createDataFrame([("A", 1, 2)], rows.schema)).first()
    assert clash.conflicts == 1 and clash.new_result_rows == 0


# ------------------------------------------------------------ ledger table

ROW = "race_id string, post_position long, race_date date, finish_position long"


def race(name, day, n=2, first=1):
    return [(name, k + 1, day, first + k) for k in range(n)]


@pytest.fixture
def table(spark, tmp_path):
    t = lt.LedgerTable(spark, str(tmp_path / "table"))
    t.replace_races(spark.createDataFrame([*race("A", D(2020, 1, 5)), *race("B", D(2020, 1, 30)), *race("C", D(2020, 3, 1))], ROW), "base", 0)
    return t


def content(t):
    return sorted((r.race_id, r.post_position, r.race_date, r.finish_position) for r in t.read().collect())


def files(t):
    return sorted(os.path.join(a, n) for a, _, names in os.walk(t.root) for n in names if n.endswith(".parquet"))


def test_whole_races_are_replaced(spark, table):
    update = spark.createDataFrame([*race("B", D(2020, 2, 2), 3, 2), *race("D", D(2020, 2, 3)), *race("E", D(2020, 2, 4), 1)], ROW)
    got = table.replace_races(update, "feed", 4)
    assert (got["status"], got["replaced_races"], got["end"]) == ("refreshed_overlap_only", 2, "2020-03-01")
    want = sorted([*race("A", D(2020, 1, 5)), *race("B", D(2020, 2, 2), 3, 2), *race("C", D(2020, 3, 1)), *race("D", D(2020, 2, 3))])
    assert content(table) == want and got["rows"] == len(want)
    held = table.state()
    assert held.months["2020-03"]["folders"][0].startswith("v=1-")  # an untouched month keeps its files
    before = files(table)
    for number in (4, 3):
        assert table.replace_races(update, "feed", number)["status"] == "repeated_batch"
    assert content(table) == want and files(table) == before and table.state() == held
    assert table.replace_races(spark.createDataFrame(race("F", D(2020, 4, 1)), ROW), "feed", 5)["status"] == "updated"


def test_nothing_to_replace(spark, table):
    assert table.replace_races(spark.createDataFrame(race("Z", D(2021, 1, 1), 1), ROW))["status"] == "no_updates"
    assert table.replace_races(spark.createDataFrame([], ROW))["status"] == "no_updates"
    empty = lt.LedgerTable(spark, table.root + "-none")
    assert empty.read() is None and empty.state().end is None and empty.vacuum() == []


def test_the_end_does_not_go_back(spark, table):
    want = content(table)
    with pytest.raises(ValueError, match="would end on 2020-01-30 instead of 2020-03-01"):
        table.replace_races(spark.createDataFrame(race("C", D(2020, 1, 6)), ROW))
    assert content(table) == want and table.state().version == 1


def test_a_crash_before_the_commit_changes_nothing(spark, table, monkeypatch):
    want, update = content(table), spark.createDataFrame(race("A", D(2020, 1, 7), 3), ROW)

    def crash(self, new):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(lt.LedgerTable, "_commit", crash)
        with pytest.raises(KeyboardInterrupt):
            table.replace_races(update, "feed", 1)
    assert content(table) == want and len(files(table)) == 3
    assert table.vacuum() and content(table) == want
    assert table.replace_races(update, "feed", 1)["replaced_races"] == 1 and len(content(table)) == len(want) + 1


def test_the_second_of_two_writers_fails(spark, table, monkeypatch):
    stale = table.state()
    table.replace_races(spark.createDataFrame(race("A", D(2020, 1, 7), 3), ROW))
    want = content(table)
    with monkeypatch.context() as m:
        m.setattr(lt.LedgerTable, "state", lambda self: stale)
        with pytest.raises(lt.ConcurrentChange):
            table.replace_races(spark.createDataFrame(race("B", D(2020, 1, 7), 3), ROW))
    assert content(table) == want


def test_incremental_leaves_out_races_with_several_winners(spark, table):
    update = spark.createDataFrame([("A", 1, D(2020, 1, 5), 1), ("A", 2, D(2020, 1, 5), 1), *race("G", D(2020, 3, 2), 3)], ROW)
    got = lt.incremental(table, update, F.col("finish_position") == 1, "feed", 0)
    assert (got["status"], got["replaced_races"], got["excluded_races"]) == ("updated", 1, 1)
    assert [r for r in content(table) if r[0] == "A"] == race("A", D(2020, 1, 5))


def test_incremental_stream(spark, table, tmp_path):
    rows = spark.createDataFrame(race("G", D(2020, 3, 2), 3), ROW)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        lt.incremental_stream(stream, table.root, F.col("finish_position") == 1, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert table.state().version == 2 and table.state().batches["incremental"] == 0
    assert sum(r[0] == "G" for r in content(table)) == 3


def test_immutable_rows_and_results(spark, tmp_path):
    t = lt.LedgerTable(spark, str(tmp_path / "shadow"))
    schema = "race_id string, horse_id string, post_position long, race_date date, odds double, finish_position long"
    one = [("A", "A-1", 1, D(2020, 1, 1), 2.5, None), ("A", "A-2", 2, D(2020, 1, 1), None, None)]
    add = lambda rows, **k: t.append_immutable(spark.createDataFrame(rows, schema), ["race_id", "horse_id"], ["post_position", "race_date", "odds"], **k)
    assert add(one, writer="p", batch=0) == 2 and add(one) == 0 and add(one, writer="p", batch=0) == 0
    assert add([*one, *one, ("B", "B-1", 1, D(2020, 2, 1), 3.0, None)]) == 1
    for bad in ([("A", "A-1", 1, D(2020, 1, 1), 2.6, None)], [("A", "A-2", 2, D(2020, 1, 1), 1.5, None)], [("C", "C-1", 1, D(2020, 1, 1), 2.0, None), ("C", "C-1", 1, D(2020, 1, 1), 2.1, None)]):
        with pytest.raises(lt.Conflict):
            add(bad)
    results = lambda *rows: spark.createDataFrame(list(rows), "race_id string, post_position long, finish_position long")
    assert lt.record_results(t, results(("A", 1, 3), ("A", 2, None), ("Z", 1, 1)), "r", 0) == 1
    assert lt.record_results(t, results(("A", 1, 3)), "r", 0) == 0 and lt.record_results(t, results(("A", 1, 3))) == 0
    with pytest.raises(lt.Conflict):
        lt.record_results(t, results(("A", 1, 4)))
    assert lt.record_results(t, results(("A", 2, 1), ("B", 1, 2))) == 2
    assert sorted((r.horse_id, r.finish_position) for r in t.read().collect()) == [("A-1", 3), ("A-2", 1), ("B-1", 2)]
    assert add(one) == 0  # results are no part of a prediction
