"""Rules, the bankroll, and the paper session against plain loops."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from racelab.functions import betting
from racelab.operators import rules, strategy
from racelab.sources import ledger_table as lt
from racelab.streaming import paper

D, T = dt.date, dt.datetime


# -------------------------------------------------------------------- rules


def test_no_rule_without_rows(spark):
    rows = spark.createDataFrame([("A", 1, 0.5, 0.4, 2.5, 1, "learn")], "race_id string, post_position long, p double, m double, odds double, won int, part string")
    found = rules.measured(rows, rules.grid(spark), F.col("part"))
    assert {r.status for r in rules.fitted(found, "learn", "judge").collect()} == {"no_eligible_rule"}
    got = {r.rule: r for r in rules.fitted(found, "learn", "judge", 1, 1).collect()}
    assert got["ev"].threshold == 1.0 and got["ev"].judged_rows == 0 and got["ev"].judged_flat_roi is None
    assert got["longshot"].status == "no_eligible_rule" and got["edge_segment"].segment == "short"
    assert rules.measured(rows.limit(0), rules.grid(spark), F.col("part")).count() == 0


# ----------------------------------------------------------------- bankroll


def test_bankroll_against_a_plain_loop(spark):
    rng = random.Random(2)
    rows = [(s, D(2020, 1, 1) + dt.timedelta(days=k // 12), k // 4, rng.choice((0.2, 0.4, 0.55)), rng.choice((2.0, 3.5, 6.0)), int(rng.random() < 0.3)) for s in "ab" for k in range(120)]
    got = {}
    for r in strategy.simulate(spark.createDataFrame(rows, "s string, race_date date, rid long, p double, win_odds double, is_winner int").repartition(7), "s").collect():
        got.setdefault(r.s, []).append((r.rid, r.stake, r.payout, round(r.bankroll, 6), round(r.drawdown, 9)))
    for s in "ab":
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2], -(r[3] * r[4] - 1), -r[3]))
        money = peak = 100_000.0
        day, day_left, want = None, 0, []
        for race in sorted({(r[1], r[2]) for r in mine}):
            if race[0] != day:
                day, day_left = race[0], math.floor(money * 0.2 / 100) * 100
            race_left, bets = min(day_left, math.floor(min(money * 0.05, 5000) / 100) * 100), []
            for r in [x for x in mine if (x[1], x[2]) == race]:
                kelly = max(0.0, min(1.0, (r[3] * r[4] - 1) / (r[4] - 1)))
                stake = int(min(math.floor(money * kelly * 0.25 / 100) * 100, race_left))
                if stake >= 100:
                    race_left -= stake
                    day_left -= stake
                    bets.append((stake, round(stake * r[4]) if r[5] else 0))
            for stake, paid in bets:
                money += paid - stake
                peak = max(peak, money)
                want.append((race[1], stake, paid, round(money, 6), round(1 - money / peak, 9)))
        assert got[s] == want and len(want) > 10


# ------------------------------------------------------------ paper session

PRED = "race_id string, horse_id string, horse_name string, model_version string, probability double, confidence double, predicted_at timestamp, sequence long"
QUOTE = "race_id string, horse_id string, observed_at timestamp, decimal_odds double, scheduled_post_time timestamp"


def session(seed=1, races=12):
    rng = random.Random(seed)
    predictions, quotes = [], []
    for r in range(races):
        post = T(2020, 1, 1 + r % 3, 12, r)
        for k in range(4):
            name = f"R{r}-{k}"
            predictions.append((f"R{r}", name, "x", "v1", rng.choice((0.05, 0.3, 0.5)), 0.5, post - dt.timedelta(minutes=20), r * 10 + k))
            quotes.append((f"R{r}", name, post - dt.timedelta(minutes=60), 9.9, post))
            if (r + k) % 7:
                quotes.append((f"R{r}", name, post - dt.timedelta(minutes=25), rng.choice((1.5, 3.0, 8.0)), post))
    return predictions, quotes


def plain(predictions, quotes, bankroll, c, stakes_before=()):
    used, limits, race_limits, race_used, out = {}, {}, {}, {}, {}
    down = lambda v: math.floor(max(0.0, v) / c.unit) * c.unit
    for day, race, stake in stakes_before:
        limits.setdefault(day, down(bankroll * c.day))
        race_limits.setdefault((day, race), down(bankroll * c.race))
        used[day] = used.get(day, 0) + stake
        race_used[day, race] = race_used.get((day, race), 0) + stake
    for race, horse, name, _, p, _, at, n in sorted(predictions, key=lambda x: x[7]):
        seen = [q for q in quotes if q[:2] == (race, horse) and q[2] <= at]
        if not seen or at - max(seen, key=lambda q: q[2])[2] > dt.timedelta(minutes=c.most_age_minutes):
            out[n] = (0, "stale" if seen else "no_quote")
            continue
        _, _, _, odds, post = max(seen, key=lambda q: q[2])
        day = post.date()
        if p < c.min_p or p * odds < c.min_value:
            out[n] = (0, "probability_below_minimum" if p < c.min_p else "expected_value_below_minimum")
            continue
        left = bankroll - used.get(day, 0)
        money = left if left > 0 else bankroll
        kelly = max(0.0, min(1.0, (p * odds - 1) / (odds - 1)))
        desired = down(min(money * min(kelly * c.share, c.race), c.cap))
        desired = desired if desired >= c.least else 0
        if not desired:
            out[n] = (0, "kelly_non_positive_or_below_unit")
            continue
        limits.setdefault(day, down(money * c.day))
        race_limits.setdefault((day, race), down(money * c.race))
        stake = down(min(desired, money, max(0, limits[day] - used.get(day, 0)), max(0, race_limits[day, race] - race_used.get((day, race), 0))))
        stake = stake if stake >= c.least else 0
        used[day] = used.get(day, 0) + stake
        race_used[day, race] = race_used.get((day, race), 0) + stake
        out[n] = (stake, "selected" if stake == desired else "selected_budget_capped" if stake else "race_or_day_budget_exhausted")
    return out


CONFIG = paper.Config(day=0.08, race=0.04)


def test_session_against_a_plain_loop(spark, tmp_path):
    predictions, quotes = session()
    p, q = spark.createDataFrame(predictions, PRED), spark.createDataFrame(quotes, QUOTE)
    got = {r.sequence: (r.stake, r.reason) for r in paper.evaluations(p, q, 20_000, CONFIG).collect()}
    want = plain(predictions, quotes, 20_000, CONFIG)
    assert got == want and len({r for _, r in want.values()}) >= 5
    # two runs over a ledger: the second goes on where the first ended, and skips what is there
    table = lt.LedgerTable(spark, str(tmp_path / "ledger"))
    early = p.where("sequence < 60")
    assert paper.run(early, q, table, 20_000, CONFIG, batch=0) == 24
    first = {r.sequence: (r.stake, r.reason) for r in table.read().collect()}
    assert first == plain([x for x in predictions if x[7] < 60], quotes, 20_000, CONFIG)
    assert paper.run(early, q, table, 20_000, CONFIG, batch=0) == 0 and paper.run(early, q, table, 20_000, CONFIG) == 0
    assert paper.run(p, q, table, 20_000, CONFIG, batch=1) == len(predictions) - 24
    days = {n: max(x for x in quotes if x[:2] == (r, h))[4].date() for r, h, *_, n in predictions}
    before = [(days[n], f"R{n // 10}", s) for n, (s, _) in sorted(first.items()) if s]
    assert {r.sequence: (r.stake, r.reason) for r in table.read().collect() if r.sequence >= 60} == plain([x for x in predictions if x[7] >= 60], quotes, 20_000, CONFIG, before)
    with pytest.raises(ValueError):
        paper.evaluations(p, q, 0)


def test_faults_stake_nothing(spark):
    at, post = T(2020, 1, 1, 11, 55), T(2020, 1, 1, 12)
    rows = [("A", "A-1", "x", "v1", 1.5, 0.5, at, 1), ("A", "A-2", " ", "v1", 0.5, 0.5, at, 2), ("A", "A-3", "x", None, 0.5, None, at, 3), ("A", "A-4", "x", "v1", 0.5, 0.5, post, 4), ("A", "A-5", "x", "v1", 0.5, 0.5, at, 5), ("A", "A-6", "x", "v1", 0.5, 0.5, at, 6)]
    quotes = [("A", f"A-{k}", T(2020, 1, 1, 11, 54), 3.0, post) for k in (1, 2, 3, 4, 5)]
    got = {r.sequence: (r.stake > 0, r.reason) for r in paper.evaluations(spark.createDataFrame(rows, PRED), spark.createDataFrame(quotes, QUOTE), 20_000).collect()}
    assert got == {1: (False, "invalid: probability"), 2: (False, "invalid: blank_horse_name"), 3: (False, "invalid: confidence,blank_model_version"), 4: (False, "after_post"), 5: (True, "selected"), 6: (False, "no_quote")}


def test_settling(spark, tmp_path):
    table = lt.LedgerTable(spark, str(tmp_path / "settled"))
    bets = spark.createDataFrame([(1, "A", "A-1", D(2020, 1, 1), 2.5, 100), (2, "A", "A-2", D(2020, 1, 1), 3.0, 100), (3, "A", "A-9", D(2020, 1, 1), 3.0, 100), (4, "B", "B-1", D(2020, 1, 2), 3.0, 100)], "bet_id long, race_id string, horse_id string, race_date date, decimal_odds double, stake long")
    results = spark.createDataFrame([("A", "A-1", 1), ("A", "A-2", 2)], "race_id string, horse_id string, finish_position long")
    assert paper.settle(table, bets, results, "s", 0) == {"settled": 2, "settled_before": 0, "race_pending": 1, "runner_missing": 1}
    assert paper.settle(table, bets, results)["settled_before"] == 2
    assert sorted((r.bet_id, r.won, r.payout) for r in table.read().collect()) == [(1, True, 250), (2, False, 0)]
    with pytest.raises(lt.Conflict):
        paper.settle(table, bets, results.withColumn("finish_position", F.col("finish_position") + 1))


def test_the_whole_decision(spark):
    rows = spark.createDataFrame([(0.5, 3.0, 0.5), (0.05, 3.0, 0.5), (0.5, 1.5, 0.5), (0.5, 2.31, 0.5), (0.9, 1.0, 0.5)], "p double, o double, c double")
    got = [r.d for r in rows.select(betting.decide_win(F.col("p"), F.col("o"), F.col("c"), F.lit(1000.0), min_value=0.5).alias("d")).collect()]
    assert [(d.stake, d.reason) for d in got] == [(0, "kelly_non_positive_or_below_unit"), (0, "probability_below_minimum"), (0, "kelly_non_positive_or_below_unit"), (0, "kelly_non_positive_or_below_unit"), (0, "kelly_non_positive_or_below_unit")]
    rich = rows.limit(1).select(betting.decide_win(F.col("p"), F.col("o"), F.col("c"), F.lit(100_000.0)).alias("d")).first().d
    assert (rich.bet_type, rich.stake, rich.expected_return, rich.edge, rich.reason) == ("WIN", 5000, 1.5, 0.5, "selected")
