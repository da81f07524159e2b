"""Bankroll simulation: a strategy's bets in order, each staked from what all before left."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racelab.sources.scratch import Scratch, batches_by_rows

#: Candidates of a stretch: what a task reads follows from it, not from the table.
STRETCH_ROWS = 2_000_000
#: Rows of a strategy that a fold collects.
_ROWS = 50_000
#: Races that are staked together while each takes its whole cap.
_BLOCK = 512
#: Stand for a null day and a null number of a race inside a fold.
_NO_DAY, _NO_RACE = -(2**31), -(2**63)


@dataclass
class Bankroll:
    """The state that one strategy carries from race to race; a race's bets settle after the race."""

    money: float
    unit: int
    share: float
    race_cap: float
    cap: int
    day_cap: float
    peak: float = 0.0
    day: int = _NO_DAY
    day_left: float = 0.0

    def down(self, value: float) -> int:
        return math.floor(value / self.unit) * self.unit

    def race(self, day, kelly: list, odds: list, won: list) -> list[tuple]:
        """(candidate, stake, payout, money after it) of one race's bets."""
        if day != self.day:
            self.day, self.day_left = day, self.down(self.money * self.day_cap)
        left, out = min(self.day_left, self.down(min(self.money * self.race_cap, self.cap))), []
        for i, k in enumerate(kelly):
            if left < self.unit:
                break
            stake = int(min(self.down(self.money * k * self.share), left))
            if stake >= self.unit:
                left -= stake
                self.day_left -= stake
                out.append((i, stake, round(stake * odds[i]) if won[i] else 0))
        settled = []
        for i, stake, paid in out:
            self.money += paid - stake
            settled.append((i, stake, paid, self.money))
        return settled

    def full(self, days: np.ndarray, kelly: np.ndarray, odds: np.ndarray, won: np.ndarray) -> tuple[np.ndarray, ...]:
        """(stake, payout, money after it) of the first of these races as long as the best candidate (one is given of each race) takes the whole
        cap of its race: no other candidate gets a stake then, so that money is a running sum."""
        stake = self.down(self.cap)
        if stake < self.unit:
            return (np.zeros(0),) * 3
        paid = np.where(won, np.rint(stake * odds), 0.0)
        money = np.cumsum(np.concatenate([[self.money], paid - stake]))
        before, after = money[:-1], money[1:]
        number = np.arange(len(days))
        new = np.concatenate([[days[0] != self.day], days[1:] != days[:-1]])
        first = np.maximum.accumulate(np.where(new, number, -1))
        start = np.where(first < 0, self.day_left, np.floor(before[first] * self.day_cap / self.unit) * self.unit)
        left = start - stake * (number - np.maximum(first, 0))
        ok = (before * self.race_cap >= self.cap) & (np.floor(before * kelly * self.share / self.unit) * self.unit >= stake) & (left >= stake)
        n = len(ok) if ok.all() else int(np.argmin(ok))
        if n:
            self.money, self.day, self.day_left = float(after[n - 1]), int(days[n - 1]), float(left[n - 1] - stake)
        return np.full(n, float(stake)), paid[:n], after[:n]

    def races(self, days, rids, p, odds, won) -> tuple[np.ndarray, ...]:
        """(candidate, stake, payout, bankroll, drawdown) of the bets of whole races, in order."""
        with np.errstate(invalid="ignore", divide="ignore"):
            kelly = np.where((odds > 1) & (p > 0) & (p < 1), np.fmax(0.0, np.fmin(1.0, (p * odds - 1) / (odds - 1))), 0.0)
        starts = np.flatnonzero(np.concatenate([[True], (days[1:] != days[:-1]) | (rids[1:] != rids[:-1])]))
        ends = np.append(starts[1:], len(days))
        found = []
        for block in range(0, len(starts), _BLOCK):
            s = starts[block : block + _BLOCK]
            whole = self.full(days[s], kelly[s], odds[s], won[s])
            n = len(whole[0])
            found.append((s[:n], *whole))
            if n == len(s):
                continue
            # the rest one by one
            a, z = s[n], ends[block + len(s) - 1]
            k, o, w, bets = kelly[a:z].tolist(), odds[a:z].tolist(), won[a:z].tolist(), []
            for day, x, y in zip(days[s[n:]].tolist(), (s[n:] - a).tolist(), (ends[block + n : block + len(s)] - a).tolist()):
                bets += [(x + i, *b) for i, *b in self.race(day, k[x:y], o[x:y], w[x:y])]
            if bets:
                i, *rest = (np.array(c) for c in zip(*bets))
                found.append((i + a, *rest))
        index, stake, paid, money = (np.concatenate(c) for c in zip(*found))
        peaks = np.maximum.accumulate(np.maximum(money, self.peak))
        if len(peaks):
            self.peak = float(peaks[-1])
        return index, stake.astype(int), paid.astype(int), money, np.where(peaks != 0, 1 - money / np.where(peaks != 0, peaks, 1.0), 0.0)


def simulate(bets: DataFrame, group: str, bankroll: float = 100_000.0, share: float = 0.25, race_cap: float = 0.05, cap: int = 5000, day_cap: float = 0.2, unit: int = 100, deal: Callable[[DataFrame], DataFrame] | None = None, ties: tuple[str, ...] = (), stretch: int = STRETCH_ROWS) -> DataFrame:
    """Stakes, payouts and drawdown of each strategy's bets (``group``) in order of day and race.

    Candidates: (group, race_date, rid, p, win_odds, is_winner); within a race by edge, then probability, then ``ties``. A
    stake depends on the bankroll left by all races before, so a strategy is a fold: candidates are stored in
    stretches of whole races by day and number, one job folds one stretch of all strategies (a task each, sorted
    there) and hands their ``Bankroll`` on as rows. A day spends at most ``day_cap`` of its start. ``deal``: adds
    ``group`` to the candidates when they are read, so that shared ones are stored once.
    """
    scratch = Scratch(bets.sparkSession, "bankroll")
    deal = deal or (lambda rows: rows)
    need = ["race_date", "rid", "p", "win_odds", "is_winner", *ties]
    kind = dict(deal(bets).dtypes)[group]
    state = "struct<money: double, peak: double, day: int, day_left: double>"
    edge = F.col("p") * F.col("win_odds") - 1
    order = ["rid", edge.desc(), F.desc("p"), *ties]
    # a race's rows stay together and in their order
    rows = scratch.save(bets.repartition("race_date", "rid"), "candidates")
    count = max(1, -(-rows.count() // stretch))
    if count > 1:
        cut = rows.repartitionByRange(count, "race_date", "rid").sortWithinPartitions("race_date", *order)
        rows = scratch.save(cut.withColumn("_stretch", F.spark_partition_id()), "stretches", stretch // 16, "_stretch")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[object, Bankroll] = {}
        waiting: dict[object, list[np.ndarray]] = {}
        one = lambda: Bankroll(bankroll, unit, share, race_cap, cap, day_cap, max(0.0, bankroll))

        def settled(name, values: list[np.ndarray]) -> pa.RecordBatch:
            days, rids, *_ = values
            i, stake, paid, money, down = states.setdefault(name, one()).races(*values)
            none = pa.nulls(len(i), pa_state)
            day = pa.array(days[i].astype("int32"), mask=days[i] == _NO_DAY).cast(pa.date32())
            number = pa.array(rids[i], mask=rids[i] == _NO_RACE)
            return pa.record_batch([day, number, pa.array(stake, pa.int64()), pa.array(paid, pa.int64()), pa.array(money, pa.float64()), pa.array(down, pa.float64()), pa.array([name] * len(i), pa_kind), none], names)

        for b in batches:
            pa_kind, pa_state = b.schema.field(group).type, b.schema.field("state").type
            names = ["race_date", "rid", "stake", "payout", "bankroll", "drawdown", group, "state"]
            known = b.column("state").is_valid()
            for name, s in zip(b.column(group).filter(known).to_pylist(), b.column("state").filter(known).to_pylist()):
                now = states.setdefault(name, one())
                now.money, now.peak, now.day, now.day_left = s["money"], s["peak"], s["day"], s["day_left"]
                waiting.setdefault(name, None)
            b = b.filter(pc.invert(known))
            if not b.num_rows:
                continue
            values = [
                b.column("race_date").cast(pa.int32()).cast(pa.int64()).fill_null(_NO_DAY).to_numpy(),
                b.column("rid").fill_null(_NO_RACE).to_numpy(),
                *(b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("p", "win_odds")),
                b.column("is_winner").cast(pa.float64()).to_numpy(zero_copy_only=False) == 1,
            ]
            found = b.column(group).dictionary_encode("encode")
            codes = found.indices.to_numpy()
            for code, name in enumerate(found.dictionary.to_pylist()):
                own = [v[codes == code] for v in values]
                if (before := waiting.get(name)) is not None:
                    own = [np.concatenate(x) for x in zip(before, own)]
                waiting[name] = own
                if len(own[0]) < _ROWS:
                    continue
                # the last race may go on in the next batch
                last = np.flatnonzero((own[0] != own[0][-1]) | (own[1] != own[1][-1]))
                cut = int(last[-1]) + 1 if len(last) else 0
                waiting[name] = [v[cut:] for v in own]
                if cut:
                    yield settled(name, [v[:cut] for v in own])
        for name, values in waiting.items():
            if values is not None:
                yield settled(name, values)
            now = states[name]
            nulls = [pa.nulls(1, t) for t in (pa.date32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            kept = {"money": now.money, "peak": now.peak, "day": now.day, "day_left": now.day_left}
            yield pa.record_batch([*nulls, pa.array([name], pa_kind), pa.array([kept], pa_state)], names)

    states, done = None, []
    for k in range(count):
        part = deal(rows.where(F.col("_stretch") == k) if count > 1 else rows).select(group, *need, F.lit(None).cast(state).alias("state"))
        if states is not None:
            part = part.unionByName(states, allowMissingColumns=True)
        # a state has no day, so that it comes first
        ordered = part.repartition(group).sortWithinPartitions("race_date", F.col("state").isNull(), *order).drop(*ties)
        with batches_by_rows(bets.sparkSession):
            done.append(scratch.save(ordered.mapInArrow(fold, f"race_date date, rid long, stake long, payout long, bankroll double, drawdown double, `{group}` {kind}, state {state}"), "bets"))
        states = done[-1].where("state IS NOT NULL").select(group, "state")
    found = bets.sparkSession.read.schema(done[0].schema).parquet(*[t._scratch_path for t in done])
    return found.where("state IS NULL").drop("state")


def summary(detail: DataFrame, group: str) -> DataFrame:
    return detail.groupBy(group).agg(
        F.count("*").alias("bets"),
        F.sum("stake").alias("stake"),
        F.sum("payout").alias("payout"),
        F.round(F.sum("payout") / F.sum("stake") - 1, 9).alias("roi"),
        F.round(F.max("drawdown"), 9).alias("max_drawdown"),
    )
