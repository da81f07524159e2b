"""Stakes under a day's and a race's limit, with state for each day.

Requests of a day are taken in order of arrival (``sequence``). A day's limit and each race's limit are
fixed by the bankroll of the first request that wants a stake there; a stake is what is asked, what both
limits leave and what the bankroll allows, rounded down to a unit, and nothing below the least stake. The
two levels don't telescope into prefix sums, so a day is a fold: one key of state, one value for the day and
a list with the races' entries. A batch appends the entries of the races that it changed, and later entries
count: state is read and written once a day and batch, not race by race. Days run side by side.

The state of a day goes when the watermark (event time) has passed the day by ``grace`` hours, or, without
event time, by the time to live of its entries. ``seeded`` builds the initial state from a ledger, so that a
restarted session goes on as if it had never stopped.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "day date, race_id string, sequence long, desired long, stake long, reason string"
SEED = "day date, race_id string, day_limit long, race_limit long, race_stakes long"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Limits:
    day: float = 0.2
    race: float = 0.05
    unit: int = 100
    least: int = 100

    def down(self, value: float) -> int:
        return int(math.floor(max(0.0, value) / self.unit) * self.unit)


class Exposure(StatefulProcessor):
    def __init__(self, limits: Limits, grace_hours: int | None, ttl_hours: int | None, bankroll: float | None = None, cap: int | None = None):
        self.limits, self.grace, self.ttl, self.bankroll, self.cap = limits, grace_hours, ttl_hours, bankroll, cap

    def _asked(self, r, committed: int) -> tuple[int, float]:
        """(desired stake, bankroll) of a request; by fractions, of what the day has left of the bankroll."""
        if self.bankroll is None:
            return int(r.desired), r.bankroll
        left = self.bankroll - committed
        money = left if left > 0 else self.bankroll
        stake = self.limits.down(min(money * r.fraction, self.cap))
        return (stake if stake >= self.limits.least else 0), money

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.ttl is None else self.ttl * 3_600_000
        self.handle = handle
        self.day = handle.getValueState("day", "day_limit long, stakes long", ttl)
        self.races = handle.getListState("races", "race_id string, race_limit long, stakes long", ttl)

    def _end(self, key: tuple) -> int:
        """Milliseconds at which the day's state goes."""
        after = dt.datetime.combine(key[0], dt.time(), dt.timezone.utc) + dt.timedelta(days=1, hours=self.grace or 0)
        return int(after.timestamp() * 1000)

    def _timer(self, key: tuple) -> None:
        if self.grace is not None:
            self.handle.registerTimer(self._end(key))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        first = initialState.iloc[0]
        self.day.update((int(first.day_limit), int(initialState.race_stakes.sum())))
        self.races.put([(r.race_id, int(r.race_limit), int(r.race_stakes)) for r in initialState.itertuples()])
        self._timer(key)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.limits
        # one batch of one day: its requests must be in order of arrival, not of the shuffle
        asked = pd.concat(list(rows)).sort_values("sequence", kind="stable")
        day = self.day.get() if self.day.exists() else None
        entries = list(self.races.get()) if self.races.exists() else []
        held = {race: (limit, used) for race, limit, used in entries}
        seen: dict[str, tuple[int, int]] = {}
        out = []
        for r in asked.itertuples():
            stake, reason = 0, "not_asked"
            desired, bankroll = self._asked(r, day[1] if day else 0)
            if desired > 0:
                if day is None:
                    day = (at.down(bankroll * at.day), 0)
                    self._timer(key)
                if r.race_id not in seen:
                    seen[r.race_id] = held.get(r.race_id) or (at.down(bankroll * at.race), 0)
                limit, used = seen[r.race_id]
                left = min(int(bankroll), max(0, day[0] - day[1]), max(0, limit - used))
                stake = at.down(min(desired, left))
                stake = stake if stake >= at.least else 0
                reason = "selected" if stake == desired else "selected_budget_capped" if stake else "race_or_day_budget_exhausted"
                day = (day[0], day[1] + stake)
                seen[r.race_id] = (limit, used + stake)
            out.append((key[0], r.race_id, int(r.sequence), desired, stake, reason))
        if day is not None:
            self.day.update((int(day[0]), int(day[1])))
        if seen and len(entries) + len(seen) > 2 * len(held | seen):
            self.races.put([(race, *entry) for race, entry in (held | seen).items()])
        elif seen:
            self.races.appendList([(race, *entry) for race, entry in seen.items()])
        yield pd.DataFrame(out, columns=["day", "race_id", "sequence", "desired", "stake", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.day.clear()
        self.races.clear()
        yield pd.DataFrame(columns=["day", "race_id", "sequence", "desired", "stake", "reason"])

    def close(self) -> None:
        """Nothing to close."""


def exposures(requests: DataFrame, limits: Limits = Limits(), seed: DataFrame | None = None, event_time: str | None = "asked_at", late: str = "1 hour", grace_hours: int = 6, ttl_hours: int = 48, bankroll: float | None = None, cap: int = 5000) -> DataFrame:
    """Stakes of (day date, race_id, sequence, desired long, bankroll double), a stream or a table.

    With ``bankroll`` the requests have ``fraction`` instead of desired and bankroll: each asks for that share
    of what its day has left of the bankroll, at most ``cap``.
    ``event_time`` names a timestamp of the requests: a day's state goes with the watermark. Without it
    (None) state lives ``ttl_hours`` after its last change. ``seed``: what ``seeded`` gives.
    """
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)  # the one that has typed state
    _ = spark.streams.active  # starts what keeps track of state, which a table's fold needs as a stream's does
    timed = event_time is not None and requests.isStreaming
    asked = ["desired", "bankroll"] if bankroll is None else ["fraction"]
    columns = ["day", "race_id", "sequence", *asked, *([event_time] if timed else [])]
    rows = requests.select(*columns)
    if timed:
        rows = rows.withWatermark(event_time, late)
    processor = Exposure(limits, grace_hours if timed else None, None if timed or not requests.isStreaming else ttl_hours, bankroll, cap)
    mode = "EventTime" if timed else "ProcessingTime" if requests.isStreaming else "None"
    return rows.groupBy("day").transformWithStateInPandas(processor, OUT, "Append", mode, None if seed is None else seed.groupBy("day"))


def seeded(ledger: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The state after recorded bets (day, race_id, sequence, stake, bankroll): limits by the first bet of a
    day and of each of its races; one row a race. Bets of nothing set no limit."""
    down = lambda c, share: (F.floor(F.greatest(F.col(c) * share, F.lit(0.0)) / limits.unit) * limits.unit).cast("long")
    bets = ledger.where("stake > 0").select("day", "race_id", "sequence", "stake", "bankroll")
    races = bets.groupBy("day", "race_id").agg(F.min_by("bankroll", "sequence").alias("b"), F.min("sequence").alias("s"), F.sum("stake").cast("long").alias("race_stakes"))
    days = races.groupBy("day").agg(F.min_by("b", "s").alias("day_bankroll"))
    return races.join(days, "day").select("day", "race_id", down("day_bankroll", limits.day).alias("day_limit"), down("b", limits.race).alias("race_limit"), "race_stakes")
