"""A ledger of races as partitioned Parquet that is changed by commits.

    <root>/data/v=<n>/month=<yyyy-MM>/...   files, each written once and never changed
    <root>/commits/<n>.json                 what the table holds after commit n: folders by month, with
                                            their rows and last day, and the last batch of each writer

A change writes the months that it touches into a folder of its own and then creates the next commit's file,
which exists or doesn't: readers see the table before or after, never between. A crash before that leaves
files that no commit names; the same batch run again after a commit is known by its number and changes
nothing. The file is created, not overwritten: of two writers that started from one commit the second fails
(``ConcurrentChange``) and writes nothing that is read. This needs a store whose create is exclusive (local
disks, HDFS; object stores with conditional writes).

Only months are listed by the driver; rows, races and keys stay in Spark.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from racelab.operators import checks, intake
from racelab.sources.scratch import Scratch


class ConcurrentChange(RuntimeError):
    """Another writer committed first."""


class Conflict(ValueError):
    """A record that must not change came again with other values."""


@dataclass
class State:
    """A commit's content."""

    version: int = 0
    schema: str | None = None
    #: month -> {"folders": [...], "rows": n, "end": "yyyy-mm-dd"}
    months: dict = field(default_factory=dict)
    #: writer -> its last batch
    batches: dict = field(default_factory=dict)

    @property
    def end(self) -> str | None:
        return max((m["end"] for m in self.months.values()), default=None)


class LedgerTable:
    def __init__(self, spark: SparkSession, root: str, day: str = "race_date"):
        self.spark, self.root, self.day = spark, root.rstrip("/"), day
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---------------------------------------------------------------- commits

    def _versions(self) -> list[int]:
        at = self._path(f"{self.root}/commits")
        if not self._fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self) -> State:
        """The content after the last commit; a commit's file that was never finished is the last one only
        if its writer died inside a write of a few bytes, and is then refused by name."""
        versions = self._versions()
        if not versions:
            return State()
        path = f"{self.root}/commits/{versions[-1]}.json"
        lines = [r.value for r in self.spark.read.option("wholetext", True).text(path).collect()]
        try:
            return State(**json.loads("".join(lines)))
        except (ValueError, TypeError) as e:
            raise RuntimeError(f"unreadable commit: {path}") from e

    def _commit(self, new: State) -> None:
        """Create the commit's file: first under a name of its own, then by an exclusive create."""
        at = self._path(f"{self.root}/commits/{new.version}.json")
        self._fs.mkdirs(at.getParent())
        try:
            out = self._fs.create(at, False)
        except Py4JJavaError as e:
            raise ConcurrentChange(f"commit {new.version} of {self.root} exists") from e
        try:
            out.write(bytearray(json.dumps(vars(new), sort_keys=True).encode()))
        finally:
            out.close()

    # ------------------------------------------------------------------ reads

    def read(self, state: State | None = None, months: list[str] | None = None) -> DataFrame | None:
        """The rows of a commit (the last one), of all months or some; None of an empty table."""
        state = state or self.state()
        if state.schema is None:
            return None
        picked = sorted(state.months if months is None else set(months) & set(state.months))
        folders = [f"{self.root}/data/{f}" for m in picked for f in state.months[m]["folders"]]
        if not folders:
            return self.spark.createDataFrame([], state.schema)
        return self.spark.read.schema(state.schema).parquet(*folders)

    # ----------------------------------------------------------------- writes

    def _month(self):
        return F.coalesce(F.date_format(F.col(self.day).cast("date"), "yyyy-MM"), F.lit("unknown"))

    def _write(self, rows: DataFrame, version: int) -> dict:
        """Write rows by month; (month -> folder, rows, end)."""
        folder = f"v={version}-{uuid.uuid4().hex[:8]}"
        path = f"{self.root}/data/{folder}"
        # a month's rows go to one task, or to several if they are many
        rows.withColumn("month", self._month()).hint("rebalance", "month").write.partitionBy("month").parquet(path)
        back = self.spark.read.schema(f"{_ddl(rows)}, month string").parquet(path)
        each = back.groupBy("month").agg(F.count("*").alias("n"), F.max(F.col(self.day).cast("date")).cast("string").alias("end"))
        return {str(r.month): {"folders": [f"{folder}/month={r.month}"], "rows": r.n, "end": r.end or ""} for r in each.collect()}

    def _finish(self, old: State, schema: str, months: dict, writer: str | None, batch: int | None) -> State:
        new = State(old.version + 1, schema, months, dict(old.batches))
        if writer is not None:
            new.batches[writer] = batch
        self._commit(new)
        return new

    def _done(self, old: State, writer: str | None, batch: int | None) -> bool:
        return writer is not None and old.batches.get(writer, -1) >= batch

    def replace_races(self, update: DataFrame, writer: str | None = None, batch: int | None = None, least: int = 2) -> dict:
        """Every race of ``update`` with at least ``least`` rows replaces that race as a whole, wherever its
        rows are; other months aren't touched. Refuses an update after which the table would end earlier.

        Gives {"status", "version", "replaced_races", "rows", "end"}; status is ``repeated_batch``,
        ``no_updates``, ``updated`` or ``refreshed_overlap_only``.
        """
        old = self.state()
        total = sum(m["rows"] for m in old.months.values())
        if self._done(old, writer, batch):
            return {"status": "repeated_batch", "version": old.version, "replaced_races": 0, "rows": total, "end": old.end}
        update = intake.multi_runner(update, least)
        races = update.select("race_id").distinct()
        touched = {r.month for r in update.select(self._month().alias("month")).distinct().collect()}
        if not touched:
            return {"status": "no_updates", "version": old.version, "replaced_races": 0, "rows": total, "end": old.end}
        now = self.read(old)
        if now is not None:
            # a race may have stood under another day
            touched |= {r.month for r in now.select("race_id", self._month().alias("month")).join(races, "race_id", "left_semi").select("month").distinct().collect()}
            kept = self.read(old, sorted(touched)).join(races, "race_id", "left_anti")
            rows = kept.unionByName(update, allowMissingColumns=True)
        else:
            rows = update
        written = self._write(rows, old.version + 1)
        months = {m: v for m, v in old.months.items() if m not in touched} | written
        end = max((m["end"] for m in months.values()), default="")
        if old.end is not None and end < old.end:
            raise ValueError(f"the table would end on {end} instead of {old.end}")
        schema = _ddl(rows)
        new = self._finish(old, schema, months, writer, batch)
        status = "updated" if old.end is None or end > old.end else "refreshed_overlap_only"
        return {"status": status, "version": new.version, "replaced_races": races.count(), "rows": sum(m["rows"] for m in months.values()), "end": end}

    def append_immutable(self, new: DataFrame, keys: list[str], values: list[str], writer: str | None = None, batch: int | None = None) -> int:
        """Rows whose key is not there yet are added; the same values again change nothing, other values
        (of the table or among the new rows) fail with ``Conflict``. The months' folders are kept, one is
        added. Gives the number of rows added."""
        old = self.state()
        if self._done(old, writer, batch):
            return 0
        scratch = Scratch(self.spark, "append")
        # asked for repeats, conflicts and the rows to write
        fresh = first = scratch.save(new.dropDuplicates([*keys, *values]), "fresh")
        if fresh.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise Conflict(f"several values for one of {', '.join(keys)}")
        now = self.read(old)
        if now is not None:
            judged = checks.against_recorded(fresh, now, keys, values)
            bad = judged.where("status = 'conflict'").select(*keys).limit(1).collect()
            if bad:
                raise Conflict(f"recorded with other values: {bad[0].asDict()}")
            fresh = judged.where("status = 'new'").drop("status")
        written = self._write(fresh, old.version + 1)
        scratch.drop(first)
        months = {m: dict(v) for m, v in old.months.items()}
        for m, v in written.items():
            had = months.get(m, {"folders": [], "rows": 0, "end": ""})
            months[m] = {"folders": had["folders"] + v["folders"], "rows": had["rows"] + v["rows"], "end": max(had["end"], v["end"])}
        if written or writer is not None:
            self._finish(old, old.schema or _ddl(fresh), months, writer, batch)
        return sum(v["rows"] for v in written.values())

    def update_months(self, change, months: list[str], writer: str | None = None, batch: int | None = None) -> State:
        """``change(rows of these months)`` replaces them; it must keep each row in its month."""
        old = self.state()
        if self._done(old, writer, batch) or old.schema is None or not set(months) & set(old.months):
            return old
        picked = sorted(set(months) & set(old.months))
        rows = change(self.read(old, picked)).select(*self.read(old, picked).columns)
        written = self._write(rows, old.version + 1)
        if written.keys() - set(picked):
            raise ValueError("a changed row left its month")
        return self._finish(old, old.schema, {m: v for m, v in old.months.items() if m not in picked} | written, writer, batch)

    def vacuum(self) -> list[str]:
        """Delete folders that the last commit doesn't name: of crashed writers and of older commits. No
        other writer or reader of an older commit may be at work."""
        named = {f.split("/")[0] for m in self.state().months.values() for f in m["folders"]}
        at = self._path(f"{self.root}/data")
        if not self._fs.exists(at):
            return []
        gone = [f.getPath() for f in self._fs.listStatus(at) if f.getPath().getName() not in named]
        for p in gone:
            self._fs.delete(p, True)
        return sorted(p.getName() for p in gone)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields)


# ------------------------------------------------------------------ over it


def incremental(table: LedgerTable, update: DataFrame, won, writer: str | None = None, batch: int | None = None) -> dict:
    """Completed races of an overlapping re-read: races without exactly one winner are left out, then whole
    races replace what is there. ``won``: whether a row is its race's winner."""
    scratch = Scratch(table.spark, "update")
    # months, races and rows are asked of it one after the other
    judged = scratch.save(intake.single_winner(update, won), "judged")
    good = judged.where("NOT quarantined").drop("winners", "quarantined")
    out = table.replace_races(good, writer, batch) | {"excluded_races": judged.where("quarantined").select("race_id").distinct().count()}
    scratch.drop(judged)
    return out


def incremental_stream(updates: DataFrame, root: str, won, checkpoint: str, writer: str = "incremental"):
    """A stream of re-read races into the table: each micro-batch is one commit, and none if it is run again."""

    def step(batch: DataFrame, number: int) -> None:
        incremental(LedgerTable(batch.sparkSession, root), batch, won, writer, number)

    return updates.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def record_results(table: LedgerTable, results: DataFrame, writer: str | None = None, batch: int | None = None) -> int:
    """Results (race_id, post_position, finish_position) into rows of the ledger that have none; another
    result for one fails with ``Conflict``; keys that repeat count for nothing. Gives the rows changed."""
    from racelab.operators import ledger

    state = table.state()
    now = table.read(state)
    if now is None or table._done(state, writer, batch):
        return 0
    scratch = Scratch(table.spark, "results")
    results = scratch.save(results, "results")  # joined to count, then to write
    judged = ledger.with_results(now, results).select("status", table._month().alias("month"))
    found = {(r.status, r.month): r.n for r in judged.groupBy("status", "month").agg(F.count("*").alias("n")).collect()}  # a row a month and status
    if any(s == "conflict" for s, _ in found):
        raise Conflict("recorded with another result")
    months = sorted({m for s, m in found if s == "updated"})
    if months:
        table.update_months(lambda rows: ledger.with_results(rows, results).drop("status"), months, writer, batch)
    scratch.drop(results)
    return sum(n for (s, _), n in found.items() if s == "updated")
