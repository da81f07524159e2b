"""Structured Streaming versions of the quote paths, and appends that may be run again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def valid_quotes(quotes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Quotes with usable odds, observed before the post; repeats of an observation go once the
    watermark can tell them (state is dropped with it)."""
    good = quotes.where((F.col("odds") > 1) & (F.col("odds") < float("inf")) & (F.col("observed_at") < F.col("post_at")))
    return good.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["race_id", "horse_id", "observed_at", "source"])


class LatestQuote(StatefulProcessor):
    """Of a runner: the last quote by time, then sequence; forgotten once the watermark passes the post."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "observed_us long, sequence long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows))
        best = got.sort_values(["observed_at", "sequence"], kind="stable").iloc[-1]
        at = (int(best.observed_at.value // 1000), int(best.sequence))
        if not self.last.exists() or at > tuple(self.last.get()):
            self.last.update(at)
            self.handle.registerTimer(int(best.post_at.value // 1_000_000))
            yield pd.DataFrame([(*key, best.observed_at, best.odds)], columns=["race_id", "horse_id", "observed_at", "odds"])
        else:
            yield pd.DataFrame(columns=["race_id", "horse_id", "observed_at", "odds"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame(columns=["race_id", "horse_id", "observed_at", "odds"])

    def close(self) -> None:
        """Nothing to close."""


def latest_quotes(quotes: DataFrame, kind: str | None = None) -> DataFrame:
    """Each quote that is its runner's last so far. ``quotes`` has a watermark on observed_at (``valid_quotes``
    gives it); a runner's state is two numbers and goes after its race's post."""
    quotes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = kind or dict(quotes.dtypes)["observed_at"]
    rows = quotes.select("race_id", "horse_id", "observed_at", "post_at", "sequence", "odds")
    return rows.groupBy("race_id", "horse_id").transformWithStateInPandas(LatestQuote(), f"race_id string, horse_id string, observed_at {kind}, odds double", "Append", "EventTime")


def decisions_with_quotes(decisions: DataFrame, quotes: DataFrame, age: str = "10 minutes") -> DataFrame:
    """Stream-stream join: quotes at most ``age`` older than the decision; both sides' state expires."""
    d = decisions.withWatermark("decided_at", age).alias("d")
    q = quotes.withWatermark("observed_at", age).alias("q")
    near = F.expr(f"d.race_id = q.race_id AND d.horse_id = q.horse_id AND q.observed_at <= d.decided_at AND q.observed_at >= d.decided_at - INTERVAL {age}")
    return d.join(q, near).select("d.race_id", "d.horse_id", "d.decided_at", "q.observed_at", "q.odds")


def tumbling_quality(quotes: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return quotes.withWatermark("observed_at", late).groupBy(F.window("observed_at", size)).agg(F.count("*").alias("quotes"), F.avg("odds").alias("mean_odds"))


def append_new(batch: DataFrame, ledger_path: str, keys: list[str]) -> int:
    """For foreachBatch: rows whose key the ledger lacks are appended; running it again adds nothing. One
    writer only: ``LedgerTable.append_immutable`` guards against a second one and refuses other values."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(keys)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
    if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        fresh = fresh.join(spark.read.parquet(ledger_path).select(*keys), keys, "left_anti")
    fresh = fresh.persist()  # counted and written from one computation
    try:
        rows = fresh.count()
        if rows:
            fresh.write.mode("append").parquet(ledger_path)
        return rows
    finally:
        fresh.unpersist()
