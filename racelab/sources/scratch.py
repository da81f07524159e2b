"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where a session has none (single-machine tests) a new local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="spark-racelab-")
    return _OWN_DIR[app]


@contextmanager
def small_splits(spark: SparkSession, size: str = "16m") -> Iterator[None]:
    """Files are read in splits of at most ``size``: for fits, whose tasks hold their rows decoded."""
    with _setting(spark, "spark.sql.files.maxPartitionBytes", size):
        yield


@contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Arrow batches of about ``size`` at most: for rows that are blocks of many values."""
    with _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size):
        yield


@contextmanager
def batches_by_rows(spark: SparkSession) -> Iterator[None]:
    """Arrow batches are bounded by their rows alone: for rows of a few numbers, as Spark otherwise measures the
    whole batch anew with each row."""
    with _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1)):
        yield


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Intermediate Parquet tables in the shared folder: lineage is cut, lost executors lose nothing."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/racelab/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, name: str = "t", file_rows: int = 0, by: str | None = None) -> DataFrame:
        """``file_rows``: most rows of a file; 0 for no bound. ``by``: a column whose values have folders of their own."""
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path, partitionBy=by)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that no later table or result reads."""
        self.delete(*(t._scratch_path for t in tables))

    def tidy(self, *tables: DataFrame) -> None:
        """``drop``, and let go of finished jobs' shuffle files: Spark deletes them when the driver's collector
        meets their plan, which on a large heap may be long after the job."""
        self.drop(*tables)
        self.spark._jvm.System.gc()

    def delete(self, *paths: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
