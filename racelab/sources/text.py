"""Text sources: delimited history and entry tables with header aliases, and fixed-width records."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from racelab.functions.safe import number
from racelab.sources import feed

#: Header names by canonical column, in order of priority.
ALIASES: dict[str, tuple[str, ...]] = {
    "race_id": ("race_id", "raceid"),
    "race_date": ("race_date", "date"),
    "horse_name": ("horse_name", "horse"),
    "finish_position": ("finish_position", "finish", "rank"),
    "win_odds": ("win_odds", "odds"),
    "post_position": ("post_position", "post", "number"),
    "racecourse": ("racecourse", "course", "venue"),
    "surface": ("surface", "track"),
    "distance_m": ("distance_m", "distance"),
    "jockey": ("jockey", "rider"),
    "trainer": ("trainer", "stable"),
}
REQUIRED = ("race_id", "race_date", "horse_name")
_NUMBERS = {"finish_position", "win_odds", "post_position", "distance_m"}
#: Tried in this order; the first that decodes all of a table's files is taken.
ENCODINGS = ("UTF-8", "windows-31j", "Shift_JIS", "EUC-JP")


_PYTHON = {"UTF-8": "utf-8", "windows-31j": "cp932", "Shift_JIS": "shift_jis", "EUC-JP": "euc_jp"}


def detect_encoding(spark: SparkSession, path: str) -> str:
    """The first of ``ENCODINGS`` that decodes every line of every file; lines are tried by the tasks that
    read them, and end in a byte that is part of no character in any of these."""
    if _zipped(path):
        lines = feed.read(spark, path, members="table").select("record")
    else:
        lines = spark.read.text(path).select(F.col("value").cast("binary").alias("raw"))  # bytes as they are

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad = dict.fromkeys(ENCODINGS, 0)
        for b in batches:
            for line in b.column(0).to_pylist():
                if line is None or line.isascii():
                    continue
                for name in ENCODINGS:
                    if not bad[name]:
                        try:
                            line.decode(_PYTHON[name])
                        except UnicodeDecodeError:
                            bad[name] = 1
        yield pa.record_batch([pa.array(list(bad)), pa.array(list(bad.values()), pa.int64())], ["name", "bad"])

    bad = {r.name: r.bad for r in lines.mapInArrow(tried, "name string, bad long").groupBy("name").agg(F.sum("bad").alias("bad")).collect()}
    for name in ENCODINGS:
        if not bad.get(name, 0):
            return name
    raise ValueError(f"{path}: none of {', '.join(ENCODINGS)} decodes it")


def normalise(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Canonical columns by their aliases; other columns go, bad numbers are null, bad dates fail."""
    have = {c.strip().lower(): c for c in df.columns}
    picked = {c: have[a] for c, names in ALIASES.items() for a in reversed(names) if a in have}
    picked = {c: next(have[a] for a in ALIASES[c] if a in have) for c in picked}
    if missing := [c for c in required if c not in picked]:
        raise ValueError(f"missing columns: {', '.join(missing)}")

    def typed(c: str) -> Column:
        x = F.col(f"`{picked[c]}`")
        if c in _NUMBERS:
            return number(x).alias(c)
        return (x.cast("date") if c == "race_date" else x.cast("string")).alias(c)

    return df.select(*map(typed, picked))


def _zipped(path: str) -> bool:
    return path.lower().endswith(".zip")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A delimited table with a header as strings, in any of ``ENCODINGS``, plain or wrapped in a ZIP archive.
    Spark's own reader knows UTF-8 only; in other charsets and archives a record is a line."""
    encoding = detect_encoding(spark, path)
    if encoding == "UTF-8" and not _zipped(path):
        return spark.read.option("header", True).csv(path)
    return feed.csv_table(spark, path, encoding)


def read_history(spark: SparkSession, path: str, required: tuple[str, ...] = (*REQUIRED, "finish_position")) -> DataFrame:
    return normalise(read_table(spark, path), required)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    return normalise(read_table(spark, path))


def field(text: Column, start: int, length: int) -> Column:
    """A fixed-width field by byte position (from 1) of the record's bytes, trimmed; blank is null."""
    raw = F.substring(text.cast("binary"), start, length).cast("string")
    return F.nullif(F.trim(raw), F.lit(""))


def whole(text: Column, start: int, length: int, zero: bool = False) -> Column:
    """Digits only, else null; zero is null unless kept."""
    x = field(text, start, length)
    n = F.when(x.rlike("^[0-9]+$"), x.try_cast("bigint"))
    return n if zero else F.nullif(n, F.lit(0).cast("bigint"))


def odds_book(records: DataFrame, text: str, first: int, width: int = 8, items: int = 28) -> DataFrame:
    """Repeating groups of runner (2 bytes), odds in tenths (4) and popularity (2), one row each;
    blanks and odds of 1 or less go."""
    rows = records.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(items - 1)))).withColumn("_g", F.expr(f"substring(cast({text} as binary), {first} + _i * {width}, {width})"))
    g = F.col("_g")
    rows = rows.withColumns({"post_position": whole(g, 1, 2), "odds": whole(g, 3, 4) / 10.0, "popularity": whole(g, 7, 2)})
    return rows.where("post_position IS NOT NULL AND odds > 1").drop("_i", "_g")
