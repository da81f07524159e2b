"""Quotes as of a moment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_before(decisions: DataFrame, quotes: DataFrame, key: str | list[str], at: str, values: list[str]) -> DataFrame:
    """Each decision with the last quote of its key at or before it (null without one).

    One union, one sort: quotes come before decisions of the same moment, and the last quote seen is
    carried forward. Linear in both sides, whatever the number of quotes of a key.
    """
    keys = [key] if isinstance(key, str) else key
    marks = quotes.select(*keys, F.col(at), F.lit(0).alias("_kind"), F.struct(F.col(at).alias("quoted_at"), *values).alias("_quote"))
    asks = decisions.withColumns({"_kind": F.lit(1), "_quote": F.lit(None).cast(marks.schema["_quote"].dataType)})
    both = asks.unionByName(marks, allowMissingColumns=True)
    seen = Window.partitionBy(*keys).orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("_last", F.last("_quote", ignorenulls=True).over(seen)).where("_kind = 1")
    return got.select(*decisions.columns, "_last.quoted_at", *[F.col(f"_last.{v}").alias(v) for v in values])


def latest(df: DataFrame, key: list[str], *order) -> DataFrame:
    """The last row of each key; the order decides ties."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def attached(rows: DataFrame, quotes: DataFrame, keys: list[str], at: str, values: list[str], same: list[str] = ()) -> DataFrame:
    """Rows with the latest quote of their key and ``attach_status``: missing (no quote), ambiguous (several
    at the latest time that differ), null_value (a value of it is null), mismatch (a column of ``same``, a
    name say, differs between the row and its quote) or ok. One aggregation of the quotes, one join; every
    row stays once, whatever the quotes."""
    held = F.struct(*values, *same)
    last = quotes.where(F.col(at).isNotNull()).groupBy(*keys, at).agg(F.min(held).alias("_q"), (F.min(held).eqNullSafe(F.max(held))).alias("_one"))
    last = last.groupBy(*keys).agg(F.max_by(F.struct("_q", "_one", F.col(at).alias("quoted_at")), at).alias("_l"))
    got = rows.join(last, keys, "left")
    null, other = F.lit(False), F.lit(False)
    for v in values:
        null = null | F.col(f"_l._q.{v}").isNull()
    for c in same:
        other = other | ~F.col(c).eqNullSafe(F.col(f"_l._q.{c}"))
    status = F.when(F.col("_l").isNull(), "missing").when(~F.col("_l._one"), "ambiguous").when(null, "null_value").when(other, "mismatch").otherwise("ok")
    return got.select(*rows.columns, F.col("_l.quoted_at").alias("quoted_at"), *[F.col(f"_l._q.{v}").alias(v) for v in values], status.alias("attach_status"))


def attached_or_fail(rows: DataFrame, quotes: DataFrame, keys: list[str], at: str, values: list[str], same: list[str] = ()) -> DataFrame:
    """``attached`` where every row must be ok; the first that isn't fails the job and is named."""
    got = attached(rows, quotes, keys, at, values, same)
    message = F.concat_ws(" ", F.lit("no usable quote:"), F.col("attach_status"), *[F.col(k).cast("string") for k in keys])
    first = F.when(F.col("attach_status") != "ok", F.raise_error(message).cast(got.schema[keys[0]].dataType)).otherwise(F.col(keys[0]))
    return got.withColumn(keys[0], first).drop("attach_status")
