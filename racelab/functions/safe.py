"""Null- and NaN-safe scalar helpers (Spark's ANSI mode raises on x / 0, and NaN > 1 is true)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """A nullable double: what doesn't parse, NaN and infinities are null."""
    x = c.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clip(c: Column, low: float, high: float) -> Column:
    """Null stays null (least and greatest skip nulls)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is zero or null."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def category(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("UNKNOWN"))


def rounded(c: Column, places: int = 9) -> Column:
    return F.round(c, places)
