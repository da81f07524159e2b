"""Instants in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[T ]([0-9]{2}:[0-9]{2})(:[0-9]{2}(?:\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2})$"


def iso_instant(text: Column) -> Column:
    """An ISO-8601 date and time as an instant; null without an offset (``Z`` or hours and minutes), and
    for a day or time that doesn't exist. Seconds may be left out."""
    t = F.trim(text)
    # one match a text: the pattern fixes the places, a cast takes the rest
    full = F.when(F.substring(t, 17, 1) == ":", t).otherwise(F.concat(F.substring(t, 1, 16), F.lit(":00"), F.substring(t, 17, 6)))
    return F.when(t.rlike(_ISO), full.try_cast("timestamp"))
