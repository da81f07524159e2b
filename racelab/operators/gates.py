"""Gates: named bounds on one row of measures, judged in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    """``measure`` above (or below) ``bound``; ``support``: columns that must reach a least value before the
    measure means anything."""

    name: str
    measure: str
    bound: float = 0.0
    below: bool = False
    inclusive: bool = False
    support: tuple[tuple[str, float], ...] = ()

    def enough(self) -> Column:
        out = F.lit(True)
        for column, least in self.support:
            out = out & F.coalesce(F.col(column) >= least, F.lit(False))
        return out

    def met(self) -> Column:
        x, b = F.col(self.measure).cast("double"), F.lit(float(self.bound))
        rule = (x <= b if self.inclusive else x < b) if self.below else (x >= b if self.inclusive else x > b)
        return F.coalesce(rule & ~F.isnan(x), F.lit(False))


def table(measures: DataFrame, gates: list[Gate], by: list[str] = ()) -> DataFrame:
    """(by, gate, observed, bound, status, passed), a row for each gate and row of measures; status is
    ``passed``, ``failed``, ``insufficient`` or, without a measure, ``unavailable``."""
    rows = []
    for g in gates:
        x = F.col(g.measure).cast("double")
        status = F.when(~g.enough(), "insufficient").when(x.isNull() | F.isnan(x), "unavailable").when(g.met(), "passed").otherwise("failed")
        rows.append(F.struct(F.lit(g.name).alias("gate"), x.alias("observed"), F.lit(float(g.bound)).alias("bound"), status.alias("status")))
    out = measures.select(*by, F.explode(F.array(*rows)).alias("g")).select(*by, "g.*")
    return out.withColumn("passed", F.col("status") == "passed")


def verdict(judged: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row (for each of ``by``): whether all gates passed, and the first reasons why not."""
    return judged.groupBy(*by).agg(
        F.bool_and("passed").alias("passed"),
        F.count_if("passed").alias("gates_passed"),
        F.count("*").alias("gates"),
        F.concat_ws(",", F.array_sort(F.collect_list(F.when(~F.col("passed"), F.concat("gate", F.lit(":"), "status"))))).alias("reasons"),
    )
