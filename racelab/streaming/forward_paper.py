"""From a frozen model to recorded paper bets: features of future entries, probabilities, quotes, stakes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racelab.ml.artifacts import Frozen
from racelab.ml.forward import future_frame, normalised
from racelab.operators.checks import horse_id
from racelab.operators.intake import from_training_start, starters
from racelab.sources.ledger_table import LedgerTable
from racelab.streaming import paper


def predictions(model: Frozen, history: DataFrame, entries: DataFrame, features: Callable[[DataFrame], DataFrame], predicted_at, most_gap_days: int = 14, allow_stale: bool = False) -> DataFrame:
    """Predictions of a frozen model for the entries that start, as ``paper.evaluations`` takes them.

    The history is cut to the model's training start. ``predicted_at``: a Column with the time of each
    prediction. Probabilities are checked to sum to one in every race where they are made.
    """
    aligned = from_training_start(history, model.manifest.train_start)
    needed = [*model.manifest.numbers, *model.manifest.categories]
    future = future_frame(aligned, starters(entries), features, needed, most_gap_days, allow_stale)
    scored = normalised(model.predict(future), "predicted_win_probability")
    order = F.xxhash64("race_id").bitwiseAND(F.lit((1 << 40) - 1)) * 1000 + F.col("post_position")
    return scored.select(
        "race_id", horse_id(F.col("race_id"), F.col("post_position"), F.lit(0)).alias("horse_id"), "horse_name", "model_version",
        F.col("predicted_win_probability").alias("probability"), "confidence", predicted_at.alias("predicted_at"), order.alias("sequence"), "history_cutoff", "model_train_end",
    )


def run(model: Frozen, history: DataFrame, entries: DataFrame, features: Callable[[DataFrame], DataFrame], quotes: DataFrame, table: LedgerTable, bankroll: float, predicted_at, config: paper.Config = paper.Config(), batch: int | None = None, **dates) -> int:
    """Predict, evaluate and record in one commit; races that the ledger holds for this model are skipped.
    Gives the rows recorded."""
    got = predictions(model, history, entries, features, predicted_at, **dates)
    return paper.run(got, quotes, table, bankroll, config, "forward", batch)
