"""Odds, stakes and closed-form top-three probabilities as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .safe import clip


def fair_odds(p: Column) -> Column:
    return F.when(p <= 0, F.lit(float("inf"))).otherwise(1 / F.nullif(p, F.lit(0.0)))


def expected_return(p: Column, odds: Column) -> Column:
    return p * odds


def edge(p: Column, odds: Column) -> Column:
    return p * odds - 1


def kelly_fraction(p: Column, odds: Column) -> Column:
    """(p * odds - 1) / (odds - 1) within [0, 1]; 0 for odds of 1 or less, or p outside (0, 1)."""
    raw = (p * odds - 1) / F.nullif(odds - 1, F.lit(0.0))
    return F.when((odds > 1) & (p > 0) & (p < 1), clip(raw, 0.0, 1.0)).otherwise(0.0)


def round_down(value: Column, unit: int) -> Column:
    return (F.floor(F.greatest(F.lit(0.0), value) / unit) * unit).cast("long")


def rounded_stake(bankroll: Column, p: Column, odds: Column, share: float = 0.25, race_cap: float = 0.05, cap: int = 5000, unit: int = 100, least: int = 100) -> Column:
    """Fractional Kelly, capped for the race and in money, in whole units; 0 below the least bet."""
    raw = F.least(bankroll * kelly_fraction(p, odds) * share, bankroll * race_cap, F.lit(float(cap)))
    stake = round_down(raw, unit)
    return F.when(stake >= least, stake).otherwise(F.lit(0)).cast("long")


def payout(stake: Column, odds: Column) -> Column:
    """Half-even rounding, as for money."""
    return F.rint(stake * odds).cast("long")


def blend(model: Column, market: Column, alpha: float | Column) -> Column:
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    return a * model + (1 - a) * market


def overlay_ratio(p: Column, market: Column) -> Column:
    return p / F.greatest(market, F.lit(1e-12)) - 1


def residual_scale(market: Column, floor: float = 1e-4) -> Column:
    return F.sqrt(F.greatest(market * (1 - market), F.lit(floor)))


def strength(p: Column) -> Column:
    """q / (1 - q) with q kept off 0 and 1."""
    q = clip(p, 1e-9, 1 - 1e-9)
    return q / (1 - q)


def plackett_luce(a: Column, b: Column, c: Column, total: Column) -> Column:
    """Probability of the order a, b, c from strengths and their sum over the race."""
    tiny = F.lit(1e-300)
    return a / F.greatest(total, tiny) * b / F.greatest(total - a, tiny) * c / F.greatest(total - a - b, tiny)


def decide_win(p: Column, odds: Column, confidence: Column, bankroll: Column, min_p: float = 0.1, min_confidence: float = 0.0, min_value: float = 1.15, share: float = 0.25, race_cap: float = 0.05, cap: int = 5000, unit: int = 100, least: int = 100) -> Column:
    """The whole decision on a win bet: (bet_type, stake, odds, expected_return, edge, reason)."""
    value = expected_return(p, odds)
    why = decision_reason(p, confidence, value, min_p, min_confidence, min_value)
    stake = F.when(why == "eligible", rounded_stake(bankroll, p, odds, share, race_cap, cap, unit, least)).otherwise(F.lit(0)).cast("long")
    reason = F.when(why != "eligible", why).when(stake > 0, "selected").otherwise("kelly_non_positive_or_below_unit")
    return F.struct(F.lit("WIN").alias("bet_type"), stake.alias("stake"), odds.alias("odds"), value.alias("expected_return"), edge(p, odds).alias("edge"), reason.alias("reason"))


def decision_reason(p: Column, confidence: Column, value: Column, min_p: float, min_confidence: float, min_value: float) -> Column:
    """Why a candidate isn't bet on, by the first rule that fails; comparisons with null don't fail."""
    return (
        F.when(p < min_p, "probability_below_minimum")
        .when(confidence < min_confidence, "confidence_below_minimum")
        .when(value < min_value, "expected_value_below_minimum")
        .otherwise("eligible")
    )
