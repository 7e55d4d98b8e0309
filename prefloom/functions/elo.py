"""Elo and pair-value column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefloom import constants as c


def expected_score(own: Column, other: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (other - own) / F.lit(c.ELO_SCALE)))


def adaptive_k(matches: Column) -> Column:
    """NULL in, NULL out: ``greatest`` alone would skip the NULL."""
    k = F.greatest(F.lit(c.K_FLOOR), F.lit(c.K_START) / F.sqrt(F.lit(1.0) + matches / F.lit(c.K_HALF_LIFE)))
    return F.when(matches.isNotNull(), k)


def elo_change(left: Column, right: Column, left_matches: Column, right_matches: Column, left_won: Column) -> Column:
    """Signed change of the left rating; the right one moves by the opposite amount."""
    k = F.least(adaptive_k(left_matches), adaptive_k(right_matches))
    return k * (left_won.cast("double") - expected_score(left, right))


def coverage_need(matches: Column, degree: Column) -> Column:
    return F.lit(0.6) / (F.lit(1.0) + matches) + F.lit(0.4) / (F.lit(1.0) + degree)


def coverage_score(need_a: Column, need_b: Column, pair_count: Column) -> Column:
    return F.lit(0.75) * (need_a + need_b) / F.lit(2.0) + F.lit(0.25) / (F.lit(1.0) + pair_count)


def pair_value(utility_a: Column, utility_b: Column, elo_a: Column, elo_b: Column, coverage: Column) -> Column:
    """Uncertainty under the model when both sides are scored, closeness in Elo otherwise."""
    decay = F.exp(-F.abs(utility_a - utility_b))
    modelled = F.lit(0.7) * (F.lit(2.0) * decay / (F.lit(1.0) + decay)) + F.lit(0.3) * coverage
    closeness = F.lit(1.0) / (F.lit(1.0) + F.abs(elo_a - elo_b) / F.lit(200.0))
    unmodelled = F.lit(0.6) * coverage + F.lit(0.4) * closeness
    return F.when(utility_a.isNotNull() & utility_b.isNotNull(), modelled).otherwise(unmodelled)
