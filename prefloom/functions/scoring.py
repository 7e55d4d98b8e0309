"""Pair and rating probabilities from utilities, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefloom import constants as c
from prefloom.functions.vectors import sigmoid


def pair_probability(left: Column, right: Column) -> Column:
    return sigmoid(left - right)


def pair_uncertainty(left: Column, right: Column) -> Column:
    return F.lit(1.0) - F.abs(F.lit(2.0) * pair_probability(left, right) - F.lit(1.0))


def rating_distribution(utility: Column, thresholds: Column) -> Column:
    """Probabilities of the values 1-5 from four strictly ordered thresholds.

    Differences of ordered probabilities already sum to one; the floor absorbs rounding. Pass
    plain columns: every argument appears once per threshold and side.
    """
    above = [F.lit(1.0), *[sigmoid(utility - F.get(thresholds, F.lit(k))) for k in range(c.RATING_LEVELS - 1)], F.lit(0.0)]
    parts = [F.greatest(F.lit(0.0), a - b) for a, b in zip(above, above[1:])]
    return F.when(utility.isNotNull(), F.array(*parts))


def expected_rating(distribution: Column) -> Column:
    terms = [F.get(distribution, F.lit(k)) * (k + 1) for k in range(c.RATING_LEVELS)]
    return sum(terms[1:], terms[0])


def most_likely(distribution: Column) -> Column:
    """Most probable value; ties go to the lowest."""
    return F.array_position(distribution, F.array_max(distribution)).cast("int")


def log_loss(label: Column, probability: Column) -> Column:
    p = F.greatest(F.lit(c.PROBABILITY_CLIP), F.least(F.lit(1.0 - c.PROBABILITY_CLIP), probability))
    return -(label * F.log(p) + (F.lit(1.0) - label) * F.log(F.lit(1.0) - p))


def acquisition(members: Column, quality: Column, beta: float, gamma: float) -> Column:
    """Upper-confidence score of an item: mean of its ensemble utilities, their spread and a bounded quality prior.

    The prior is held to 0..1 and a missing one is 0; without a member utility there is no score.
    """
    known = F.filter(members, lambda u: u.isNotNull())
    size = F.size(known)
    mean = F.aggregate(known, F.lit(0.0), lambda a, u: a + u) / size
    spread = F.sqrt(F.aggregate(known, F.lit(0.0), lambda a, u: a + (u - mean) * (u - mean)) / size)
    prior = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(quality, F.lit(0.0))))
    return F.when(size > 0, mean + beta * spread + gamma * prior)
