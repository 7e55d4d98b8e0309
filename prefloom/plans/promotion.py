"""Promotion gate over holdout metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom import constants as c

# Reasons stored with a model.
NO_HOLDOUT = "no grouped feedback holdout was available"
NO_SUPPORT = "joint image-disjoint holdout left too little training feedback"
PAIR_BASELINE = "pairwise holdout did not beat the 0.5 baseline"
PAIR_REGRESSED = "pairwise holdout materially regressed from the promoted head"
ORDINAL_BASELINE = "ordinal holdout did not beat its empirical baseline"
ORDINAL_REGRESSED = "ordinal holdout materially regressed from the promoted head"
PASSED = "grouped feedback holdout passed baseline and regression gates"


def pair_failure() -> Column:
    m = F.col
    return (
        F.when((m("pair_accuracy") <= c.GATE_MIN_ACCURACY) | (m("pair_log_loss") >= m("pair_base_log_loss")), PAIR_BASELINE)
        .when(
            (m("pair_fresh_accuracy") < m("pair_prior_accuracy") - c.GATE_ACCURACY_REGRESSION)
            | (m("pair_fresh_log_loss") > m("pair_prior_log_loss") + c.GATE_LOG_LOSS_REGRESSION),
            PAIR_REGRESSED,
        )
    )


def ordinal_failure() -> Column:
    m = F.col
    return (
        F.when((m("ord_log_loss") >= m("ord_base_log_loss")) | (m("ord_mae") > m("ord_base_mae") + c.GATE_MAE_REGRESSION), ORDINAL_BASELINE)
        .when(
            (m("ord_fresh_log_loss") > m("ord_prior_log_loss") + c.GATE_LOG_LOSS_REGRESSION)
            | (m("ord_fresh_mae") > m("ord_prior_mae") + c.GATE_MAE_REGRESSION),
            ORDINAL_REGRESSED,
        )
    )


def gate(metrics: DataFrame) -> DataFrame:
    """Promoted flag and reason per row of holdout metrics.

    Sizes: validation_pairs, validation_ratings, training_pairs, training_ratings. Metrics of a
    missing holdout or incumbent are NULL, and a comparison with NULL never fails a gate.
    """
    m = F.col
    seeded = (m("validation_pairs") > 0) | (m("validation_ratings") > 0)
    supported = ((m("training_pairs") >= c.MIN_COMPARISONS) | (m("training_ratings") >= c.MIN_RATINGS)) & (
        (m("validation_ratings") == 0) | (m("training_ratings") >= c.MIN_RATINGS)
    )
    failures = F.concat_ws(
        "; ", F.when(m("validation_pairs") > 0, pair_failure()), F.when(m("validation_ratings") > 0, ordinal_failure())
    )
    reason = (
        F.when(~seeded, NO_HOLDOUT).when(~supported, NO_SUPPORT).when(failures != "", failures).otherwise(PASSED)
    )
    return metrics.withColumn("promotion_reason", reason).withColumn("promoted", F.col("promotion_reason") == PASSED)
