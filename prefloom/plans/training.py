"""The training job for all users at once: windows, features, split, fit, gate, refit, rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom import constants as c
from prefloom.functions.scoring import rating_distribution
from prefloom.functions.vectors import dot, sigmoid
from prefloom.operators import features, feedback, metrics, splits
from prefloom.plans.model import fit_users, with_user_thresholds
from prefloom.plans.promotion import gate
from prefloom.session import checkpoint_dir


def participant_cap() -> int:
    return math.floor(c.TRAINING_IMAGES * c.PARTICIPANT_SHARE)


def training_windows(comparisons: DataFrame, ratings: DataFrame, cutoffs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback up to the cutoffs inside the image cap, as (pairs, ratings) with positions.

    ``cutoffs`` has user_id, comparison_cutoff and rating_cutoff.
    """
    pair_cut = cutoffs.select("user_id", F.col("comparison_cutoff").alias("cutoff"))
    rating_cut = cutoffs.select("user_id", F.col("rating_cutoff").alias("cutoff"))
    pairs = feedback.feedback_window(comparisons, pair_cut, "created_at")
    points = feedback.feedback_window(ratings, rating_cut, "rated_at")
    kept = feedback.participant_window(feedback.timeline(pairs, points), participant_cap()).select("user_id", "id", "kind")
    usable = feedback.window_sufficiency(kept).filter("sufficient").select("user_id")
    kept = kept.join(usable, "user_id", "left_semi")
    chosen_pairs = pairs.join(kept.filter("kind = 'comparison'").drop("kind"), ["user_id", "id"], "left_semi")
    chosen_points = points.join(kept.filter("kind = 'rating'").drop("kind"), ["user_id", "id"], "left_semi")
    return chosen_pairs, chosen_points


def seeded(pairs: DataFrame, ratings: DataFrame, prior: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mark the fresh validation seeds of both streams; ``prior`` has the cutoffs of the last model."""

    def mark(rows: DataFrame, cutoff: str, first, second) -> DataFrame:
        last = prior.select("user_id", F.col(cutoff).alias("prior_cutoff"))
        keyed = rows.join(last, "user_id", "left").fillna(0, ["prior_cutoff"])
        keyed = keyed.withColumns({"first_id": first, "second_id": second})
        seeds = splits.fresh_validation(keyed).select("user_id", "id", F.lit(True).alias("is_seed"))
        return rows.join(seeds, ["user_id", "id"], "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))

    return (
        mark(pairs, "comparison_cutoff", F.least("left_id", "right_id"), F.greatest("left_id", "right_id")),
        mark(ratings, "rating_cutoff", F.col("image_id"), F.col("image_id")),
    )


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("side") == name)


def holdout_metrics(pairs: DataFrame, ratings: DataFrame, models: DataFrame, incumbents: DataFrame) -> DataFrame:
    """Candidate, baseline and incumbent metrics per user on the validation side.

    ``models`` were fitted on the training side; ``incumbents`` has user_id, weights and
    thresholds of the promoted models (thresholds NULL without ratings).
    """
    new = models.select("user_id", "weights", "thresholds")
    old = incumbents.select("user_id", F.col("weights").alias("old_weights"), F.col("thresholds").alias("old_thresholds"))

    sizes = pairs.groupBy("user_id").agg(
        F.count_if(F.col("side") == "train").alias("training_pairs"), F.count_if(F.col("side") == "validation").alias("validation_pairs")
    ).join(
        ratings.groupBy("user_id").agg(
            F.count_if(F.col("side") == "train").alias("training_ratings"),
            F.count_if(F.col("side") == "validation").alias("validation_ratings"),
        ), "user_id", "full_outer",
    ).fillna(0)

    label, value = F.col("y"), F.col("value")
    vp = _side(pairs, "validation").join(new, "user_id").join(old, "user_id", "left")
    vp = vp.withColumn("p", sigmoid(dot(F.col("x"), F.col("weights")))).withColumn("q", sigmoid(dot(F.col("x"), F.col("old_weights"))))
    pair = vp.groupBy("user_id").agg(*metrics.binary_columns(label, F.col("p"), "pair_"), *metrics.binary_columns(label, F.col("q"), "pair_prior_"))

    prior = metrics.class_prior(_side(ratings, "train"), ["user_id"])
    vr = _side(ratings, "validation").join(new, "user_id").filter(F.col("thresholds").isNotNull()).join(prior, "user_id").join(old, "user_id", "left")
    vr = vr.withColumn("u", dot(F.col("x"), F.col("weights"))).withColumn("old_u", dot(F.col("x"), F.col("old_weights")))
    vr = vr.withColumn("p", rating_distribution(F.col("u"), F.col("thresholds")))
    vr = vr.withColumn("q", F.when(F.col("old_thresholds").isNotNull(), rating_distribution(F.col("old_u"), F.col("old_thresholds"))))
    points = vr.groupBy("user_id").agg(
        *metrics.ordinal_columns(value, "p", "ord_"), *metrics.ordinal_columns(value, "prior", "ord_base_"),
        *metrics.ordinal_columns(value, "q", "ord_prior_"),
    )
    out = sizes.join(pair, "user_id", "left").join(points, "user_id", "left")
    out = out.withColumn("pair_base_log_loss", F.when(F.col("validation_pairs") > 0, F.lit(math.log(2.0))))
    # every validation seed is newer than the incumbent, so its comparison uses the same rows
    for kind, size, measures in (("pair", "validation_pairs", ("accuracy", "log_loss")), ("ord", "validation_ratings", ("log_loss", "mae"))):
        enough = F.col(size) >= c.MIN_RATINGS
        for name in measures:
            known = enough & F.col(f"{kind}_prior_{name}").isNotNull()
            out = out.withColumn(f"{kind}_fresh_{name}", F.when(known, F.col(f"{kind}_{name}")))
            out = out.withColumn(f"{kind}_prior_{name}", F.when(known, F.col(f"{kind}_prior_{name}")))
    return out


def stored_counts(comparisons: DataFrame, ratings: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Events of each user up to the cutoffs, whether or not the windows take them all."""
    out = cutoffs
    for name, log in (("comparison", comparisons), ("rating", ratings)):
        ends = cutoffs.select("user_id", F.col(f"{name}_cutoff").alias("_cut"))
        seen = log.select("user_id", "id").join(ends, "user_id").filter(F.col("id") <= F.col("_cut"))
        out = out.join(seen.groupBy("user_id").agg(F.count("*").alias(f"{name}_count")), "user_id", "left")
    return out.fillna(0, ["comparison_count", "rating_count"])


def train(
    comparisons: DataFrame, ratings: DataFrame, embeddings: DataFrame, cutoffs: DataFrame, prior: DataFrame, incumbents: DataFrame, seed: str = "ensemble"
) -> DataFrame:
    """One model row per user with enough feedback: parameters, ensemble, metrics, promotion and cutoffs.

    Users already trained at the same cutoffs are left out, so a repeated run adds nothing. Counts
    are those of the whole logs up to the cutoffs. Feedback on an image without a vector is an error.
    """
    checkpoint_dir(comparisons.sparkSession)
    done = prior.select("user_id", "comparison_cutoff", "rating_cutoff")
    due = cutoffs.join(done, ["user_id", "comparison_cutoff", "rating_cutoff"], "left_anti")
    windows = [rows.checkpoint() for rows in training_windows(comparisons, ratings, due)]
    pairs, points = seeded(*windows, prior)
    pairs, points = splits.image_disjoint_split(pairs, points)
    missing = features.missing_vectors(features.feedback_images(pairs, points), embeddings).limit(5).collect()
    if missing:
        raise ValueError(f"feedback on images without a vector, such as {[r['image_id'] for r in missing]}")
    # the windows are bounded per user and feed both fits and the evaluation
    x_pairs = features.pair_features(pairs, embeddings).checkpoint()
    x_points = features.rating_features(points, embeddings).checkpoint()
    evaluation = fit_users(_side(x_pairs, "train"), _side(x_points, "train")).checkpoint()
    incumbents = with_user_thresholds(incumbents, _side(x_points, "train"))
    gated = gate(holdout_metrics(x_pairs, x_points, evaluation, incumbents))
    final = fit_users(x_pairs, x_points, seed)
    columns = [k for k in gated.columns if k != "user_id"]
    return (
        final.join(gated, "user_id", "left").join(stored_counts(comparisons, ratings, due), "user_id")
        .select(
            "user_id", "comparison_cutoff", "rating_cutoff", "comparison_count", "rating_count",
            (F.col("comparison_count") + F.col("rating_count")).alias("feedback_count"),
            (F.col("comparison_count") > F.col("pairs")).alias("comparison_window_capped"),
            (F.col("rating_count") > F.col("ratings")).alias("rating_window_capped"),
            "weights", "thresholds", "ensemble_weights", "ensemble_thresholds", "objective", F.struct(*[k for k in columns if not k.startswith("promot")]).alias("metrics"),
            "promoted", "promotion_reason",
        )
    )
