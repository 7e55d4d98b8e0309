"""Feature rows for the preference model and scoring of libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.functions.vectors import difference, dot, is_finite
from prefloom.operators.ordered import last_per_key


def pair_features(comparisons: DataFrame, embeddings: DataFrame) -> DataFrame:
    """x = left vector minus right vector, y = 1 when the left side won."""
    left = embeddings.select(F.col("image_id").alias("left_id"), F.col("vector").alias("_l"))
    right = embeddings.select(F.col("image_id").alias("right_id"), F.col("vector").alias("_r"))
    joined = comparisons.join(left, "left_id").join(right, "right_id")
    return joined.withColumn("x", difference(F.col("_l"), F.col("_r"))).withColumn(
        "y", (F.col("winner_id") == F.col("left_id")).cast("double")
    ).drop("_l", "_r")


def rating_features(ratings: DataFrame, embeddings: DataFrame) -> DataFrame:
    return ratings.join(embeddings.select("image_id", F.col("vector").alias("x")), "image_id")


def feedback_images(comparisons: DataFrame, ratings: DataFrame) -> DataFrame:
    """Every image that comparisons (either side) or ratings name."""
    sides = comparisons.select(F.explode(F.array("left_id", "right_id")).alias("image_id"))
    return sides.unionByName(ratings.select("image_id")).distinct()


def missing_vectors(image_ids: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Images that feedback needs but no vector exists for; must be empty before a fit."""
    return image_ids.select("image_id").distinct().join(embeddings, "image_id", "left_anti")


def score(embeddings: DataFrame, weights: Column) -> DataFrame:
    """Utility of every vector; only finite scores are valid."""
    scored = embeddings.withColumn("utility", dot(F.col("vector"), weights))
    return scored.withColumn("valid", is_finite(F.array("utility")))


def score_library(library: DataFrame, embeddings: DataFrame, models: DataFrame) -> DataFrame:
    """Utilities of a library under each user's own model; users without one keep NULL.

    Old scores are dropped first, so an item without a vector loses its score.
    """
    rows = library.drop("predicted_utility").join(embeddings.select("image_id", "vector"), "image_id", "left")
    rows = rows.join(models.select("user_id", "weights"), "user_id", "left")
    return rows.withColumn("predicted_utility", dot(F.col("vector"), F.col("weights"))).drop("vector", "weights")


def scoring_violations(wanted: DataFrame, images: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (user_id, image_id) that cannot be scored, each once, with the check it fails.

    unknown-image: null or not among ``images``; missing-vector: known, but without a stored vector.
    """
    rows = wanted.select("user_id", "image_id").distinct()
    known = images.select("image_id").distinct().withColumn("_known", F.lit(True))
    stored = embeddings.filter(F.col("vector").isNotNull()).select("image_id").distinct().withColumn("_stored", F.lit(True))
    checked = rows.join(known, "image_id", "left").join(stored, "image_id", "left")
    failed = F.when(F.col("_known").isNull(), "unknown-image").when(F.col("_stored").isNull(), "missing-vector")
    return checked.select("user_id", "image_id", failed.alias("check")).filter(F.col("check").isNotNull())


def score_requested(wanted: DataFrame, images: DataFrame, embeddings: DataFrame, models: DataFrame) -> DataFrame:
    """Utilities of the (user, image) rows asked for; raises if one of them cannot be scored."""
    bad = scoring_violations(wanted, images, embeddings).orderBy("check", "image_id").limit(5).collect()
    if bad:
        raise ValueError(f"items that cannot be scored, such as {[(r['user_id'], r['image_id'], r['check']) for r in bad]}")
    rows = wanted.select("user_id", "image_id").distinct().withColumn("predicted_utility", F.lit(None).cast("double"))
    return score_library(rows, embeddings, models)


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """(image, encoder) pairs that still need encoding."""
    return wanted.join(cache.select("image_id", "encoder"), ["image_id", "encoder"], "left_anti")


def refresh_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    return last_per_key(cache.unionByName(fresh), ["image_id", "encoder"], ["created_at"])
