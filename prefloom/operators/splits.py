"""Leakage-free validation splits over bounded feedback windows.

Every function here runs after the feedback window, so a user holds at most the training event
limit and per-user windows stay bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefloom import constants as c


def _groups(events: DataFrame) -> DataFrame:
    """Size and latest position of every (user, least, greatest) group."""
    return events.groupBy("user_id", "first_id", "second_id").agg(
        F.max("position").alias("last_position"), F.count("*").alias("size")
    )


def _latest_first(column: str = "last_position") -> Window:
    return Window.partitionBy("user_id").orderBy(F.col(column).desc())


def fresh_validation(events: DataFrame, minimum: int = c.MIN_FRESH_VALIDATION) -> DataFrame:
    """Latest whole groups of events beyond the prior cutoff until ``minimum`` rows.

    ``events`` has user_id, id, position, first_id, second_id and prior_cutoff.
    """
    fresh = events.filter(F.col("id") > F.col("prior_cutoff"))
    frame = _latest_first()
    groups = _groups(fresh).withColumn(
        "_before", F.coalesce(F.sum("size").over(frame.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("_total", F.sum("size").over(Window.partitionBy("user_id")))
    chosen = groups.filter((F.col("_before") < minimum) & (F.col("_total") >= minimum))
    return fresh.join(chosen.select("user_id", "first_id", "second_id"), ["user_id", "first_id", "second_id"], "left_semi")


def chronological_split(
    events: DataFrame, fraction: float = 0.2, min_validation: int = 5, min_training: int = 10
) -> DataFrame:
    """Add ``is_validation``: the suffix of groups whose size is closest to the target."""
    by_user = Window.partitionBy("user_id")
    groups = (
        _groups(events)
        .withColumn("_held", F.sum("size").over(_latest_first().rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_n", F.sum("size").over(by_user))
        .withColumn("_boundary", F.row_number().over(by_user.orderBy("last_position")) - 1)
    )
    target = F.greatest(F.lit(min_validation), F.ceil(F.col("_n") * F.lit(fraction)))
    possible = (
        (F.col("_n") >= min_validation + min_training)
        & (F.col("_boundary") >= 1)
        & (F.col("_held") >= min_validation)
        & (F.col("_n") - F.col("_held") >= min_training)
    )
    distance = F.struct(F.abs(F.col("_held") - target).alias("distance"), (-F.col("_boundary")).alias("boundary"))
    best = groups.filter(possible).groupBy("user_id").agg(F.min_by("last_position", distance).alias("_from"))
    flagged = groups.join(best, "user_id", "left").select(
        "user_id", "first_id", "second_id",
        F.coalesce(F.col("last_position") >= F.col("_from"), F.lit(False)).alias("is_validation"),
    )
    return events.join(flagged, ["user_id", "first_id", "second_id"])


def image_disjoint_split(pairs: DataFrame, ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add ``side`` (train, validation or dropped) to pairs and ratings with an ``is_seed`` flag.

    Seeds are scored. Other rows touching a seed image belong to neither side.
    """
    seeds = (
        pairs.filter("is_seed").select("user_id", F.explode(F.array("left_id", "right_id")).alias("image_id"))
        .union(ratings.filter("is_seed").select("user_id", "image_id"))
        .distinct()
        .withColumn("_held", F.lit(True))
    )

    def side(held):
        return F.when(F.col("is_seed"), "validation").when(held, "dropped").otherwise("train").alias("side")

    left = seeds.select("user_id", F.col("image_id").alias("left_id"), F.col("_held").alias("_hl"))
    right = seeds.select("user_id", F.col("image_id").alias("right_id"), F.col("_held").alias("_hr"))
    split_pairs = pairs.join(left, ["user_id", "left_id"], "left").join(right, ["user_id", "right_id"], "left")
    split_ratings = ratings.join(seeds, ["user_id", "image_id"], "left")
    return (
        split_pairs.select(*pairs.columns, side(F.coalesce("_hl", "_hr", F.lit(False)))),
        split_ratings.select(*ratings.columns, side(F.coalesce("_held", F.lit(False)))),
    )


def leaked_images(pairs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Images on both sides of a split; must be empty."""

    def images(name: str) -> DataFrame:
        return pairs.filter(F.col("side") == name).select(
            "user_id", F.explode(F.array("left_id", "right_id")).alias("image_id")
        ).union(ratings.filter(F.col("side") == name).select("user_id", "image_id"))

    return images("train").intersect(images("validation"))
