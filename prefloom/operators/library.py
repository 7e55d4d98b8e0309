"""Library projections: leaderboards, queues, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.operators.ordered import first_per_key, top_per_key


def active_library(user_images: DataFrame, images: DataFrame) -> DataFrame:
    """Library rows whose link and item are both active."""
    items = images.filter("active").drop("active")
    return user_images.filter("active").drop("active").join(items, "image_id")


def library_stats(library: DataFrame, comparisons: DataFrame, ratings: DataFrame) -> DataFrame:
    """Active images, comparisons and ratings per user in one aggregation."""

    def tally(df: DataFrame, name: str) -> DataFrame:
        zeros = [F.lit(1 if name == other else 0).alias(other) for other in ("images", "comparisons", "ratings")]
        return df.select("user_id", *zeros)

    rows = tally(library, "images").unionByName(tally(comparisons, "comparisons")).unionByName(tally(ratings, "ratings"))
    return rows.groupBy("user_id").agg(*[F.sum(n).alias(n) for n in ("images", "comparisons", "ratings")])


def leaderboard(library: DataFrame, limit: int = 100) -> DataFrame:
    limit = max(1, min(500, limit))
    shown = library.filter(F.col("point_rating").isNotNull() | (F.col("matches") > 0))
    order = [
        F.col("point_rating").desc_nulls_last(), F.col("predicted_utility").desc_nulls_last(),
        F.col("elo").desc(), F.col("matches").desc(), F.col("image_id"),
    ]
    return top_per_key(shown, ["user_id"], order, limit, "rank")


def local_leaderboard(library: DataFrame, limit: int = 100) -> DataFrame:
    """Compared items by Elo; the id is added as the last tie-break."""
    order = [F.col("elo").desc(), F.col("matches").desc(), F.col("image_id")]
    return top_per_key(library.filter(F.col("matches") > 0), ["user_id"], order, limit, "rank")


def last_issued(issuances: DataFrame) -> DataFrame:
    return issuances.groupBy("user_id", "image_id").agg(F.max("issued_at").alias("last_issued_at"))


def next_to_rate(library: DataFrame, issuances: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """One unrated item per user: never or longest ago issued, then newest, then highest id."""
    open_items = library.filter(F.col("point_rating").isNull())
    if excluded is not None:
        open_items = open_items.join(excluded, ["user_id", "image_id"], "left_anti")
    queue = open_items.select("user_id", "image_id", "discovered_day").join(
        last_issued(issuances), ["user_id", "image_id"], "left"
    )
    order = [
        F.col("last_issued_at").isNotNull(), F.col("last_issued_at"), -F.col("discovered_day"), -F.col("image_id"),
    ]
    return first_per_key(queue, ["user_id"], order)


def participants(comparisons: DataFrame, user_images: DataFrame) -> DataFrame:
    """Distinct compared images that are still active in the library."""
    sides = comparisons.select("user_id", F.col("left_id").alias("image_id")).union(
        comparisons.select("user_id", F.col("right_id").alias("image_id"))
    )
    return sides.distinct().join(user_images.filter("active"), ["user_id", "image_id"], "left_semi")
