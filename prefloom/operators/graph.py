"""The comparison graph: pair counts, degrees, match counts and anchor items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefloom import constants as c
from prefloom.operators.ordered import grid_chunk, ranked


def pair_counts(comparisons: DataFrame) -> DataFrame:
    return (
        comparisons.groupBy(
            "user_id",
            F.least("left_id", "right_id").alias("first_id"),
            F.greatest("left_id", "right_id").alias("second_id"),
        )
        .agg(F.count("*").alias("pair_count"))
    )


def degrees(counts: DataFrame) -> DataFrame:
    """Distinct opponents per (user, image)."""
    ends = F.explode(F.array("first_id", "second_id")).alias("image_id")
    return counts.select("user_id", ends).groupBy("user_id", "image_id").agg(F.count("*").alias("degree"))


def match_counts(comparisons: DataFrame) -> DataFrame:
    sides = comparisons.select(
        "user_id",
        F.explode(
            F.array(
                F.struct(F.col("left_id").alias("image_id"), (F.col("winner_id") == F.col("left_id")).alias("won")),
                F.struct(F.col("right_id").alias("image_id"), (F.col("winner_id") == F.col("right_id")).alias("won")),
            )
        ).alias("side"),
    )
    return sides.groupBy("user_id", F.col("side.image_id").alias("image_id")).agg(
        F.count("*").alias("matches"),
        F.count_if("side.won").alias("wins"),
        F.count_if(~F.col("side.won")).alias("losses"),
    )


def with_degree(library: DataFrame, comparisons: DataFrame) -> DataFrame:
    return library.join(degrees(pair_counts(comparisons)), ["user_id", "image_id"], "left").withColumn(
        "degree", F.coalesce("degree", F.lit(0))
    )


def is_stable() -> Column:
    return (F.col("matches") >= c.ANCHOR_MIN_MATCHES) & (F.col("degree") >= c.ANCHOR_MIN_OPPONENTS)


def anchor_position(position: Column, total: Column) -> Column:
    """Whether a 1-based rank is one of the evenly spaced quantile positions (half up)."""
    last = c.ANCHOR_QUANTILES - 1
    wanted = F.array(*[F.floor(F.lit(float(i)) * (total - 1) / F.lit(float(last)) + F.lit(0.5)) for i in range(last + 1)])
    return (total <= c.ANCHOR_QUANTILES) | F.array_contains(wanted, (position - 1).cast("bigint"))


def quantile_anchors(nodes: DataFrame) -> DataFrame:
    """(user_id, image_id) of the anchors; users may own any number of items.

    Ranks come from running counts on an Elo grid instead of one sort per user.
    """
    stable = nodes.filter(is_stable()).select("user_id", "image_id", "elo")
    total = stable.groupBy("user_id").agg(F.count("*").alias("total"))
    placed = ranked(stable, ["user_id"], ["elo", "image_id"], grid_chunk("elo", 10.0))
    return placed.join(total, "user_id").filter(anchor_position(F.col("position"), F.col("total"))).select("user_id", "image_id")


def pool_anchor_flag(pool: DataFrame) -> DataFrame:
    """Anchor flag inside an already bounded pool (at most the pool size per user)."""
    by_user = Window.partitionBy("user_id")
    stable = F.when(is_stable(), F.lit(1))
    ranked_pool = pool.withColumn("_total", F.count(stable).over(by_user)).withColumn(
        "_rank", F.row_number().over(by_user.orderBy(F.when(is_stable(), 0).otherwise(1), "elo", "image_id"))
    )
    flag = is_stable() & anchor_position(F.col("_rank"), F.col("_total"))
    return ranked_pool.withColumn("is_anchor", flag).drop("_total", "_rank")


def under_compared() -> Column:
    return (F.col("matches") < c.UNDER_COMPARED_MATCHES) | (F.col("degree") < c.UNDER_CONNECTED_OPPONENTS)
