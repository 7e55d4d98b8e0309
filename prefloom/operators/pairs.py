"""Informative next pairs for all users at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom import constants as c
from prefloom.functions.elo import coverage_need, coverage_score, pair_value
from prefloom.functions.hashing import coin, digest
from prefloom.operators.feedback import recent_pairs
from prefloom.operators.graph import (
    degrees,
    pair_counts,
    pool_anchor_flag,
    quantile_anchors,
    under_compared,
    with_degree,
)
from prefloom.operators.ordered import top_per_key
from prefloom.session import landed

NODE = ("user_id", "image_id", "elo", "matches", "degree", "predicted_utility")


def pair_nodes(library: DataFrame, comparisons: DataFrame) -> DataFrame:
    return with_degree(library.select("user_id", "image_id", "elo", "matches", "predicted_utility"), comparisons).select(*NODE)


def coverage_pool(nodes: DataFrame, seed: str, slots: int = c.COVERAGE_SLOTS) -> DataFrame:
    """The least compared, least connected items of every user."""
    order = [F.col("matches"), F.col("degree"), digest(F.lit(seed), "user_id", "image_id"), F.col("image_id")]
    return top_per_key(nodes, ["user_id"], order, slots)


def candidate_pool(library: DataFrame, comparisons: DataFrame, seed: str, with_anchors: bool = True) -> DataFrame:
    """Coverage, anchor and exploration items: at most the pool size per user.

    Three rank-limited scans give a bounded set per user. Coverage and anchor items come first;
    the exploration draw keeps enough extra rows to fill the pool after them, so one ranking of
    the union replaces counting and anti joins. Only coverage needs degrees of the whole library.
    The single-machine form has no anchors.
    """
    keys = ["user_id", "image_id"]
    items = library.select(*keys, "elo", "matches", "predicted_utility")
    degree = degrees(pair_counts(comparisons))
    coverage = coverage_pool(pair_nodes(items, comparisons), seed).select(*keys, F.lit(0).cast("bigint").alias("turn"))
    compared = pair_nodes(items.filter(F.col("matches") >= c.ANCHOR_MIN_MATCHES), comparisons)
    anchors = quantile_anchors(compared).select(*keys, F.lit(0).cast("bigint").alias("turn"))
    reserve = c.POOL_SIZE + c.COVERAGE_SLOTS + c.ANCHOR_QUANTILES
    draw = [digest(F.lit(seed + "x"), *keys), F.col("image_id")]
    spare = top_per_key(items.select(*keys), ["user_id"], draw, reserve, "turn")
    first = coverage.unionByName(anchors) if with_anchors else coverage
    turns = first.unionByName(spare).groupBy(*keys).agg(F.min("turn").alias("turn"))
    chosen = top_per_key(turns, ["user_id"], [F.col("turn"), F.col("image_id")], c.POOL_SIZE).select(*keys)
    return chosen.join(items, keys).join(degree, keys, "left").withColumn("degree", F.coalesce("degree", F.lit(0))).select(*NODE)


def pool_pairs(pool: DataFrame, first_only: tuple[str, ...] = ()) -> DataFrame:
    """Unordered pairs inside each bounded pool (at most 96 choose 2 per user).

    A pool is one array of at most 96 structs, so pairing it needs no join and no second pass; pairs of a user stay
    in one task. Fields of ``first_only`` are carried for the first item of a pair alone.
    """
    fields = [k for k in pool.columns if k not in ("user_id", "image_id")]
    item = F.struct("image_id", *fields)
    arrays = pool.groupBy("user_id").agg(F.sort_array(F.collect_list(item)).alias("pool"))
    second = F.transform("pool", lambda x: x.dropFields(*first_only)) if first_only else F.col("pool")
    first = arrays.select("user_id", second.alias("others"), F.posexplode("pool").alias("place", "a"))
    rest = F.slice(F.col("others"), F.col("place") + 2, F.lit(c.POOL_SIZE))
    both = first.select("user_id", "a", F.explode(rest).alias("b"))
    return both.select(
        "user_id", F.col("a.image_id").alias("first_id"), F.col("b.image_id").alias("second_id"),
        *[F.col(f"{side}.{k}").alias(f"{side}_{k}") for side in "ab" for k in fields if side == "a" or k not in first_only],
    )


def _with_met(pool: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Pool items with what is known of their pairs with later items of the pool: at most 95 of them.

    Counts and recent pairs are far fewer than the pairs of a pool, so they go to the items before these are paired.
    """
    keys = ["user_id", "first_id", "second_id"]
    recent = recent_pairs(comparisons).select(*keys).distinct().withColumn("recent", F.lit(True))
    met = pair_counts(comparisons).join(recent, keys, "left")
    for end in ("first_id", "second_id"):
        met = met.join(pool.select("user_id", F.col("image_id").alias(end)), ["user_id", end], "left_semi")
    known = F.collect_list(F.struct("second_id", "pair_count", "recent"))
    met = met.groupBy("user_id", F.col("first_id").alias("image_id")).agg(known.alias("met"))
    return pool.join(met, ["user_id", "image_id"], "left")


def _known(field: str):
    """A field of the known pair, or null where the two items have not met."""
    place = F.array_position(F.col("a_met.second_id"), F.col("second_id"))
    return F.get(F.col(f"a_met.{field}"), (place - 1).cast("int"))


def fresh_pairs(pool: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Pairs of each pool that are not among the recent ones."""
    rows = _with_met(landed(pool.select("user_id", "image_id")), comparisons)
    return pool_pairs(rows, ("met",)).filter(_known("recent").isNull()).select("user_id", "first_id", "second_id")


def scored_pairs(pool: DataFrame, comparisons: DataFrame, seed: str) -> DataFrame:
    """Freshness, bridge flag and value of every pool pair."""
    pool = landed(pool)
    flagged = pool_anchor_flag(pool).select(
        "user_id", "image_id", "elo", "predicted_utility", "is_anchor",
        under_compared().alias("under"), coverage_need(F.col("matches"), F.col("degree")).alias("need"),
    )
    pairs = pool_pairs(_with_met(flagged, comparisons), ("met",))
    keys = ["user_id", "first_id", "second_id"]
    coverage = coverage_score(F.col("a_need"), F.col("b_need"), F.coalesce(_known("pair_count"), F.lit(0)))
    value = pair_value(
        F.col("a_predicted_utility"), F.col("b_predicted_utility"), F.col("a_elo"), F.col("b_elo"), coverage
    ) + F.lit(1e-6) * coin(F.lit(seed + "n"), *keys)
    bridge = (F.col("a_is_anchor") & F.col("b_under")) | (F.col("b_is_anchor") & F.col("a_under"))
    return pairs.select(
        *keys, _known("recent").isNull().alias("fresh"), bridge.alias("bridge"), coverage.alias("coverage"), value.alias("value"),
    )


def choose_pairs(
    pairs: DataFrame, seed: str, exploration_rate: float = c.EXPLORATION_RATE, anchor_rate: float = c.ANCHOR_MIX_RATE
) -> DataFrame:
    """One pair per user as a single maximum over the scored pairs.

    Fresh pairs come before all others; a user whose coin asks for it prefers bridges to anchors
    among them; exploring users take a uniform draw instead of the best value.
    """
    user = F.col("user_id")
    explore = coin(F.lit(seed + "c"), user) < exploration_rate
    use_bridge = ~explore & (coin(F.lit(seed + "b"), user) < anchor_rate)
    class_ = F.col("fresh").cast("int") * 2 + (F.col("bridge") & use_bridge).cast("int")
    draw = coin(F.lit(seed + "e"), "user_id", "first_id", "second_id")
    key = F.struct(
        class_.alias("class"), F.when(explore, draw).otherwise(F.col("value")).alias("score"),
        (-F.col("first_id")).alias("first"), (-F.col("second_id")).alias("second"),
    )
    best = pairs.groupBy("user_id").agg(F.max(key).alias("p"))
    pair = best.select("user_id", (-F.col("p.first")).alias("first_id"), (-F.col("p.second")).alias("second_id"))
    flip = coin(F.lit(seed + "s"), user) < 0.5
    return pair.select(
        "user_id",
        F.when(flip, F.col("first_id")).otherwise(F.col("second_id")).alias("left_id"),
        F.when(flip, F.col("second_id")).otherwise(F.col("first_id")).alias("right_id"),
    )


def next_pairs(library: DataFrame, comparisons: DataFrame, seed: str, with_anchors: bool = True) -> DataFrame:
    pool = candidate_pool(library, comparisons, seed, with_anchors)
    rate = c.ANCHOR_MIX_RATE if with_anchors else 0.0
    return choose_pairs(scored_pairs(pool, comparisons, seed), seed, anchor_rate=rate)
