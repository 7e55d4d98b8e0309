"""Evaluation metrics as single aggregations per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefloom import constants as c
from prefloom.functions.scoring import expected_rating, log_loss, most_likely


def binary_columns(label: Column, probability: Column, prefix: str = "") -> list[Column]:
    """Accuracy at one half, clipped log loss and Brier score as aggregates."""
    hit = ((probability >= 0.5) == (label == 1)).cast("double")
    return [
        F.avg(hit).alias(f"{prefix}accuracy"), F.avg(log_loss(label, probability)).alias(f"{prefix}log_loss"),
        F.avg(F.pow(probability - label, 2)).alias(f"{prefix}brier"),
    ]


def binary_metrics(df: DataFrame, keys: Sequence[str], label: Column, probability: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("count"), *binary_columns(label, probability))


def ordinal_columns(value: Column, distribution: str, prefix: str = "") -> list[Column]:
    """Accuracy of the most likely value; the absolute error uses the expected value."""
    p = F.col(distribution)
    expected = expected_rating(p)
    chosen = F.greatest(F.lit(c.PROBABILITY_CLIP), F.least(F.lit(1.0), F.get(p, value - 1)))
    gaps = [F.pow(F.get(p, F.lit(k)) - (value == k + 1).cast("double"), 2) for k in range(c.RATING_LEVELS)]
    squared = sum(gaps[1:], gaps[0])
    return [
        F.avg((most_likely(p) == value).cast("double")).alias(f"{prefix}accuracy"),
        F.avg(F.abs(expected - value)).alias(f"{prefix}mae"), F.avg(F.when(p.isNotNull(), -F.log(chosen))).alias(f"{prefix}log_loss"),
        F.avg(squared).alias(f"{prefix}brier"), F.avg(expected).alias(f"{prefix}mean_expected_value"),
    ]


def ordinal_metrics(df: DataFrame, keys: Sequence[str], value: Column, distribution: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("count"), *ordinal_columns(value, distribution))


def class_prior(ratings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smoothed share of every value, as the baseline distribution."""
    levels = range(1, c.RATING_LEVELS + 1)
    counts = [((F.count_if(F.col("value") == k) + 1) / (F.count("*") + c.RATING_LEVELS)).alias(f"_p{k}") for k in levels]
    return ratings.groupBy(*keys).agg(*counts).select(*keys, F.array(*[f"_p{k}" for k in levels]).alias("prior"))


def initial_cutpoints(ratings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smoothed empirical logits of the four thresholds with a minimum gap."""
    levels = range(1, c.RATING_LEVELS)
    above = [((F.count_if(F.col("value") > k) + 0.5) / (F.count("*") + 1.0)).alias(f"_a{k}") for k in levels]
    rows = ratings.groupBy(*keys).agg(*above)
    previous = None
    cutpoints = []
    for k in levels:
        raw = F.log(F.lit(1.0) - F.col(f"_a{k}")) - F.log(F.col(f"_a{k}"))
        previous = raw if previous is None else F.greatest(raw, previous + c.INITIAL_CUTPOINT_GAP)
        cutpoints.append(previous)
    return rows.select(*keys, F.array(*cutpoints).alias("cutpoints"))


def weighted_kappa(df: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """Quadratic-weighted kappa from per-key sums; equal to the confusion-matrix form."""
    n = F.count("*")
    observed = F.sum(F.pow(F.col(actual) - F.col(predicted), 2))
    # expected disagreement factorises over the two margins
    chance = F.sum(F.pow(F.col(actual), 2)) + F.sum(F.pow(F.col(predicted), 2)) - 2 * F.sum(actual) * F.sum(predicted) / n
    return df.groupBy(*keys).agg((F.lit(1.0) - observed / chance).alias("kappa"))


def ndcg(ranking: DataFrame, keys: Sequence[str], score: str, gain: str, at: int) -> DataFrame:
    """Discounted gain of the best scored rows over that of the best possible order."""
    from prefloom.operators.ordered import top_per_key

    def total(order: str, name: str) -> DataFrame:
        best = top_per_key(ranking, list(keys), [F.col(order).desc(), F.col("image_id")], at)
        return best.groupBy(*keys).agg(F.sum((F.pow(F.lit(2.0), gain) - 1) / F.log2(F.col("position") + 1)).alias(name))

    return total(score, "dcg").join(total(gain, "ideal"), list(keys)).withColumn("ndcg", F.col("dcg") / F.col("ideal"))


def contingency(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Counts of every distinct (x, y) per key, the small input of rank statistics."""
    return df.groupBy(*keys, x, y).agg(F.count("*").alias("n"))


def spearman(cells: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties, from value counts."""

    def ranks(column: str, name: str) -> DataFrame:
        totals = cells.groupBy(*keys, column).agg(F.sum("n").alias("_m"))
        frame = Window.partitionBy(*keys).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
        upto = F.sum("_m").over(frame)
        return totals.select(*keys, column, (upto - (F.col("_m") - 1) / 2.0).alias(name))

    rows = cells.join(ranks(x, "_rx"), [*keys, x]).join(ranks(y, "_ry"), [*keys, y])
    n = F.sum("n")

    def moment(a: Column) -> Column:
        return F.sum(F.col("n") * a)

    rx, ry = F.col("_rx"), F.col("_ry")
    covariance = moment(rx * ry) - moment(rx) * moment(ry) / n
    spread = F.sqrt((moment(rx * rx) - moment(rx) * moment(rx) / n) * (moment(ry * ry) - moment(ry) * moment(ry) / n))
    return rows.groupBy(*keys).agg((covariance / spread).alias("spearman"))


def kendall(cells: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation tau-b with ties on both sides, from :func:`contingency`; null where one side never varies.

    Discordant pairs are counted without forming any. Cells stand in order of x, then y, and y becomes its rank. Two
    cells with different ranks agree down to one bit and differ there, so each is counted at that bit: a cell with a
    0 meets, among those that share the higher bits, the cells before it with a 1, which a running sum gives. Rows
    grow with the logarithm of the distinct values of y. Rows with a null in x, y or a key do not count.
    """
    from prefloom.operators.ordered import id_chunk, placed, running

    keys = list(keys)
    cells = cells.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), "n").dropna()
    exact = lambda a: a.cast("decimal(19,0)")
    pairs = lambda a: exact(a) * exact(a - 1)

    totals = cells.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum(pairs(F.col("n"))).alias("_both"))
    for side in ("_x", "_y"):
        tied = cells.groupBy(*keys, side).agg(F.sum("n").alias("_t"))
        totals = totals.join(tied.groupBy(*keys).agg(F.sum(pairs(F.col("_t"))).alias(f"_tied{side}")), keys)
    ranks = placed(cells.select(*keys, "_y").distinct(), keys, ["_y"], "_rank")
    levels = ranks.groupBy(*keys).agg(F.max("_rank").alias("_ranks"))
    rows = placed(cells.join(ranks, [*keys, "_y"]).join(levels, keys), keys, ["_x", "_y"], "_place")
    bits = F.sequence(F.lit(0), F.length(F.bin("_ranks")) - 1)
    rows = rows.select(*keys, "_place", "_rank", "n", F.explode(bits).alias("_level"))
    rows = rows.withColumn("_prefix", F.expr("shiftright(_rank, _level + 1)")).withColumn("_bit", F.expr("shiftright(_rank, _level) & 1"))
    met = running(rows, [*keys, "_level", "_prefix"], ["_place"], id_chunk("_place"), {"_ones": F.col("n") * F.col("_bit")}, inclusive=False)
    discordant = met.filter("_bit = 0").groupBy(*keys).agg(F.sum(exact(F.col("n")) * exact(F.col("_ones"))).alias("_discordant"))
    joined = totals.join(discordant, keys, "left")
    every = pairs(F.col("_n")).cast("double")
    tied_x, tied_y, both = (F.col(k).cast("double") for k in ("_tied_x", "_tied_y", "_both"))
    # all counts but the discordant ones hold every pair twice
    over = every - tied_x - tied_y + both - 4 * F.coalesce("_discordant", F.lit(0)).cast("double")
    spread = (every - tied_x) * (every - tied_y)
    return joined.select(*keys, F.when(spread > 0, over / F.sqrt(spread)).alias("kendall"))
