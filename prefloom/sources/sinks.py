"""Table sinks: conflict-free appends, upserts with per-column merge policy, model rows.

Each function computes the table (or the rows) to write as a DataFrame; the write itself is an
ordinary ``df.write``. Keys are matched with equi joins, so re-running a job writes nothing new.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.operators.ordered import first_per_key, last_per_key

OVERWRITE, COALESCE, KEEP = "overwrite", "coalesce", "keep"


def new_rows(incoming: DataFrame, target: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Rows to append: the first incoming row per key, by ``order``, that the target does not hold.

    Without ``order`` the other columns decide, from left to right.
    """
    order = list(order) if order else [k for k in incoming.columns if k not in keys]
    first = first_per_key(incoming, list(keys), order) if order else incoming.distinct()
    return first.select(*incoming.columns).join(target.select(*keys), list(keys), "left_anti")


def upsert(target: DataFrame, incoming: DataFrame, keys: Sequence[str], policy: dict[str, str], order: Sequence[str] | None = None) -> DataFrame:
    """The merged table; a column is overwritten, filled by the new non-null value, or kept.

    Of several incoming rows of a key the last by ``order`` counts (without it, by the other columns
    from left to right).
    """
    keys = list(keys)
    incoming = last_per_key(incoming, keys, list(order) if order else [k for k in incoming.columns if k not in keys])
    values = [k for k in target.columns if k not in keys]
    fresh = incoming.select(*keys, F.lit(True).alias("_new"), *[F.col(k).alias(f"_n_{k}") for k in values])
    old = target.withColumn("_old", F.lit(True))
    both = old.join(fresh, keys, "full_outer")
    inserted, updated = F.col("_old").isNull(), F.col("_new").isNotNull()

    def merged(name: str):
        rule = policy.get(name, KEEP)
        new, old_value = F.col(f"_n_{name}"), F.col(name)
        if rule == OVERWRITE:
            chosen = F.when(updated, new).otherwise(old_value)
        elif rule == COALESCE:
            chosen = F.coalesce(new, old_value)
        else:
            chosen = F.when(inserted, new).otherwise(old_value)
        return chosen.alias(name)

    return both.select(*keys, *[merged(k) for k in values])


def latest_rows(target: DataFrame, incoming: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Cache upsert: the newest row per key wins."""
    return last_per_key(target.unionByName(incoming), list(keys), [at])


def migrate_comparisons(local: DataFrame, id_map: DataFrame, target: DataFrame) -> DataFrame:
    """Comparisons to insert after an id migration; rows with an unmapped id are dropped.

    ``id_map`` has local_id and hosted_id. A row equal to a stored one in all seven columns is
    not inserted again, and of equal local rows only the one of the smallest id is inserted.
    """
    rows = local
    for side in ("left_id", "right_id", "winner_id"):
        mapped = id_map.select(F.col("local_id").alias(side), F.col("hosted_id").alias(f"_{side}"))
        rows = rows.join(mapped, side).drop(side).withColumnRenamed(f"_{side}", side)
    same = ["user_id", "left_id", "right_id", "winner_id", "left_elo_before", "right_elo_before", "created_at"]
    return first_per_key(rows, same, ["id"]).select(*rows.columns).join(target.select(*same), same, "left_anti")


def migratable(images: DataFrame, active_only: bool, limit: int | None = None) -> DataFrame:
    """Licensed local items in id order."""
    rows = images.filter(F.trim(F.coalesce("license", F.lit(""))) != "")
    if active_only:
        rows = rows.filter("active")
    return rows.orderBy("image_id").limit(limit) if limit is not None else rows


def model_rows(models: DataFrame, target: DataFrame) -> DataFrame:
    """Model runs to append: one per user and pair of cutoffs."""
    return new_rows(models, target, ["user_id", "comparison_cutoff", "rating_cutoff"])
