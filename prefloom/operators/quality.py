"""Constraints as data-quality checks: one row per check with its number of violations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom import constants as c
from prefloom.functions.vectors import norm
from prefloom.operators.ordered import id_chunk, running


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Count rows where a rule is false, all rules in one pass. NULL passes, as in a CHECK."""
    counts = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in rules])
    return counts.select(F.explode(pairs).alias("r")).select("r.check", "r.violations")


def quarantine(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking a rule, with the names of the rules they break."""
    broken = F.array_compact(F.array(*[F.when(~rule, F.lit(n)) for n, rule in rules.items()]))
    return df.withColumn("broken", broken).filter(F.size("broken") > 0)


def duplicate_keys(df: DataFrame, keys: Sequence[str | Column], name: str, where: Column | None = None) -> DataFrame:
    """Number of (possibly partial or expression) keys that occur more than once."""
    rows = df if where is None else df.filter(where)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    return counts.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def orphans(df: DataFrame, parent: DataFrame, keys: Mapping[str, str], name: str) -> DataFrame:
    """Rows whose foreign key is set but absent in the parent; ``keys`` maps child to parent."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    parents = parent.select(*[F.col(p).alias(k) for k, p in keys.items()]).distinct()
    lost = df.filter(present).join(parents, list(keys), "left_anti")
    return lost.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def changed_rows(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows of an immutable log that a later version of it lost or holds with other values."""
    kept = after.select(*keys, *[F.col(v).alias(f"_{v}") for v in values], F.lit(True).alias("_there"))
    joined = before.select(*keys, *values).join(kept, list(keys), "left")
    same = reduce(lambda a, b: a & b, [F.col(v).eqNullSafe(F.col(f"_{v}")) for v in values])
    change = F.when(F.col("_there").isNull(), "lost").when(~same, "changed")
    return joined.withColumn("change", change).filter("change IS NOT NULL").select(*keys, "change")


def union_checks(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def not_negative(*columns: str) -> dict[str, Column]:
    return {f"{k}_not_negative": F.col(k) >= 0 for k in columns}


def library_rules() -> dict[str, Column]:
    return {
        "matches_sum": F.col("matches") == F.col("wins") + F.col("losses"),
        "counts_not_negative": (F.col("matches") >= 0) & (F.col("wins") >= 0) & (F.col("losses") >= 0),
        **not_negative("matches", "wins", "losses"),
        "rating_pairing": F.col("point_rating").isNull() == F.col("point_rated_at").isNull(),
        "rating_range": F.col("point_rating").between(1, c.RATING_LEVELS),
    }


def comparison_rules() -> dict[str, Column]:
    return {
        "distinct_sides": F.col("left_id") != F.col("right_id"),
        "winner_in_pair": F.col("winner_id").isin(F.col("left_id"), F.col("right_id")),
        "key_is_digest": F.col("idempotency_key").rlike(c.DIGEST_PATTERN),
    }


def outcome_rules() -> dict[str, Column]:
    """Of comparisons that store their outcome."""
    return {"delta_not_negative": F.col("elo_delta") >= 0}


def image_rules() -> dict[str, Column]:
    return {"width": F.col("width") > 0, "height": F.col("height") > 0}


def issuance_rules(pairs: bool) -> dict[str, Column]:
    rules = {"token_is_digest": F.col("token_hash").rlike(c.DIGEST_PATTERN), "expires_later": F.col("expires_at") > F.col("issued_at")}
    return rules | ({"distinct_sides": F.col("left_id") != F.col("right_id")} if pairs else {})


def rating_rules() -> dict[str, Column]:
    return {"value_range": F.col("value").between(1, c.RATING_LEVELS), "key_is_digest": F.col("idempotency_key").rlike(c.DIGEST_PATTERN)}


def action_rules() -> dict[str, Column]:
    return {
        "propensity_range": (F.col("propensity") > 0) & (F.col("propensity") <= 1),
        "reward_range": F.col("effective_reward").between(0, 1),
        "known_status": F.col("status").isin("chosen", "observed", "censored", "failed"),
    }


def action_detail_rules() -> dict[str, Column]:
    """Of actions that store their place, both rewards and their counts."""
    rewards = {f"{k}_range": F.col(k).between(0, 1) for k in ("proxy_reward", "human_reward")}
    return not_negative("action_index", "human_matches", "candidates_seen", "candidates_eligible") | rewards


def discovery_rules() -> dict[str, Column]:
    return {"candidate_proxy_reward_range": F.col("candidate_proxy_reward").between(0, 1)}


def job_rules() -> dict[str, Column]:
    statuses = ("queued", "running", "succeeded", "failed", "skipped")
    return {"known_kind": F.col("kind").isin("train", "crawl"), "known_status": F.col("status").isin(*statuses)}


def model_count_rules() -> dict[str, Column]:
    counts = ("comparison_cutoff", "comparison_count", "rating_cutoff", "rating_count", "feedback_count")
    return {"dimensions": F.col("dimensions") > 0} | not_negative(*counts)


def model_rules() -> dict[str, Column]:
    """Model rows: finite weights of the stated width, ordered thresholds, known encoder."""
    finite = F.forall("weights", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    steps = F.zip_with(F.slice("thresholds", 1, c.RATING_LEVELS - 2), F.slice("thresholds", 2, c.RATING_LEVELS - 2), lambda a, b: a < b)
    return {
        "feedback_sum": F.col("feedback_count") == F.col("comparison_count") + F.col("rating_count"),
        "weights_finite": finite,
        "weights_width": F.size("weights") == F.col("dimensions"),
        "thresholds_ordered": (F.size("thresholds") == c.RATING_LEVELS - 1) & F.forall(steps, lambda ok: ok),
    }


def vector_rules(dimensions: int) -> dict[str, Column]:
    return {
        "width": F.size("vector") == dimensions,
        "unit_norm": F.abs(norm(F.col("vector")) - 1.0) <= 1e-3,
    }


def contract_rules() -> dict[str, Column]:
    """Input contracts of a rating or comparison request."""
    def safe(name: str) -> Column:
        return F.col(name).isNotNull() & (F.col(name) > 0) & (F.col(name) <= c.MAX_SAFE_INTEGER)

    return {
        "safe_ids": safe("left_id") & safe("right_id") & safe("winner_id"),
        "distinct_sides": F.col("left_id") != F.col("right_id"),
        "winner_in_pair": F.col("winner_id").isin(F.col("left_id"), F.col("right_id")),
        "value_range": F.col("value").between(1, c.RATING_LEVELS),
        "token_form": F.col("token").rlike(c.TOKEN_PATTERN),
    }


FRONTIER_SCHEMA = "version int, categories array<string>, next_category int, continuations map<string, map<string, string>>"


def frontier_rules(version: int, categories: Sequence[str]) -> dict[str, Column]:
    """A crawl frontier document parsed with :data:`FRONTIER_SCHEMA` into ``frontier``."""
    f = F.col("frontier")
    wanted = F.array(*[F.lit(k) for k in categories])
    return {
        "version": F.coalesce(f["version"] == version, F.lit(False)),
        "categories": F.coalesce(f["categories"] == wanted, F.lit(False)),
        "next_category": F.coalesce((f["next_category"] >= 0) & (f["next_category"] < len(categories)), F.lit(False)),
        "continuations": F.coalesce(
            F.forall(wanted, lambda k: F.map_contains_key(f["continuations"], k) & F.try_element_at(f["continuations"], k).isNotNull()), F.lit(False)),
    }


def recount(models: DataFrame, events: DataFrame, cutoff: str, stored: str) -> DataFrame:
    """Models whose stored count differs from the events up to their cutoff.

    Events and cutoffs share one timeline per user, so one running count answers every model.
    """
    marks = models.select("user_id", "id", F.col(cutoff).alias("at"), F.col(stored).alias("stored"), F.lit(0).alias("event"))
    rows = events.select("user_id", F.col("id").alias("at"), F.lit(1).alias("event"))
    line = rows.unionByName(marks, allowMissingColumns=True)
    counted = running(line, ["user_id"], ["at", F.col("event").desc(), "id"], id_chunk("at"), {"recounted": F.col("event").cast("bigint")})
    return counted.filter((F.col("event") == 0) & (F.col("stored") != F.col("recounted"))).select("id", "user_id", "stored", "recounted")
