"""Feedback logs: windows, cutoffs, idempotent apply and issuance retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefloom import constants as c
from prefloom.operators.ordered import first_per_key, id_chunk, ranked, top_per_key


def feedback_window(events: DataFrame, cutoffs: DataFrame, at: str, limit: int = c.TRAINING_EVENTS) -> DataFrame:
    """Newest ``limit`` events up to each user's cutoff, oldest first, with the uncut total."""
    seen = events.join(cutoffs, "user_id").filter(F.col("id") <= F.col("cutoff"))
    totals = seen.groupBy("user_id").agg(F.count("*").alias("total"))
    newest = top_per_key(seen, ["user_id"], [F.col(at).desc(), F.col("id").desc()], limit, "age", spread="id")
    kept = F.least(F.col("total"), F.lit(limit))
    return newest.join(totals, "user_id").withColumn("position", kept - F.col("age") + 1).drop("age", "cutoff")


def nth_event(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """Id of each user's n-th event; ``wanted`` has (user_id, n)."""
    numbered = ranked(events.select("user_id", "id"), ["user_id"], ["id"], id_chunk("id"))
    return (
        numbered.join(wanted, "user_id")
        .filter(F.col("position") == F.col("n"))
        .select("user_id", "n", F.col("id").alias("cutoff"))
    )


def timeline(comparisons: DataFrame, ratings: DataFrame) -> DataFrame:
    """Both kinds of feedback as one log."""
    pairs = comparisons.select(
        "user_id", "id", F.lit("comparison").alias("kind"), F.col("created_at").alias("at"), "left_id", "right_id",
    )
    points = ratings.select("user_id", "id", F.lit("rating").alias("kind"), F.col("rated_at").alias("at"), "image_id", "value")
    return pairs.unionByName(points, allowMissingColumns=True)


def participant_window(events: DataFrame, cap: int) -> DataFrame:
    """Newest suffix of a bounded timeline that touches at most ``cap`` distinct images.

    Runs after :func:`feedback_window`, so a user holds at most the training event limit.
    """
    newest = [F.col("at").desc(), F.col("id").desc(), F.col("kind").desc()]
    touched = events.select(
        "user_id", "id", "kind", "at", F.explode(F.array_compact(F.array("left_id", "right_id", "image_id"))).alias("touched"),
    )
    first = F.row_number().over(Window.partitionBy("user_id", "touched").orderBy(*newest)) == 1
    added = touched.withColumn("_new", first.cast("int")).groupBy("user_id", "at", "id", "kind").agg(F.sum("_new").alias("_new"))
    frame = Window.partitionBy("user_id").orderBy(*newest).rowsBetween(Window.unboundedPreceding, 0)
    kept = added.withColumn("distinct_images", F.sum("_new").over(frame)).filter(F.col("distinct_images") <= cap)
    return events.join(kept.select("user_id", "id", "kind", "distinct_images"), ["user_id", "id", "kind"])


def window_sufficiency(events: DataFrame) -> DataFrame:
    """Whether a window holds enough feedback to train on."""
    counts = events.groupBy("user_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("kind") == "rating").alias("ratings")
    )
    least = F.when(F.col("ratings") > 0, c.MIN_RATINGS).otherwise(c.MIN_COMPARISONS)
    return counts.withColumn("sufficient", F.col("events") >= least)


def fill_images(
    participants: DataFrame, library: DataFrame, cap: int = c.TRAINING_IMAGES
) -> DataFrame:
    """Participants first, then the least compared other active items up to ``cap``."""
    counts = participants.groupBy("user_id").agg(F.count("*").alias("used"))
    others = library.join(participants, ["user_id", "image_id"], "left_anti")
    order = [
        F.col("matches"), F.col("predicted_utility").isNull().desc(), F.col("discovered_day").desc(), F.col("image_id"),
    ]
    filled = top_per_key(others.select("user_id", "image_id", "matches", "predicted_utility", "discovered_day"),
                         ["user_id"], order, cap, "slot")
    room = filled.join(counts, "user_id", "left").filter(F.col("slot") <= F.lit(cap) - F.coalesce("used", F.lit(0)))
    return participants.select("user_id", "image_id", F.lit("participant").alias("origin")).unionByName(
        room.select("user_id", "image_id", F.lit("fill").alias("origin"))
    )


def missing_participants(participants: DataFrame, library: DataFrame) -> DataFrame:
    """Participants that the active library no longer holds."""
    return participants.join(library, ["user_id", "image_id"], "left_anti")


def within_ttl(at: Column, issued_at: Column) -> Column:
    return (at >= issued_at) & (at < issued_at + F.expr(f"INTERVAL {c.TOKEN_TTL_HOURS} HOURS"))


def apply_ratings(responses: DataFrame, issuances: DataFrame, library: DataFrame) -> DataFrame:
    """One status per response: applied, replayed, conflict, expired, duplicate, missing or invalid.

    The earliest eligible response of a (user, image) is applied; it is found by a partial
    aggregate, so copies of one token never gather in one task.
    """
    issued = issuances.select("token_hash", "user_id", "image_id", "issued_at")
    known = responses.join(issued, ["token_hash", "user_id", "image_id"], "left").join(
        library.select("user_id", "image_id", F.lit(True).alias("in_library")), ["user_id", "image_id"], "left"
    )
    live = F.col("issued_at").isNotNull() & (
        F.col("responded_at") < F.col("issued_at") + F.expr(f"INTERVAL {c.TOKEN_TTL_HOURS} HOURS")
    )
    eligible = known.filter(live & F.col("in_library"))
    applied = first_per_key(
        eligible.select(
            "user_id", "image_id", "responded_at", F.col("response_id").alias("applied_id"),
            F.col("token_hash").alias("applied_token"), F.col("value").alias("applied_value"),
        ),
        ["user_id", "image_id"],
        ["responded_at", "applied_id"],
    ).withColumnRenamed("responded_at", "applied_at")
    joined = known.join(applied, ["user_id", "image_id"], "left")
    same_token = F.col("token_hash") == F.col("applied_token")
    later = F.col("applied_id").isNotNull() & (F.struct("responded_at", "response_id") > F.struct(F.col("applied_at"), F.col("applied_id")))
    status = (
        F.when(F.col("issued_at").isNull(), "invalid")
        .when(F.col("response_id") == F.col("applied_id"), "applied")
        .when(same_token & later & (F.col("value") == F.col("applied_value")), "replayed")
        .when(same_token & later, "conflict")
        .when(~live, "expired")
        .when(F.col("in_library").isNull(), "missing")
        .otherwise("duplicate")
    )
    return joined.select("response_id", "user_id", "image_id", "value", status.alias("status"))


def apply_comparisons(choices: DataFrame, issuances: DataFrame, library: DataFrame) -> DataFrame:
    """One status per choice: applied, replayed, conflict, expired, missing or invalid.

    A token is applied once, by its earliest eligible choice.
    """
    issued = issuances.select("token_hash", "user_id", "left_id", "right_id", "issued_at")
    items = library.select("user_id", "image_id")
    left = items.select("user_id", F.col("image_id").alias("left_id"), F.lit(True).alias("_l"))
    right = items.select("user_id", F.col("image_id").alias("right_id"), F.lit(True).alias("_r"))
    known = (
        choices.join(issued, ["token_hash", "user_id", "left_id", "right_id"], "left")
        .join(left, ["user_id", "left_id"], "left")
        .join(right, ["user_id", "right_id"], "left")
    )
    proper = (F.col("left_id") != F.col("right_id")) & F.col("winner_id").isin(F.col("left_id"), F.col("right_id")) & F.col("issued_at").isNotNull()
    live = F.col("responded_at") < F.col("issued_at") + F.expr(f"INTERVAL {c.TOKEN_TTL_HOURS} HOURS")
    present = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    applied = first_per_key(
        known.filter(proper & live & present).select(
            "user_id", "token_hash", "responded_at", F.col("response_id").alias("applied_id"), F.col("winner_id").alias("applied_winner")
        ),
        ["user_id", "token_hash"],
        ["responded_at", "applied_id"],
    ).withColumnRenamed("responded_at", "applied_at")
    joined = known.join(applied, ["user_id", "token_hash"], "left")
    later = F.col("applied_id").isNotNull() & (F.struct("responded_at", "response_id") > F.struct(F.col("applied_at"), F.col("applied_id")))
    status = (
        F.when(~proper, "invalid")
        .when(F.col("response_id") == F.col("applied_id"), "applied")
        .when(later & (F.col("winner_id") == F.col("applied_winner")), "replayed")
        .when(later, "conflict")
        .when(~live, "expired")
        .otherwise("missing")
    )
    return joined.select("response_id", "user_id", "winner_id", status.alias("status"))


def stale_issuances(issuances: DataFrame, as_of: Column, batch: int | None = None) -> DataFrame:
    """Expired unused and long-used tokens; with ``batch``, per user up to so many of either."""
    expires = F.col("issued_at") + F.expr(f"INTERVAL {c.TOKEN_TTL_HOURS} HOURS")
    unused = issuances.filter(F.col("used_at").isNull() & (expires < as_of))
    used = issuances.filter(F.col("used_at") < as_of - F.expr(f"INTERVAL {c.USED_RETENTION_DAYS} DAYS"))
    if batch is None:
        return unused.select("user_id", "token_hash").union(used.select("user_id", "token_hash")).distinct()
    first = top_per_key(unused, ["user_id"], [F.col("issued_at"), F.col("token_hash")], batch)
    second = top_per_key(used, ["user_id"], [F.col("used_at"), F.col("token_hash")], batch)
    return first.select("user_id", "token_hash").union(second.select("user_id", "token_hash")).distinct()


def purge_issuances(issuances: DataFrame, stale: DataFrame) -> DataFrame:
    return issuances.join(stale, ["user_id", "token_hash"], "left_anti")


def recent_pairs(comparisons: DataFrame, limit: int = c.RECENT_PAIRS) -> DataFrame:
    newest = top_per_key(
        comparisons.select("user_id", "id", "left_id", "right_id"), ["user_id"], [F.col("id").desc()], limit
    )
    return newest.select(
        "user_id", "id", F.least("left_id", "right_id").alias("first_id"), F.greatest("left_id", "right_id").alias("second_id"),
    )
