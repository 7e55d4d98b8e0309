"""Elo histories: single steps, full replay and audits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom import constants as c
from prefloom.functions.elo import elo_change
from prefloom.operators.ordered import id_chunk, previous, ranked
from prefloom.session import checkpoint_dir

STATE = "user_id bigint, image_id bigint, elo double, matches bigint, wins bigint, losses bigint"
REPLAY = (
    "id bigint, user_id bigint, left_id bigint, right_id bigint, winner_id bigint, "
    "left_elo_before double, right_elo_before double, left_elo_after double, right_elo_after double, elo_delta double"
)


def elo_step(rows: DataFrame) -> DataFrame:
    """Add change, ratings after and absolute change to rows with a known state before."""
    change = elo_change(
        F.col("left_elo_before"), F.col("right_elo_before"),
        F.col("left_matches"), F.col("right_matches"),
        F.col("winner_id") == F.col("left_id"),
    )
    stepped = rows.withColumn("_change", change)
    return (
        stepped.withColumn("left_elo_after", F.col("left_elo_before") + F.col("_change"))
        .withColumn("right_elo_after", F.col("right_elo_before") - F.col("_change"))
        .withColumn("elo_delta", F.abs("_change"))
        .drop("_change")
    )


def fold_user(events, state):
    """Replay one user's ordered events over ``{image: [elo, matches, wins, losses]}``.

    Shared by the batch replay and the streaming processor. Returns before/after columns.
    """
    before_l, before_r, after_l, after_r = [], [], [], []
    for left, right, winner in events:
        a = state.setdefault(left, [c.ELO_START, 0, 0, 0])
        b = state.setdefault(right, [c.ELO_START, 0, 0, 0])
        ka = max(c.K_FLOOR, c.K_START / (1.0 + a[1] / c.K_HALF_LIFE) ** 0.5)
        kb = max(c.K_FLOOR, c.K_START / (1.0 + b[1] / c.K_HALF_LIFE) ** 0.5)
        won = 1 if winner == left else 0
        change = min(ka, kb) * (won - 1.0 / (1.0 + 10.0 ** ((b[0] - a[0]) / c.ELO_SCALE)))
        before_l.append(a[0])
        before_r.append(b[0])
        a[0] += change
        b[0] -= change
        after_l.append(a[0])
        after_r.append(b[0])
        for side, gained in ((a, won), (b, 1 - won)):
            side[1] += 1
            side[2] += gained
            side[3] += 1 - gained
    return before_l, before_r, after_l, after_r


def _replay_group(key, events, states):
    import pandas as pd

    state = {
        int(r.image_id): [float(r.elo), int(r.matches), int(r.wins), int(r.losses)]
        for r in states.itertuples(index=False)
    }
    events = events.sort_values("id", kind="stable").reset_index(drop=True)
    columns = fold_user(
        zip(events["left_id"].tolist(), events["right_id"].tolist(), events["winner_id"].tolist()), state
    )
    out = events[["id", "user_id", "left_id", "right_id", "winner_id"]].copy()
    for name, values in zip(("left_elo_before", "right_elo_before", "left_elo_after", "right_elo_after"), columns):
        out[name] = pd.Series(values, dtype="float64")
    out["elo_delta"] = (out["left_elo_after"] - out["left_elo_before"]).abs()
    return out


def _fold(events: DataFrame, state: DataFrame) -> DataFrame:
    known = state.join(events.select("user_id").distinct(), "user_id", "left_semi")
    return events.groupBy("user_id").cogroup(known.groupBy("user_id")).applyInPandas(_replay_group, REPLAY)


def replay(comparisons: DataFrame, rows_per_step: int = 1 << 20) -> DataFrame:
    """Before and after ratings of every comparison, replayed per user in id order.

    The fold is the one step whose result depends on order; users run in parallel. A step takes
    at most ``rows_per_step`` events of every user, so a task never holds more of a user of any
    size, and only users with more events take part in later steps. Between steps the latest
    rating per (user, image) is carried through a checkpoint.
    """
    spark = comparisons.sparkSession
    events = comparisons.select("id", "user_id", "left_id", "right_id", "winner_id")
    longest = events.groupBy("user_id").count().agg(F.max("count")).first()[0] or 0
    state = spark.createDataFrame([], STATE)
    if longest <= rows_per_step:
        return _fold(events, state)
    folder = f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/replay-{uuid.uuid4().hex[:8]}"
    step = F.floor((F.col("position") - 1) / rows_per_step)
    placed = ranked(events, ["user_id"], ["id"], id_chunk("id")).withColumn("step", step).drop("position")
    placed.write.partitionBy("step").parquet(folder)
    placed = spark.read.parquet(folder)
    result: DataFrame | None = None
    for k in range(-(-longest // rows_per_step)):
        part = _fold(placed.filter(F.col("step") == k).drop("step"), state).checkpoint()
        result = part if result is None else result.unionByName(part)
        state = merge_state(state, part).checkpoint()
    return result


def _sides(history: DataFrame) -> DataFrame:
    def side(name: str):
        won = (F.col("winner_id") == F.col(f"{name}_id")).cast("bigint")
        return F.struct(
            F.col(f"{name}_id").alias("image_id"), F.col(f"{name}_elo_before").alias("before"),
            F.col(f"{name}_elo_after").alias("after"), won.alias("won"),
        )

    return history.select("id", "user_id", F.explode(F.array(side("left"), side("right"))).alias("s")).select("id", "user_id", "s.*")


def ratings_from(history: DataFrame) -> DataFrame:
    """Current rating and counts per (user, image): the last row wins, counts add up."""
    return _sides(history).groupBy("user_id", "image_id").agg(
        F.max_by("after", "id").alias("elo"),
        F.count("*").alias("matches"),
        F.sum("won").alias("wins"),
        (F.count("*") - F.sum("won")).alias("losses"),
    )


def merge_state(state: DataFrame, history: DataFrame) -> DataFrame:
    fresh = ratings_from(history).select(*[F.col(k).alias(f"n_{k}") if k not in ("user_id", "image_id") else k
                                           for k in ("user_id", "image_id", "elo", "matches", "wins", "losses")])
    both = state.join(fresh, ["user_id", "image_id"], "full_outer")
    return both.select(
        "user_id",
        "image_id",
        F.coalesce("n_elo", "elo").alias("elo"),
        *[(F.coalesce(k, F.lit(0)) + F.coalesce(f"n_{k}", F.lit(0))).alias(k) for k in ("matches", "wins", "losses")],
    )


def chain_breaks(history: DataFrame, bits: int = 20) -> DataFrame:
    """Rows whose rating before differs from the image's previous rating after."""
    chained = previous(_sides(history), ["user_id", "image_id"], "id", "after", "previous_after", bits)
    return chained.filter(F.col("previous_after").isNotNull() & (F.abs(F.col("before") - F.col("previous_after")) > 1e-9))
