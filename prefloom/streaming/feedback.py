"""Structured Streaming twins of the feedback jobs.

State is bounded everywhere: by a watermark for joins, windows and duplicate suppression, and by
the number of compared items for ratings. Each transformation takes and returns a streaming
DataFrame; sinks and triggers are the caller's choice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

import prefloom
from prefloom import constants as c
from prefloom.operators.decisions import training_due
from prefloom.operators.elo import REPLAY, fold_user, replay

# The process that initialises stateful Python operators does not see shipped files, so the
# processor travels with its code.
register_pickle_by_value(prefloom)

TTL = f"{c.TOKEN_TTL_HOURS} hours"


def first_responses(responses: DataFrame, lateness: str = TTL) -> DataFrame:
    """One response per (user, token); replays inside the token's lifetime are dropped."""
    return responses.withWatermark("responded_at", lateness).dropDuplicatesWithinWatermark(["user_id", "token_hash"])


def answered_issuances(issuances: DataFrame, responses: DataFrame, how: str = "inner", lateness: str = "1 hour") -> DataFrame:
    """Join issuances to responses inside the token lifetime; ``leftOuter`` also yields unanswered ones."""
    issued = issuances.select("token_hash", "user_id", "image_id", "issued_at").withWatermark("issued_at", lateness).alias("i")
    answers = responses.select(
        F.col("token_hash").alias("answer_token"), "response_id", "value", "responded_at"
    ).withWatermark("responded_at", lateness).alias("r")
    inside = (
        (F.col("token_hash") == F.col("answer_token"))
        & (F.col("responded_at") >= F.col("issued_at"))
        & (F.col("responded_at") < F.col("issued_at") + F.expr(f"INTERVAL {TTL}"))
    )
    return issued.join(answers, inside, how).drop("answer_token")


def delayed_rewards(imports: DataFrame, ratings: DataFrame, horizon: str = "30 days", lateness: str = "1 day") -> DataFrame:
    """Reward of source actions whose import is rated within the horizon.

    Later ratings are picked up by the batch attribution.
    """
    actions = imports.select("user_id", "image_id", "action_id", "chosen_at").withWatermark("chosen_at", lateness)
    rated = ratings.select(
        F.col("user_id").alias("rater"), F.col("image_id").alias("rated_image"), "value", "rated_at"
    ).withWatermark("rated_at", lateness)
    condition = (
        (F.col("user_id") == F.col("rater")) & (F.col("image_id") == F.col("rated_image"))
        & (F.col("rated_at") >= F.col("chosen_at")) & (F.col("rated_at") <= F.col("chosen_at") + F.expr(f"INTERVAL {horizon}"))
    )
    return actions.join(rated, condition).select(
        "user_id", "action_id", "image_id", ((F.col("value") - 1) / F.lit(c.REWARD_STEPS)).alias("reward")
    )


NAMES = ("left_elo_before", "right_elo_before", "left_elo_after", "right_elo_after")
EVENT = ("id", "left_id", "right_id", "winner_id")
SIDE = ("elo", "matches", "wins", "losses")
FRESH = (c.ELO_START, 0, 0, 0)
#: One folded event with both sides' ratings before it.
ENTRY = [(k, "<i8") for k in EVENT] + [(f"{side}_{k}", "<f8" if k == "elo" else "<i8") for side in ("left", "right") for k in SIDE]


class EloProcessor(StatefulProcessor):
    """Running ratings of one user, with the latest ``recent`` events at hand to fold again behind a late one.

    Frames of a micro-batch are folded one by one. An id below the newest folded one rewinds the ratings to the
    point before it; it and all events after it come out again under a higher ``revision``. An id that was
    folded already is a repeat and does nothing. What lies behind the events at hand comes out as late.
    """

    def __init__(self, recent: int = 0):
        self.recent = recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = StructType([StructField("image_id", LongType())])
        value = StructType([
            StructField("elo", DoubleType()), StructField("matches", LongType()),
            StructField("wins", LongType()), StructField("losses", LongType()),
        ])
        self.ratings = handle.getMapState("ratings", key, value)
        self.log = handle.getValueState("log", StructType([
            StructField("horizon", LongType()), StructField("revision", LongType()), StructField("entries", BinaryType())]))

    def _rating(self, image: int) -> list:
        return list(self.ratings.getValue((image,)) if self.ratings.containsKey((image,)) else FRESH)

    def _fold(self, user: int, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        horizon, revision, packed = self.log.get() if self.log.exists() else (None, 0, b"")
        log = np.frombuffer(packed, ENTRY)
        events = frame.sort_values("id", kind="stable")
        if horizon is not None:
            # these belong into a past that is out of reach
            late = events.loc[events["id"] <= horizon, list(EVENT)]
            if len(late):
                yield late.assign(user_id=user, **dict.fromkeys((*NAMES, "elo_delta"), float("nan")), late=True, revision=revision)
            events = events[events["id"] > horizon]
        if self.recent:
            events = events[~events["id"].isin(log["id"])].drop_duplicates("id")
        if not len(events):
            return
        kept, again = log, log[:0]
        if len(log) and int(events["id"].iloc[0]) < int(log["id"][-1]):
            cut = int(np.searchsorted(log["id"], int(events["id"].iloc[0])))
            kept, again, revision = log[:cut], log[cut:], revision + 1
        state: dict[int, list] = {}
        for entry in again:
            for side in ("left", "right"):
                # an image's first event behind the cut has its rating at the cut
                state.setdefault(int(entry[f"{side}_id"]), [entry[f"{side}_{k}"].item() for k in SIDE])
        todo = sorted([*map(tuple, again[list(EVENT)].tolist()), *zip(*[events[k].tolist() for k in EVENT])], key=lambda e: e[0])
        folded, columns = np.zeros(len(todo), ENTRY), ([], [], [], [])
        for at, (number, left, right, winner) in enumerate(todo):
            for image in (left, right):
                if image not in state:
                    state[image] = self._rating(image)
            folded[at] = (number, left, right, winner, *state[left], *state[right])
            for values, new in zip(columns, fold_user([(left, right, winner)], state)):
                values.extend(new)
        for image, rating in state.items():
            self.ratings.updateValue((image,), (float(rating[0]), *map(int, rating[1:])))
        log = np.concatenate([kept, folded])
        drop = max(0, len(log) - self.recent)
        self.log.update((int(log["id"][drop - 1]) if drop else horizon, revision, log[drop:].tobytes()))
        out = pd.DataFrame({k: folded[k] for k in EVENT}).assign(user_id=user, **dict(zip(NAMES, columns)))
        yield out.assign(elo_delta=(out["left_elo_after"] - out["left_elo_before"]).abs(), late=False, revision=revision)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in self._frames(rows):
            for out in self._fold(int(key[0]), frame):
                yield out[RUNNING]

    def _frames(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # without events at hand the order inside a micro-batch must come from one sort
        return rows if self.recent else iter([pd.concat(list(rows), ignore_index=True)])

    def close(self) -> None:
        pass


RUNNING = ["id", "user_id", "left_id", "right_id", "winner_id", *NAMES, "elo_delta", "late", "revision"]


def running_elo(comparisons: DataFrame, recent: int = 0) -> DataFrame:
    """Every comparison with its ratings before and after. Needs the RocksDB state store.

    State keeps the latest ``recent`` events of a user; a late event among them is folded in place and the
    events after it come out again, so :func:`latest_revisions` equals the replay of the whole log. A late event
    further back comes out with ``late`` set and without ratings; :func:`settle_late` recomputes such users.
    With ``recent`` above 0 ids are unique per user.
    """
    return (
        comparisons.select("id", "user_id", "left_id", "right_id", "winner_id")
        .groupBy("user_id")
        .transformWithStateInPandas(
            statefulProcessor=EloProcessor(recent), outputStructType=REPLAY + ", late boolean, revision bigint", outputMode="Append", timeMode="None"
        )
    )


def latest_revisions(running: DataFrame) -> DataFrame:
    """The last word of :func:`running_elo` on every comparison that is not late."""
    known = running.filter("NOT late")
    rest = [k for k in known.columns if k not in ("user_id", "id")]
    newest = known.groupBy("user_id", "id").agg(F.max_by(F.struct(*rest), "revision").alias("_last"))
    return newest.select("id", "user_id", *[f"_last.{k}" for k in rest if k not in ("late", "revision")])


def settle_late(running: DataFrame, comparisons: DataFrame) -> DataFrame:
    """What :func:`running_elo` wrote last, with users that had late events replayed from ``comparisons``."""
    late = running.filter("late").select("user_id").distinct()
    again = replay(comparisons.join(late, "user_id", "left_semi"))
    return latest_revisions(running.join(late, "user_id", "left_anti")).unionByName(again)


def use_rocksdb(spark) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def feedback_counts(events: DataFrame) -> DataFrame:
    """Running comparison and rating counts per user from the mixed feedback stream."""
    return events.groupBy("user_id").agg(
        F.count_if(F.col("kind") == "comparison").alias("comparison_count"), F.count_if(F.col("kind") == "rating").alias("rating_count")
    )


DUE = "user_id bigint, pinned_comparison bigint, pinned_rating bigint, comparison_target bigint, rating_target bigint"


def emit_training_due(
    trained: DataFrame, write: Callable[[DataFrame, int], None], earlier: Callable[[int], DataFrame | None] = lambda epoch: None
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink over updated counts that writes users once per milestone they cross.

    ``trained`` has user_id, last_comparison_count and last_rating_count; ``earlier`` gives what
    epochs before the named one wrote.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        due = training_due(batch.join(trained, "user_id", "left")).filter("due")
        targets = {k: F.when(F.col(f"{k}_due"), F.col(f"pinned_{k}")) for k in ("comparison", "rating")}
        due = due.withColumns({f"{k}_target": v for k, v in targets.items()})
        before = earlier(epoch)
        if before is not None:
            seen = before.groupBy("user_id").agg(*[F.max(f"{k}_target").alias(f"_seen_{k}") for k in targets])
            new = [F.col(f"{k}_target") > F.coalesce(f"_seen_{k}", F.lit(-1)) for k in targets]
            due = due.join(seen, "user_id", "left").filter(F.coalesce(new[0], F.lit(False)) | F.coalesce(new[1], F.lit(False)))
        write(due.select("user_id", "pinned_comparison", "pinned_rating", "comparison_target", "rating_target"), epoch)

    return sink


def distinct_wakeups(wakeups: DataFrame) -> DataFrame:
    """One wake-up per (user, event) in seven days, keyed by its digest."""
    keyed = wakeups.withColumn("event_hash", F.sha2(F.concat_ws(":", F.lit("crawl"), "user_id", "event_key"), 256))
    return keyed.withWatermark("ts", f"{c.USED_RETENTION_DAYS} days").dropDuplicatesWithinWatermark(["event_hash"])


def open_issuances(issuances: DataFrame, responses: DataFrame) -> DataFrame:
    """Issuances that expired without an answer, emitted once their lifetime has passed."""
    return answered_issuances(issuances, responses, "leftOuter").filter(F.col("response_id").isNull()).select(
        "user_id", "token_hash", "image_id", "issued_at"
    )


def hourly_activity(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 hour"), "event_type")
        .agg(F.count("*").alias("events"))
        .select(F.col("window.start").alias("hour"), "event_type", "events")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.session_window("ts", gap), "user_id")
        .agg(F.count("*").alias("events"))
        .select("user_id", F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("ended_at"), "events")
    )
