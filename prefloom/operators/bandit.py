"""EXP3-IX source policy: delayed rewards, replay, probabilities, sampling and log checks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefloom import constants as c
from prefloom.functions.hashing import coin
from prefloom.operators.ordered import last_per_key, top_per_key


def rating_reward(value: Column) -> Column:
    """A 1-5 rating on [0, 1]; anything else has no reward."""
    return F.when(value.between(1, c.RATING_LEVELS), (value - 1) / F.lit(c.REWARD_STEPS))


def action_outcome(imported: Column, eligible: Column, censored: Column) -> tuple[Column, Column]:
    """Status and immediate reward of a finished action. Censoring beats a zero reward."""
    cut = censored | ((eligible > 0) & (imported == 0))
    status = F.when(cut, "censored").otherwise("observed")
    reward = F.when(~cut & (imported == 0), F.lit(0.0))
    return status, reward


def attributed(actions: DataFrame, discoveries: DataFrame, ratings: DataFrame) -> DataFrame:
    """Rated imports of open actions of the current policy, with their reward."""
    open_actions = actions.filter(
        (F.col("policy_version") == c.POLICY_VERSION) & (F.col("status") == "observed") & F.col("effective_reward").isNull()
    )
    return (
        open_actions.select("user_id", F.col("id").alias("action_id"), "chosen_at")
        .join(discoveries.select("user_id", "action_id", "image_id"), ["user_id", "action_id"])
        .join(ratings.select("user_id", "image_id", "value", "rated_at"), ["user_id", "image_id"])
        .withColumn("reward", rating_reward(F.col("value")))
    )


def attribution_violations(rewards: DataFrame) -> DataFrame:
    """Actions that import more than one rated image."""
    return rewards.groupBy("user_id", "action_id").agg(F.count("*").alias("imports")).filter(F.col("imports") > 1)


def refreshed(actions: DataFrame, rewards: DataFrame) -> DataFrame:
    """The action table after the newly attributed rewards are applied."""
    new = rewards.select("user_id", F.col("action_id").alias("id"), "reward")
    return (
        actions.join(new, ["user_id", "id"], "left")
        .withColumn("effective_reward", F.coalesce("effective_reward", "reward"))
        .drop("reward")
    )


def policy_history(actions: DataFrame, limit: int = c.POLICY_HISTORY) -> DataFrame:
    """Newest observed, rewarded actions of the current policy per user."""
    usable = actions.filter(
        (F.col("policy_version") == c.POLICY_VERSION)
        & (F.col("status") == "observed")
        & F.col("effective_reward").isNotNull()
    ).select("user_id", "id", "arm", "propensity", "effective_reward")
    return top_per_key(usable, ["user_id"], [F.col("id").desc()], limit, "age", spread="id")


def discounted_rewards(history: DataFrame, arms: Sequence[str]) -> DataFrame:
    """Discounted importance-weighted reward per (user, arm).

    The replay has a closed form: the weight of round t is the discount to the power of the
    known-arm rounds after it, so no sequential fold is needed. Histories are already cut to
    the policy's history length.
    """
    known = F.col("arm").isin(list(arms))
    newest_first = Window.partitionBy("user_id").orderBy("age")
    later = newest_first.rowsBetween(Window.unboundedPreceding, -1)
    rounds = F.count("*").over(Window.partitionBy("user_id")) - F.row_number().over(newest_first) + 1
    k = len(arms)
    rate = F.least(F.lit(c.MAX_LEARNING_RATE), F.sqrt(F.lit(math.log(k)) / (F.lit(float(k)) * F.col("round"))))
    terms = (
        history.withColumn("round", rounds)
        .withColumn("later", F.coalesce(F.sum(known.cast("int")).over(later), F.lit(0)))
        .withColumn("rate", rate)
        .filter(known)
    )
    estimate = F.col("rate") * F.col("effective_reward") / (F.col("propensity") + F.col("rate") / 2.0)
    decay = F.pow(F.lit(c.POLICY_DISCOUNT), F.col("later"))
    return terms.groupBy("user_id", "arm").agg(F.sum(decay * estimate).alias("discounted_reward"))


def log_weights(users: DataFrame, history: DataFrame, arms: Sequence[str]) -> DataFrame:
    """Log-weight of every configured arm for every user, shifted so the largest is zero."""
    position = F.posexplode(F.array(*[F.lit(a) for a in arms])).alias("arm_position", "arm")
    grid = users.select("user_id", position)
    sums = discounted_rewards(history, arms)
    weights = grid.join(sums, ["user_id", "arm"], "left").withColumn(
        "raw", F.coalesce("discounted_reward", F.lit(0.0))
    )
    top = F.max("raw").over(Window.partitionBy("user_id"))
    return weights.select("user_id", "arm_position", "arm", (F.col("raw") - top).alias("log_weight"))


def behaviour(weights: DataFrame, available: Sequence[str] | None = None) -> DataFrame:
    """Softmax over the available arms mixed with uniform exploration."""
    active = weights if available is None else weights.filter(F.col("arm").isin(list(available)))
    by_user = Window.partitionBy("user_id")
    return (
        active.withColumn("_e", F.exp(F.col("log_weight") - F.max("log_weight").over(by_user)))
        .withColumn("_n", F.count("*").over(by_user))
        .withColumn(
            "probability",
            F.lit(1.0 - c.POLICY_EXPLORATION) * F.col("_e") / F.sum("_e").over(by_user) + F.lit(c.POLICY_EXPLORATION) / F.col("_n"),
        )
        .drop("_e", "_n")
    )


def sample_arm(probabilities: DataFrame, job: Column, day: Column) -> DataFrame:
    """One arm per user by cumulative probability and a seeded draw; the last arm closes gaps."""
    frame = Window.partitionBy("user_id").orderBy("arm_position")
    draw = coin(F.col("user_id"), job, day, F.lit(c.POLICY_VERSION))
    reached = probabilities.withColumn("_draw", draw).withColumn(
        "_cumulative", F.sum("probability").over(frame.rowsBetween(Window.unboundedPreceding, 0))
    )
    # rows below the draw sort behind the others; among them the last arm comes first
    order = F.when(F.col("_draw") <= F.col("_cumulative"), F.col("arm_position")).otherwise(F.lit(1_000_000) - F.col("arm_position"))
    return reached.groupBy("user_id").agg(
        F.min_by(F.struct("arm", "probability"), order).alias("_pick")
    ).select("user_id", F.col("_pick.arm").alias("arm"), F.col("_pick.probability").alias("propensity"))


def log_checks(actions: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Whether a logged distribution is valid and agrees with the logged propensity."""
    values = F.map_values("probabilities")
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    valid = (F.size("probabilities") > 0) & F.forall(values, lambda x: (x > 0) & (x <= 1)) & (F.abs(total - 1.0) <= tolerance)
    chosen = F.try_element_at("probabilities", F.col("arm"))
    agrees = F.coalesce(F.abs(chosen - F.col("propensity")) <= 1e-12, F.lit(False))
    return actions.withColumn("distribution_ok", valid).withColumn("propensity_ok", agrees)


def action_transitions(actions: DataFrame, results: DataFrame) -> DataFrame:
    """Apply finished results to chosen actions; every other row stays as it is."""
    status, reward = action_outcome(F.col("imported"), F.col("eligible"), F.col("censored"))
    done = results.select(
        "user_id", "id", F.when(F.col("failed"), "failed").otherwise(status).alias("_status"),
        F.when(~F.col("failed"), reward).alias("_reward"),
    )
    joined = actions.join(done, ["user_id", "id"], "left")
    hit = (F.col("status") == "chosen") & F.col("_status").isNotNull()
    return joined.withColumn("effective_reward", F.when(hit, F.col("_reward")).otherwise(F.col("effective_reward"))).withColumn(
        "status", F.when(hit, F.col("_status")).otherwise(F.col("status"))
    ).drop("_status", "_reward")


def latest_models(models: DataFrame, encoder: str | None = None, promoted_only: bool = False, minimum: int = 0) -> DataFrame:
    """Per user the model with most feedback, then the highest id."""
    usable = models.filter(F.col("feedback_count") >= minimum)
    if promoted_only:
        usable = usable.filter("promoted")
    if encoder is not None:
        usable = usable.filter(F.col("encoder") == encoder)
    return last_per_key(usable, ["user_id"], ["feedback_count", "id"])


def arm_yield(actions: DataFrame, rewards: DataFrame) -> DataFrame:
    """Mean reward, share rated 4-5, delay to rating and reward per action for each arm."""
    done = actions.join(
        rewards.select("user_id", F.col("action_id").alias("id"), "value", "reward", "rated_at"), ["user_id", "id"], "left"
    )
    delay = (F.unix_micros("rated_at") - F.unix_micros("chosen_at")) / F.lit(3_600_000_000.0)
    return done.groupBy("arm").agg(
        F.count("*").alias("actions"), F.count("reward").alias("rated"), F.avg("reward").alias("mean_reward"),
        (F.count_if(F.col("value") >= 4) / F.count("reward")).alias("share_high"),
        F.avg(delay).alias("mean_delay_hours"), (F.coalesce(F.sum("reward"), F.lit(0.0)) / F.count("*")).alias("reward_per_action"),
    )


def off_policy_value(log: DataFrame, clip: float = 10.0) -> DataFrame:
    """IPS, self-normalised and clipped estimates of a target policy with effective sample size.

    ``log`` has user_id, reward, propensity and target (probability of the logged arm).
    """
    w = F.col("target") / F.col("propensity")
    clipped = F.least(w, F.lit(clip))
    return log.groupBy("user_id").agg(
        F.count("*").alias("rounds"),
        F.avg(w * F.col("reward")).alias("ips"),
        (F.sum(w * F.col("reward")) / F.sum(w)).alias("snips"),
        F.avg(clipped * F.col("reward")).alias("clipped_ips"),
        (F.pow(F.sum(w), 2) / F.sum(w * w)).alias("effective_samples"),
    )
