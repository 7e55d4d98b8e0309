"""Source-policy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefloom import constants as c
from prefloom.catalog.ranking import coin_sql
from prefloom.catalog.registry import query, rounded
from prefloom.operators import bandit

ARMS = ["arm0", "arm1", "arm2", "arm3", "arm4"]
AVAILABLE = ["arm0", "arm2", "arm3", "arm4"]

V2 = "direct-rating-exp3-ix-v2"
REW = f"""rew AS (SELECT a.user_id, a.id AS action_id, d.image_id, r.value, (r.value - 1) / 4.0E0 AS reward, a.chosen_at, r.rated_at FROM fx_actions a JOIN fx_discoveries d ON d.user_id = a.user_id AND d.action_id = a.id
JOIN fx_ratings r ON r.user_id = d.user_id AND r.image_id = d.image_id WHERE a.policy_version = '{V2}' AND a.status = 'observed' AND a.zero_reward IS NULL)"""
ACT = f"""{REW}, act AS (SELECT a.*, COALESCE(a.zero_reward, rew.reward) AS effective_reward FROM fx_actions a LEFT JOIN rew ON rew.user_id = a.user_id AND rew.action_id = a.id)"""
HIST = f"""{ACT}, hist AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY id DESC) AS age FROM act WHERE policy_version = '{V2}' AND status = 'observed' AND effective_reward IS NOT NULL) WHERE age <= 4096)"""
KNOWN = "arm IN ('arm0','arm1','arm2','arm3','arm4')"
DISC = f"""{HIST}, rt AS (SELECT *, COUNT(*) OVER (PARTITION BY user_id) - age + 1 AS t, COALESCE(SUM(CASE WHEN {KNOWN} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY age ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM hist),
et AS (SELECT *, LEAST(0.25, sqrt(ln(5) / (5 * t))) AS eta FROM rt WHERE {KNOWN}),
ds AS (SELECT user_id, arm, SUM(pow(0.995, m) * eta * effective_reward / (propensity + eta / 2)) AS s FROM et GROUP BY ALL)"""
LW = f"""{DISC}, grid AS (SELECT DISTINCT user_id, UNNEST(['arm0','arm1','arm2','arm3','arm4']) AS arm FROM fx_actions),
lw AS (SELECT grid.user_id, grid.arm, COALESCE(s, 0) - MAX(COALESCE(s, 0)) OVER (PARTITION BY grid.user_id) AS w FROM grid LEFT JOIN ds ON ds.user_id = grid.user_id AND ds.arm = grid.arm)"""
PROB = f"""{LW}, pe AS (SELECT *, exp(w - MAX(w) OVER (PARTITION BY user_id)) AS e FROM lw WHERE arm <> 'arm1'),
pr AS (SELECT user_id, arm, 0.8 * e / SUM(e) OVER (PARTITION BY user_id) + 0.2 / COUNT(*) OVER (PARTITION BY user_id) AS p FROM pe)"""


def actions(i):
    return i.actions.withColumnRenamed("zero_reward", "effective_reward")


def rewarded(i):
    acts = actions(i)
    return bandit.refreshed(acts, bandit.attributed(acts, i.discoveries, i.ratings))


def users(i):
    return i.actions.select("user_id").distinct()


def weights(i):
    return bandit.log_weights(users(i), bandit.policy_history(rewarded(i)), ARMS)


@query("i1_rating_reward", "SELECT id, (value - 1) / 4.0E0 AS reward FROM fx_ratings")
def _(i):
    return i.ratings.select("id", bandit.rating_reward(F.col("value")).alias("reward"))


@query("i1_action_outcome", """WITH o AS (SELECT event_id AS id, event_id % 2 AS imported, event_id % 2 + event_id % 3 AS eligible, event_id % 5 = 0 AS censored FROM fx_events)
SELECT id, CASE WHEN censored OR (eligible > 0 AND imported = 0) THEN 'censored' ELSE 'observed' END AS status, CASE WHEN NOT (censored OR (eligible > 0 AND imported = 0)) AND imported = 0 THEN 0.0E0 END AS reward FROM o""")
def _(i):
    e = F.col("event_id")
    status, reward = bandit.action_outcome(e % 2, e % 2 + e % 3, e % 5 == 0)
    return i.events.select(e.alias("id"), status.alias("status"), reward.alias("reward"))


@query("c4_reward_attribution", f"WITH {REW} SELECT user_id, action_id, image_id, reward FROM rew")
def _(i):
    return bandit.attributed(actions(i), i.discoveries, i.ratings).select("user_id", "action_id", "image_id", "reward")


@query("c4_attribution_violations", f"WITH {REW} SELECT user_id, action_id, COUNT(*) AS imports FROM rew GROUP BY ALL HAVING COUNT(*) > 1")
def _(i):
    return bandit.attribution_violations(bandit.attributed(actions(i), i.discoveries, i.ratings))


@query("i5_policy_history", f"WITH {HIST} SELECT user_id, id, arm, effective_reward, age FROM hist")
def _(i):
    return bandit.policy_history(rewarded(i)).select("user_id", "id", "arm", "effective_reward", "age")


@query("d16_discounted_rewards", f"WITH {DISC} SELECT user_id, arm, ROUND(s, 9) + 0.0 AS discounted_reward FROM ds")
def _(i):
    sums = bandit.discounted_rewards(bandit.policy_history(rewarded(i)), ARMS)
    return sums.select("user_id", "arm", rounded("discounted_reward", 9).alias("discounted_reward"))


@query("i2_exp3_log_weights", f"WITH {LW} SELECT user_id, arm, ROUND(w, 9) + 0.0 AS log_weight FROM lw")
def log_weights(i):
    return weights(i).select("user_id", "arm", rounded("log_weight", 9).alias("log_weight"))


@query("i3_behaviour", f"WITH {PROB} SELECT user_id, arm, ROUND(p, 9) + 0.0 AS probability FROM pr")
def _(i):
    return bandit.behaviour(weights(i), AVAILABLE).select("user_id", "arm", rounded("probability", 9).alias("probability"))


@query("i4_sampled_arm", f"""WITH {PROB}, cu AS (SELECT *, SUM(p) OVER (PARTITION BY user_id ORDER BY arm ROWS UNBOUNDED PRECEDING) AS cum, {coin_sql('user_id', "'7'", "'2024-01-15'", f"'{V2}'")} AS draw FROM pr),
pk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY CASE WHEN draw <= cum THEN 0 ELSE 1 END, CASE WHEN draw <= cum THEN arm END, arm DESC) AS rn FROM cu)
SELECT user_id, arm, ROUND(p, 9) + 0.0 AS propensity FROM pk WHERE rn = 1""")
def _(i):
    picked = bandit.sample_arm(bandit.behaviour(weights(i), AVAILABLE), F.lit("7"), F.lit("2024-01-15"))
    return picked.select("user_id", "arm", rounded("propensity", 9).alias("propensity"))


def logged(i):
    e = F.col("id")
    parts = [(1 + (e * (k + 1)) % 7).cast("double") for k in range(6)]
    total = sum(parts[1:], parts[0]) + F.when(e % 29 == 0, 1.0).otherwise(0.0)
    probabilities = F.map_from_arrays(F.array(*[F.lit(f"arm{k}") for k in range(6)]), F.array(*[p / total for p in parts]))
    acts = i.actions.withColumn("probabilities", probabilities)
    return acts.withColumn("propensity", F.try_element_at("probabilities", F.col("arm")) + F.when(e % 31 == 0, 0.01).otherwise(0.0))


@query("i6_policy_log_checks", "SELECT id, id % 29 <> 0 AS distribution_ok, id % 31 <> 0 AS propensity_ok FROM fx_actions")
def _(i):
    return bandit.log_checks(logged(i)).select("id", "distribution_ok", "propensity_ok")


@query("i6_action_transitions", """SELECT id, CASE WHEN status <> 'chosen' THEN status WHEN id % 8 = 0 THEN 'failed' WHEN id % 5 = 0 OR (id % 3 > 0 AND id % 2 = 0) THEN 'censored' ELSE 'observed' END AS status,
CASE WHEN status <> 'chosen' THEN zero_reward WHEN id % 8 = 0 OR id % 5 = 0 OR (id % 3 > 0 AND id % 2 = 0) THEN NULL WHEN id % 2 = 0 THEN 0.0E0 END AS effective_reward FROM fx_actions""")
def _(i):
    e = F.col("id")
    results = i.actions.select("user_id", "id", (e % 2).alias("imported"), (e % 2 + e % 3).alias("eligible"), (e % 5 == 0).alias("censored"), (e % 8 == 0).alias("failed"))
    return bandit.action_transitions(actions(i), results).select("id", "status", "effective_reward")


@query("f13_latest_promoted_model", """SELECT user_id, id, feedback_count FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY feedback_count DESC, id DESC) AS rn FROM fx_models
WHERE promoted AND feedback_count >= 40 AND encoder = 'encoder-a') WHERE rn = 1""")
def _(i):
    return bandit.latest_models(i.models, "encoder-a", True, c.TASTE_MIN_FEEDBACK).select("user_id", "id", "feedback_count")


@query("c3_latest_model", """SELECT u.user_id, m.id AS model_id, m.comparison_count, m.rating_count FROM (SELECT DISTINCT user_id FROM fx_events) u LEFT JOIN
(SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY feedback_count DESC, id DESC) AS rn FROM fx_models) m ON m.user_id = u.user_id AND m.rn = 1""")
def _(i):
    latest = bandit.latest_models(i.models).select("user_id", F.col("id").alias("model_id"), "comparison_count", "rating_count")
    return i.events.select("user_id").distinct().join(latest, "user_id", "left")


@query("m3_arm_yield", f"""WITH {REW} SELECT a.arm, COUNT(*) AS actions, COUNT(rew.reward) AS rated, ROUND(AVG(rew.reward), 9) + 0.0 AS mean_reward, ROUND(COUNT(*) FILTER (WHERE rew.value >= 4) / COUNT(rew.reward), 9) + 0.0 AS share_high,
ROUND(AVG((epoch_us(rew.rated_at) - epoch_us(rew.chosen_at)) / 3600000000.0), 4) + 0.0 AS mean_delay_hours, ROUND(COALESCE(SUM(rew.reward), 0) / COUNT(*), 9) + 0.0 AS reward_per_action
FROM fx_actions a LEFT JOIN rew ON rew.user_id = a.user_id AND rew.action_id = a.id GROUP BY a.arm""")
def _(i):
    acts = actions(i)
    out = bandit.arm_yield(acts, bandit.attributed(acts, i.discoveries, i.ratings))
    return out.select("arm", "actions", "rated", *[rounded(k, 9).alias(k) for k in ("mean_reward", "share_high", "reward_per_action")],
                      rounded("mean_delay_hours", 4).alias("mean_delay_hours"))


@query("m4_off_policy_value", f"""WITH {PROB}, lg AS (SELECT h.user_id, h.effective_reward AS r, pr.p / h.propensity AS w FROM hist h JOIN pr ON pr.user_id = h.user_id AND pr.arm = h.arm)
SELECT user_id, COUNT(*) AS rounds, ROUND(AVG(w * r), 9) + 0.0 AS ips, ROUND(SUM(w * r) / SUM(w), 9) + 0.0 AS snips, ROUND(AVG(LEAST(w, 1.5) * r), 9) + 0.0 AS clipped_ips, ROUND(pow(SUM(w), 2) / SUM(w * w), 9) + 0.0 AS effective_samples FROM lg GROUP BY user_id""")
def _(i):
    history = bandit.policy_history(rewarded(i))
    target = bandit.behaviour(weights(i), AVAILABLE).select("user_id", "arm", F.col("probability").alias("target"))
    log = history.join(target, ["user_id", "arm"]).withColumnRenamed("effective_reward", "reward")
    out = bandit.off_policy_value(log, clip=1.5)
    return out.select("user_id", "rounds", *[rounded(k, 9).alias(k) for k in ("ips", "snips", "clipped_ips", "effective_samples")])
