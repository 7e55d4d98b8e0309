from pyspark.sql import functions as F

from prefloom import constants as c
from prefloom.operators import bandit, decisions


def rows(spark, data, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*columns).collect()]


def test_comparison_cadence(spark):
    cases = [(None, 20), (20, 40), (39, 40), (40, 60), (70, 80), (80, 100), (100, 150), (120, 150), (150, 200)]
    got = rows(spark, cases, "last int, want bigint", decisions.next_target(F.col("last"), c.COMPARISON_CADENCE), "want")
    assert all(a == b for a, b in got)
    latest = [(19, None, 20), (94, None, 80), (94, 20, 80), (149, 40, 100), (260, 100, 250)]
    got = rows(spark, latest, "n int, last int, want bigint", decisions.latest_target(F.col("n"), F.col("last"), c.COMPARISON_CADENCE), "want")
    assert all(a == b for a, b in got)


def test_rating_cadence(spark):
    cases = [(None, 5), (0, 5), (5, 10), (39, 40), (45, 50), (50, 60), (59, 60), (60, 70)]
    got = rows(spark, cases, "last int, want bigint", decisions.next_target(F.col("last"), c.RATING_CADENCE), "want")
    assert all(a == b for a, b in got)
    latest = [(4, None, 5), (34, None, 30), (34, 5, 30), (59, 10, 50), (86, 50, 80)]
    got = rows(spark, latest, "n int, last int, want bigint", decisions.latest_target(F.col("n"), F.col("last"), c.RATING_CADENCE), "want")
    assert all(a == b for a, b in got)


def test_latest_target_equals_stepping(spark):
    def step(last, cadence):
        first, early, limit, mature = cadence
        if last is None:
            return first
        return min(limit, (last // early + 1) * early) if last < limit else (last // mature + 1) * mature

    for cadence in (c.COMPARISON_CADENCE, c.RATING_CADENCE):
        cases = []
        for n in range(0, 330, 3):
            for last in (None, 0, 7, 20, 45, 99, 100, 130):
                target = step(last, cadence)
                while n >= target and step(target, cadence) <= n:
                    target = step(target, cadence)
                cases.append((n, last, target))
        got = rows(spark, cases, "n int, last int, want bigint", decisions.latest_target(F.col("n"), F.col("last"), cadence), "want")
        assert all(a == b for a, b in got)


def test_crawl_size(spark):
    cases = [(51, 0, 0), (50, 0, 10), (0, 0, 10), (50, 95, 5), (50, 100, 0)]
    got = rows(spark, cases, "b bigint, n bigint, want bigint", decisions.crawl_size(F.col("b"), F.col("n")), "want")
    assert all(a == b for a, b in got)


def test_rewards_and_outcomes(spark):
    got = rows(spark, [(v,) for v in range(0, 7)], "v int", bandit.rating_reward(F.col("v")))
    assert [g[0] for g in got] == [None, 0.0, 0.25, 0.5, 0.75, 1.0, None]
    cases = [(0, 0, False, "observed", 0.0), (1, 1, False, "observed", None), (1, 1, True, "censored", None), (0, 1, False, "censored", None)]
    status, reward = bandit.action_outcome(F.col("i"), F.col("e"), F.col("x"))
    got = rows(spark, cases, "i int, e int, x boolean, s string, r double", status, reward, "s", "r")
    assert all((a, b) == (s, r) for a, b, s, r in got)


def test_log_weights_equal_sequential_replay(spark):
    import math
    import random

    rng = random.Random(3)
    arms = ["a", "b", "c"]
    data = [(1, i, rng.choice(arms + ["gone"]), rng.uniform(0.1, 1.0), rng.random()) for i in range(300)]
    w = dict.fromkeys(arms, 0.0)
    for t, (_, _, arm, p, r) in enumerate(data, 1):
        if arm not in w:
            continue
        eta = min(0.25, math.sqrt(math.log(3) / (3 * t)))
        w = {k: 0.995 * x for k, x in w.items()}
        w[arm] += eta * r / (p + eta / 2)
    top = max(w.values())
    log = spark.createDataFrame(data, "user_id bigint, id bigint, arm string, propensity double, effective_reward double")
    log = log.withColumn("policy_version", F.lit(c.POLICY_VERSION)).withColumn("status", F.lit("observed"))
    users = spark.createDataFrame([(1,), (2,)], "user_id bigint")
    got = {(r["user_id"], r["arm"]): r["log_weight"] for r in bandit.log_weights(users, bandit.policy_history(log), arms).collect()}
    assert all(abs(got[(1, a)] - (w[a] - top)) < 1e-12 for a in arms)
    assert all(got[(2, a)] == 0.0 for a in arms)
    probabilities = bandit.behaviour(bandit.log_weights(users, bandit.policy_history(log), arms))
    sums = probabilities.groupBy("user_id").agg(F.sum("probability").alias("s"), F.min("probability").alias("low")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 and r["low"] >= 0.2 / 3 - 1e-12 for r in sums)


def test_two_imports_are_a_violation(spark):
    rewards = spark.createDataFrame([(1, 7, 1), (1, 7, 2), (1, 8, 3)], "user_id bigint, action_id bigint, image_id bigint")
    assert [tuple(r) for r in bandit.attribution_violations(rewards).collect()] == [(1, 7, 2)]


JOBS = "id bigint, user_id bigint, kind string, status string, input_json string, output_json string, error string, created_at timestamp, finished_at timestamp"


def job_log(spark, rows):
    """Rows of (id, user, kind, status, cutoffs, imported, created, finished)."""
    from datetime import datetime

    at = lambda t: t and datetime.fromisoformat(f"2024-03-0{t}")
    data = [
        (n, u, kind, status, f'{{"comparison_cutoff":"{cuts[0]}","rating_cutoff":"{cuts[1]}","run_day":"2024-03-0{created[0]}"}}', f'{{"imported":{imported}}}', None, at(created), at(done))
        for n, u, kind, status, cuts, imported, created, done in rows
    ]
    return spark.createDataFrame(data, JOBS)


def settled(log, as_of):
    return decisions.with_cutoffs(decisions.expire_stale(decisions.as_known(log, as_of), as_of))


def test_replenishment_reasons(spark):
    as_of = F.expr("TIMESTAMP '2024-03-05 12:00:00'")
    log = job_log(spark, [
        (1, 1, "train", "running", ("0", "0"), 0, "5T11:50", None),
        (2, 3, "crawl", "succeeded", ("0", "7"), 4, "5T08:00", "5T08:05"),
        *[(10 + k, 4, "crawl", "failed", ("0", "7"), 0, "5T08:00", "5T08:05") for k in range(3)],
        (20, 5, "crawl", "succeeded", ("0", "6"), 100, "5T01:00", "5T01:05"),
        (21, 6, "crawl", "succeeded", ("0", "6"), 95, "5T01:00", "5T01:05"),
        (22, 7, "crawl", "queued", ("0", "7"), 0, "5T11:39", None),
        (23, 8, "crawl", "succeeded", ("0", "7"), 9, "5T11:58", "5T12:03"),
        (24, 9, "crawl", "queued", ("0", "7"), 0, "5T12:01", None),
    ])
    library = spark.createDataFrame([(u, k, None) for u in range(1, 10) for k in range(51 if u == 2 else 50)], "user_id bigint, image_id bigint, point_rating int")
    ratings = spark.createDataFrame([(7, u) for u in range(1, 9)] + [(3, 1)], "id bigint, user_id bigint")
    jobs = settled(log, as_of)
    state = decisions.with_active_job(decisions.backlog(library, ratings), jobs)
    out = decisions.decide_replenishment(state, jobs, as_of, F.col("active_job_id").isNotNull()).collect()
    assert {r["user_id"]: (r["decision"], r["requested"]) for r in out} == {
        1: ("active-job", 0), 2: ("label-backlog", 0), 3: ("daily-cap", 0), 4: ("attempt-cap", 0), 5: ("daily-cap", 0),
        6: ("schedule", 5), 7: ("schedule", 10), 8: ("active-job", 0), 9: ("schedule", 10)}
    shared = decisions.with_active_job(decisions.backlog(library, ratings), jobs, shared=True).collect()
    assert {r["active_job_id"] for r in shared} == {1}
    idle = decisions.with_active_job(decisions.backlog(library, ratings), jobs.filter("id = 2"), shared=True).collect()
    assert {r["active_job_id"] for r in idle} == {None}


def test_training_reasons(spark):
    as_of = F.expr("TIMESTAMP '2024-03-05 12:00:00'")
    log = job_log(spark, [
        (1, 1, "crawl", "queued", ("0", "0"), 0, "5T11:45", None),
        *[(10 + k, 3, "train", "failed", ("40", "9"), 0, f"{k + 1}T08:00", f"{k + 1}T08:05") for k in range(3)],
        (20, 4, "train", "skipped", ("40", "9"), 0, "5T08:00", "5T08:05"),
        (21, 5, "train", "failed", ("40", "8"), 0, "5T08:00", "5T08:05"),
        (22, 6, "train", "running", ("40", "9"), 0, "5T11:00", None),
    ])
    state = spark.createDataFrame([(u, "40", "9", u != 2) for u in range(1, 7)], "user_id bigint, comparison_cutoff string, rating_cutoff string, due boolean")
    jobs = settled(log, as_of)
    rows = decisions.with_active_job(state, jobs)
    out = decisions.decide_training(rows, decisions.training_attempts(jobs, as_of), as_of, F.col("active_job_id").isNotNull()).collect()
    assert {r["user_id"]: r["decision"] for r in out} == {
        1: "active-job", 2: "not-due", 3: "attempt-cap", 4: "retry-backoff", 5: "schedule", 6: "retry-backoff"}
    tries = {r["user_id"]: str(r["next_try"]) for r in out if r["next_try"]}
    assert tries == {3: "2024-03-08 08:05:00", 4: "2024-03-06 00:00:00", 6: "2024-03-06 00:00:00"}


def test_local_rules(spark):
    library = spark.createDataFrame([(1, k, 0 if k < 19 else 1) for k in range(40)] + [(2, k, 0) for k in range(20)], "user_id bigint, image_id bigint, matches bigint")
    made = spark.createDataFrame([(u,) for u, n in ((1, 69), (2, 19), (3, 20)) for _ in range(n)], "user_id bigint")
    models = spark.createDataFrame([(1, 5), (1, 20)], "user_id bigint, comparison_count bigint")
    out = decisions.decide_local(decisions.local_state(library, made, models))
    got = {r["user_id"]: (r["unranked"], r["comparisons"], r["last_trained"], r["train_due"], r["crawl_due"]) for r in out.collect()}
    assert got == {1: (19, 69, 20, False, True), 2: (20, 19, None, False, False), 3: (0, 20, None, True, True)}
