"""Decision-table and job-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefloom import constants as c
from prefloom.catalog.ranking import LIB, lib
from prefloom.catalog.registry import big, micros, query
from prefloom.operators import bandit, decisions, feedback

NOW = "TIMESTAMP '2024-01-29 02:00:00'"
DURING = "TIMESTAMP '2024-01-28 12:00:00'"
CUTS = """jc AS (SELECT *, json_extract_string(input_json, '$.comparison_cutoff') AS comparison_cutoff, COALESCE(json_extract_string(input_json, '$.rating_cutoff'), '0') AS rating_cutoff,
json_extract_string(input_json, '$.run_day') AS run_day FROM fx_jobs)"""

SIDES = [f"json_extract_string(input_json, '$.{k}')" for k in ("comparison_cutoff", "rating_cutoff")]
HEALTH_CUTS = f"""jc AS (SELECT *, CASE WHEN COALESCE({SIDES[0]}, {SIDES[1]}) IS NOT NULL THEN COALESCE({SIDES[0]}, '0') END AS comparison_cutoff,
CASE WHEN COALESCE({SIDES[0]}, {SIDES[1]}) IS NOT NULL THEN COALESCE({SIDES[1]}, '0') END AS rating_cutoff FROM fx_jobs)"""


def now():
    return F.expr(NOW)


@query("i22_expired_jobs", f"""SELECT id, CASE WHEN status IN ('queued','running') AND created_at < {DURING} - INTERVAL 20 MINUTE THEN 'failed' ELSE status END AS status,
CASE WHEN status IN ('queued','running') AND created_at < {DURING} - INTERVAL 20 MINUTE THEN 'worker exceeded the hard runtime cap' ELSE error END AS error FROM fx_jobs""")
def _(i):
    return decisions.expire_stale(i.jobs, F.expr(DURING)).select("id", "status", "error")


@query("c14_failed_job_actions", """SELECT a.id, CASE WHEN a.status = 'chosen' AND EXISTS (SELECT 1 FROM fx_jobs j WHERE j.id = a.worker_job_id AND j.status = 'failed') THEN 'failed' ELSE a.status END AS status FROM fx_actions a""")
def _(i):
    return decisions.fail_actions(i.actions, i.jobs).select("id", "status")


@query("d5_retry_state", f"""WITH {CUTS} SELECT user_id, comparison_cutoff, rating_cutoff, COUNT(*) FILTER (WHERE status IN ('failed','skipped') AND finished_at >= {NOW} - INTERVAL 7 DAY) AS attempts,
BOOL_OR(run_day = '2024-01-29') AS attempted_today, epoch_us(MIN(finished_at) FILTER (WHERE status IN ('failed','skipped') AND finished_at >= {NOW} - INTERVAL 7 DAY) + INTERVAL 7 DAY) AS retry_us FROM jc WHERE kind = 'train' GROUP BY ALL""")
def _(i):
    out = decisions.training_attempts(decisions.with_cutoffs(i.jobs), now())
    return out.select("user_id", "comparison_cutoff", "rating_cutoff", "attempts", "attempted_today", micros("retry_at").alias("retry_us"))


@query("d6_imported_today", f"""SELECT user_id, CAST(COALESCE(SUM(TRY_CAST(json_extract_string(output_json, '$.imported') AS BIGINT)), 0) AS BIGINT) AS imported_today FROM fx_jobs
WHERE kind = 'crawl' AND status = 'succeeded' AND finished_at >= date_trunc('day', {DURING}) GROUP BY user_id""")
def _(i):
    return decisions.imported_today(i.jobs, F.expr(DURING))


@query("d12_latest_jobs", """WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, kind ORDER BY created_at DESC, id DESC) AS rn FROM fx_jobs),
s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, kind ORDER BY created_at DESC, id DESC) AS rn FROM fx_jobs WHERE status = 'succeeded')
SELECT r.user_id, r.kind, r.id, r.status, s.id AS succeeded_id FROM r LEFT JOIN s ON s.user_id = r.user_id AND s.kind = r.kind AND s.rn = 1 WHERE r.rn = 1""")
def _(i):
    return decisions.latest_jobs(i.jobs).select("user_id", "kind", "id", "status", "succeeded_id")


@query("d13_backlog", f"""WITH {LIB} SELECT user_id, COUNT(*) FILTER (WHERE point_rating IS NULL) AS backlog, COALESCE((SELECT MAX(id) FROM fx_ratings r WHERE r.user_id = lib.user_id), 0) AS rating_cutoff FROM lib GROUP BY user_id""")
def _(i):
    return decisions.backlog(lib(i), i.ratings)


@query("d15_local_state", f"""WITH {LIB}, l AS (SELECT user_id, COUNT(*) FILTER (WHERE matches = 0) AS unranked FROM lib GROUP BY user_id),
n AS (SELECT user_id, COUNT(*) AS comparisons FROM fx_comparisons GROUP BY user_id), m AS (SELECT user_id, MAX(comparison_count) AS last_trained FROM fx_models GROUP BY user_id),
u AS (SELECT user_id, COALESCE(unranked, 0) AS unranked, COALESCE(comparisons, 0) AS comparisons FROM l FULL JOIN n USING (user_id))
SELECT u.user_id, unranked, comparisons, last_trained, comparisons >= 20 AND (last_trained IS NULL OR comparisons - last_trained >= 50) AS train_due, unranked < 20 AS crawl_due FROM u LEFT JOIN m ON m.user_id = u.user_id""")
def _(i):
    return decisions.decide_local(decisions.local_state(lib(i), i.comparisons, i.models))


def _next(last: str, first: int, early: int, limit: int, mature: int) -> str:
    return f"CAST(CASE WHEN {last} IS NULL THEN {first} WHEN {last} < {limit} THEN LEAST({limit}, ({last} // {early} + 1) * {early}) ELSE ({last} // {mature} + 1) * {mature} END AS BIGINT)"


def _pinned(count: str, last: str, first: int, early: int, limit: int, mature: int) -> str:
    return f"""CASE WHEN {count} < {_next(last, first, early, limit, mature)} THEN {count} WHEN {count} < {limit} THEN {count} // {early} * {early} ELSE GREATEST({limit}, {count} // {mature} * {mature}) END"""


STATE = f"""cc AS (SELECT user_id, COUNT(*) AS n FROM fx_comparisons GROUP BY ALL), rc AS (SELECT user_id, COUNT(*) AS n FROM fx_ratings GROUP BY ALL),
lm AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY feedback_count DESC, id DESC) AS rn FROM fx_models) WHERE rn = 1),
s0 AS (SELECT u.user_id, COALESCE(cc.n, 0) AS comparison_count, COALESCE(rc.n, 0) AS rating_count, lm.comparison_count AS lc, lm.rating_count AS lr FROM (SELECT DISTINCT user_id FROM fx_events) u
LEFT JOIN cc ON cc.user_id = u.user_id LEFT JOIN rc ON rc.user_id = u.user_id LEFT JOIN lm ON lm.user_id = u.user_id),
s1 AS (SELECT *, {_next('lc', 20, 20, 100, 50)} AS next_comparison, {_next('lr', 5, 5, 50, 10)} AS next_rating, {_pinned('comparison_count', 'lc', 20, 20, 100, 50)} AS pinned_comparison, {_pinned('rating_count', 'lr', 5, 5, 50, 10)} AS pinned_rating FROM s0),
s2 AS (SELECT *, comparison_count >= next_comparison OR rating_count >= next_rating AS due FROM s1)"""


def counts(i):
    users = i.events.select("user_id").distinct()
    comparisons = i.comparisons.groupBy("user_id").agg(F.count("*").alias("comparison_count"))
    ratings = i.ratings.groupBy("user_id").agg(F.count("*").alias("rating_count"))
    models = bandit.latest_models(i.models).select(
        "user_id", F.col("comparison_count").alias("last_comparison_count"), F.col("rating_count").alias("last_rating_count"))
    joined = users.join(comparisons, "user_id", "left").join(ratings, "user_id", "left").join(models, "user_id", "left")
    return joined.fillna(0, ["comparison_count", "rating_count"])


def state(i):
    return decisions.training_due(counts(i))


@query("i18_training_due", f"WITH {STATE} SELECT user_id, next_comparison, next_rating, pinned_comparison, pinned_rating, due FROM s2")
def _(i):
    return state(i).select("user_id", "next_comparison", "next_rating", big("pinned_comparison").alias("pinned_comparison"), big("pinned_rating").alias("pinned_rating"), "due")


def pinned_state(i):
    """Training state with the event ids of its pinned counts."""
    rows = state(i)
    cuts = {}
    for kind, log in (("comparison", i.comparisons), ("rating", i.ratings)):
        wanted = rows.select("user_id", F.col(f"pinned_{kind}").alias("n"))
        cuts[kind] = feedback.nth_event(log, wanted).select("user_id", F.col("cutoff").cast("string").alias(f"{kind}_cutoff"))
    return rows.join(cuts["comparison"], "user_id", "left").join(cuts["rating"], "user_id", "left").fillna("0", ["comparison_cutoff", "rating_cutoff"])


PINNED = f"""{STATE}, pin AS (SELECT s2.*, COALESCE(CAST(c.id AS VARCHAR), '0') AS cutc, COALESCE(CAST(r.id AS VARCHAR), '0') AS cutr FROM s2
LEFT JOIN (SELECT user_id, id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY id) AS rn FROM fx_comparisons) c ON c.user_id = s2.user_id AND c.rn = pinned_comparison
LEFT JOIN (SELECT user_id, id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY id) AS rn FROM fx_ratings) r ON r.user_id = s2.user_id AND r.rn = pinned_rating)"""


LATE = "TIMESTAMP '2024-01-28 23:00:00'"


def _jobs_sql(at: str) -> str:
    """The job log as known at a moment, after stale jobs have expired, with the oldest active job per user."""
    stale = f"st IN ('queued','running') AND created_at < {at} - INTERVAL 20 MINUTE"
    return f"""kn AS (SELECT *, CASE WHEN finished_at > {at} THEN 'running' ELSE status END AS st, finished_at <= {at} AS done FROM fx_jobs WHERE created_at <= {at}),
jb AS (SELECT id, user_id, kind, created_at, CASE WHEN done THEN output_json END AS output_json, CASE WHEN {stale} THEN 'failed' ELSE st END AS status,
CASE WHEN {stale} THEN {at} WHEN done THEN finished_at END AS finished_at, json_extract_string(input_json, '$.comparison_cutoff') AS comparison_cutoff,
COALESCE(json_extract_string(input_json, '$.rating_cutoff'), '0') AS rating_cutoff, json_extract_string(input_json, '$.run_day') AS run_day FROM kn),
act AS (SELECT user_id, id AS active_job_id FROM (SELECT user_id, id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY created_at, id) AS rn FROM jb WHERE status IN ('queued','running')) WHERE rn = 1)"""


def jobs_at(i, at: str):
    return decisions.with_cutoffs(decisions.expire_stale(decisions.as_known(i.jobs, F.expr(at)), F.expr(at)))


@query("i20_training_decision", f"""WITH {PINNED}, {_jobs_sql(LATE)},
att AS (SELECT user_id, comparison_cutoff, rating_cutoff, COUNT(*) FILTER (WHERE status IN ('failed','skipped') AND COALESCE(finished_at, created_at) >= {LATE} - INTERVAL 7 DAY) AS attempts, BOOL_OR(run_day = '2024-01-28') AS today FROM jb WHERE kind = 'train' GROUP BY ALL)
SELECT pin.user_id, cutc AS comparison_cutoff, cutr AS rating_cutoff, active_job_id, CASE WHEN active_job_id IS NOT NULL THEN 'active-job' WHEN NOT due THEN 'not-due' WHEN COALESCE(attempts, 0) >= 3 THEN 'attempt-cap' WHEN COALESCE(today, FALSE) THEN 'retry-backoff' ELSE 'schedule' END AS decision
FROM pin LEFT JOIN att ON att.user_id = pin.user_id AND att.comparison_cutoff = cutc AND att.rating_cutoff = cutr LEFT JOIN act ON act.user_id = pin.user_id""")
def training_decision(i):
    as_of, jobs = F.expr(LATE), jobs_at(i, LATE)
    rows = decisions.with_active_job(pinned_state(i), jobs)
    out = decisions.decide_training(rows, decisions.training_attempts(jobs, as_of), as_of, F.col("active_job_id").isNotNull())
    return out.select("user_id", "comparison_cutoff", "rating_cutoff", "active_job_id", "decision")


@query("i19_replenishment_decision", f"""WITH {LIB}, {_jobs_sql(DURING)},
b AS (SELECT user_id, COUNT(*) FILTER (WHERE point_rating IS NULL) AS backlog, COALESCE((SELECT MAX(id) FROM fx_ratings r WHERE r.user_id = lib.user_id), 0) AS rating_cutoff FROM lib GROUP BY user_id),
t AS (SELECT user_id, CAST(rating_cutoff AS BIGINT) AS rating_cutoff, COUNT(*) AS attempts, BOOL_OR(status IN ('queued','running','succeeded')) AS blocking FROM jb WHERE kind = 'crawl' AND run_day = '2024-01-28' GROUP BY ALL),
im AS (SELECT user_id, SUM(TRY_CAST(json_extract_string(output_json, '$.imported') AS BIGINT)) AS n FROM jb WHERE kind = 'crawl' AND status = 'succeeded' AND finished_at >= TIMESTAMP '2024-01-28 00:00:00' GROUP BY user_id),
z AS (SELECT b.*, act.active_job_id, t.attempts, t.blocking, CASE WHEN backlog > 50 THEN 0 ELSE LEAST(10, GREATEST(0, 100 - COALESCE(im.n, 0))) END AS size FROM b LEFT JOIN t ON t.user_id = b.user_id AND t.rating_cutoff = b.rating_cutoff LEFT JOIN im ON im.user_id = b.user_id LEFT JOIN act ON act.user_id = b.user_id),
d AS (SELECT *, CASE WHEN active_job_id IS NOT NULL THEN 'active-job' WHEN backlog > 50 THEN 'label-backlog' WHEN COALESCE(blocking, FALSE) THEN 'daily-cap' WHEN COALESCE(attempts, 0) >= 3 THEN 'attempt-cap' WHEN size = 0 THEN 'daily-cap' ELSE 'schedule' END AS decision FROM z)
SELECT user_id, backlog, active_job_id, decision, CAST(CASE WHEN decision = 'schedule' THEN size ELSE 0 END AS BIGINT) AS requested FROM d""")
def _(i):
    jobs = jobs_at(i, DURING)
    current = decisions.with_active_job(decisions.backlog(lib(i), i.ratings), jobs)
    out = decisions.decide_replenishment(current, jobs, F.expr(DURING), F.col("active_job_id").isNotNull())
    return out.select("user_id", "backlog", "active_job_id", "decision", "requested")


@query("e11_retry_cap", f"""WITH {HEALTH_CUTS} SELECT user_id, comparison_cutoff, rating_cutoff FROM jc WHERE kind = 'train' AND comparison_cutoff IS NOT NULL AND status IN ('failed','skipped') AND created_at >= {NOW} - INTERVAL 7 DAY GROUP BY ALL HAVING COUNT(*) >= 3""")
def _(i):
    return decisions.retries_exhausted(decisions.with_health_cutoffs(i.jobs), now()).drop("exhausted")


BS = chr(92)
SHORT = f"""CASE WHEN trim(error) = '' THEN NULL ELSE substr(trim(regexp_replace(regexp_replace(regexp_replace(error, '(postgres(?:ql)?://)[^@{BS}s]+@', '{BS}1•••@', 'gi'), '([?&](?:access_?token|api_?key|password|secret|token)=)[^&{BS}s]+', '{BS}1•••', 'gi'), '{BS}s+', ' ', 'g')), 1, 220) END"""


@query("b10_short_error", f"SELECT id, {SHORT} AS message FROM fx_jobs")
def _(i):
    from prefloom.functions.text import short_error

    return i.jobs.select("id", short_error(F.col("error")).alias("message"))


@query("i21_job_health", f"""WITH {HEALTH_CUTS}, ex AS (SELECT user_id, comparison_cutoff, rating_cutoff FROM jc WHERE kind = 'train' AND comparison_cutoff IS NOT NULL AND status IN ('failed','skipped') AND created_at >= {NOW} - INTERVAL 7 DAY GROUP BY ALL HAVING COUNT(*) >= 3),
la AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, kind ORDER BY created_at DESC, id DESC) AS rn FROM jc) WHERE rn = 1),
ls AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, kind ORDER BY created_at DESC, id DESC) AS rn FROM jc WHERE status = 'succeeded') WHERE rn = 1),
j AS (SELECT la.*, ls.finished_at AS okat, la.kind = 'train' AND la.status IN ('failed','skipped') AND ex.user_id IS NOT NULL AS exhausted, {SHORT.replace('error', 'la.error')} AS short,
 TRY_CAST(json_extract_string(la.output_json, '$.imported') AS BIGINT) AS imp, TRY_CAST(json_extract_string(la.output_json, '$.comparison_count') AS BIGINT) AS cc, TRY_CAST(json_extract_string(la.output_json, '$.rating_count') AS BIGINT) AS rc
 FROM la LEFT JOIN ls ON ls.user_id = la.user_id AND ls.kind = la.kind LEFT JOIN ex ON ex.user_id = la.user_id AND ex.comparison_cutoff = la.comparison_cutoff AND ex.rating_cutoff = la.rating_cutoff)
SELECT user_id, kind, id AS latest_id, CASE WHEN status = 'queued' THEN 'Queued' WHEN status = 'succeeded' THEN 'Healthy' WHEN exhausted THEN 'Retries paused' WHEN status = 'skipped' THEN 'Deferred' ELSE 'Needs attention' END AS state,
CASE WHEN status = 'queued' THEN 'active' WHEN status = 'succeeded' THEN 'healthy' ELSE 'attention' END AS tone,
CASE WHEN status = 'queued' THEN 'Waiting for the private worker to start.' WHEN status = 'succeeded' AND kind = 'crawl' THEN CASE WHEN imp IS NULL THEN 'The latest discovery run completed.' WHEN imp = 0 THEN 'Discovery completed; no photograph passed every quality filter.' WHEN imp = 1 THEN '1 new photograph added.' ELSE imp || ' new photographs added.' END
 WHEN status = 'succeeded' AND cc IS NULL AND rc IS NULL THEN 'The latest taste model trained successfully.'
 WHEN status = 'succeeded' AND cc = 0 AND rc = 0 THEN 'Model trained on 0 feedback events.'
 WHEN status = 'succeeded' THEN 'Model trained on ' || concat_ws(' and ', CASE WHEN rc > 0 THEN rc || CASE WHEN rc = 1 THEN ' rating' ELSE ' ratings' END END, CASE WHEN cc > 0 THEN cc || CASE WHEN cc = 1 THEN ' legacy choice' ELSE ' legacy choices' END END) || ' (' || (cc + rc) || CASE WHEN cc + rc = 1 THEN ' feedback event' ELSE ' feedback events' END || ' total).'
 ELSE COALESCE(short, CASE WHEN status = 'skipped' THEN 'The latest worker run was deferred.' ELSE 'The latest worker run failed.' END) END AS note,
CASE WHEN status NOT IN ('failed','skipped') THEN NULL WHEN exhausted THEN '{decisions.RETRIES_PAUSED}' WHEN error LIKE '%timed out%' THEN 'runtime' ELSE 'other' END AS action,
epoch_us(finished_at) AS last_attempt_us, epoch_us(okat) AS last_success_us, exhausted AS retries_exhausted FROM j
UNION ALL SELECT u.user_id, k.kind, NULL, 'Waiting', 'idle', 'No run has been recorded yet.', NULL, NULL, NULL, FALSE FROM (SELECT DISTINCT user_id FROM fx_user_images) u, (VALUES ('crawl'), ('train')) k(kind)
WHERE NOT EXISTS (SELECT 1 FROM fx_jobs x WHERE x.user_id = u.user_id AND x.kind = k.kind)""")
def job_health(i):
    out = decisions.job_health(i.jobs, now(), i.user_images)
    return out.withColumn("last_attempt_us", micros("last_attempt_at")).withColumn("last_success_us", micros("last_success_at")).drop("last_attempt_at", "last_success_at")
