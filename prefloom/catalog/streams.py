"""Streaming queries, each checked against its batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefloom.catalog.operations import _next
from prefloom.catalog.ranking import REPLAY
from prefloom.catalog.registry import micros, query, rounded
from prefloom.operators import bandit
from prefloom.streaming import feedback as live
from prefloom.streaming import lifetimes
from prefloom.streaming.runs import run_available, run_each_batch


@query("k1_first_responses", "SELECT user_id, token_hash FROM fx_responses GROUP BY ALL")
def _(i):
    return run_available(live.first_responses(i.stream("fx_responses")).select("user_id", "token_hash"), "k1")


@query("k2_answered_issuances", """SELECT r.response_id, s.user_id, s.image_id FROM fx_responses r JOIN fx_rating_issuances s ON s.token_hash = r.token_hash
WHERE r.responded_at >= s.issued_at AND r.responded_at < s.issued_at + INTERVAL 24 HOUR""")
def answered(i):
    joined = live.answered_issuances(i.stream("fx_rating_issuances"), i.stream("fx_responses"))
    return run_available(joined.select("response_id", "user_id", "image_id"), "k2")


@query("k3_delayed_rewards", """SELECT d.user_id, d.action_id, d.image_id, (r.value - 1) / 4.0E0 AS reward FROM fx_imports d JOIN fx_ratings r ON r.user_id = d.user_id AND r.image_id = d.image_id
WHERE r.rated_at >= d.chosen_at AND r.rated_at <= d.chosen_at + INTERVAL 30 DAY""")
def _(i):
    return run_available(live.delayed_rewards(i.stream("fx_imports"), i.stream("fx_ratings")), "k3")


@query("k4_running_elo", REPLAY + "SELECT id, ROUND(lb + d, 6) + 0.0 AS left_elo_after, ROUND(rb - d, 6) + 0.0 AS right_elo_after FROM st WHERE n > 0")
def running_elo(i):
    live.use_rocksdb(i.spark)
    # the files hold ids in no order: what a later micro-batch brings is folded into the past of the earlier ones
    out = run_available(live.running_elo(i.stream("fx_comparisons", files=4), recent=1 << 14), "k4")
    out = live.settle_late(out, i.comparisons)
    return out.select("id", rounded("left_elo_after").alias("left_elo_after"), rounded("right_elo_after").alias("right_elo_after"))


@query("k5_expired_issuances", """WITH w AS (SELECT LEAST((SELECT MAX(issued_at) FROM fx_rating_issuances), (SELECT MAX(responded_at) FROM fx_responses)) - INTERVAL 1 HOUR AS wm)
SELECT s.user_id, s.token_hash FROM fx_rating_issuances s, w WHERE s.issued_at + INTERVAL 24 HOUR < wm AND NOT EXISTS (SELECT 1 FROM fx_responses r WHERE r.token_hash = s.token_hash AND r.responded_at >= s.issued_at AND r.responded_at < s.issued_at + INTERVAL 24 HOUR)""")
def _(i):
    lost = live.open_issuances(i.stream("fx_rating_issuances"), i.stream("fx_responses"))
    return run_available(lost.select("user_id", "token_hash"), "k5")


@query("k5_ended_issuances", """WITH w AS (SELECT GREATEST((SELECT MAX(issued_at) FROM fx_rating_issuances), (SELECT MAX(responded_at) FROM fx_responses)) - INTERVAL 1 HOUR AS wm),
u AS (SELECT s.token_hash, s.user_id, s.issued_at, MIN(r.responded_at) AS used FROM fx_rating_issuances s LEFT JOIN fx_responses r ON r.token_hash = s.token_hash AND r.responded_at >= s.issued_at AND r.responded_at < s.issued_at + INTERVAL 24 HOUR GROUP BY ALL)
SELECT user_id, token_hash, CASE WHEN used IS NULL THEN 'unanswered' ELSE 'retention-over' END AS reason FROM u, w WHERE CASE WHEN used IS NULL THEN issued_at + INTERVAL 24 HOUR ELSE used + INTERVAL 7 DAY END < wm""")
def _(i):
    live.use_rocksdb(i.spark)
    ended = lifetimes.ended_issuances(i.stream("fx_rating_issuances"), i.stream("fx_responses"))
    return run_available(ended, "k5e")


@query("k7_retry_seconds", "SELECT event_id, CASE WHEN event_id % 80 < 64 THEN CAST(LEAST(300, pow(2, event_id % 80) * 5) AS BIGINT) END AS seconds FROM fx_events")
def _(i):
    return i.events.select("event_id", lifetimes.retry_seconds(F.col("event_id") % 80).alias("seconds"))


@query("k6_training_triggers", f"""WITH n AS (SELECT user_id, COUNT(*) FILTER (WHERE kind = 'comparison') AS c, COUNT(*) FILTER (WHERE kind = 'rating') AS r FROM fx_feedback GROUP BY user_id),
lm AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY feedback_count DESC, id DESC) AS rn FROM fx_models) WHERE rn = 1)
SELECT n.user_id FROM n LEFT JOIN lm ON lm.user_id = n.user_id WHERE c >= {_next('lm.comparison_count', 20, 20, 100, 50)} OR r >= {_next('lm.rating_count', 5, 5, 50, 10)}""")
def _(i):
    trained = bandit.latest_models(i.models).select(
        "user_id", F.col("comparison_count").alias("last_comparison_count"), F.col("rating_count").alias("last_rating_count"))
    counts = live.feedback_counts(i.stream("fx_feedback"))
    out = run_each_batch(counts, "k6", lambda *sink: live.emit_training_due(trained, *sink), live.DUE)
    return out.select("user_id").distinct()


@query("k7_distinct_wakeups", "SELECT DISTINCT sha256('crawl:' || user_id || ':' || event_id % 50) AS event_hash FROM fx_events")
def _(i):
    wakeups = i.stream("fx_events").select("user_id", (F.col("event_id") % 50).cast("string").alias("event_key"), "ts")
    return run_available(live.distinct_wakeups(wakeups).select("event_hash"), "k7")


@query("k8_hourly_activity", """SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, event_type, COUNT(*) AS events FROM fx_events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT MAX(ts) FROM fx_events) - INTERVAL 1 HOUR GROUP BY ALL""")
def hourly(i):
    out = run_available(live.hourly_activity(i.stream("fx_events")), "k8")
    return out.select(micros("hour").alias("hour_us"), "event_type", "events")


@query("k8_sessions", """WITH g AS (SELECT *, CASE WHEN ts <= LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS isnew FROM fx_events),
s AS (SELECT *, SUM(isnew) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g),
a AS (SELECT user_id, n, MIN(ts) AS lo, MAX(ts) + INTERVAL 30 MINUTE AS hi, COUNT(*) AS events FROM s GROUP BY ALL)
SELECT user_id, epoch_us(lo) AS started_us, epoch_us(hi) AS ended_us, events FROM a WHERE hi <= (SELECT MAX(ts) FROM fx_events) - INTERVAL 1 HOUR""")
def _(i):
    out = run_available(live.sessions(i.stream("fx_events")), "k8s")
    return out.select("user_id", micros("started_at").alias("started_us"), micros("ended_at").alias("ended_us"), "events")
