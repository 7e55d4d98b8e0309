"""Streams fed file by file against their batch twins."""

import random

from pyspark.sql import functions as F

from prefloom.operators import elo
from prefloom.streaming import feedback as live
from prefloom.streaming.runs import run_available, run_each_batch


def staged(spark, path, parts):
    """Write parts as consecutive files and stream them one per micro-batch."""
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{path}/{k:03d}")
    schema = parts[0].schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def responses(spark, rows):
    return spark.createDataFrame(rows, "response_id bigint, user_id bigint, image_id bigint, token_hash string, value int, t bigint").withColumn(
        "responded_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t"))).drop("t")


def test_elo_across_micro_batches_equals_replay(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for k in range(240):
        a, b = rng.sample(range(12), 2)
        rows.append((k, 1 if k % 2 else rng.randint(2, 4), a, b, rng.choice((a, b))))
    log = spark.createDataFrame(rows, "id bigint, user_id bigint, left_id bigint, right_id bigint, winner_id bigint")
    live.use_rocksdb(spark)
    stream = staged(spark, tmp_path / "log", [log.filter((F.col("id") >= s) & (F.col("id") < s + 80)).orderBy(F.rand(1)) for s in (0, 80, 160)])
    got = {r["id"]: r["left_elo_after"] for r in run_available(live.running_elo(stream), "elo").collect()}
    want = {r["id"]: r["left_elo_after"] for r in elo.replay(log).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_late_events_are_marked_and_settled(spark, tmp_path):
    log = spark.createDataFrame([(2, 1, 5, 6, 5), (3, 1, 5, 7, 7), (1, 1, 6, 7, 6), (1, 2, 5, 6, 6), (4, 1, 5, 6, 6)], "id bigint, user_id bigint, left_id bigint, right_id bigint, winner_id bigint")
    live.use_rocksdb(spark)
    batches = [log.filter("id IN (2, 3)"), log.filter("id NOT IN (2, 3)")]
    out = run_available(live.running_elo(staged(spark, tmp_path / "late", batches)), "late")
    assert {(r["user_id"], r["id"]) for r in out.filter("late").collect()} == {(1, 1)}
    got = {(r["user_id"], r["id"]): r["left_elo_after"] for r in live.settle_late(out, log).collect()}
    assert got == {(r["user_id"], r["id"]): r["left_elo_after"] for r in elo.replay(log).collect()}


def test_replays_are_dropped_across_batches(spark, tmp_path):
    first = responses(spark, [(1, 1, 1, "a", 3, 0), (2, 1, 2, "b", 4, 10)])
    second = responses(spark, [(3, 1, 1, "a", 3, 3600), (4, 2, 1, "a", 5, 3700)])
    out = run_available(live.first_responses(staged(spark, tmp_path / "r", [first, second])).select("response_id"), "first")
    assert sorted(r[0] for r in out.collect()) == [1, 2, 4]


def test_expiry_bounds_the_join(spark, tmp_path):
    issued = spark.createDataFrame([("a", 1, 1, 0), ("b", 1, 2, 0), ("z", 1, 3, 900_000)], "token_hash string, user_id bigint, image_id bigint, t bigint")
    issued = issued.withColumn("issued_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t"))).drop("t")
    answers = responses(spark, [(1, 1, 1, "a", 3, 86_399), (2, 1, 2, "b", 3, 86_400), (3, 1, 3, "z", 3, 900_010), (4, 9, 9, "none", 1, 900_020)])
    pairs = live.answered_issuances(staged(spark, tmp_path / "i", [issued]), staged(spark, tmp_path / "a", [answers]))
    assert sorted(r[0] for r in run_available(pairs.select("response_id"), "join").collect()) == [1, 3]
    lost = live.open_issuances(staged(spark, tmp_path / "i2", [issued]), staged(spark, tmp_path / "a2", [answers]))
    assert [r["token_hash"] for r in run_available(lost, "lost").collect()] == ["b"]


def test_training_trigger_fires_once_per_crossing_batch(spark, tmp_path):
    log = spark.createDataFrame([(1, "rating") for _ in range(4)], "user_id bigint, kind string")
    more = spark.createDataFrame([(1, "rating"), (2, "comparison")], "user_id bigint, kind string")
    trained = spark.createDataFrame([], "user_id bigint, last_comparison_count bigint, last_rating_count bigint")
    counts = live.feedback_counts(staged(spark, tmp_path / "f", [log, more]))
    out = run_each_batch(counts, "due", lambda *sink: live.emit_training_due(trained, *sink), live.DUE)
    # due from the first batch on, written once although later batches update the user again
    assert [tuple(r) for r in out.collect()] == [(1, 0, 5, None, 5)]


def replayed(log):
    return {(r["user_id"], r["id"]): (r["left_elo_before"], r["right_elo_after"]) for r in elo.replay(log).collect()}


def test_late_events_are_folded_in_place(spark, tmp_path):
    log = spark.createDataFrame([(2, 1, 5, 6, 5), (3, 1, 5, 7, 7), (1, 1, 6, 7, 6)], "id bigint, user_id bigint, left_id bigint, right_id bigint, winner_id bigint")
    live.use_rocksdb(spark)
    out = run_available(live.running_elo(staged(spark, tmp_path / "l", [log.filter(F.col("id") == k) for k in (2, 3, 1)]), recent=10), "in-place")
    assert out.filter("late").count() == 0 and out.filter("revision = 1").count() == 3
    got = {(r["user_id"], r["id"]): (r["left_elo_before"], r["right_elo_after"]) for r in live.latest_revisions(out).collect()}
    assert got == replayed(log)


def test_shuffled_batches_with_repeats_equal_replay(spark, tmp_path):
    rng = random.Random(12)
    rows = []
    for k in range(300):
        a, b = rng.sample(range(9), 2)
        rows.append((k, 1 if k % 2 else rng.randint(2, 4), a, b, rng.choice((a, b))))
    schema = "id bigint, user_id bigint, left_id bigint, right_id bigint, winner_id bigint"
    mixed = rng.sample(rows, len(rows))
    parts = [spark.createDataFrame(part, schema) for part in (mixed[:100], mixed[100:200] + mixed[:7], mixed[200:] + mixed[90:95])]
    log = spark.createDataFrame(rows, schema)
    live.use_rocksdb(spark)
    out = run_available(live.running_elo(staged(spark, tmp_path / "all", parts), recent=1000), "mixed")
    got = {(r["user_id"], r["id"]): (r["left_elo_before"], r["right_elo_after"]) for r in live.latest_revisions(out).collect()}
    assert out.filter("late").count() == 0 and got == replayed(log)
    # a short memory cannot reach all of them; those users are replayed
    out = run_available(live.running_elo(staged(spark, tmp_path / "few", parts), recent=40), "few")
    assert out.filter("late").count() > 0
    got = {(r["user_id"], r["id"]): (r["left_elo_before"], r["right_elo_after"]) for r in live.settle_late(out, log).collect()}
    assert got == replayed(log)


def at(frame):
    return frame.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t"))).drop("t")


def test_issuances_end_when_the_clock_passes(spark, tmp_path):
    from prefloom.streaming.lifetimes import ended_issuances

    hour, day = 3600, 86_400
    schema = "token_hash string, user_id bigint, t bigint"
    issued = [[("a", 1, 0), ("b", 1, 0), ("c", 2, 0)], [("d", 2, day)], [("e", 3, 8 * day)], [("z", 9, 9 * day)]]
    used = [[("b", 1, hour), ("d", 2, day + 5)], [("c", 2, day)], [("b", 1, 2 * hour)], [("z", 9, 9 * day + hour), ("none", 9, 9 * day)]]
    live.use_rocksdb(spark)
    left = staged(spark, tmp_path / "i", [at(spark.createDataFrame(p, schema)).withColumnRenamed("ts", "issued_at") for p in issued])
    right = staged(spark, tmp_path / "u", [at(spark.createDataFrame(p, schema)).withColumnRenamed("ts", "responded_at") for p in used])
    out = run_available(ended_issuances(left, right, "10 days"), "never")
    assert out.count() == 0
    out = run_available(ended_issuances(left, right), "ended")
    # c was answered at the very end of its lifetime, which is too late; e expires exactly where the clock does not pass
    got = sorted((r["token_hash"], r["user_id"], r["reason"]) for r in out.collect())
    assert got == [("a", 1, "unanswered"), ("b", 1, "retention-over"), ("c", 2, "unanswered"), ("d", 2, "retention-over")]


def test_tokens_of_a_bucket_end_each_at_its_own_time(spark, tmp_path):
    from prefloom.streaming.lifetimes import ended_issuances

    rng, hour, day = random.Random(5), 3600, 86_400
    schema = "token_hash string, user_id bigint, t bigint"
    issued = [(f"k{n}", n, rng.randrange(12 * day)) for n in range(300)]
    used = [(t, n, at + rng.randrange(-hour, 30 * hour)) for t, n, at in issued for _ in range(rng.randrange(3))]
    # uses and issuances come in the order of time, a repeat of each in the batch after
    days = [[r for r in rows if 3 * k * day <= r[2] < 3 * (k + 1) * day] for rows in (issued, used) for k in range(5)]
    parts = [[spark.createDataFrame(now + before, schema) for now, before in zip(d, [[], *d])] for d in (days[:5], days[5:])]
    live.use_rocksdb(spark)
    left = staged(spark, tmp_path / "i", [at(p).withColumnRenamed("ts", "issued_at") for p in parts[0]])
    right = staged(spark, tmp_path / "u", [at(p).withColumnRenamed("ts", "responded_at") for p in parts[1]])
    got = sorted(tuple(r) for r in run_available(ended_issuances(left, right, "5 days", buckets=2), "buckets").collect())
    clock = max(r[2] for r in issued + used if r[2] >= 0) - 5 * day
    want = []
    for token, user, start in issued:
        first = min((t for k, _, t in used if k == token and start <= t < start + day), default=None)
        if (start + day if first is None else first + 7 * day) < clock:
            want.append((token, user, "unanswered" if first is None else "retention-over"))
    assert got == sorted(want) and {r[2] for r in want} == {"unanswered", "retention-over"}


def test_wakeups_are_redelivered_with_growing_waits(spark, tmp_path):
    from prefloom.streaming.lifetimes import redeliveries, retry_seconds

    wakeups = [[("a", 1, 0), ("b", 2, 0)], [("a", 1, 3)], [("c", 3, 100)], [("x", 9, 1000)]]
    outcomes = [[("a", 1, "failed", 1)], [("b", 2, "done", 2)], [("a", 1, "failed", 102)], [("a", 1, "done", 1001), ("b", 2, "failed", 1001)]]
    live.use_rocksdb(spark)
    sent = staged(spark, tmp_path / "w", [at(spark.createDataFrame(p, "event_hash string, user_id bigint, t bigint")) for p in wakeups])
    ends = staged(spark, tmp_path / "o", [at(spark.createDataFrame(p, "event_hash string, user_id bigint, kind string, t bigint")) for p in outcomes])
    out = run_available(redeliveries(sent, ends), "wakeups")
    got = sorted((r["event_hash"], r["delivery"], r["ms"] // 1000 - 1_700_000_000, r["action"]) for r in out.collect())
    assert got == [("a", 1, 0, "deliver"), ("a", 2, 11, "deliver"), ("a", 3, 122, "deliver"), ("b", 1, 0, "deliver"), ("c", 1, 100, "deliver"), ("x", 1, 1000, "deliver")]
    waits = spark.createDataFrame([(1,), (5,), (6,), (63,), (64,)], "n bigint").select(retry_seconds(F.col("n"))).collect()
    assert [r[0] for r in waits] == [10, 160, 300, 300, None]
