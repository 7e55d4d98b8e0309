import random

from pyspark.sql import functions as F

from prefloom.functions.elo import adaptive_k, expected_score
from prefloom.operators import elo, graph, pairs


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_elo_values(spark):
    assert value(spark, expected_score(F.lit(1500.0), F.lit(1500.0))) == 0.5
    assert value(spark, adaptive_k(F.lit(0))) == 48.0
    assert value(spark, adaptive_k(F.lit(None).cast("int"))) is None
    assert value(spark, adaptive_k(F.lit(100000))) == 16.0


def comparisons(spark, n=400, users=3, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        left, right = rng.sample(range(1, 15), 2)
        rows.append((i, rng.randint(1, users) if i % 3 else 1, left, right, rng.choice((left, right))))
    return spark.createDataFrame(rows, "id bigint, user_id bigint, left_id bigint, right_id bigint, winner_id bigint")


def test_first_comparison_and_conservation(spark):
    log = comparisons(spark)
    history = elo.replay(log)
    first = history.orderBy("id").first()
    assert abs(first["elo_delta"] - 24.0) < 1e-9
    totals = elo.ratings_from(history).groupBy("user_id").agg(F.sum("elo").alias("s"), F.count("*").alias("n"), F.sum("matches").alias("m"), F.sum("wins").alias("w"))
    for row in totals.collect():
        assert abs(row["s"] - 1500.0 * row["n"]) < 1e-6 and row["m"] == 2 * row["w"]
    assert elo.chain_breaks(history, bits=4).count() == 0


def test_replay_in_steps_equals_one_step(spark):
    log = comparisons(spark, seed=1)
    once = {r["id"]: r["left_elo_after"] for r in elo.replay(log).collect()}
    steps = {r["id"]: r["left_elo_after"] for r in elo.replay(log, rows_per_step=90).collect()}
    assert once.keys() == steps.keys() and all(abs(once[k] - steps[k]) < 1e-9 for k in once)


def test_anchor_positions(spark):
    rows = [(1, i, 1200.0 + 25 * i, 12, 6) for i in range(1, 21)]
    nodes = spark.createDataFrame(rows, "user_id bigint, image_id bigint, elo double, matches int, degree int")
    got = sorted(r["image_id"] for r in graph.quantile_anchors(nodes).collect())
    assert got == [1, 4, 7, 11, 14, 17, 20]
    flags = {r["image_id"] for r in graph.pool_anchor_flag(nodes).filter("is_anchor").collect()}
    assert sorted(flags) == got
    weaker = nodes.withColumn("degree", F.when(F.col("image_id") == 11, 1).otherwise(F.col("degree")))
    assert 11 not in {r["image_id"] for r in graph.quantile_anchors(weaker).collect()}


def library(spark, rows):
    return spark.createDataFrame(rows, "user_id bigint, image_id bigint, elo double, matches bigint, predicted_utility double")


def empty_log(spark):
    return spark.createDataFrame([], "id bigint, user_id bigint, left_id bigint, right_id bigint, winner_id bigint")


def test_most_uncertain_pair_wins(spark):
    lib = library(spark, [(1, 1, 1500.0, 0, 0.0), (1, 2, 1500.0, 0, 0.05), (1, 3, 1500.0, 0, 4.0)])
    pool = pairs.candidate_pool(lib, empty_log(spark), "t")
    row = pairs.choose_pairs(pairs.scored_pairs(pool, empty_log(spark), "t"), "t", exploration_rate=0.0).first()
    assert {row["left_id"], row["right_id"]} == {1, 2}


def test_recent_pair_is_skipped_until_nothing_is_fresh(spark):
    lib = library(spark, [(1, 1, 1500.0, 1, 0.0), (1, 2, 1500.0, 1, 0.05), (1, 3, 1500.0, 0, 4.0)])
    log = spark.createDataFrame([(1, 1, 1, 2, 1)], empty_log(spark).schema)
    row = pairs.next_pairs(lib, log, "t").first()
    assert {row["left_id"], row["right_id"]} != {1, 2}
    two = lib.filter("image_id < 3")
    row = pairs.next_pairs(two, log, "t").first()
    assert {row["left_id"], row["right_id"]} == {1, 2}


def test_pool_is_bounded_and_complete_for_small_libraries(spark):
    rows = [(u, i, 1500.0 + i, i % 12, None) for u, n in ((1, 500), (2, 50)) for i in range(1, n + 1)]
    lib = library(spark, rows)
    sizes = {r["user_id"]: r["count"] for r in pairs.candidate_pool(lib, empty_log(spark), "t").groupBy("user_id").count().collect()}
    assert sizes == {1: 96, 2: 50}


def test_pairs_of_a_pool_stay_where_they_are_made(spark):
    node = "user_id bigint, image_id bigint, elo double, matches bigint, degree bigint, predicted_utility double"
    pool = spark.createDataFrame([(u, k, 1500.0 + k, 1, 1, None) for u in (1, 2) for k in range(30)], node)
    log = spark.createDataFrame([(1, 1, 3, 2, 3), (2, 1, 2, 3, 3), (3, 2, 4, 99, 4)], "id bigint, user_id bigint, left_id bigint, right_id bigint, winner_id bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for frame in (pairs.scored_pairs(pool, log, "t"), pairs.fresh_pairs(pool, log)):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            above = plan[:plan.index("Generate explode")]
            assert "Exchange" not in above and "Join" not in above
        rows = {(r["user_id"], r["first_id"], r["second_id"]): r for r in pairs.scored_pairs(pool, log, "t").collect()}
        assert len(rows) == 2 * 435 and [k for k, r in rows.items() if not r["fresh"]] == [(1, 2, 3)]
        met, other = rows[1, 2, 3]["coverage"], rows[2, 2, 3]["coverage"]
        assert abs(other - met - 0.25 * (1 - 1 / 3)) < 1e-12
        assert pairs.fresh_pairs(pool, log).count() == 2 * 435 - 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
