import numpy as np
import pytest
from pyspark.sql import functions as F

from prefloom import constants as c
from prefloom.functions import scoring
from prefloom.functions.vectors import literal
from prefloom.operators import features, feedback, metrics, splits
from prefloom.plans import model, training

PAIR = "user_id bigint, id bigint, left_id bigint, right_id bigint, winner_id bigint, position bigint, is_seed boolean"


def test_pair_features(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "image_id bigint, vector array<double>")
    log = spark.createDataFrame([(1, 1, 2, 1), (2, 2, 1, 1)], "id bigint, left_id bigint, right_id bigint, winner_id bigint")
    rows = features.pair_features(log, vectors).orderBy("id").collect()
    assert [r["x"] for r in rows] == [[1.0, -1.0], [-1.0, 1.0]] and [r["y"] for r in rows] == [1.0, 0.0]


def test_most_likely_ratings(spark):
    df = spark.createDataFrame([(-3.0, 1), (0.0, 3), (3.0, 5)], "u double, value int")
    df = df.withColumn("p", scoring.rating_distribution(F.col("u"), literal([-1.5, -0.5, 0.5, 1.5])))
    assert [r[0] for r in df.select(scoring.most_likely(F.col("p"))).collect()] == [1, 3, 5]
    row = metrics.ordinal_metrics(df, [], F.col("value"), "p").first()
    assert row["accuracy"] == 1.0 and row["mae"] < 0.7


def test_joint_disjoint_split(spark):
    left, right = [1, 2, 4, 6], [2, 3, 5, 7]
    pairs = spark.createDataFrame([(1, i, a, b, a, i, i == 0) for i, (a, b) in enumerate(zip(left, right))], PAIR)
    ratings = spark.createDataFrame([(1, i, im, 3, i == 2) for i, im in enumerate([1, 3, 4, 8])], "user_id bigint, id bigint, image_id bigint, value int, is_seed boolean")
    p, r = splits.image_disjoint_split(pairs, ratings)
    assert {x["id"] for x in p.filter("side = 'train'").collect()} == {3}
    assert {x["id"] for x in r.filter("side = 'train'").collect()} == {1, 3}
    assert splits.leaked_images(p, r).count() == 0


@pytest.mark.parametrize("pairs, cutoff, want", [
    ([(2 * i + 1, 2 * i + 2) for i in range(5)], 0, {1, 2, 3, 4, 5}),
    ([(2 * i + 1, 2 * i + 2) for i in range(15)], 10, {11, 12, 13, 14, 15}),
    ([(2 * i + 1, 2 * i + 2) for i in range(4)], 0, set()),
    ([(1, 2), (3, 4), (5, 6), (7, 8), (9, 10), (11, 12), (12, 11)], 0, {3, 4, 5, 6, 7}),
])
def test_fresh_seeds(spark, pairs, cutoff, want):
    rows = [(1, k + 1, k + 1, min(a), max(a), cutoff) for k, a in enumerate(pairs)]
    df = spark.createDataFrame(rows, "user_id bigint, id bigint, position bigint, first_id bigint, second_id bigint, prior_cutoff bigint")
    assert {r["id"] for r in splits.fresh_validation(df).collect()} == want


def test_mixed_window_keeps_ratings_of_one_image(spark):
    pairs = spark.sql("SELECT 1L AS user_id, 1L AS id, 'comparison' AS kind, TIMESTAMP '2024-01-01' AS at, 1L AS left_id, 2L AS right_id, CAST(NULL AS BIGINT) AS image_id")
    points = spark.range(20).selectExpr("1L AS user_id", "id + 10 AS id", "'rating' AS kind", "TIMESTAMP '2024-01-02' AS at", "CAST(NULL AS BIGINT) AS left_id", "CAST(NULL AS BIGINT) AS right_id", "10L AS image_id")
    kept = feedback.participant_window(pairs.unionByName(points), 1)
    assert kept.filter("kind = 'rating'").count() == 20 and kept.filter("kind = 'comparison'").count() == 0


def synthetic(spark, users=2, seed=0):
    rng = np.random.default_rng(seed)
    truth = np.array([1.5, -1.0, 0.5, 0.0])
    images = rng.normal(size=(80, 4))
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(images)], "image_id bigint, vector array<double>")
    pairs, ratings = [], []
    for u in range(users):
        for k in range(120):
            a, b = rng.choice(80, 2, replace=False)
            won = rng.random() < 1 / (1 + np.exp(-(images[a] - images[b]) @ truth * 3))
            pairs.append((u, 1000 * u + k, int(a), int(b), int(a if won else b)))
        for k, im in enumerate(rng.permutation(80)[:70]):
            value = int(np.clip(np.round(3 + images[im] @ truth), 1, 5))
            ratings.append((u, 1000 * u + k, int(im), value))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    p = spark.createDataFrame(pairs, "user_id bigint, id bigint, left_id bigint, right_id bigint, winner_id bigint").withColumn("created_at", at)
    r = spark.createDataFrame(ratings, "user_id bigint, id bigint, image_id bigint, value int").withColumn("rated_at", at)
    return vectors, p, r


def test_distributed_and_per_user_fits_agree(spark):
    vectors, pairs, ratings = synthetic(spark, users=1)
    x = features.pair_features(pairs, vectors).withColumn("w", F.lit(1.0))
    z = features.rating_features(ratings, vectors).withColumn("w", F.lit(1.0))
    whole = model.fit_joint(x, z)
    user = model.fit_users(x, z).first()
    assert np.allclose(whole.weights, user["weights"], atol=2e-3) and np.allclose(whole.thresholds, user["thresholds"], atol=2e-2)
    assert all(a < b for a, b in zip(whole.thresholds, whole.thresholds[1:]))
    assert abs(whole.objective - user["objective"]) < 1e-4
    scored = x.withColumn("p", scoring.pair_probability(features.dot(F.col("x"), literal(whole.weights)), F.lit(0.0)))
    assert metrics.binary_metrics(scored, [], F.col("y"), F.col("p")).first()["accuracy"] > 0.8
    alone = model.fit_bradley_terry(x)
    assert alone.thresholds is None and len(alone.weights) == 4


def test_threshold_calibration(spark):
    rng = np.random.default_rng(1)
    cuts = np.array([-1.5, -0.5, 0.5, 1.5])
    u = rng.normal(size=3000) * 1.5
    uniform = rng.random(3000)
    above = 1 / (1 + np.exp(-(u[:, None] - cuts)))
    values = 1 + (uniform[:, None] < above).sum(axis=1)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(u, values)], "utility double, value int")
    got = model.calibrate_thresholds(df)
    assert np.allclose(got, cuts, atol=0.2)
    onesided = model.calibrate_thresholds(df.filter("value >= 3"))
    assert all(a < b for a, b in zip(onesided, onesided[1:]))


def test_bootstrap_is_repeatable(spark):
    vectors, pairs, ratings = synthetic(spark, users=1)
    x = features.pair_features(pairs, vectors).withColumn("w", F.lit(1.0))
    primary = model.fit_bradley_terry(x)
    a, b = (model.bootstrap(x, None, primary, "seed", members=3) for _ in range(2))
    assert a[0] is primary and [m.weights for m in a] == [m.weights for m in b] and a[1].weights != a[2].weights
    spread = model.ensemble_scores(vectors, a, beta=2.0).first()
    assert spread["utility_std"] > 0 and abs(spread["acquisition"] - spread["mean_utility"] - 2 * spread["utility_std"]) < 1e-12
    draws = spark.range(20000).select(model.multiplicity("s", 1, "id").alias("m")).agg(F.avg("m"), F.variance("m")).first()
    assert abs(draws[0] - 1) < 0.05 and abs(draws[1] - 1) < 0.1


@pytest.mark.parametrize("direct", [0, 16])
def test_all_members_in_one_fit(spark, monkeypatch, direct):
    monkeypatch.setattr(model, "DIRECT", direct)
    vectors, pairs, ratings = synthetic(spark, users=1)
    x = features.pair_features(pairs, vectors).withColumn("w", F.lit(1.0))
    z = features.rating_features(ratings, vectors).withColumn("w", F.lit(1.0))
    members = model.bootstrap(x, z, None, "seed", members=4)
    drawn = model.fit_users(x, z, "other", members=4).first()
    assert len(members) == 4 and len(drawn["ensemble_weights"]) == 3
    group = [F.least("left_id", "right_id").cast("string"), F.greatest("left_id", "right_id").cast("string")]
    for k, member in enumerate(members):
        wx, wz = (F.lit(1.0), F.lit(1.0)) if k == 0 else (model.multiplicity("seed", k, *group), model.multiplicity("seedr", k, F.col("image_id").cast("string")))
        p, r = (rows.withColumn("m", w).orderBy("id").collect() for rows, w in ((x, wx), (z, wz)))
        weight = tuple(np.array([row["m"] for row in rows]) for rows in (p, r))
        beta, loss = model._newton(
            np.array([row["x"] for row in p]), np.array([row["y"] for row in p]), np.array([row["x"] for row in r]), np.array([row["value"] for row in r], float),
            c.L2, weight=weight, floor=c.L2 / model.THRESHOLD_SCALE**2,
        )
        assert np.allclose(member.weights, beta[:4], atol=1e-6) and np.allclose(member.thresholds, model.ordered(beta[4:]), atol=1e-6)
        assert abs(member.objective - loss) < 1e-9
    whole = model.fit_joint(x, z)
    assert np.allclose(members[0].weights, whole.weights, atol=2e-3) and abs(members[0].objective - whole.objective) < 1e-5
    alone = model.bootstrap(None, z, None, "seed", members=2)
    assert len(alone) == 2 and alone[0].thresholds is not None


def test_training_job_is_idempotent(spark):
    vectors, pairs, ratings = synthetic(spark)
    cut = spark.createDataFrame([(0, 119, 69), (1, 1119, 1069)], "user_id bigint, comparison_cutoff bigint, rating_cutoff bigint")
    none = cut.filter("user_id < 0")
    heads = spark.createDataFrame([], "user_id bigint, weights array<double>, thresholds array<double>")
    runs = training.train(pairs, ratings, vectors, cut, none, heads)
    rows = {r["user_id"]: r for r in runs.collect()}
    assert set(rows) == {0, 1}
    assert all(r["comparison_count"] == 120 and r["rating_count"] == 70 and r["feedback_count"] == 190 for r in rows.values())
    assert all(r["metrics"]["validation_pairs"] >= c.MIN_FRESH_VALIDATION and r["promotion_reason"] for r in rows.values())
    assert all(len(r["ensemble_weights"]) == c.ENSEMBLE_MEMBERS - 1 and len(r["ensemble_thresholds"][0]) == 4 for r in rows.values())
    assert training.train(pairs, ratings, vectors, cut, cut, heads).count() == 0
    with pytest.raises(ValueError, match="without a vector"):
        training.train(pairs, ratings, vectors.limit(2), cut, none, heads)


def test_thresholds_of_a_model_without_them(spark):
    rng = np.random.default_rng(3)
    u = rng.normal(size=4000)
    true = np.array([-1.5, -0.5, 0.4, 1.3])
    value = 1 + (u[:, None] + rng.logistic(size=(4000, 1)) > true).sum(axis=1)
    rows = spark.createDataFrame([(1, [float(a)], int(b)) for a, b in zip(u, value)], "user_id bigint, x array<double>, value int")
    heads = spark.createDataFrame([(1, [1.0], None), (2, [1.0], None), (3, [1.0], [0.0, 1.0, 2.0, 3.0])], "user_id bigint, weights array<double>, thresholds array<double>")
    got = {r["user_id"]: r["thresholds"] for r in model.with_user_thresholds(heads, rows).collect()}
    assert np.abs(np.array(got[1]) - true).max() < 0.15 and got[2] is None and got[3] == [0.0, 1.0, 2.0, 3.0]


def test_items_that_cannot_be_scored(spark):
    import pytest

    from prefloom.operators import features

    wanted = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 3), (2, None)], "user_id bigint, image_id bigint")
    images = spark.createDataFrame([(1,), (2,), (2,)], "image_id bigint")
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [0.0, 1.0])], "image_id bigint, vector array<double>")
    models = spark.createDataFrame([(1, [0.5, 0.25])], "user_id bigint, weights array<double>")
    bad = features.scoring_violations(wanted, images, vectors).collect()
    assert sorted((r["user_id"], r["image_id"] or 0, r["check"]) for r in bad) == [(1, 2, "missing-vector"), (2, 0, "unknown-image"), (2, 3, "unknown-image")]
    with pytest.raises(ValueError, match="missing-vector"):
        features.score_requested(wanted, images, vectors, models)
    got = features.score_requested(wanted.filter("image_id = 1"), images, vectors, models).collect()
    assert [(r["user_id"], r["image_id"], r["predicted_utility"]) for r in got] == [(1, 1, 1.0)]


def test_events_that_are_alike_are_one_row_of_bounded_tasks(spark, monkeypatch):
    rows = spark.range(400).selectExpr("array(double(id % 4), 1.0D) AS x", "double(id % 2) AS y", "1.0D AS w")
    few = model.collapsed(rows, "x", "y")
    assert sorted((r["x"][0], r["y"], r["w"]) for r in few.collect()) == [(0.0, 0.0, 100.0), (1.0, 1.0, 100.0), (2.0, 0.0, 100.0), (3.0, 1.0, 100.0)]
    monkeypatch.setattr(model, "TASK_ROWS", 10)
    assert model.spread(rows).rdd.getNumPartitions() == 40
