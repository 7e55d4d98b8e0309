"""Feature, metric, scoring and model-fit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefloom import constants as c
from prefloom.catalog.feedback import cutoffs
from prefloom.catalog.registry import big, query, rounded
from prefloom.functions import scoring
from prefloom.functions.vectors import as_double, dot, literal
from prefloom.operators import bandit, features, metrics
from prefloom.plans import encoding, model, promotion, training

D = 64
WEIGHTS = [((k * 7) % 11 - 5) / 10.0 for k in range(D)]
THRESHOLDS = [-1.5, -0.5, 0.5, 1.5]
W_SQL = "w AS (SELECT i AS pos, ((i * 7) % 11 - 5) / 10.0E0 AS w FROM range(64) t(i))"
SC_SQL = f"{W_SQL}, sc AS (SELECT image_id, SUM(v * w) AS u FROM fx_long JOIN w USING (pos) GROUP BY image_id)"
SIG = "(1 / (1 + exp(-({})))) "


def vectors(i):
    return i.images.select("image_id", as_double(F.col("embedding")).alias("vector"))


@query("c5_pair_features", """SELECT c.id, CASE WHEN c.winner_id = c.left_id THEN 1.0E0 ELSE 0.0E0 END AS y, ROUND(SUM((l.v - r.v) * (l.pos + 1)), 6) + 0.0 AS checksum
FROM fx_comparisons c JOIN fx_long l ON l.image_id = c.left_id JOIN fx_long r ON r.image_id = c.right_id AND r.pos = l.pos GROUP BY c.id, c.winner_id, c.left_id""")
def _(i):
    ramp = literal([k + 1 for k in range(D)])
    rows = features.pair_features(i.comparisons, vectors(i))
    return rows.select("id", "y", rounded(dot(F.col("x"), ramp)).alias("checksum"))


@query("c5_missing_vectors", """SELECT image_id FROM (SELECT left_id AS image_id FROM fx_comparisons UNION SELECT right_id FROM fx_comparisons UNION SELECT image_id FROM fx_ratings) WHERE image_id % 3 = 0""")
def _(i):
    return features.missing_vectors(features.feedback_images(i.comparisons, i.ratings), vectors(i).filter("image_id % 3 <> 0"))


@query("c6_rating_features", "SELECT r.id, r.value, ROUND(SUM(l.v * (l.pos + 1)), 6) + 0.0 AS checksum FROM fx_ratings r JOIN fx_long l ON l.image_id = r.image_id GROUP BY r.id, r.value")
def _(i):
    ramp = literal([k + 1 for k in range(D)])
    return features.rating_features(i.ratings, vectors(i)).select("id", "value", rounded(dot(F.col("x"), ramp)).alias("checksum"))


@query("d7_binary_metrics", """WITH p AS (SELECT toxic, quality AS y, ((doc_id * 37) % 101) / 100.0E0 AS p FROM labels), q AS (SELECT *, LEAST(GREATEST(p, 1e-7), 1 - 1e-7) AS k FROM p)
SELECT toxic, COUNT(*) AS count, ROUND(AVG(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 9) + 0.0 AS accuracy, ROUND(AVG(-(y * ln(k) + (1 - y) * ln(1 - k))), 9) + 0.0 AS log_loss, ROUND(AVG(pow(p - y, 2)), 9) + 0.0 AS brier FROM q GROUP BY toxic""")
def _(i):
    p = (F.col("doc_id") * 37 % 101) / F.lit(100.0)
    out = metrics.binary_metrics(i.table("labels"), ["toxic"], F.col("quality"), p)
    return out.select("toxic", "count", *[rounded(k, 9).alias(k) for k in ("accuracy", "log_loss", "brier")])


DIST = """ut AS (SELECT r.*, ((r.image_id * 7 + r.user_id * 3) % 41 - 20) / 8.0E0 AS u FROM fx_ratings r),
lv AS (SELECT ut.*, k, 1 / (1 + exp(-(u - (k - 2.5)))) AS above FROM ut, range(1, 5) t(k)),
di AS (SELECT id, user_id, value, k, p FROM (SELECT id, user_id, value, 1 AS k, 1 - above AS p FROM lv WHERE k = 1 UNION ALL SELECT a.id, a.user_id, a.value, a.k + 1, a.above - b.above FROM lv a JOIN lv b ON b.id = a.id AND b.k = a.k + 1 UNION ALL SELECT id, user_id, value, 5, above FROM lv WHERE k = 4)),
pr AS (SELECT id, user_id, value, SUM(k * p) AS e, arg_max(k, p) AS cls, MAX(CASE WHEN k = value THEN p END) AS chosen, SUM(pow(p - CASE WHEN k = value THEN 1 ELSE 0 END, 2)) AS sq FROM di GROUP BY ALL)"""


def rating_predictions(i):
    u = ((F.col("image_id") * 7 + F.col("user_id") * 3) % 41 - 20) / F.lit(8.0)
    return i.ratings.withColumn("p", scoring.rating_distribution(u, literal(THRESHOLDS)))


@query("d8_ordinal_metrics", f"""WITH {DIST} SELECT user_id, COUNT(*) AS count, ROUND(AVG(CASE WHEN cls = value THEN 1.0 ELSE 0.0 END), 9) + 0.0 AS accuracy, ROUND(AVG(abs(e - value)), 9) + 0.0 AS mae,
ROUND(AVG(-ln(GREATEST(1e-7, chosen))), 9) + 0.0 AS log_loss, ROUND(AVG(sq), 9) + 0.0 AS brier, ROUND(AVG(e), 9) + 0.0 AS mean_expected_value FROM pr GROUP BY user_id""")
def _(i):
    out = metrics.ordinal_metrics(rating_predictions(i), ["user_id"], F.col("value"), "p")
    return out.select("user_id", "count", *[rounded(k, 9).alias(k) for k in ("accuracy", "mae", "log_loss", "brier", "mean_expected_value")])


@query("d9_class_prior", "SELECT user_id, k AS value, ROUND((COUNT(*) FILTER (WHERE r.value = k) + 1) / (COUNT(*) + 5.0), 9) + 0.0 AS prior FROM fx_ratings r, range(1, 6) t(k) GROUP BY user_id, k")
def _(i):
    prior = metrics.class_prior(i.ratings, ["user_id"])
    rows = prior.select("user_id", F.posexplode("prior").alias("k", "p"))
    return rows.select("user_id", big(F.col("k") + 1).alias("value"), rounded("p", 9).alias("prior"))


@query("d10_initial_cutpoints", """WITH a AS (SELECT user_id, [(COUNT(*) FILTER (WHERE value > 1) + 0.5) / (COUNT(*) + 1.0), (COUNT(*) FILTER (WHERE value > 2) + 0.5) / (COUNT(*) + 1.0), (COUNT(*) FILTER (WHERE value > 3) + 0.5) / (COUNT(*) + 1.0), (COUNT(*) FILTER (WHERE value > 4) + 0.5) / (COUNT(*) + 1.0)] AS q FROM fx_ratings GROUP BY user_id),
l AS (SELECT user_id, ln(1 - q[1]) - ln(q[1]) AS t1, ln(1 - q[2]) - ln(q[2]) AS t2, ln(1 - q[3]) - ln(q[3]) AS t3, ln(1 - q[4]) - ln(q[4]) AS t4 FROM a),
g AS (SELECT user_id, t1, GREATEST(t2, t1 + 0.05) AS t2, t3, t4 FROM l), h AS (SELECT user_id, t1, t2, GREATEST(t3, t2 + 0.05) AS t3, t4 FROM g)
SELECT user_id, ROUND(t1, 9) + 0.0 AS t1, ROUND(t2, 9) + 0.0 AS t2, ROUND(t3, 9) + 0.0 AS t3, ROUND(GREATEST(t4, t3 + 0.05), 9) + 0.0 AS t4 FROM h""")
def _(i):
    rows = metrics.initial_cutpoints(i.ratings, ["user_id"])
    return rows.select("user_id", *[rounded(F.col("cutpoints")[k], 9).alias(f"t{k + 1}") for k in range(4)])


@query("i7_utility_scores", f"WITH {SC_SQL} SELECT image_id, ROUND(u, 9) + 0.0 AS utility FROM sc")
def _(i):
    scored = features.score(vectors(i), literal(WEIGHTS)).filter("valid")
    return scored.select("image_id", rounded("utility", 9).alias("utility"))


@query("i8_pair_probability", f"""WITH {SC_SQL} SELECT c.id, ROUND({SIG.format('l.u - r.u')}, 9) + 0.0 AS probability, ROUND(l.u - r.u, 9) + 0.0 AS margin, ROUND(1 - abs(2 * {SIG.format('l.u - r.u')} - 1), 9) + 0.0 AS uncertainty
FROM fx_comparisons c JOIN sc l ON l.image_id = c.left_id JOIN sc r ON r.image_id = c.right_id""")
def _(i):
    scored = features.score(vectors(i), literal(WEIGHTS)).select("image_id", "utility")
    left = scored.select(F.col("image_id").alias("left_id"), F.col("utility").alias("l"))
    right = scored.select(F.col("image_id").alias("right_id"), F.col("utility").alias("r"))
    rows = i.comparisons.join(left, "left_id").join(right, "right_id")
    l, r = F.col("l"), F.col("r")
    return rows.select("id", rounded(scoring.pair_probability(l, r), 9).alias("probability"), rounded(l - r, 9).alias("margin"), rounded(scoring.pair_uncertainty(l, r), 9).alias("uncertainty"))


@query("i9_rating_distribution", f"WITH {DIST} SELECT id, CAST(cls AS INTEGER) AS most_likely, ROUND(e, 9) + 0.0 AS expected FROM pr")
def _(i):
    p = F.col("p")
    return rating_predictions(i).select("id", scoring.most_likely(p).alias("most_likely"), rounded(scoring.expected_rating(p), 9).alias("expected"))


@query("i17_library_scores", f"""WITH {W_SQL}, lm AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY feedback_count DESC, id DESC) AS rn FROM fx_models) WHERE rn = 1)
SELECT u.user_id, u.image_id, ROUND((SELECT SUM(l.v * (w.w + lm.id % 7 / 10.0E0)) FROM fx_long l JOIN w USING (pos) WHERE l.image_id = u.image_id), 6) + 0.0 AS predicted_utility FROM fx_user_images u LEFT JOIN lm ON lm.user_id = u.user_id""")
def _(i):
    shift = (F.col("id") % 7) / F.lit(10.0)
    models = bandit.latest_models(i.models).withColumn("weights", F.transform(literal(WEIGHTS), lambda w: w + shift))
    scored = features.score_library(i.user_images.select("user_id", "image_id", "predicted_utility"), vectors(i), models)
    return scored.select("user_id", "image_id", rounded("predicted_utility").alias("predicted_utility"))


@query("i17_scoring_violations", """WITH st AS (SELECT image_id FROM fx_images WHERE active)
SELECT DISTINCT c.user_id, c.candidate_id AS image_id, CASE WHEN i.image_id IS NULL THEN 'unknown-image' ELSE 'missing-vector' END AS "check" FROM fx_candidates c
LEFT JOIN fx_images i ON i.image_id = c.candidate_id LEFT JOIN st ON st.image_id = c.candidate_id WHERE st.image_id IS NULL""")
def _(i):
    # candidates ask for scores under their own number; only active items have a vector
    wanted = i.candidates.select("user_id", F.col("candidate_id").alias("image_id"))
    stored = i.images.filter("active").select("image_id", F.col("embedding").alias("vector"))
    return features.scoring_violations(wanted, i.images, stored)


GATE = """g AS (SELECT id, id % 7 AS validation_pairs, id % 6 AS validation_ratings, id % 45 AS training_pairs, id % 11 AS training_ratings, CASE WHEN id % 7 > 0 THEN (40 + id % 40) / 100.0E0 END AS pa, CASE WHEN id % 7 > 0 THEN (50 + id % 35) / 100.0E0 END AS pl, 0.693E0 AS pbl,
 CASE WHEN id % 4 > 0 THEN (45 + id % 30) / 100.0E0 END AS fa, CASE WHEN id % 4 > 0 THEN (50 + id % 31) / 100.0E0 END AS fl, CASE WHEN id % 4 > 0 THEN (45 + id % 23) / 100.0E0 END AS qa, CASE WHEN id % 4 > 0 THEN (50 + id % 29) / 100.0E0 END AS ql,
 (120 + id % 60) / 100.0E0 AS ol, (60 + id % 40) / 100.0E0 AS om, 1.6E0 AS obl, 0.8E0 AS obm, CASE WHEN id % 3 > 0 THEN (120 + id % 50) / 100.0E0 END AS ofl, CASE WHEN id % 3 > 0 THEN (60 + id % 37) / 100.0E0 END AS ofm, CASE WHEN id % 3 > 0 THEN (125 + id % 43) / 100.0E0 END AS oql, CASE WHEN id % 3 > 0 THEN (60 + id % 41) / 100.0E0 END AS oqm FROM fx_models)"""
GATE_COLUMNS = {"pa": "pair_accuracy", "pl": "pair_log_loss", "pbl": "pair_base_log_loss", "fa": "pair_fresh_accuracy", "fl": "pair_fresh_log_loss", "qa": "pair_prior_accuracy",
                "ql": "pair_prior_log_loss", "ol": "ord_log_loss", "om": "ord_mae", "obl": "ord_base_log_loss", "obm": "ord_base_mae", "ofl": "ord_fresh_log_loss", "ofm": "ord_fresh_mae",
                "oql": "ord_prior_log_loss", "oqm": "ord_prior_mae"}


@query("i14_promotion_gate", f"""WITH {GATE}, f AS (SELECT *, CASE WHEN validation_pairs > 0 THEN CASE WHEN pa <= 0.5 OR pl >= pbl THEN '{promotion.PAIR_BASELINE}' WHEN fa < qa - 0.02 OR fl > ql + 0.02 THEN '{promotion.PAIR_REGRESSED}' END END AS f1,
CASE WHEN validation_ratings > 0 THEN CASE WHEN ol >= obl OR om > obm + 0.05 THEN '{promotion.ORDINAL_BASELINE}' WHEN ofl > oql + 0.02 OR ofm > oqm + 0.05 THEN '{promotion.ORDINAL_REGRESSED}' END END AS f2 FROM g),
r AS (SELECT id, CASE WHEN validation_pairs = 0 AND validation_ratings = 0 THEN '{promotion.NO_HOLDOUT}' WHEN NOT ((training_pairs >= 20 OR training_ratings >= 5) AND (validation_ratings = 0 OR training_ratings >= 5)) THEN '{promotion.NO_SUPPORT}'
WHEN f1 IS NOT NULL OR f2 IS NOT NULL THEN concat_ws('; ', f1, f2) ELSE '{promotion.PASSED}' END AS promotion_reason FROM f)
SELECT id, promotion_reason, promotion_reason = '{promotion.PASSED}' AS promoted FROM r""")
def _(i):
    rows = i.sql(f"SELECT g.* FROM (SELECT * FROM ({GATE[len('g AS '):]})) g").withColumnsRenamed(GATE_COLUMNS)
    return promotion.gate(rows).select("id", "promotion_reason", "promoted")


# -- fits: no closed SQL form; unit tests compare them with a direct optimiser ---------
def weighted(i):
    x = vectors(i)
    pairs = features.pair_features(i.comparisons, x).withColumn("w", F.lit(1.0))
    ratings = features.rating_features(i.ratings, x).withColumn("w", F.lit(1.0))
    return pairs, ratings


def model_frame(i, fitted):
    rows = [(k, float(w)) for k, w in enumerate(fitted.weights)]
    rows += [(1000 + k, float(t)) for k, t in enumerate(fitted.thresholds or ())]
    return i.spark.createDataFrame(rows, "position bigint, value double")


@query("i10_bradley_terry_fit")
def _(i):
    return model_frame(i, model.fit_bradley_terry(weighted(i)[0]))


@query("i11_joint_fit")
def joint_fit(i):
    return model_frame(i, model.fit_joint(*weighted(i)))


@query("i11_user_models")
def user_models(i):
    ends = cutoffs(i).select("user_id", F.col("cutoff").alias("comparison_cutoff"), F.col("cutoff").alias("rating_cutoff"))
    pairs, ratings = training.training_windows(i.comparisons, i.ratings, ends)
    return model.fit_users(features.pair_features(pairs, vectors(i)), features.rating_features(ratings, vectors(i)))


@query("i12_threshold_calibration")
def _(i):
    rows = weighted(i)[1].withColumn("utility", dot(F.col("x"), literal(WEIGHTS)))
    cuts = model.calibrate_thresholds(rows.select("utility", "value"))
    return i.spark.createDataFrame([(k, t) for k, t in enumerate(cuts)], "level bigint, threshold double")


@query("i13_bootstrap_scores")
def _(i):
    ensemble = model.bootstrap(*weighted(i), None, "seed")
    return model.ensemble_scores(vectors(i), ensemble).drop("vector")


def training_inputs(i):
    ends = cutoffs(i).select("user_id", F.col("cutoff").alias("comparison_cutoff"), F.col("cutoff").alias("rating_cutoff"))
    prior = ends.select("user_id", F.floor(F.col("comparison_cutoff") * 0.8).alias("comparison_cutoff"), F.floor(F.col("rating_cutoff") * 0.8).alias("rating_cutoff"))
    incumbents = ends.select("user_id", literal(WEIGHTS).alias("weights"), literal(THRESHOLDS).alias("thresholds"))
    return i.comparisons, i.ratings, vectors(i), ends, prior, incumbents


@query("i15_training_run")
def training_run(i):
    return training.train(*training_inputs(i)).drop("metrics")


@query("i16_cache_misses", "SELECT doc_id AS image_id FROM documents WHERE doc_id % 4 <> 0")
def _(i):
    docs = i.table("documents").select(F.col("doc_id").alias("image_id"), F.lit("hash-64").alias("encoder"))
    return features.cache_misses(docs, docs.filter("image_id % 4 = 0")).select("image_id")


@query("i16_encoded_documents")
def encoded(i):
    docs = i.table("documents").select(F.col("doc_id").alias("image_id"), "text")
    cache = docs.filter("image_id % 4 = 0").select("image_id", F.lit("hash-64").alias("encoder"))
    return encoding.encode_missing(docs, cache, "hash-64")


# -- analytics of the design notes ------------------------------------------------------
@query("m1_acquisition", """WITH m AS (SELECT user_id, image_id, point_rating, predicted_utility + ((image_id * (k + 3)) % 7 - 3) / 10.0E0 AS u FROM fx_user_images, range(8) t(k))
SELECT user_id, image_id, ROUND(AVG(u) + 0.5 * STDDEV_POP(u) + 0.25 * LEAST(1, GREATEST(0, COALESCE(ANY_VALUE(point_rating) / 4.0E0 - 0.3E0, 0))), 6) + 0.0 AS acquisition FROM m GROUP BY user_id, image_id""")
def _(i):
    member = lambda k: F.col("predicted_utility") + (F.col("image_id") * (k + 3) % 7 - 3) / F.lit(10.0)
    score = scoring.acquisition(F.array(*[member(k) for k in range(8)]), F.col("point_rating") / 4.0 - 0.3, 0.5, 0.25)
    return i.user_images.select("user_id", "image_id", rounded(score).alias("acquisition"))


@query("m2_weighted_kappa", f"""WITH {DIST}, cm AS (SELECT user_id, value AS a, cls AS b, COUNT(*) AS n FROM pr GROUP BY ALL), ra AS (SELECT user_id, a, SUM(n) AS n FROM cm GROUP BY ALL), rb AS (SELECT user_id, b, SUM(n) AS n FROM cm GROUP BY ALL),
ob AS (SELECT user_id, SUM(n * pow(a - b, 2)) AS o, SUM(n) AS t FROM cm GROUP BY ALL), ex AS (SELECT ra.user_id, SUM(ra.n * rb.n * pow(a - b, 2)) AS e FROM ra JOIN rb ON ra.user_id = rb.user_id GROUP BY ALL)
SELECT ob.user_id, ROUND(1 - o / (e / t), 9) + 0.0 AS kappa FROM ob JOIN ex ON ex.user_id = ob.user_id""")
def _(i):
    rows = rating_predictions(i).withColumn("predicted", scoring.most_likely(F.col("p")))
    return metrics.weighted_kappa(rows, ["user_id"], "value", "predicted").withColumn("kappa", rounded("kappa", 9))


@query("m2_spearman", f"""WITH {DIST}, rk AS (SELECT user_id, RANK() OVER (PARTITION BY user_id ORDER BY value) + (COUNT(*) OVER (PARTITION BY user_id, value) - 1) / 2.0 AS ra, RANK() OVER (PARTITION BY user_id ORDER BY cls) + (COUNT(*) OVER (PARTITION BY user_id, cls) - 1) / 2.0 AS rb FROM pr)
SELECT user_id, ROUND(corr(ra, rb), 9) + 0.0 AS spearman FROM rk GROUP BY user_id""")
def _(i):
    rows = rating_predictions(i).withColumn("predicted", scoring.most_likely(F.col("p")))
    cells = metrics.contingency(rows, ["user_id"], "value", "predicted")
    return metrics.spearman(cells, ["user_id"], "value", "predicted").withColumn("spearman", rounded("spearman", 9))


@query("m2_kendall", """WITH c AS (SELECT user_id, value AS x, (image_id * 13) % 101 AS y, COUNT(*) AS n FROM fx_ratings GROUP BY ALL)
SELECT a.user_id, ROUND(SUM(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(CAST(SUM(a.n * b.n) FILTER (WHERE a.x <> b.x) AS DOUBLE) * CAST(SUM(a.n * b.n) FILTER (WHERE a.y <> b.y) AS DOUBLE)), 9) + 0.0 AS kendall
FROM c a JOIN c b ON b.user_id = a.user_id GROUP BY a.user_id""")
def _(i):
    cells = metrics.contingency(i.ratings.withColumn("score", F.col("image_id") * 13 % 101), ["user_id"], "value", "score")
    return metrics.kendall(cells, ["user_id"], "value", "score").withColumn("kendall", rounded("kendall", 9))


@query("m2_ndcg", """WITH r AS (SELECT user_id, image_id, value, (image_id * 13) % 101 AS s FROM fx_ratings),
a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY s DESC, image_id) AS pa, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value DESC, image_id) AS pb FROM r)
SELECT user_id, ROUND(SUM(CASE WHEN pa <= 20 THEN (pow(2, value) - 1) / log2(pa + 1) ELSE 0 END) / SUM(CASE WHEN pb <= 20 THEN (pow(2, value) - 1) / log2(pb + 1) ELSE 0 END), 9) + 0.0 AS ndcg FROM a GROUP BY user_id""")
def _(i):
    rows = i.ratings.select("user_id", "image_id", F.col("value"), (F.col("image_id") * 13 % 101).alias("score"))
    return metrics.ndcg(rows, ["user_id"], "score", "value", 20).select("user_id", rounded("ndcg", 9).alias("ndcg"))


@query("m5_creator_quota", "SELECT candidate_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id, creator ORDER BY score DESC, discovery_index) AS rn FROM fx_candidates) WHERE rn <= 2")
def _(i):
    from prefloom.operators.candidates import creator_quota

    return creator_quota(i.candidates, 2).select("candidate_id")
