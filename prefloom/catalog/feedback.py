"""Feedback window, idempotent apply, retention and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefloom import constants as c
from prefloom.catalog.ranking import LIB, lib
from prefloom.catalog.registry import micros, query
from prefloom.operators import feedback, splits
from prefloom.session import checkpoint_dir

CUT = "cut AS (SELECT user_id, CAST(FLOOR(MAX(event_id) * 0.9E0) AS BIGINT) AS cutoff FROM fx_events GROUP BY user_id)"


def cutoffs(i):
    return i.events.groupBy("user_id").agg(F.floor(F.max("event_id") * F.lit(0.9)).alias("cutoff"))


def windows(i):
    return (
        feedback.feedback_window(i.comparisons, cutoffs(i), "created_at").drop("position", "total"),
        feedback.feedback_window(i.ratings, cutoffs(i), "rated_at").drop("position", "total"),
    )


WIN = f"""{CUT},
cw AS (SELECT * FROM (SELECT e.*, ROW_NUMBER() OVER (PARTITION BY e.user_id ORDER BY e.created_at DESC, e.id DESC) AS age, COUNT(*) OVER (PARTITION BY e.user_id) AS total FROM fx_comparisons e JOIN cut ON cut.user_id = e.user_id WHERE e.id <= cut.cutoff) WHERE age <= 10000),
rw AS (SELECT * FROM (SELECT e.*, ROW_NUMBER() OVER (PARTITION BY e.user_id ORDER BY e.rated_at DESC, e.id DESC) AS age, COUNT(*) OVER (PARTITION BY e.user_id) AS total FROM fx_ratings e JOIN cut ON cut.user_id = e.user_id WHERE e.id <= cut.cutoff) WHERE age <= 10000)"""


@query("a2_feedback_window", f"WITH {WIN} SELECT user_id, id, LEAST(total, 10000) - age + 1 AS position, total FROM rw")
def _(i):
    return feedback.feedback_window(i.ratings, cutoffs(i), "rated_at").select("user_id", "id", "position", "total")


@query("a3_window_totals", f"WITH {WIN} SELECT user_id, id, total FROM cw WHERE age <= 50")
def _(i):
    return feedback.feedback_window(i.comparisons, cutoffs(i), "created_at", limit=50).select("user_id", "id", "total")


@query("e1_nth_event_cutoff", """WITH n AS (SELECT user_id, COUNT(*) AS c FROM fx_ratings GROUP BY user_id),
w AS (SELECT user_id, c - c % 10 AS n FROM n),
r AS (SELECT user_id, id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY id) AS rn FROM fx_ratings)
SELECT w.user_id, w.n, r.id AS cutoff FROM w JOIN r ON r.user_id = w.user_id AND r.rn = w.n""")
def _(i):
    counts = i.ratings.groupBy("user_id").agg(F.count("*").alias("c"))
    return feedback.nth_event(i.ratings, counts.select("user_id", (F.col("c") - F.col("c") % 10).alias("n")))


TL = f"""{WIN}, ev AS (SELECT user_id, id, 'comparison' AS kind, created_at AS happened, left_id, right_id, NULL AS image_id, NULL AS value FROM cw
UNION ALL SELECT user_id, id, 'rating', rated_at, NULL, NULL, image_id, value FROM rw)"""


@query("g4_feedback_timeline", f"WITH {TL} SELECT user_id, id, kind, epoch_us(happened) AS at_us, left_id, right_id, image_id, CAST(value AS INTEGER) AS value FROM ev")
def _(i):
    return feedback.timeline(*windows(i)).select("user_id", "id", "kind", micros("at").alias("at_us"), "left_id", "right_id", "image_id", "value")


def _capped(source: str, cap: int) -> str:
    return f"""tou AS (SELECT * FROM (SELECT user_id, id, kind, happened, UNNEST([left_id, right_id, image_id]) AS touched FROM {source}) WHERE touched IS NOT NULL),
f1 AS (SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY user_id, touched ORDER BY happened DESC, id DESC, kind DESC) = 1 THEN 1 ELSE 0 END AS isnew FROM tou),
ag AS (SELECT user_id, id, kind, happened, SUM(isnew) AS added FROM f1 GROUP BY ALL),
ru AS (SELECT *, CAST(SUM(added) OVER (PARTITION BY user_id ORDER BY happened DESC, id DESC, kind DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS distinct_images FROM ag)
SELECT user_id, id, kind, distinct_images FROM ru WHERE distinct_images <= {cap}"""


@query("e2_pair_participant_window", f"WITH {TL}, pe AS (SELECT * FROM ev WHERE kind = 'comparison'), {_capped('pe', 60)}")
def _(i):
    events = feedback.timeline(*windows(i)).filter(F.col("kind") == "comparison")
    return feedback.participant_window(events, 60).select("user_id", "id", "kind", "distinct_images")


@query("e3_mixed_participant_window", f"WITH {TL}, {_capped('ev', 60)}")
def _(i):
    return feedback.participant_window(feedback.timeline(*windows(i)), 60).select("user_id", "id", "kind", "distinct_images")


@query("e3_window_sufficiency", f"WITH {TL} SELECT user_id, COUNT(*) AS events, COUNT(*) FILTER (WHERE kind = 'rating') AS ratings, COUNT(*) >= CASE WHEN COUNT(*) FILTER (WHERE kind = 'rating') > 0 THEN 5 ELSE 20 END AS sufficient FROM ev GROUP BY user_id")
def _(i):
    return feedback.window_sufficiency(feedback.timeline(*windows(i)))


PART = f"""{LIB}, par AS (SELECT user_id, left_id AS image_id FROM fx_comparisons UNION SELECT user_id, right_id FROM fx_comparisons)"""


def compared(i):
    return i.comparisons.select("user_id", F.explode(F.array("left_id", "right_id")).alias("image_id")).distinct()


@query("c12_known_participants", f"WITH {PART} SELECT user_id, image_id FROM par WHERE EXISTS (SELECT 1 FROM lib WHERE lib.user_id = par.user_id AND lib.image_id = par.image_id)")
def _(i):
    return compared(i).join(lib(i), ["user_id", "image_id"], "left_semi")


@query("g3_missing_participants", f"WITH {PART} SELECT user_id, image_id FROM par EXCEPT SELECT user_id, image_id FROM lib")
def _(i):
    return feedback.missing_participants(compared(i), lib(i))


@query("c13_fill_images", f"""WITH {PART}, ok AS (SELECT par.* FROM par JOIN lib ON lib.user_id = par.user_id AND lib.image_id = par.image_id),
o AS (SELECT lib.user_id, lib.image_id, ROW_NUMBER() OVER (PARTITION BY lib.user_id ORDER BY matches, CASE WHEN predicted_utility IS NULL THEN 0 ELSE 1 END, discovered_day DESC, lib.image_id) AS slot,
 (SELECT COUNT(*) FROM ok WHERE ok.user_id = lib.user_id) AS used FROM lib WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.user_id = lib.user_id AND ok.image_id = lib.image_id))
SELECT user_id, image_id, 'participant' AS origin FROM ok UNION ALL SELECT user_id, image_id, 'fill' FROM o WHERE slot <= 120 - used""")
def _(i):
    known = lib(i)
    return feedback.fill_images(compared(i).join(known, ["user_id", "image_id"], "left_semi"), known, cap=120)


@query("h4_idempotent_ratings", f"""WITH {LIB}, k AS (SELECT r.*, s.issued_at, l.image_id IS NOT NULL AS inlib, s.issued_at IS NOT NULL AND r.responded_at < s.issued_at + INTERVAL 24 HOUR AS live
FROM fx_responses r LEFT JOIN fx_rating_issuances s ON s.token_hash = r.token_hash AND s.user_id = r.user_id AND s.image_id = r.image_id
LEFT JOIN lib l ON l.user_id = r.user_id AND l.image_id = r.image_id),
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, image_id, live AND inlib ORDER BY responded_at, response_id) AS rn FROM k),
a AS (SELECT user_id, image_id, response_id AS aid, token_hash AS atok, value AS aval, responded_at AS aat FROM o WHERE live AND inlib AND rn = 1)
SELECT o.response_id, o.user_id, o.image_id, CAST(o.value AS INTEGER) AS value, CASE WHEN issued_at IS NULL THEN 'invalid' WHEN response_id = aid THEN 'applied'
 WHEN token_hash = atok AND (responded_at, response_id) > (aat, aid) AND value = aval THEN 'replayed' WHEN token_hash = atok AND (responded_at, response_id) > (aat, aid) THEN 'conflict'
 WHEN NOT live THEN 'expired' WHEN NOT inlib THEN 'missing' ELSE 'duplicate' END AS status
FROM o LEFT JOIN a ON a.user_id = o.user_id AND a.image_id = o.image_id""")
def _(i):
    return feedback.apply_ratings(i.responses, i.rating_issuances, lib(i))


@query("h4_idempotent_comparisons", f"""WITH {LIB}, k AS (SELECT c.*, s.issued_at, c.winner_id IN (c.left_id, c.right_id) AND s.issued_at IS NOT NULL AS proper, COALESCE(c.responded_at < s.issued_at + INTERVAL 24 HOUR, FALSE) AS live,
EXISTS (SELECT 1 FROM lib WHERE lib.user_id = c.user_id AND lib.image_id = c.left_id) AND EXISTS (SELECT 1 FROM lib WHERE lib.user_id = c.user_id AND lib.image_id = c.right_id) AS present
FROM fx_choices c LEFT JOIN fx_pair_issuances s ON s.token_hash = c.token_hash AND s.user_id = c.user_id AND s.left_id = c.left_id AND s.right_id = c.right_id),
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, token_hash, proper AND live AND present ORDER BY responded_at, response_id) AS rn FROM k),
a AS (SELECT user_id, token_hash, response_id AS aid, winner_id AS aw, responded_at AS aat FROM o WHERE proper AND live AND present AND rn = 1)
SELECT o.response_id, o.user_id, o.winner_id, CASE WHEN NOT proper THEN 'invalid' WHEN response_id = aid THEN 'applied' WHEN (responded_at, response_id) > (aat, aid) AND winner_id = aw THEN 'replayed'
 WHEN (responded_at, response_id) > (aat, aid) THEN 'conflict' WHEN NOT live THEN 'expired' ELSE 'missing' END AS status FROM o LEFT JOIN a ON a.user_id = o.user_id AND a.token_hash = o.token_hash""")
def _(i):
    return feedback.apply_comparisons(i.choices, i.pair_issuances, lib(i))


@query("c17_responses_within_ttl", """SELECT r.response_id, r.user_id FROM fx_responses r JOIN fx_rating_issuances s ON s.token_hash = r.token_hash
WHERE r.responded_at >= s.issued_at AND r.responded_at < s.issued_at + INTERVAL 24 HOUR""")
def _(i):
    issued = i.rating_issuances.select("token_hash", "issued_at")
    return i.responses.join(issued, "token_hash").filter(feedback.within_ttl(F.col("responded_at"), F.col("issued_at"))).select("response_id", "user_id")


AS_OF = "TIMESTAMP '2024-01-25 00:00:00'"
STALE = f"""st AS (SELECT user_id, token_hash FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY issued_at, token_hash) AS rn FROM fx_rating_issuances WHERE used_at IS NULL AND issued_at + INTERVAL 24 HOUR < {AS_OF})
UNION SELECT user_id, token_hash FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY used_at, token_hash) AS rn FROM fx_rating_issuances WHERE used_at < {AS_OF} - INTERVAL 7 DAY))"""


@query("g1_stale_issuances", f"WITH {STALE} SELECT user_id, token_hash FROM st")
def _(i):
    return feedback.stale_issuances(i.rating_issuances, F.expr(AS_OF))


@query("c15_purged_issuances", f"WITH {STALE} SELECT user_id, token_hash, image_id FROM fx_rating_issuances s WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.token_hash = s.token_hash)")
def _(i):
    stale = feedback.stale_issuances(i.rating_issuances, F.expr(AS_OF))
    return feedback.purge_issuances(i.rating_issuances, stale).select("user_id", "token_hash", "image_id")


GROUPED = f"""{WIN}, ge AS (SELECT user_id, id, left_id, right_id, LEAST(left_id, right_id) AS first_id, GREATEST(left_id, right_id) AS second_id, total - age + 1 AS position, CAST(FLOOR(cutoff * 0.8E0) AS BIGINT) AS prior FROM cw JOIN cut USING (user_id))"""
FRESH = """fe AS (SELECT * FROM ge WHERE id > prior),
fg AS (SELECT user_id, first_id, second_id, MAX(position) AS lastpos, COUNT(*) AS size FROM fe GROUP BY ALL),
fw AS (SELECT *, COALESCE(SUM(size) OVER (PARTITION BY user_id ORDER BY lastpos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef, SUM(size) OVER (PARTITION BY user_id) AS tot FROM fg),
seeds AS (SELECT fe.* FROM fe JOIN fw USING (user_id, first_id, second_id) WHERE bef < 5 AND tot >= 5)"""


def grouped_pairs(i):
    window = feedback.feedback_window(i.comparisons, cutoffs(i), "created_at")
    prior = cutoffs(i).select("user_id", F.floor(F.col("cutoff") * F.lit(0.8)).alias("prior_cutoff"))
    return window.join(prior, "user_id").select(
        "user_id", "id", "left_id", "right_id", "winner_id", "position", "prior_cutoff",
        F.least("left_id", "right_id").alias("first_id"), F.greatest("left_id", "right_id").alias("second_id"))


def grouped_ratings(i):
    window = feedback.feedback_window(i.ratings, cutoffs(i), "rated_at")
    prior = cutoffs(i).select("user_id", F.floor(F.col("cutoff") * F.lit(0.8)).alias("prior_cutoff"))
    return window.join(prior, "user_id").select(
        "user_id", "id", "image_id", "value", "position", "prior_cutoff",
        F.col("image_id").alias("first_id"), F.col("image_id").alias("second_id"))


@query("e4_fresh_validation", f"WITH {GROUPED}, {FRESH} SELECT user_id, id FROM seeds")
def _(i):
    return splits.fresh_validation(grouped_pairs(i)).select("user_id", "id")


@query("e5_chronological_split", f"""WITH {GROUPED}, gg AS (SELECT user_id, first_id, second_id, MAX(position) AS lastpos, COUNT(*) AS size FROM ge GROUP BY ALL),
gw AS (SELECT *, SUM(size) OVER (PARTITION BY user_id ORDER BY lastpos DESC ROWS UNBOUNDED PRECEDING) AS held, SUM(size) OVER (PARTITION BY user_id) AS n, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY lastpos) - 1 AS b FROM gg),
cand AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ABS(held - GREATEST(5, CEIL(n * 0.2E0))), -b) AS rn FROM gw WHERE n >= 15 AND b >= 1 AND held >= 5 AND n - held >= 10),
best AS (SELECT user_id, lastpos AS frompos FROM cand WHERE rn = 1)
SELECT ge.user_id, ge.id, COALESCE(gw.lastpos >= best.frompos, FALSE) AS is_validation FROM ge JOIN gw USING (user_id, first_id, second_id) LEFT JOIN best ON best.user_id = ge.user_id""")
def _(i):
    return splits.chronological_split(grouped_pairs(i)).select("user_id", "id", "is_validation")


RGROUPED = """re AS (SELECT user_id, id, image_id, total - age + 1 AS position, CAST(FLOOR(cutoff * 0.8E0) AS BIGINT) AS prior FROM rw JOIN cut USING (user_id)),
rf AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY position DESC) AS k, COUNT(*) OVER (PARTITION BY user_id) AS tot FROM re WHERE id > prior),
rseeds AS (SELECT * FROM rf WHERE k <= 5 AND tot >= 5)"""


def disjoint(i):
    # windows are bounded per user and read several times
    checkpoint_dir(i.spark)
    pairs, ratings = grouped_pairs(i).checkpoint(), grouped_ratings(i).checkpoint()
    pair_seeds = splits.fresh_validation(pairs).select("user_id", "id", F.lit(True).alias("is_seed"))
    rating_seeds = splits.fresh_validation(ratings).select("user_id", "id", F.lit(True).alias("is_seed"))
    return splits.image_disjoint_split(
        pairs.join(pair_seeds, ["user_id", "id"], "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False))),
        ratings.join(rating_seeds, ["user_id", "id"], "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False))),
    )


@query("e6_image_disjoint_split", f"""WITH {GROUPED}, {FRESH}, {RGROUPED},
held AS (SELECT user_id, left_id AS image_id FROM seeds UNION SELECT user_id, right_id FROM seeds UNION SELECT user_id, image_id FROM rseeds)
SELECT user_id, id, 'comparison' AS kind, CASE WHEN EXISTS (SELECT 1 FROM seeds s WHERE s.id = ge.id) THEN 'validation'
 WHEN EXISTS (SELECT 1 FROM held h WHERE h.user_id = ge.user_id AND h.image_id IN (ge.left_id, ge.right_id)) THEN 'dropped' ELSE 'train' END AS side FROM ge
UNION ALL SELECT user_id, id, 'rating', CASE WHEN EXISTS (SELECT 1 FROM rseeds s WHERE s.id = re.id) THEN 'validation'
 WHEN EXISTS (SELECT 1 FROM held h WHERE h.user_id = re.user_id AND h.image_id = re.image_id) THEN 'dropped' ELSE 'train' END FROM re""")
def _(i):
    pairs, ratings = disjoint(i)
    return pairs.select("user_id", "id", F.lit("comparison").alias("kind"), "side").unionByName(
        ratings.select("user_id", "id", F.lit("rating").alias("kind"), "side"))


@query("e6_leaked_images", "SELECT user_id, image_id FROM fx_ratings WHERE FALSE")
def _(i):
    return splits.leaked_images(*disjoint(i))
