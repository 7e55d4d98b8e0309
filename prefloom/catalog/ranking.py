"""Library, queue, Elo and pair-selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefloom import constants as c
from prefloom.catalog.registry import big, micros, query, rounded
from prefloom.functions.elo import adaptive_k, expected_score
from prefloom.operators import elo, feedback, graph, library, pairs
from prefloom.operators.ordered import top_per_key

SEED = "s1"

LIB = """lib AS (SELECT u.* FROM fx_user_images u JOIN fx_images i ON i.image_id = u.image_id WHERE u.active AND i.active)"""
DEG = """pc AS (SELECT user_id, LEAST(left_id, right_id) AS first_id, GREATEST(left_id, right_id) AS second_id, COUNT(*) AS pair_count FROM fx_comparisons GROUP BY ALL),
deg AS (SELECT user_id, image_id, COUNT(*) AS degree FROM (SELECT user_id, first_id AS image_id FROM pc UNION ALL SELECT user_id, second_id FROM pc) GROUP BY ALL)"""
NODES = f"""{LIB}, {DEG}, nodes AS (SELECT lib.user_id, lib.image_id, elo, matches, COALESCE(degree, 0) AS degree, predicted_utility FROM lib LEFT JOIN deg ON deg.user_id = lib.user_id AND deg.image_id = lib.image_id)"""


def coin_sql(*parts: str) -> str:
    joined = " || ':' || ".join(parts)
    return f"(CAST(CONCAT('0x', substr(sha256({joined}), 1, 8)) AS BIGINT) / 4294967296.0)"


def sha_sql(*parts: str) -> str:
    return "sha256(" + " || ':' || ".join(parts) + ")"


def lib(i):
    return library.active_library(i.user_images, i.images.select("image_id", "active"))


@query("a1_active_library", f"WITH {LIB} SELECT user_id, image_id, matches, CAST(point_rating AS INTEGER) AS point_rating FROM lib")
def _(i):
    return lib(i).select("user_id", "image_id", big("matches").alias("matches"), "point_rating")


@query("b16_point_lookups", f"""WITH {LIB} SELECT user_id, image_id, elo FROM lib WHERE image_id = 42
UNION ALL SELECT user_id, id, CAST(NULL AS DOUBLE) FROM fx_jobs WHERE user_id = 3""")
def _(i):
    image = lib(i).filter("image_id = 42").select("user_id", "image_id", "elo")
    jobs = i.jobs.filter("user_id = 3").select("user_id", F.col("id").alias("image_id"), F.lit(None).cast("double").alias("elo"))
    return image.unionByName(jobs)


@query("c1_library_join", f"WITH {LIB} SELECT lib.user_id, i.title, i.creator, lib.elo FROM lib JOIN fx_images i ON i.image_id = lib.image_id")
def _(i):
    return library.active_library(i.user_images, i.images.select("image_id", "active", "title", "creator")).select("user_id", "title", "creator", "elo")


@query("d1_library_stats", f"""WITH {LIB}, u AS (SELECT user_id FROM lib UNION SELECT user_id FROM fx_comparisons UNION SELECT user_id FROM fx_ratings)
SELECT user_id, (SELECT COUNT(*) FROM lib WHERE lib.user_id = u.user_id) AS images,
(SELECT COUNT(*) FROM fx_comparisons x WHERE x.user_id = u.user_id) AS comparisons,
(SELECT COUNT(*) FROM fx_ratings x WHERE x.user_id = u.user_id) AS ratings FROM u""")
def _(i):
    return library.library_stats(lib(i), i.comparisons, i.ratings)


@query("d2_pair_counts", f"WITH {DEG} SELECT user_id, first_id, second_id, pair_count FROM pc")
def _(i):
    return graph.pair_counts(i.comparisons)


@query("d3_degrees", f"WITH {DEG} SELECT user_id, image_id, degree FROM deg")
def _(i):
    return graph.degrees(graph.pair_counts(i.comparisons))


@query("d4_match_counts", "SELECT user_id, image_id, matches, wins, matches - wins AS losses FROM fx_match_counts")
def _(i):
    return graph.match_counts(i.comparisons)


@query("g2_participants", """SELECT p.user_id, p.image_id FROM (SELECT user_id, left_id AS image_id FROM fx_comparisons UNION SELECT user_id, right_id FROM fx_comparisons) p
WHERE EXISTS (SELECT 1 FROM fx_user_images u WHERE u.user_id = p.user_id AND u.image_id = p.image_id AND u.active)""")
def _(i):
    return library.participants(i.comparisons, i.user_images)


@query("e10_quantile_anchors", f"""WITH {NODES}, st AS (SELECT user_id, image_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY elo, image_id) - 1 AS pos, COUNT(*) OVER (PARTITION BY user_id) AS n
FROM nodes WHERE matches >= 8 AND degree >= 4)
SELECT user_id, image_id FROM st WHERE n <= 7 OR pos IN (SELECT CAST(FLOOR(k * (n - 1) / 6.0 + 0.5) AS BIGINT) FROM range(7) t(k))""")
def _(i):
    return graph.quantile_anchors(pairs.pair_nodes(lib(i), i.comparisons))


@query("h8_anchor_bridges", f"""WITH {NODES}, st AS (SELECT user_id, image_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY elo, image_id) - 1 AS pos, COUNT(*) OVER (PARTITION BY user_id) AS n
FROM nodes WHERE matches >= 8 AND degree >= 4),
an AS (SELECT user_id, image_id FROM st WHERE n <= 7 OR pos IN (SELECT CAST(FLOOR(k * (n - 1) / 6.0 + 0.5) AS BIGINT) FROM range(7) t(k))),
fl AS (SELECT nodes.*, an.image_id IS NOT NULL AS anchor, (matches < 4 OR degree < 3) AS under FROM nodes LEFT JOIN an ON an.user_id = nodes.user_id AND an.image_id = nodes.image_id)
SELECT c.id, ((l.anchor AND r.under) OR (r.anchor AND l.under)) AS bridge FROM fx_comparisons c
JOIN fl l ON l.user_id = c.user_id AND l.image_id = c.left_id JOIN fl r ON r.user_id = c.user_id AND r.image_id = c.right_id""")
def _(i):
    nodes = pairs.pair_nodes(lib(i), i.comparisons)
    anchors = graph.quantile_anchors(nodes).withColumn("anchor", F.lit(True))
    flags = nodes.join(anchors, ["user_id", "image_id"], "left").select(
        "user_id", "image_id", F.coalesce("anchor", F.lit(False)).alias("anchor"), graph.under_compared().alias("under"))
    left = flags.select("user_id", F.col("image_id").alias("left_id"), F.col("anchor").alias("la"), F.col("under").alias("lu"))
    right = flags.select("user_id", F.col("image_id").alias("right_id"), F.col("anchor").alias("ra"), F.col("under").alias("ru"))
    joined = i.comparisons.join(left, ["user_id", "left_id"]).join(right, ["user_id", "right_id"])
    return joined.select("id", ((F.col("la") & F.col("ru")) | (F.col("ra") & F.col("lu"))).alias("bridge"))


LEADER = """SELECT user_id, image_id, CAST(point_rating AS INTEGER) AS point_rating, predicted_utility, elo, matches, rank FROM (
SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY point_rating DESC NULLS LAST, predicted_utility DESC NULLS LAST, elo DESC, matches DESC, image_id) AS rank
FROM lib WHERE point_rating IS NOT NULL OR matches > 0) WHERE rank <= 100"""


@query("f1_leaderboard", f"WITH {LIB} {LEADER}")
def leaderboard(i):
    return library.leaderboard(lib(i)).select("user_id", "image_id", "point_rating", "predicted_utility", "elo", big("matches").alias("matches"), "rank")


@query("f2_local_leaderboard", """SELECT user_id, image_id, elo, matches, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY elo DESC, matches DESC, image_id) AS rank
FROM fx_user_images WHERE matches > 0) WHERE rank <= 100""")
def _(i):
    return library.local_leaderboard(i.user_images).select("user_id", "image_id", "elo", big("matches").alias("matches"), "rank")


@query("c2_last_issued", """SELECT u.user_id, u.image_id, epoch_us(m.last) AS last_issued_us FROM fx_user_images u
LEFT JOIN (SELECT user_id, image_id, MAX(issued_at) AS last FROM fx_rating_issuances GROUP BY ALL) m ON m.user_id = u.user_id AND m.image_id = u.image_id""")
def _(i):
    last = library.last_issued(i.rating_issuances)
    return i.user_images.select("user_id", "image_id").join(last, ["user_id", "image_id"], "left").select(
        "user_id", "image_id", micros("last_issued_at").alias("last_issued_us"))


@query("f3_next_to_rate", f"""WITH {LIB}, last AS (SELECT user_id, image_id, MAX(issued_at) AS last_at FROM fx_rating_issuances GROUP BY ALL)
SELECT user_id, image_id FROM (SELECT lib.user_id, lib.image_id, ROW_NUMBER() OVER (PARTITION BY lib.user_id ORDER BY last_at ASC NULLS FIRST, discovered_day DESC, lib.image_id DESC) AS rn
FROM lib LEFT JOIN last ON last.user_id = lib.user_id AND last.image_id = lib.image_id WHERE point_rating IS NULL AND lib.image_id <> 29) WHERE rn = 1""")
def _(i):
    open_items = lib(i)
    excluded = open_items.filter("image_id = 29").select("user_id", "image_id")
    return library.next_to_rate(open_items, i.rating_issuances, excluded).select("user_id", "image_id")


POOL = f"""{NODES},
cov AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY matches, degree, {sha_sql(f"'{SEED}'", 'user_id', 'image_id')}, image_id) AS rn FROM nodes) WHERE rn <= 64),
st AS (SELECT user_id, image_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY elo, image_id) - 1 AS pos, COUNT(*) OVER (PARTITION BY user_id) AS n FROM nodes WHERE matches >= 8 AND degree >= 4),
an AS (SELECT user_id, image_id FROM st WHERE n <= 7 OR pos IN (SELECT CAST(FLOOR(k * (n - 1) / 6.0 + 0.5) AS BIGINT) FROM range(7) t(k))),
sel AS (SELECT user_id, image_id FROM cov UNION SELECT user_id, image_id FROM an),
spare AS (SELECT nodes.*, ROW_NUMBER() OVER (PARTITION BY nodes.user_id ORDER BY {sha_sql(f"'{SEED}x'", 'nodes.user_id', 'nodes.image_id')}) AS rn, (SELECT COUNT(*) FROM sel s WHERE s.user_id = nodes.user_id) AS taken
  FROM nodes WHERE NOT EXISTS (SELECT 1 FROM sel WHERE sel.user_id = nodes.user_id AND sel.image_id = nodes.image_id)),
pool AS (SELECT user_id, image_id, elo, matches, degree, predicted_utility FROM nodes WHERE EXISTS (SELECT 1 FROM sel WHERE sel.user_id = nodes.user_id AND sel.image_id = nodes.image_id)
  UNION ALL SELECT user_id, image_id, elo, matches, degree, predicted_utility FROM spare WHERE rn <= 96 - taken)"""


@query("f4_coverage_pool", f"WITH {POOL} SELECT user_id, image_id, rn AS position FROM cov")
def _(i):
    return pairs.coverage_pool(pairs.pair_nodes(lib(i), i.comparisons), SEED).select("user_id", "image_id", "position")


@query("f5_candidate_pool", f"WITH {POOL} SELECT user_id, image_id FROM pool")
def _(i):
    return pairs.candidate_pool(lib(i), i.comparisons, SEED).select("user_id", "image_id")


@query("c7_pool_pairs", f"WITH {POOL} SELECT a.user_id, COUNT(*) AS pairs, CAST(SUM(a.image_id * 7 + b.image_id) AS BIGINT) AS checksum FROM pool a JOIN pool b ON a.user_id = b.user_id AND a.image_id < b.image_id GROUP BY a.user_id")
def _(i):
    pool = pairs.candidate_pool(lib(i), i.comparisons, SEED)
    return pairs.pool_pairs(pool).groupBy("user_id").agg(
        F.count("*").alias("pairs"), F.sum(F.col("first_id") * 7 + F.col("second_id")).alias("checksum"))


RECENT = """recent AS (SELECT DISTINCT user_id, LEAST(left_id, right_id) AS first_id, GREATEST(left_id, right_id) AS second_id FROM
  (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY id DESC) AS rn FROM fx_comparisons) WHERE rn <= 100)"""
PAIRS = f"""{POOL}, {RECENT},
pst AS (SELECT user_id, image_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY elo, image_id) - 1 AS pos, COUNT(*) OVER (PARTITION BY user_id) AS n FROM pool WHERE matches >= 8 AND degree >= 4),
pan AS (SELECT user_id, image_id FROM pst WHERE n <= 7 OR pos IN (SELECT CAST(FLOOR(k * (n - 1) / 6.0 + 0.5) AS BIGINT) FROM range(7) t(k))),
fl AS (SELECT pool.*, EXISTS (SELECT 1 FROM pan WHERE pan.user_id = pool.user_id AND pan.image_id = pool.image_id) AS anchor, (matches < 4 OR degree < 3) AS under, 0.6/(1.0+matches)+0.4/(1.0+degree) AS need FROM pool),
sp AS (SELECT a.user_id, a.image_id AS first_id, b.image_id AS second_id, r.first_id IS NULL AS fresh, ((a.anchor AND b.under) OR (b.anchor AND a.under)) AS bridge,
   0.75*(a.need+b.need)/2.0 + 0.25/(1.0+COALESCE(p.pair_count,0)) AS coverage, a.predicted_utility AS ua, b.predicted_utility AS ub, a.elo AS ea, b.elo AS eb
  FROM fl a JOIN fl b ON a.user_id = b.user_id AND a.image_id < b.image_id
  LEFT JOIN pc p ON p.user_id = a.user_id AND p.first_id = a.image_id AND p.second_id = b.image_id
  LEFT JOIN recent r ON r.user_id = a.user_id AND r.first_id = a.image_id AND r.second_id = b.image_id),
sv AS (SELECT *, CASE WHEN ua IS NOT NULL AND ub IS NOT NULL THEN 0.7*(2*exp(-abs(ua-ub))/(1+exp(-abs(ua-ub)))) + 0.3*coverage ELSE 0.6*coverage + 0.4/(1.0+abs(ea-eb)/200.0) END
   + 1e-6*{coin_sql(f"'{SEED}n'", 'user_id', 'first_id', 'second_id')} AS v FROM sp)"""


@query("h5_coverage_score", f"WITH {PAIRS} SELECT user_id, first_id, second_id, ROUND(coverage, 6) + 0.0 AS coverage FROM sv")
def _(i):
    pool = pairs.candidate_pool(lib(i), i.comparisons, SEED)
    return pairs.scored_pairs(pool, i.comparisons, SEED).select("user_id", "first_id", "second_id", rounded("coverage").alias("coverage"))


@query("h6_pair_value", f"WITH {PAIRS} SELECT user_id, first_id, second_id, ROUND(v, 6) + 0.0 AS value FROM sv")
def _(i):
    pool = pairs.candidate_pool(lib(i), i.comparisons, SEED)
    return pairs.scored_pairs(pool, i.comparisons, SEED).select("user_id", "first_id", "second_id", rounded("value").alias("value"))


@query("c8_fresh_pairs", f"WITH {PAIRS} SELECT user_id, first_id, second_id FROM sv WHERE fresh")
def _(i):
    pool = pairs.candidate_pool(lib(i), i.comparisons, SEED)
    return pairs.fresh_pairs(pool, i.comparisons)


@query("f6_best_pair", f"WITH {PAIRS} SELECT user_id, first_id, second_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY v DESC, first_id, second_id) AS rn FROM sv) WHERE rn = 1")
def _(i):
    pool = pairs.candidate_pool(lib(i), i.comparisons, SEED)
    scored = pairs.scored_pairs(pool, i.comparisons, SEED)
    best = scored.groupBy("user_id").agg(F.max(F.struct("value", (-F.col("first_id")).alias("first"), (-F.col("second_id")).alias("second"))).alias("b"))
    return best.select("user_id", (-F.col("b.first")).alias("first_id"), (-F.col("b.second")).alias("second_id"))


@query("h7_next_pair", f"""WITH {PAIRS},
el AS (SELECT *, BOOL_OR(fresh) OVER (PARTITION BY user_id) AS anyfresh FROM sv),
el2 AS (SELECT *, BOOL_OR(bridge) OVER (PARTITION BY user_id) AS anybridge FROM el WHERE fresh OR NOT anyfresh),
pick AS (SELECT *, {coin_sql(f"'{SEED}c'", 'user_id')} < 0.12 AS explore, {coin_sql(f"'{SEED}b'", 'user_id')} < 0.4 AND anybridge AS bridged FROM el2),
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY CASE WHEN explore THEN {coin_sql(f"'{SEED}e'", 'user_id', 'first_id', 'second_id')} ELSE v END DESC, first_id, second_id) AS rn
  FROM pick WHERE explore OR NOT bridged OR bridge)
SELECT user_id, CASE WHEN {coin_sql(f"'{SEED}s'", 'user_id')} < 0.5 THEN first_id ELSE second_id END AS left_id,
 CASE WHEN {coin_sql(f"'{SEED}s'", 'user_id')} < 0.5 THEN second_id ELSE first_id END AS right_id FROM best WHERE rn = 1""")
def next_pair(i):
    return pairs.next_pairs(lib(i), i.comparisons, SEED)


LOCAL_PAIRS = PAIRS.replace("UNION SELECT user_id, image_id FROM an)", ")")


@query("h7_next_pair_local", f"""WITH {LOCAL_PAIRS}, el AS (SELECT *, BOOL_OR(fresh) OVER (PARTITION BY user_id) AS anyfresh, {coin_sql(f"'{SEED}c'", 'user_id')} < 0.12 AS explore FROM sv),
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY CASE WHEN explore THEN {coin_sql(f"'{SEED}e'", 'user_id', 'first_id', 'second_id')} ELSE v END DESC, first_id, second_id) AS rn FROM el WHERE fresh OR NOT anyfresh)
SELECT user_id, CASE WHEN {coin_sql(f"'{SEED}s'", 'user_id')} < 0.5 THEN first_id ELSE second_id END AS left_id,
 CASE WHEN {coin_sql(f"'{SEED}s'", 'user_id')} < 0.5 THEN second_id ELSE first_id END AS right_id FROM best WHERE rn = 1""")
def _(i):
    return pairs.next_pairs(lib(i), i.comparisons, SEED, with_anchors=False)


@query("h1_expected_and_k", """SELECT id, ROUND(1/(1+pow(10,(right_elo_before-left_elo_before)/400)), 9) + 0.0 AS expected_left,
ROUND(CASE WHEN left_matches % 13 = 0 THEN NULL ELSE GREATEST(16.0, 48.0/sqrt(1.0+left_matches/20.0)) END, 9) + 0.0 AS k FROM fx_elo_log""")
def _(i):
    matches = F.when(F.col("left_matches") % 13 != 0, F.col("left_matches"))
    return i.elo_log.select("id", rounded(expected_score(F.col("left_elo_before"), F.col("right_elo_before")), 9).alias("expected_left"),
                            rounded(adaptive_k(matches), 9).alias("k"))


@query("h2_elo_step", """WITH s AS (SELECT *, LEAST(GREATEST(16.0, 48.0/sqrt(1.0+left_matches/20.0)), GREATEST(16.0, 48.0/sqrt(1.0+right_matches/20.0)))
 * ((CASE WHEN winner_id = left_id THEN 1.0 ELSE 0.0 END) - 1/(1+pow(10,(right_elo_before-left_elo_before)/400))) AS d FROM fx_elo_log)
SELECT id, ROUND(left_elo_before + d, 6) + 0.0 AS left_elo_after, ROUND(right_elo_before - d, 6) + 0.0 AS right_elo_after, ROUND(ABS(d), 6) + 0.0 AS elo_delta FROM s""")
def _(i):
    rows = elo.elo_step(i.elo_log.drop("left_elo_after", "right_elo_after"))
    return rows.select("id", *[rounded(k).alias(k) for k in ("left_elo_after", "right_elo_after", "elo_delta")])


REPLAY = """WITH RECURSIVE ev AS (SELECT id, user_id, left_id, right_id, winner_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY id) AS n FROM fx_comparisons),
st AS (
  SELECT CAST(0 AS BIGINT) AS n, user_id, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS left_id, CAST(NULL AS BIGINT) AS right_id, CAST(NULL AS DOUBLE) AS lb, CAST(NULL AS DOUBLE) AS rb, CAST(NULL AS DOUBLE) AS d,
         CAST(MAP {} AS MAP(BIGINT, DOUBLE)) AS elo, CAST(MAP {} AS MAP(BIGINT, BIGINT)) AS cnt FROM (SELECT DISTINCT user_id FROM ev)
  UNION ALL
  SELECT n, user_id, id, left_id, right_id, lb, rb, d, map_concat(elo, MAP {left_id: lb + d, right_id: rb - d}), map_concat(cnt, MAP {left_id: lm + 1, right_id: rm + 1}) FROM (
    SELECT *, LEAST(GREATEST(16.0, 48.0/sqrt(1.0+lm/20.0)), GREATEST(16.0, 48.0/sqrt(1.0+rm/20.0))) * (CASE WHEN winner_id = left_id THEN 1.0 ELSE 0.0 END - 1/(1+pow(10,(rb-lb)/400))) AS d FROM (
      SELECT ev.n, ev.user_id, ev.id, ev.left_id, ev.right_id, ev.winner_id, st.elo, st.cnt, COALESCE(st.elo[ev.left_id], 1500.0::DOUBLE) AS lb, COALESCE(st.elo[ev.right_id], 1500.0::DOUBLE) AS rb,
             COALESCE(st.cnt[ev.left_id], 0) AS lm, COALESCE(st.cnt[ev.right_id], 0) AS rm FROM st JOIN ev ON ev.user_id = st.user_id AND ev.n = st.n + 1)))
"""


@query("h3_elo_replay", REPLAY + """SELECT id, ROUND(lb, 6) + 0.0 AS left_elo_before, ROUND(rb, 6) + 0.0 AS right_elo_before, ROUND(lb + d, 6) + 0.0 AS left_elo_after, ROUND(rb - d, 6) + 0.0 AS right_elo_after FROM st WHERE n > 0""")
def _(i):
    cols = ("left_elo_before", "right_elo_before", "left_elo_after", "right_elo_after")
    return elo.replay(i.comparisons).select("id", *[rounded(k).alias(k) for k in cols])


@query("h3_current_ratings", REPLAY + """SELECT user_id, image_id, ROUND(arg_max(after, id), 6) + 0.0 AS elo, COUNT(*) AS matches FROM (
SELECT user_id, id, left_id AS image_id, lb + d AS after FROM st WHERE n > 0 UNION ALL SELECT user_id, id, right_id, rb - d FROM st WHERE n > 0) GROUP BY ALL""")
def _(i):
    return elo.ratings_from(elo.replay(i.comparisons)).select("user_id", "image_id", rounded("elo").alias("elo"), "matches")


@query("e7_elo_chain_audit", """WITH s AS (SELECT id, user_id, left_id AS image_id, left_elo_before AS before, left_elo_after AS after FROM fx_elo_log
UNION ALL SELECT id, user_id, right_id, right_elo_before, right_elo_after FROM fx_elo_log),
l AS (SELECT *, LAG(after) OVER (PARTITION BY user_id, image_id ORDER BY id) AS previous_after FROM s)
SELECT id, user_id, image_id, before, previous_after FROM l WHERE previous_after IS NOT NULL AND abs(before - previous_after) > 1e-9""")
def _(i):
    return elo.chain_breaks(i.elo_log).select("id", "user_id", "image_id", "before", "previous_after")


@query("f12_recent_pairs", f"""SELECT user_id, id, LEAST(left_id, right_id) AS first_id, GREATEST(left_id, right_id) AS second_id FROM
(SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY id DESC) AS rn FROM fx_comparisons) WHERE rn <= {c.RECENT_PAIRS}""")
def _(i):
    return feedback.recent_pairs(i.comparisons)


@query("f12_recent_jobs", "SELECT user_id, id, position FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS position FROM fx_jobs) WHERE position <= 20")
def _(i):
    jobs = i.jobs.select("user_id", "id", "created_at")
    return top_per_key(jobs, ["user_id"], [F.col("created_at").desc(), F.col("id").desc()], 20).select("user_id", "id", "position")
