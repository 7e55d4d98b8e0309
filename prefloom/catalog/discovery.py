"""Candidate gate, selection and near-duplicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefloom import constants as c
from prefloom.catalog.registry import query, rounded
from prefloom.functions import rights, urls
from prefloom.functions.vectors import as_double, unit
from prefloom.operators import blur, candidates as cand, neardup

DAY = "2024-01-15"
MAX_BYTES = 40_000_000
_U = "'^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/:?#]*)(?::[0-9]*)?([^?#]*)'"


def host_sql(x: str) -> str:
    return f"lower(regexp_extract({x}, {_U}, 2))"


def path_sql(x: str) -> str:
    return f"lower(regexp_extract({x}, {_U}, 3))"


FREE = ", ".join(f"'{n}'" for n in c.FREE_LICENSES)
MATCH = f"""(license_url LIKE 'https://%' AND CASE WHEN starts_with(license, 'CC BY-SA ') THEN {host_sql('license_url')} = 'creativecommons.org' AND contains({path_sql('license_url')}, '/licenses/by-sa/')
 WHEN starts_with(license, 'CC BY ') THEN {host_sql('license_url')} = 'creativecommons.org' AND contains({path_sql('license_url')}, '/licenses/by/')
 WHEN license IN ('CC0','CC0 1.0','PDM 1.0','Public domain') THEN ({host_sql('license_url')} = 'creativecommons.org' AND contains({path_sql('license_url')}, '/publicdomain/')) OR ({host_sql('license_url')} = 'commons.wikimedia.org' AND starts_with({path_sql('license_url')}, '/wiki/public_domain'))
 WHEN starts_with(license, 'GFDL') THEN {host_sql('license_url')} IN ('gnu.org','www.gnu.org') AND contains({path_sql('license_url')}, '/copyleft/fdl')
 WHEN license IN ('FAL','Free Art License') THEN {host_sql('license_url')} IN ('artlibre.org','www.artlibre.org') ELSE FALSE END)"""
LICENSE_OK = f"({MATCH} OR (license_url = '' AND license = 'Public domain' AND license_identifier = 'pd' AND lower(copyrighted) = 'false' AND lower(usage_terms) = 'public domain'))"
# the view's links are normalised first, like provider records on arrival
CAND = "ca AS (SELECT * REPLACE (CASE WHEN license_url LIKE 'http://creativecommons.org/%' THEN 'https:' || substr(license_url, 6) ELSE license_url END AS license_url) FROM fx_candidates)"
REASON = f"""CASE WHEN LEAST(width, height) < 1200 OR width * height < 2500000 THEN 'insufficient resolution' WHEN mime NOT IN ('image/jpeg','image/png','image/webp') THEN 'unsupported media type'
 WHEN NOT (source_url LIKE 'https://upload.wikimedia.org/%') THEN 'invalid original-file provenance' WHEN NOT (page_url LIKE 'https://commons.wikimedia.org/%') THEN 'missing Commons description page'
 WHEN provider_sha1 = '' THEN 'missing Commons identifiers' WHEN title = '' OR creator = '' THEN 'missing title or creator attribution' WHEN lower(non_free) IN ('1','true','yes') THEN 'non-free work'
 WHEN license NOT IN ({FREE}) THEN 'license is not allowlisted' WHEN NOT {LICENSE_OK} THEN 'license URL does not match license' END"""
THUMB = """CASE WHEN NOT (thumbnail_url LIKE 'https://upload.wikimedia.org/%') THEN 'invalid thumbnail provenance' WHEN NOT (LEAST(thumbnail_width, thumbnail_height) >= 1 AND GREATEST(thumbnail_width, thumbnail_height) <= 512 AND thumbnail_width <= width AND thumbnail_height <= height) THEN 'invalid thumbnail dimensions' END"""
SIZE = f"""CASE WHEN TRY_CAST(bytes AS BIGINT) IS NULL THEN 'invalid source metadata' WHEN TRY_CAST(bytes AS BIGINT) < 1 THEN 'invalid file size' WHEN TRY_CAST(bytes AS BIGINT) > {MAX_BYTES} THEN 'file exceeds byte cap' END"""
GATED = f"{CAND}, ga AS (SELECT *, COALESCE({REASON}, {THUMB}, {SIZE}) AS reason FROM ca)"


def candidates(i):
    return i.candidates.withColumn("license_url", urls.normalized_url(F.col("license_url")))


def gated(i):
    return candidates(i).withColumn("reason", cand.gate_reason(MAX_BYTES))


@query("b1_rejection_reason", f"WITH {CAND} SELECT candidate_id, {REASON} AS reason FROM ca")
def rejection(i):
    return candidates(i).select("candidate_id", rights.rejection_reason().alias("reason"))


@query("b2_license_gate", f"WITH {CAND} SELECT candidate_id, license IN ({FREE}) AS allowlisted, {LICENSE_OK} AS link_ok FROM ca")
def _(i):
    return candidates(i).select("candidate_id", F.col("license").isin(*c.FREE_LICENSES).alias("allowlisted"), rights.license_ok().alias("link_ok"))


@query("b3_thumbnail_gate", f"SELECT candidate_id, {THUMB} AS reason FROM fx_candidates")
def _(i):
    return i.candidates.select("candidate_id", rights.thumbnail_reason().alias("reason"))


@query("b4_source_size_gate", f"SELECT candidate_id, {SIZE} AS reason FROM fx_candidates")
def _(i):
    return i.candidates.select("candidate_id", rights.source_size_reason(MAX_BYTES).alias("reason"))


@query("b5_download_agreement", """WITH m AS (SELECT *, width + CASE WHEN candidate_id % 12 = 0 THEN 1 ELSE 0 END AS mw, CASE WHEN candidate_id % 10 = 0 THEN 'png' ELSE 'jpeg' END AS mf, height AS tw, CAST(width * (1 + candidate_id % 4 / 100.0E0) AS DOUBLE) AS th FROM fx_candidates)
SELECT candidate_id, CASE WHEN mw <> width THEN 'downloaded dimensions differ from source metadata' WHEN mf <> split_part(mime, '/', 2) THEN 'downloaded format differs from source metadata'
WHEN abs(mw / height - th / tw) > 0.02 * GREATEST(abs(mw / height), abs(th / tw)) THEN 'thumbnail aspect ratio differs from Commons metadata' END AS reason FROM m""")
def _(i):
    k = F.col("candidate_id")
    rows = i.candidates.withColumn("measured_width", F.col("width") + F.when(k % 12 == 0, 1).otherwise(0)).withColumn("measured_height", F.col("height"))
    rows = rows.withColumn("measured_format", F.when(k % 10 == 0, "png").otherwise("jpeg"))
    rows = rows.withColumn("thumbnail_width", F.col("width") * (F.lit(1.0) + (k % 4) / F.lit(100.0))).withColumn("thumbnail_height", F.col("height"))
    return rows.select("candidate_id", rights.download_mismatch().alias("reason"))


@query("b8_url_normalisation", """SELECT page_id, CASE WHEN starts_with(trim(u), '//') THEN 'https:' || trim(u) WHEN u LIKE 'http://creativecommons.org/%' THEN 'https:' || substr(u, 6) ELSE trim(u) END AS url,
CASE WHEN trim(k) = '' THEN NULL WHEN starts_with(lower(trim(k)), 'category:') THEN trim(k) ELSE 'Category:' || trim(k) END AS category FROM (
SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(url, 'http:', '') WHEN 2 THEN 'http://creativecommons.org/x?' || url ELSE ' ' || url END AS u,
regexp_replace(CASE page_id % 3 WHEN 0 THEN '  ' WHEN 1 THEN 'category:' || CAST(page_id AS VARCHAR) || '  a ' ELSE ' birds   of ' || CAST(page_id AS VARCHAR) END, '\\s+', ' ', 'g') AS k FROM pages)""")
def _(i):
    k = F.col("page_id")
    url = (F.when(k % 4 == 0, F.col("url")).when(k % 4 == 1, F.replace(F.col("url"), F.lit("http:"), F.lit("")))
           .when(k % 4 == 2, F.concat(F.lit("http://creativecommons.org/x?"), "url")).otherwise(F.concat(F.lit(" "), "url")))
    category = (F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.concat(F.lit("category:"), k.cast("string"), F.lit("  a ")))
                .otherwise(F.concat(F.lit(" birds   of "), k.cast("string"))))
    return i.table("pages").select("page_id", urls.normalized_url(url).alias("url"), urls.normalized_category(category).alias("category"))


@query("b11_rejection_histogram", f"WITH {GATED} SELECT reason, COUNT(*) AS rejected FROM ga WHERE reason IS NOT NULL GROUP BY reason")
def _(i):
    return cand.rejection_histogram(gated(i))


PROV = "pv AS (SELECT u.user_id, x.source_url, x.page_url FROM fx_user_images u JOIN fx_images x ON x.image_id = u.image_id)"
UNSEEN = f"""{PROV}, us AS (SELECT * FROM fx_candidates k WHERE NOT EXISTS (SELECT 1 FROM pv WHERE pv.user_id = k.user_id AND pv.source_url = k.source_url) AND NOT EXISTS (SELECT 1 FROM pv WHERE pv.user_id = k.user_id AND pv.page_url = k.page_url AND k.page_url <> ''))"""


def unseen(i):
    provenance = i.user_images.select("user_id", "image_id").join(i.images.select("image_id", "source_url", "page_url"), "image_id")
    return cand.unseen(i.candidates, provenance)


@query("c9_not_in_library", f"WITH {UNSEEN} SELECT candidate_id FROM us")
def _(i):
    return unseen(i).select("candidate_id")


@query("c9_first_seen_in_run", """WITH RECURSIVE kc AS MATERIALIZED (SELECT candidate_id, run_id, list_filter(['s:' || source_url, CASE WHEN page_url <> '' THEN 'p:' || page_url END, CASE WHEN provider_sha1 <> '' THEN 'd:' || provider_sha1 END], lambda x: x IS NOT NULL) AS ks,
 ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY discovery_index) AS n FROM (SELECT * REPLACE (candidate_id // 200 AS run_id, 'https://upload.wikimedia.org/' || CAST((p * 7) % 90 AS VARCHAR) AS source_url) FROM (SELECT *, candidate_id % 1000 AS p FROM fx_candidates))),
st AS (SELECT run_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS candidate_id, FALSE AS kept, CAST([] AS VARCHAR[]) AS seen FROM (SELECT DISTINCT run_id FROM kc)
UNION ALL SELECT st.run_id, kc.n, kc.candidate_id, NOT list_has_any(st.seen, kc.ks), CASE WHEN list_has_any(st.seen, kc.ks) THEN st.seen ELSE list_concat(st.seen, kc.ks) END FROM st JOIN kc ON kc.run_id = st.run_id AND kc.n = st.n + 1)
SELECT candidate_id FROM st WHERE kept""")
def _(i):
    # links repeat inside a run, so that chains of conflicts occur
    link = F.concat(F.lit("https://upload.wikimedia.org/"), ((F.col("candidate_id") % 1000) * 7 % 90).cast("string"))
    rows = i.candidates.withColumn("source_url", link)
    return cand.first_seen(rows, ["run_id"], "discovery_index", ["source_url", "page_url", "provider_sha1"]).select("candidate_id")


@query("c18_content_lookup", """WITH s AS (SELECT candidate_id, user_id, sha256(CAST(candidate_id % 700 AS VARCHAR)) AS sha FROM fx_candidates)
SELECT s.candidate_id, x.image_id AS existing_id, u.image_id IS NOT NULL AS already_linked, COALESCE(x.image_id % 3 <> 0, FALSE) AS has_embedding FROM s LEFT JOIN fx_images x ON x.sha256 = s.sha
LEFT JOIN fx_user_images u ON u.user_id = s.user_id AND u.image_id = x.image_id""")
def _(i):
    staged = i.candidates.select("candidate_id", "user_id", F.sha2((F.col("candidate_id") % 700).cast("string"), 256).alias("sha256"))
    stored = i.images.filter("image_id % 3 <> 0").select("image_id")
    return cand.content_lookup(staged, i.images, i.user_images, stored).select("candidate_id", "existing_id", "already_linked", "has_embedding")


@query("c19_manifest_reconciliation", """WITH l AS (SELECT image_id, 'images/' || sha256 || '/original.jpg' AS path, width * 10 AS bytes, sha256, width, height FROM fx_images),
o AS (SELECT path AS opath, bytes + CASE WHEN image_id % 9 = 0 THEN 1 ELSE 0 END AS ob, CASE WHEN image_id % 10 = 0 THEN 'x' ELSE sha256 END AS os, width + CASE WHEN image_id % 11 = 0 THEN 1 ELSE 0 END AS ow FROM l WHERE image_id % 8 <> 0)
SELECT image_id, CASE WHEN opath IS NULL THEN 'missing' WHEN ob <> bytes THEN 'size-mismatch' WHEN os <> sha256 THEN 'digest-mismatch' WHEN ow <> width THEN 'dimension-mismatch' ELSE 'present' END AS status FROM l LEFT JOIN o ON o.opath = l.path""")
def _(i):
    from prefloom.functions.hashing import image_path

    k = F.col("image_id")
    rows = i.images.select("image_id", image_path(F.col("sha256"), F.lit("jpg")).alias("path"), (F.col("width") * 10).alias("bytes"), "sha256", "width", "height")
    listing = rows.filter(k % 8 != 0).select(
        "path", (F.col("bytes") + F.when(k % 9 == 0, 1).otherwise(0)).alias("object_bytes"), F.when(k % 10 == 0, "x").otherwise(F.col("sha256")).alias("object_sha256"),
        (F.col("width") + F.when(k % 11 == 0, 1).otherwise(0)).alias("object_width"), F.col("height").alias("object_height"))
    return cand.reconcile(rows, listing).select("image_id", "status")


@query("f7_ranked_candidates", "SELECT candidate_id, run_id, rank FROM (SELECT candidate_id, run_id, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY score DESC, discovery_index) AS rank FROM fx_candidates) WHERE rank <= 50")
def _(i):
    from prefloom.operators.ordered import top_per_key

    return top_per_key(i.candidates, ["run_id"], cand.rank_order(), 50, "rank").select("candidate_id", "run_id", "rank")


@query("f8_one_finalist_per_action", "SELECT run_id, action_id, candidate_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id, action_id ORDER BY score DESC, discovery_index) AS rn FROM fx_candidates) WHERE rn = 1")
def _(i):
    return cand.one_per_action(i.candidates, cand.rank_order()).select("run_id", "action_id", "candidate_id")


KEY = f"sha256(user_id || ':{DAY}:' || CASE WHEN provider_sha1 <> '' THEN provider_sha1 WHEN source_url <> '' THEN source_url ELSE CAST(discovery_index AS VARCHAR) END)"
DIST = f"di AS (SELECT *, {KEY} AS k, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY score DESC, discovery_index) AS pos, COUNT(*) OVER (PARTITION BY run_id) AS n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id, action_id ORDER BY score DESC, discovery_index) AS rn FROM fx_candidates) WHERE rn = 1)"


@query("f9_selected_candidates", f"""WITH {DIST}, q AS (SELECT *, LEAST(n, 2) AS ex, GREATEST(0, LEAST(8, n) - LEAST(n, 2)) AS et FROM di),
re AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY k, score DESC, discovery_index) AS turn FROM q WHERE pos > et)
SELECT candidate_id, run_id, 'taste' AS mode FROM q WHERE pos <= et UNION ALL SELECT candidate_id, run_id, 'exploration' FROM re WHERE turn <= ex""")
def _(i):
    return cand.select_candidates(i.candidates, 8, DAY).select("candidate_id", "run_id", "mode")


@query("f9_curated_candidates", "SELECT candidate_id, run_id, 'curated' AS mode FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY discovery_index) AS p FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id, action_id ORDER BY discovery_index) AS rn FROM fx_candidates) WHERE rn = 1) WHERE p <= 5")
def _(i):
    return cand.select_candidates(i.candidates, 5, DAY, with_model=False).select("candidate_id", "run_id", "mode")


@query("f10_admitted_candidates", f"""WITH g AS (SELECT run_id, COUNT(DISTINCT action_id) AS n FROM fx_candidates GROUP BY run_id),
gd AS (SELECT *, LEAST(8, n) AS desired, LEAST(LEAST(8, n), 2) AS ex FROM g),
fs AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY score DESC, discovery_index) AS pos FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id, action_id ORDER BY score DESC, discovery_index) AS rn FROM fx_candidates WHERE ok) WHERE rn = 1),
ta AS (SELECT fs.* FROM fs JOIN gd USING (run_id) WHERE pos <= desired - ex),
xs AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id, action_id ORDER BY k, score DESC, discovery_index) AS rn FROM (SELECT *, {KEY} AS k FROM fx_candidates WHERE ok)) WHERE rn = 1),
xr AS (SELECT xs.*, ROW_NUMBER() OVER (PARTITION BY xs.run_id ORDER BY k, score DESC, discovery_index) AS turn FROM xs WHERE NOT EXISTS (SELECT 1 FROM ta WHERE ta.run_id = xs.run_id AND ta.action_id = xs.action_id))
SELECT candidate_id, run_id, 'taste' AS mode FROM ta UNION ALL SELECT xr.candidate_id, xr.run_id, 'exploration' FROM xr JOIN gd USING (run_id) WHERE turn <= ex""")
def _(i):
    return cand.admit(i.candidates, 8, DAY).select("candidate_id", "run_id", "mode")


@query("f11_round_robin", """WITH t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_category ORDER BY discovery_index) AS turn, CASE WHEN provider_sha1 <> '' THEN provider_sha1 WHEN source_url <> '' THEN source_url ELSE CAST(discovery_index AS VARCHAR) END AS ident FROM fx_candidates),
f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ident ORDER BY turn, source_category) AS rn FROM t) SELECT candidate_id, source_category, turn FROM f WHERE rn = 1 ORDER BY turn, source_category LIMIT 300""")
def _(i):
    return cand.round_robin(i.candidates, 300).select("candidate_id", "source_category", "turn")


@query("f14_scoring_pool", "SELECT candidate_id, run_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY discovery_index) AS p FROM fx_candidates) WHERE p <= 60")
def _(i):
    return cand.scoring_pool(i.candidates, 3, 1000, with_model=False).select("candidate_id", "run_id")


@query("f14_local_pool", f"""WITH {GATED}, s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY discovery_index) AS p FROM ga),
e AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY discovery_index) AS q FROM s WHERE p <= 120 AND reason IS NULL) SELECT candidate_id, run_id FROM e WHERE q <= 12""")
def _(i):
    return cand.local_pool(gated(i), 4, True, F.col("reason").isNull()).select("candidate_id", "run_id")


SIZED = "sz AS (SELECT *, COALESCE(TRY_CAST(bytes AS BIGINT), 0) AS size FROM fx_candidates)"


def sized(i):
    return i.candidates.withColumn("size", F.coalesce(F.col("bytes").try_cast("bigint"), F.lit(0)))


@query("e8_byte_budget", f"WITH {SIZED} SELECT candidate_id, CAST(SUM(size) OVER (PARTITION BY run_id ORDER BY discovery_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used_bytes, SUM(size) OVER (PARTITION BY run_id ORDER BY discovery_index ROWS UNBOUNDED PRECEDING) <= 300000000 AS admitted FROM sz")
def _(i):
    return cand.byte_budget(sized(i), 300_000_000).select("candidate_id", "used_bytes", "admitted")


@query("e8_byte_budget_skipping", f"""WITH RECURSIVE {SIZED}, o AS (SELECT run_id, candidate_id, size, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY discovery_index) AS n FROM sz),
st AS (SELECT run_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS candidate_id, FALSE AS fits, CAST(0 AS BIGINT) AS used FROM (SELECT DISTINCT run_id FROM o)
UNION ALL SELECT st.run_id, o.n, o.candidate_id, st.used + o.size <= 300000000, CASE WHEN st.used + o.size <= 300000000 THEN st.used + o.size ELSE st.used END FROM st JOIN o ON o.run_id = st.run_id AND o.n = st.n + 1)
SELECT run_id, candidate_id AS discovery_index FROM st WHERE fits""")
def _(i):
    return cand.byte_budget_skipping(sized(i), 300_000_000)


@query("e9_pool_cap", f"WITH {GATED} SELECT candidate_id, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY discovery_index) > 20 AS censored FROM ga WHERE reason IS NULL")
def _(i):
    return cand.pool_cap(gated(i).filter(F.col("reason").isNull()), 20).select("candidate_id", "censored")


@query("e9_censored_actions", f"WITH {GATED}, p AS (SELECT action_id, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY discovery_index) > 20 AS censored FROM ga WHERE reason IS NULL) SELECT action_id, BOOL_OR(censored) AS censored FROM p GROUP BY action_id")
def _(i):
    capped = cand.pool_cap(gated(i).filter(F.col("reason").isNull()), 20)
    return capped.groupBy("action_id").agg(F.bool_or("censored").alias("censored"))


@query("d11_action_diagnostics", f"WITH {GATED} SELECT action_id, COUNT(*) AS candidates_seen, COUNT(*) FILTER (WHERE reason IS NULL) AS candidates_eligible, ROUND(MAX(CASE WHEN reason IS NULL THEN 1 / (1 + exp(-score)) END), 9) + 0.0 AS proxy_reward FROM ga GROUP BY action_id")
def _(i):
    out = cand.action_diagnostics(gated(i).withColumn("eligible", F.col("reason").isNull()))
    return out.withColumn("proxy_reward", rounded("proxy_reward", 9))


@query("d14_run_summary", f"""WITH {GATED}, s AS (SELECT *, CASE WHEN reason IS NULL AND candidate_id % 3 = 0 THEN CASE WHEN candidate_id % 2 = 0 THEN 'taste' ELSE 'exploration' END END AS mode FROM ga)
SELECT run_id, COUNT(*) AS scanned, COUNT(*) FILTER (WHERE reason IS NULL) AS eligible, COUNT(*) FILTER (WHERE candidate_id % 10 = 0) AS near_duplicates, COUNT(mode) AS imported, COUNT(*) FILTER (WHERE mode = 'exploration') AS exploration_selected,
COUNT(DISTINCT action_id) AS actions_recorded, GREATEST(0, 40 - COUNT(mode)) AS shortfall FROM s GROUP BY run_id""")
def _(i):
    k = F.col("candidate_id")
    mode = F.when(F.col("reason").isNull() & (k % 3 == 0), F.when(k % 2 == 0, "taste").otherwise("exploration"))
    return cand.run_summary(gated(i).withColumn("mode", mode).withColumn("near_duplicate", k % 10 == 0), 40)


# -- vectors ------------------------------------------------------------------
VEC = "ve AS MATERIALIZED (SELECT v.image_id AS id, x.label, list(v ORDER BY pos) AS vec FROM fx_vectors v JOIN fx_images x ON x.image_id = v.image_id % 1000000 GROUP BY ALL)"


def vectors(i):
    """Unit vectors of all items plus shifted and exact copies (ids above one million)."""
    k = F.col("image_id")
    copies = F.array_compact(F.array(
        F.struct(F.lit(0).alias("offset"), F.lit(0.0).alias("shift")),
        F.when(k % 10 == 0, F.struct(F.lit(1_000_000).alias("offset"), F.lit(0.03).alias("shift"))),
        F.when(k % 20 == 0, F.struct(F.lit(2_000_000).alias("offset"), F.lit(0.05).alias("shift"))),
        F.when(k % 25 == 0, F.struct(F.lit(3_000_000).alias("offset"), F.lit(0.0).alias("shift"))),
    ))
    rows = i.images.select("image_id", "label", as_double(F.col("embedding")).alias("e"), F.explode(copies).alias("copy"))
    shifted = F.transform("e", lambda x, n: F.when(n == 0, x + F.col("copy.shift")).otherwise(x))
    return rows.select((k + F.col("copy.offset")).alias("id"), "label", unit(shifted).alias("vector"))


GRID = neardup.Grid(dimensions=64)


@query("c10_near_library", f"WITH {VEC} SELECT c.label, c.id FROM ve c WHERE c.id >= 1000000 AND EXISTS (SELECT 1 FROM ve l WHERE l.id < 1000000 AND l.label = c.label AND list_dot_product(l.vec, c.vec) >= 0.995)")
def near_library(i):
    rows = vectors(i)
    return neardup.near_library(rows.filter("id >= 1000000"), rows.filter("id < 1000000"), ["label"], GRID)


@query("c11_greedy_distinct", f"""WITH RECURSIVE {VEC}, rk AS MATERIALIZED (SELECT *, (id * 7919) % 10000019 AS rank, ROW_NUMBER() OVER (PARTITION BY label ORDER BY (id * 7919) % 10000019) AS n FROM ve),
ed AS MATERIALIZED (SELECT a.label, a.n, list(b.n) AS nb FROM rk a JOIN rk b ON a.label = b.label AND b.n < a.n AND list_dot_product(a.vec, b.vec) >= 0.995 GROUP BY ALL),
tn AS MATERIALIZED (SELECT rk.label, rk.n, rk.rank, COALESCE(ed.nb, []) AS nb FROM rk LEFT JOIN ed ON ed.label = rk.label AND ed.n = rk.n),
st AS (SELECT label, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS rank, FALSE AS kept, CAST([] AS BIGINT[]) AS acc FROM (SELECT DISTINCT label FROM rk)
UNION ALL SELECT st.label, tn.n, tn.rank, NOT list_has_any(st.acc, tn.nb), CASE WHEN list_has_any(st.acc, tn.nb) THEN st.acc ELSE list_append(st.acc, tn.n) END FROM st JOIN tn ON tn.label = st.label AND tn.n = st.n + 1)
SELECT label, rank FROM st WHERE kept""")
def greedy(i):
    ranked = vectors(i).withColumn("rank", F.col("id") * 7919 % 10000019)
    return neardup.greedy_distinct(ranked, ["label"], GRID)


@query("b6_edge_energy", """WITH p AS (SELECT image_id, pos % 8 AS x, CAST(FLOOR(pos / 8.0) AS INT) AS y, CAST(FLOOR((v + 1) * 127.5) AS INT) AS v FROM fx_long),
s AS (SELECT *, LAG(v) OVER (PARTITION BY image_id, y ORDER BY x) AS l, LEAD(v) OVER (PARTITION BY image_id, y ORDER BY x) AS r, LAG(v) OVER (PARTITION BY image_id, x ORDER BY y) AS u, LEAD(v) OVER (PARTITION BY image_id, x ORDER BY y) AS d FROM p),
e AS (SELECT image_id, sqrt(AVG(CAST(4*v-l-r-u-d AS DOUBLE) * (4*v-l-r-u-d))) AS e FROM s WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 GROUP BY image_id)
SELECT image_id, ROUND(e, 6) + 0.0 AS energy, CASE WHEN e < 0.75 THEN 'severely blurry or blank' END AS reason FROM e""")
def _(i):
    luma = F.transform(as_double(F.col("embedding")), lambda x: F.floor((x + 1) * 127.5).cast("int"))
    rows = i.images.select("image_id", luma.alias("luma"))
    energy = blur.edge_energy(F.col("luma"), F.lit(8), F.lit(8))
    return rows.select("image_id", rounded(energy).alias("energy"), blur.blur_reason(energy).alias("reason"))
