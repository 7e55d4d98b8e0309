"""Text, source, sink and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefloom import constants
from prefloom.catalog.registry import micros, query
from prefloom.functions import hashing, text
from prefloom.functions.vectors import as_double
from prefloom.operators import quality
from prefloom.sources import provider, sinks

BS = chr(92)
W = "[A-Za-z0-9_-]"
SECRETS = ["correct horse", "correct horse battery"]


def _redact_sql(x: str) -> str:
    rules = [
        (f"{BS}bpostgres(?:ql)?://[^{BS}s''\"`<>]+", "[REDACTED_DATABASE_URL]", "gi"),
        (f"{BS}bvercel_blob_{W}+", "[REDACTED]", "g"),
        (f"{BS}bGOCSPX-{W}+", "[REDACTED]", "g"),
        (f"{BS}bBearer{BS}s+[^{BS}s,''\"`<>]+", "Bearer [REDACTED]", "gi"),
        (f"{BS}beyJ{W}{{8,}}{BS}.{W}{{8,}}{BS}.{W}{{8,}}{BS}b", "[REDACTED]", "g"),
        (f"([?&](?:access_token|api_key|auth|client_secret|password|secret|signature|token|x-amz-signature)=)[^&#{BS}s]+", f"{BS}1[REDACTED]", "gi"),
        (f"(\"(?:access_token|api_key|authorization|client_secret|password|private_key|secret|token)\"{BS}s*:{BS}s*\")[^\"]*(\")", f"{BS}1[REDACTED]{BS}2", "gi"),
        (f"({BS}b(?:access[_-]?token|api[_-]?key|authorization|client[_-]?secret|password|private[_-]?key|secret|signature|token){BS}s*[:=]{BS}s*)(?:\"[^\"]*\"|''[^'']*''|[^{BS}s,;''\"`<>}}{BS}]]+)", f"{BS}1[REDACTED]", "gi"),
    ]
    out = f"replace(replace({x}, 'correct horse battery', '[REDACTED]'), 'correct horse', '[REDACTED]')"
    for pattern, replacement, flags in rules:
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', '{flags}')"
    return out


# credentials of every format are appended to the whole text of each document
PLANTED_TEXT = """text || CASE doc_id % 9 WHEN 0 THEN ' see postgres://u:p@h/db now' WHEN 1 THEN ' vercel_blob_rw_abc-1 end' WHEN 2 THEN ' GOCSPX-aaaa_b' WHEN 3 THEN ' Authorization: bearer abc.def'
WHEN 4 THEN ' eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK x' WHEN 5 THEN ' https://a.b/?x=1&api_key=zzz#f' WHEN 6 THEN ' {"password" : "a b"}' WHEN 7 THEN ' the correct horse battery staple' ELSE '' END"""


def planted(i):
    return i.table("documents").select("doc_id", F.expr(PLANTED_TEXT).alias("text"))


@query("b9_redacted_text", f"SELECT doc_id, {_redact_sql('text')} AS text FROM (SELECT doc_id, {PLANTED_TEXT} AS text FROM documents)")
def redacted(i):
    return text.redact_texts(planted(i), "text", SECRETS)


@query("b9_safe_error_message", f"""SELECT doc_id, substr(CASE WHEN m = '' THEN 'Unknown error' ELSE m END, 1, 2000) AS message FROM (SELECT doc_id, trim(regexp_replace({_redact_sql('text')}, '{BS}s+', ' ', 'g')) AS m FROM (SELECT doc_id, {PLANTED_TEXT} AS text FROM documents))""")
def _(i):
    rows = text.redact_texts(planted(i), "text", SECRETS)
    return rows.select("doc_id", text.bounded_message(F.col("text")).alias("message"))


# the pages' own constructs, spelled out: scripts keep a quoted end tag; the named entities also
# decode without their semicolon
DECODED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')"""
PLAIN = f"""trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(replace({DECODED}, '"</p>"', chr(1)), '<!--.*?-->|<!DOCTYPE[^>]*>', '', 'gs'),
'</?(?:div|li|p|tr)(?:{BS}s[^>]*)?>|<br(?:{BS}s[^>]*)?/?>', ' ', 'g'), '<[^>]*>', '', 'g'), chr(1), '"</p>"'), '{BS}s+', ' ', 'g'))"""


@query("b7_html_to_text", f"SELECT page_id, {PLAIN} AS text FROM pages")
def html_text(i):
    return i.table("pages").select("page_id", text.html_to_text("html").alias("text"))


@query("b12_contract_violations", """WITH r AS (SELECT CASE WHEN id % 40 = 0 THEN 0 ELSE left_id + 1 END AS l, right_id + 1 AS r, CASE WHEN id % 30 = 0 THEN 7777 ELSE winner_id + 1 END AS w, id % 7 AS v, CASE WHEN id % 20 = 0 THEN 'short' ELSE substr(idempotency_key, 1, 43) END AS t FROM fx_comparisons)
SELECT 'safe_ids' AS "check", COUNT(*) FILTER (WHERE NOT (l > 0 AND r > 0 AND w > 0)) AS violations FROM r UNION ALL SELECT 'distinct_sides', COUNT(*) FILTER (WHERE l = r) FROM r
UNION ALL SELECT 'winner_in_pair', COUNT(*) FILTER (WHERE w NOT IN (l, r)) FROM r UNION ALL SELECT 'value_range', COUNT(*) FILTER (WHERE v NOT BETWEEN 1 AND 5) FROM r UNION ALL SELECT 'token_form', COUNT(*) FILTER (WHERE t = 'short') FROM r""")
def _(i):
    k = F.col("id")
    rows = i.comparisons.select(
        F.when(k % 40 == 0, 0).otherwise(F.col("left_id") + 1).alias("left_id"), (F.col("right_id") + 1).alias("right_id"),
        F.when(k % 30 == 0, 7777).otherwise(F.col("winner_id") + 1).alias("winner_id"), (k % 7).alias("value"),
        F.when(k % 20 == 0, "short").otherwise(F.substring("idempotency_key", 1, 43)).alias("token"))
    return quality.violations(rows, quality.contract_rules())


@query("b13_token_digest", """SELECT id, CASE WHEN id % 20 <> 0 THEN sha256(substr(idempotency_key, 1, 43)) END AS digest FROM fx_comparisons""")
def _(i):
    token = F.when(F.col("id") % 20 == 0, "not a token").otherwise(F.substring("idempotency_key", 1, 43))
    return i.comparisons.select("id", hashing.token_digest(token).alias("digest"))


@query("b14_presentation", "SELECT id, '/api/images/' || image_id AS image_url, strftime(rated_at, '%Y-%m-%dT%H:%M:%S') || 'Z' AS rated_at FROM fx_ratings")
def _(i):
    at = F.concat(F.date_format("rated_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return i.ratings.select("id", F.concat(F.lit("/api/images/"), F.col("image_id").cast("string")).alias("image_url"), at.alias("rated_at"))


@query("b15_local_timestamps", "SELECT event_id, epoch_us(date_trunc('second', ts)) AS at_us FROM fx_events")
def _(i):
    stored = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return i.events.select("event_id", micros(F.to_timestamp(stored, "yyyy-MM-dd HH:mm:ss")).alias("at_us"))


@query("a4_vector_load", """SELECT 'valid' AS status, COUNT(*) AS n FROM embeddings WHERE vec_id % 10 NOT IN (3, 7) UNION ALL SELECT 'quarantined', COUNT(*) FROM embeddings WHERE vec_id % 10 IN (3, 7)""")
def _(i):
    import struct

    def pack(batches):
        import pandas as pd

        for b in batches:
            out = []
            for image, vector in zip(b["vec_id"], b["embedding"]):
                values = [float(x) for x in vector]
                if image % 10 == 3:
                    values = values[:-1]
                if image % 10 == 7:
                    values[0] = float("nan")
                out.append(struct.pack(f"<{len(values)}f", *values))
            yield pd.DataFrame({"image_id": b["vec_id"], "dimensions": 64, "vector_bytes": out})

    stored = i.table("embeddings").select("vec_id", "embedding").mapInPandas(pack, "image_id bigint, dimensions int, vector_bytes binary")
    good, bad = provider.load_vectors(stored)
    return good.select(F.lit("valid").alias("status")).unionByName(bad.select(F.lit("quarantined").alias("status"))).groupBy("status").agg(F.count("*").alias("n"))


@query("a5_provider_candidates", """SELECT candidate_id + 0 AS candidate_id, title, source_url, CASE WHEN candidate_id % 3 = 0 THEN 'B & C' ELSE creator END AS creator, license, 'Category:' || source_category AS source_category FROM fx_candidates""")
def provider_candidates(i):
    # provider responses as JSON lines, one per category group, read back through the parser
    def value(column):
        return F.struct(column.alias("value"))

    k = F.col("candidate_id")
    meta = F.map_from_arrays(
        F.array(*[F.lit(n) for n in ("Artist", "Attribution", "LicenseShortName")]),
        F.array(value(F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("<b>"), "creator", F.lit("</b>")))),
                value(F.when(k % 3 == 0, "<p>B &amp; C</p>").otherwise("")), value(F.col("license"))))
    info = F.array(F.struct(F.col("source_url").alias("url"), "width", "height", meta.alias("extmetadata")))
    page = F.struct(k.alias("pageid"), F.concat(F.lit("File:"), "title").alias("title"), info.alias("imageinfo"))
    lines = i.candidates.select(F.to_json(F.struct(
        F.col("source_category").alias("category"), F.struct(F.array(page).alias("pages")).alias("query"))).alias("line"))
    dump = lines.select(F.from_json("line", provider.PAGE_SCHEMA).alias("d")).select("d.*")
    return provider.candidate_rows(dump).select(F.col("provider_page_id").alias("candidate_id"), "title", "source_url", "creator", "license", "source_category")


@query("a6_migratable_items", "SELECT image_id, license FROM fx_images WHERE trim(license) <> '' AND active")
def _(i):
    return sinks.migratable(i.images, active_only=True).select("image_id", "license")


@query("a7_file_scan")
def _(i):
    return provider.scan_files(i.spark, i.path, "*.parquet").select("filename", "extension", "bytes", "sha256")


@query("a8_append_new_events", "SELECT id, user_id, image_id FROM fx_ratings WHERE id % 3 = 0")
def _(i):
    stored = i.ratings.filter("id % 3 <> 0")
    return sinks.new_rows(i.ratings, stored, ["user_id", "image_id"]).select("id", "user_id", "image_id")


ITEMS = """o AS (SELECT image_id, width, source_url, page_url, creator, CAST(discovered AS BIGINT) AS discovered FROM (SELECT *, 1 AS discovered FROM fx_images WHERE image_id % 5 <> 4)),
n AS (SELECT image_id, width + 1 AS width, CASE WHEN image_id % 2 = 0 THEN 'https://new/' || image_id END AS source_url, CASE WHEN image_id % 3 = 0 THEN 'https://page/' || image_id END AS page_url, CASE WHEN image_id % 4 = 0 THEN 'new' END AS creator, CAST(2 AS BIGINT) AS discovered FROM fx_images WHERE image_id % 7 <> 1)"""


@query("a9_upsert_items", f"""WITH {ITEMS} SELECT COALESCE(o.image_id, n.image_id) AS image_id, CASE WHEN n.image_id IS NOT NULL THEN n.width ELSE o.width END AS width, COALESCE(n.source_url, o.source_url) AS source_url,
COALESCE(n.page_url, o.page_url) AS page_url, COALESCE(n.creator, o.creator) AS creator, CASE WHEN o.image_id IS NULL THEN n.discovered ELSE o.discovered END AS discovered FROM o FULL JOIN n ON n.image_id = o.image_id""")
def _(i):
    k = F.col("image_id")
    old = i.images.filter(k % 5 != 4).select("image_id", "width", "source_url", "page_url", "creator", F.lit(1).cast("bigint").alias("discovered"))
    new = i.images.filter(k % 7 != 1).select(
        "image_id", (F.col("width") + 1).alias("width"), F.when(k % 2 == 0, F.concat(F.lit("https://new/"), k.cast("string"))).alias("source_url"),
        F.when(k % 3 == 0, F.concat(F.lit("https://page/"), k.cast("string"))).alias("page_url"), F.when(k % 4 == 0, "new").alias("creator"), F.lit(2).cast("bigint").alias("discovered"))
    policy = {"width": sinks.OVERWRITE, "source_url": sinks.COALESCE, "page_url": sinks.COALESCE, "creator": sinks.COALESCE}
    return sinks.upsert(old, new, ["image_id"], policy)


@query("a10_cache_upsert", "SELECT user_id, image_id, MAX(response_id) AS response_id, arg_max(value, response_id) AS value FROM fx_responses GROUP BY ALL")
def _(i):
    rows = i.responses.select("user_id", "image_id", "response_id", "value")
    return sinks.latest_rows(rows.filter("response_id % 10 = 0"), rows.filter("response_id % 10 <> 0"), ["user_id", "image_id"], "response_id")


@query("a11_artifact_paths", """SELECT x.image_id, 'images/' || x.sha256 || '/original.jpg' AS original, 'images/' || x.sha256 || '/thumb.webp' AS thumb,
'models/' || substr(sha256(CAST(x.image_id AS VARCHAR)), 1, 24) || '/head-' || x.width || '-' || x.sha256 || '.npz' AS model FROM fx_images x""")
def _(i):
    sha = F.col("sha256")
    return i.images.select("image_id", hashing.image_path(sha, F.lit("jpg")).alias("original"), hashing.rendition_path(sha, "thumb").alias("thumb"),
                           hashing.model_path(F.col("image_id"), F.col("width"), sha).alias("model"))


@query("a12_model_rows_to_append", "SELECT id, user_id FROM fx_models WHERE id % 2 = 1")
def _(i):
    return sinks.model_rows(i.models, i.models.filter("id % 2 = 0")).select("id", "user_id")


@query("c16_migrated_comparisons", """WITH m AS (SELECT image_id AS local_id, image_id + 5000 AS hosted_id FROM fx_images WHERE image_id % 9 <> 0)
SELECT e.id, l.hosted_id AS left_id, r.hosted_id AS right_id, w.hosted_id AS winner_id FROM fx_elo_log e JOIN m l ON l.local_id = e.left_id JOIN m r ON r.local_id = e.right_id JOIN m w ON w.local_id = e.winner_id WHERE e.id % 4 <> 0""")
def _(i):
    ids = i.images.filter("image_id % 9 <> 0").select(F.col("image_id").alias("local_id"), (F.col("image_id") + 5000).alias("hosted_id"))
    log = i.elo_log
    stored = log.filter("id % 4 = 0").withColumns({k: F.col(k) + 5000 for k in ("left_id", "right_id", "winner_id")})
    return sinks.migrate_comparisons(log, ids, stored).select("id", "left_id", "right_id", "winner_id")


# rows that break each rule are planted by id, in the tables and in the SQL alike
BROKEN = {
    "li": ("fx_user_images", {"matches": "CASE WHEN image_id % 97 = 3 THEN -1 ELSE matches END", "point_rating": "CASE WHEN image_id % 89 = 5 THEN 9 ELSE point_rating END"}),
    "co": ("fx_comparisons", {"winner_id": "CASE WHEN id % 90 = 4 THEN -5 ELSE winner_id END", "right_id": "CASE WHEN id % 70 = 6 THEN left_id ELSE right_id END",
           "idempotency_key": "CASE WHEN id % 80 = 7 THEN 'x' ELSE idempotency_key END", "elo_delta": "CASE WHEN id % 60 = 8 THEN -1.0E0 WHEN id % 3 = 0 THEN 1.5E0 END"}),
    "im": ("fx_images", {"width": "CASE WHEN image_id % 71 = 2 THEN 0 ELSE width END", "height": "CASE WHEN image_id % 73 = 2 THEN -1 ELSE height END"}),
    "pi": ("fx_pair_issuances", {"right_id": "CASE WHEN left_id % 11 = 2 THEN left_id ELSE right_id END", "expires_at": "CASE WHEN left_id % 7 = 3 THEN issued_at ELSE issued_at + CAST('24 hours' AS INTERVAL) END"}),
    "ri": ("fx_rating_issuances", {"token_hash": "CASE WHEN image_id % 41 = 1 THEN 'short' ELSE token_hash END", "expires_at": "CASE WHEN image_id % 43 = 1 THEN issued_at ELSE issued_at + CAST('24 hours' AS INTERVAL) END"}),
    "ra": ("fx_ratings", {"value": "CASE WHEN id % 53 = 1 THEN 0 ELSE value END", "idempotency_key": "CASE WHEN id % 59 = 1 THEN '' ELSE idempotency_key END"}),
    "ac": ("fx_actions", {"propensity": "propensity * CASE WHEN id % 50 = 0 THEN 20 ELSE 1 END", "effective_reward": "CASE WHEN id % 47 = 0 THEN 1.5E0 ELSE zero_reward END", "status": "CASE WHEN id % 45 = 0 THEN 'lost' ELSE status END",
           "action_index": "CASE WHEN id % 61 = 1 THEN -1 ELSE action_index END", "proxy_reward": "CASE WHEN id % 3 > 0 THEN (id % 28) / 25.0E0 END", "human_reward": "CASE WHEN id % 5 > 0 THEN (id % 31 - 2) / 25.0E0 END",
           "human_matches": "id % 37 - 1", "candidates_seen": "id % 41 - 1", "candidates_eligible": "id % 43 - 2"}),
    "di": ("fx_discoveries", {"candidate_proxy_reward": "CASE WHEN image_id % 4 > 0 THEN (image_id % 33) / 30.0E0 END"}),
    "jo": ("fx_jobs", {"kind": "CASE WHEN id % 83 = 1 THEN 'score' ELSE kind END", "status": "CASE WHEN id % 79 = 1 THEN 'paused' WHEN id % 77 = 1 THEN NULL ELSE status END"}),
    "mo": ("fx_models", {"dimensions": "id % 29", "comparison_count": "comparison_count - CASE WHEN id % 31 = 0 THEN 60 ELSE 0 END", "rating_count": "CASE WHEN id % 23 = 1 THEN -1 ELSE rating_count END",
           "comparison_cutoff": "comparison_cutoff - 30", "rating_cutoff": "CASE WHEN id % 19 = 1 THEN -1 ELSE rating_cutoff END", "feedback_count": "feedback_count - CASE WHEN id % 17 = 0 THEN 200 ELSE 0 END"}),
}
# columns that the views do not have
PLANTED = ("elo_delta", "expires_at", "effective_reward", "proxy_reward", "human_reward", "human_matches", "candidates_seen", "candidates_eligible", "candidate_proxy_reward", "dimensions")
BROKEN_SQL = ", ".join(
    f"{k} AS (SELECT * REPLACE ({', '.join(f'{e} AS {n}' for n, e in c.items() if n not in PLANTED)})"
    f"{''.join(f', {e} AS {n}' for n, e in c.items() if n in PLANTED)} FROM {t})".replace("* REPLACE ()", "*")
    for k, (t, c) in BROKEN.items()
)


def broken(i, key):
    view, columns = BROKEN[key]
    return i.view(view).withColumns({n: F.expr(e) for n, e in columns.items()})


def _counts(name, key, rules):
    return [f"SELECT '{name}.{rule}' AS \"check\", COUNT(*) FILTER (WHERE NOT ({test})) AS violations FROM {key}" for rule, test in rules.items()]


def _not_negative(*columns):
    return {f"{k}_not_negative": f"{k} >= 0" for k in columns}


DIGEST_TEST = "regexp_full_match({}, '[0-9a-f]{{64}}')"
L1 = " UNION ALL ".join(
    _counts("library", "li", {"matches_sum": "matches = wins + losses", "counts_not_negative": "matches >= 0 AND wins >= 0 AND losses >= 0",
                              **_not_negative("matches", "wins", "losses"), "rating_pairing": "(point_rating IS NULL) = (point_rated_at IS NULL)", "rating_range": "point_rating BETWEEN 1 AND 5"})
    + _counts("comparison", "co", {"distinct_sides": "left_id <> right_id", "winner_in_pair": "winner_id = left_id OR winner_id = right_id",
                                   "key_is_digest": DIGEST_TEST.format("idempotency_key"), "delta_not_negative": "elo_delta >= 0"})
    + _counts("image", "im", {"width": "width > 0", "height": "height > 0"})
    + _counts("pair_issuance", "pi", {"token_is_digest": DIGEST_TEST.format("token_hash"), "expires_later": "expires_at > issued_at", "distinct_sides": "left_id <> right_id"})
    + _counts("rating_issuance", "ri", {"token_is_digest": DIGEST_TEST.format("token_hash"), "expires_later": "expires_at > issued_at"})
    + _counts("rating", "ra", {"value_range": "value BETWEEN 1 AND 5", "key_is_digest": DIGEST_TEST.format("idempotency_key")})
    + _counts("action", "ac", {"propensity_range": "propensity > 0 AND propensity <= 1", "reward_range": "effective_reward BETWEEN 0 AND 1",
                               "known_status": "status IN ('chosen', 'observed', 'censored', 'failed')", **_not_negative("action_index", "human_matches", "candidates_seen", "candidates_eligible"),
                               "proxy_reward_range": "proxy_reward BETWEEN 0 AND 1", "human_reward_range": "human_reward BETWEEN 0 AND 1"})
    + _counts("discovery", "di", {"candidate_proxy_reward_range": "candidate_proxy_reward BETWEEN 0 AND 1"})
    + _counts("job", "jo", {"known_kind": "kind IN ('train', 'crawl')", "known_status": "status IN ('queued', 'running', 'succeeded', 'failed', 'skipped')"})
    + _counts("model", "mo", {"dimensions": "dimensions > 0", **_not_negative("comparison_cutoff", "comparison_count", "rating_cutoff", "rating_count", "feedback_count")})
)


@query("l1_check_violations", f"WITH {BROKEN_SQL} {L1}")
def _(i):
    rules = (("library", "li", quality.library_rules()), ("comparison", "co", quality.comparison_rules() | quality.outcome_rules()), ("image", "im", quality.image_rules()),
             ("pair_issuance", "pi", quality.issuance_rules(True)), ("rating_issuance", "ri", quality.issuance_rules(False)),
             ("rating", "ra", quality.rating_rules()), ("action", "ac", quality.action_rules() | quality.action_detail_rules()),
             ("discovery", "di", quality.discovery_rules()), ("job", "jo", quality.job_rules()), ("model", "mo", quality.model_count_rules()))
    return quality.union_checks([quality.violations(broken(i, key), r).withColumn("check", F.concat(F.lit(f"{name}."), "check")) for name, key, r in rules])


def _twice(name, table, keys, where="TRUE"):
    return f"""SELECT '{name}' AS "check", (SELECT COUNT(*) FROM (SELECT {keys} FROM {table} WHERE {where} GROUP BY ALL HAVING COUNT(*) > 1)) AS violations FROM region WHERE r_regionkey = 0"""


JOB_KEYS = ", ".join(f"json_extract_string(input_json, '$.{k}') AS {k}" for k in ("comparison_cutoff", "rating_cutoff", "run_day"))
# keys that repeat are planted by folding ids together
L2 = " UNION ALL ".join([
    _twice("images.sha256", "fx_images", "sha256"), _twice("ratings.user_image", "fx_responses", "user_id, image_id"),
    _twice("actions.job_index", "fx_actions", "worker_job_id, action_index"), _twice("jobs.training_day", "fx_jobs", f"user_id, {JOB_KEYS}", "kind = 'train'"),
    _twice("responses.user_key", "fx_responses", "user_id, token_hash"), _twice("choices.user_key", "fx_choices", "user_id, token_hash", "token_hash <> 'unknown'"),
    _twice("discoveries.user_image", "fx_discoveries", "user_id, image_id"),
    _twice("discoveries.action", "(SELECT d.user_id, CAST(FLOOR(d.action_id / 3.0E0) AS BIGINT) AS action FROM fx_discoveries d JOIN fx_actions a ON a.user_id = d.user_id AND a.id = d.action_id WHERE a.policy_version = 'direct-rating-exp3-ix-v2')", "user_id, action"),
])


@query("l2_unique_violations", L2)
def _(i):
    cuts = [F.get_json_object("input_json", f"$.{k}").alias(k) for k in ("comparison_cutoff", "rating_cutoff", "run_day")]
    current = i.actions.filter(F.col("policy_version") == constants.POLICY_VERSION).select("user_id", F.col("id").alias("action_id"))
    found = i.discoveries.join(current, ["user_id", "action_id"]).withColumn("action", F.floor(F.col("action_id") / 3.0))
    return quality.union_checks([
        quality.duplicate_keys(i.images, ["sha256"], "images.sha256"),
        quality.duplicate_keys(i.responses, ["user_id", "image_id"], "ratings.user_image"),
        quality.duplicate_keys(i.actions, ["worker_job_id", "action_index"], "actions.job_index"),
        quality.duplicate_keys(i.jobs, ["user_id", *cuts], "jobs.training_day", F.col("kind") == "train"),
        quality.duplicate_keys(i.responses, ["user_id", "token_hash"], "responses.user_key"),
        quality.duplicate_keys(i.choices, ["user_id", "token_hash"], "choices.user_key", F.col("token_hash") != "unknown"),
        quality.duplicate_keys(i.discoveries, ["user_id", "image_id"], "discoveries.user_image"),
        quality.duplicate_keys(found, ["user_id", "action"], "discoveries.action")])


# (check, child, key columns, parent, parent's key columns); children point at moved ids in places
FOREIGN = [
    ("user_images.image", "fx_user_images", ["image_id"], "fx_images", ["image_id"]),
    *[(f"pair_issuances.{k}", "fx_pair_issuances", ["user_id", f"{k}_id"], "fx_user_images", ["user_id", "image_id"]) for k in ("left", "right")],
    ("rating_issuances.image", "fx_rating_issuances", ["user_id", "image_id"], "fx_user_images", ["user_id", "image_id"]),
    *[(f"comparisons.{k}", "fx_comparisons", ["user_id", f"{k}_id"], "fx_user_images", ["user_id", "image_id"]) for k in ("left", "right", "winner")],
    ("ratings.library", "fx_ratings", ["user_id", "image_id"], "fx_user_images", ["user_id", "image_id"]),
    ("actions.job", "fx_actions", ["worker_job_id"], "fx_jobs", ["id"]),
    ("discoveries.action", "fx_discoveries", ["user_id", "action_id"], "fx_actions", ["user_id", "id"]),
    ("discoveries.image", "fx_discoveries", ["image_id"], "fx_images", ["image_id"]),
]


def moved(column):
    """Every 37th value of a key points nowhere."""
    return f"CASE WHEN {column} % 37 = 5 THEN -{column} ELSE {column} END"


L3 = " UNION ALL ".join(
    f"SELECT '{name}' AS \"check\", COUNT(*) AS violations FROM (SELECT {', '.join(keys[:-1] + [f'{moved(keys[-1])} AS {keys[-1]}'])} FROM {child}) c "
    f"WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE {' AND '.join(f'p.{b} = c.{a}' for a, b in zip(keys, parents))})"
    for name, child, keys, parent, parents in FOREIGN
)


@query("l3_orphans", L3)
def _(i):
    return quality.union_checks([
        quality.orphans(i.view(child).withColumn(keys[-1], F.expr(moved(keys[-1]))), i.view(parent), dict(zip(keys, parents)), name)
        for name, child, keys, parent, parents in FOREIGN])


@query("l8_changed_ratings", """SELECT id, CASE WHEN id % 31 = 0 THEN 'lost' ELSE 'changed' END AS change FROM fx_ratings WHERE id % 31 = 0 OR id % 29 = 0""")
def _(i):
    later = i.ratings.filter("id % 31 <> 0").withColumn("value", F.when(F.col("id") % 29 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return quality.changed_rows(i.ratings, later, ["id"], ["user_id", "image_id", "value", "rated_at"])


@query("l4_model_rows", """SELECT 'feedback_sum' AS "check", COUNT(*) FILTER (WHERE feedback_count <> comparison_count + rating_count) AS violations FROM fx_models UNION ALL SELECT 'weights_finite', COUNT(*) FILTER (WHERE id % 77 = 0) FROM fx_models
UNION ALL SELECT 'weights_width', COUNT(*) FILTER (WHERE id % 55 = 0) FROM fx_models UNION ALL SELECT 'thresholds_ordered', COUNT(*) FILTER (WHERE id % 33 = 0) FROM fx_models""")
def _(i):
    k = F.col("id")
    weights = F.array(F.when(k % 77 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal") / 1000), F.lit(0.5), F.lit(-0.25))
    thresholds = F.array(F.lit(-1.5), F.lit(-0.5), F.when(k % 33 == 0, -0.5).otherwise(0.5), F.lit(1.5))
    rows = i.models.withColumns({"weights": weights, "dimensions": F.when(k % 55 == 0, 4).otherwise(3), "thresholds": thresholds})
    return quality.violations(rows, quality.model_rules())


@query("l5_vector_norms", """SELECT 'width' AS "check", COUNT(*) FILTER (WHERE len(embedding) <> 64) AS violations FROM embeddings UNION ALL SELECT 'unit_norm', COUNT(*) FILTER (WHERE vec_id % 21 = 0 OR abs(sqrt(list_dot_product(embedding, embedding)) - 1) > 1e-3) FROM embeddings""")
def _(i):
    vector = F.transform(as_double(F.col("embedding")), lambda x: F.when(F.col("image_id") % 21 == 0, x * 1.1).otherwise(x))
    return quality.violations(i.images.select("image_id", vector.alias("vector")), quality.vector_rules(64))


CATEGORIES = ["Category:A", "Category:B"]


@query("l6_frontier_documents", """SELECT 'version' AS "check", COUNT(*) FILTER (WHERE id % 10 = 1) AS violations FROM fx_models UNION ALL SELECT 'categories', COUNT(*) FILTER (WHERE id % 10 = 2) FROM fx_models
UNION ALL SELECT 'next_category', COUNT(*) FILTER (WHERE id % 10 = 3) FROM fx_models UNION ALL SELECT 'continuations', COUNT(*) FILTER (WHERE id % 10 = 4) FROM fx_models""")
def _(i):
    k = F.col("id") % 10
    document = F.format_string(
        '{"version":%d,"categories":["Category:A","Category:%s"],"next_category":%d,"continuations":{"Category:A":{"gcm":"1"}%s}}',
        F.when(k == 1, 2).otherwise(1), F.when(k == 2, "C").otherwise("B"), F.when(k == 3, 2).otherwise(1),
        F.when(k == 4, "").otherwise(',"Category:B":{}'))
    parsed = i.models.select("id", F.from_json(document, quality.FRONTIER_SCHEMA).alias("frontier"))
    return quality.violations(parsed, quality.frontier_rules(1, CATEGORIES))


@query("l7_recounted_models", """SELECT m.id, m.user_id, m.comparison_count AS stored, (SELECT COUNT(*) FROM fx_comparisons c WHERE c.user_id = m.user_id AND c.id <= m.comparison_cutoff) AS recounted FROM fx_models m
WHERE m.comparison_count <> (SELECT COUNT(*) FROM fx_comparisons c WHERE c.user_id = m.user_id AND c.id <= m.comparison_cutoff)""")
def _(i):
    return quality.recount(i.models, i.comparisons, "comparison_cutoff", "comparison_count")


@query("l7_recounted_ratings", """SELECT m.id, m.user_id, m.rating_count AS stored, (SELECT COUNT(*) FROM fx_ratings r WHERE r.user_id = m.user_id AND r.id <= m.rating_cutoff) AS recounted FROM fx_models m
WHERE m.rating_count <> (SELECT COUNT(*) FROM fx_ratings r WHERE r.user_id = m.user_id AND r.id <= m.rating_cutoff)""")
def _(i):
    return quality.recount(i.models, i.ratings, "rating_cutoff", "rating_count")


@query("l7_vanished_feedback", """WITH n AS (SELECT m.id, m.user_id, m.comparison_count + m.rating_count AS stored, (SELECT COUNT(*) FROM fx_comparisons c WHERE c.user_id = m.user_id) + (SELECT COUNT(*) FROM fx_ratings r WHERE r.user_id = m.user_id) AS present FROM fx_models m)
SELECT id, user_id, stored, present FROM n WHERE present < stored""")
def _(i):
    there = i.comparisons.select("user_id").unionByName(i.ratings.select("user_id")).groupBy("user_id").agg(F.count("*").alias("present"))
    rows = i.models.select("id", "user_id", (F.col("comparison_count") + F.col("rating_count")).alias("stored")).join(there, "user_id", "left")
    return rows.withColumn("present", F.coalesce("present", F.lit(0))).filter("present < stored").select("id", "user_id", "stored", "present")
