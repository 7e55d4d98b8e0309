"""Feedback, library, policy, candidate and job tables derived from the given parquet tables.

Every view covers its whole source table and grows linearly with it: no cross joins, no
subsets. The text is plain SQL shared by both engines (only the digest function differs), so a
check can put the same definitions in front of an independent query.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from prefloom.session import checkpoint_dir, prepare

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    # library items
    "fx_images": """
SELECT vec_id AS image_id, label, embedding, (vec_id % 13 <> 0) AS active,
       CAST(1000 + (vec_id*37) % 3000 AS INT) AS width, CAST(1000 + (vec_id*53) % 2600 AS INT) AS height,
       {SHA}(CAST(vec_id AS STRING){BITS}) AS sha256,
       CONCAT('https://upload.wikimedia.org/', CAST((vec_id*3) % 900 AS STRING), '.jpg') AS source_url,
       CASE WHEN vec_id % 5 = 0 THEN NULL ELSE CONCAT('https://commons.wikimedia.org/wiki/File:', CAST(vec_id*4 AS STRING)) END AS page_url,
       CASE WHEN vec_id % 7 = 0 THEN ' ' ELSE 'CC BY 4.0' END AS license,
       CONCAT('item ', CAST(vec_id AS STRING)) AS title,
       CASE WHEN vec_id % 6 = 0 THEN NULL ELSE CONCAT('creator ', CAST(vec_id % 40 AS STRING)) END AS creator
FROM embeddings""",
    # events of one rater: eight neighbouring source users
    "fx_events": """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, CAST(FLOOR(user_id / 8.0E0) AS BIGINT) AS user_id, event_type,
       (event_id*31+7) % (SELECT COUNT(*) FROM embeddings) AS image_id, value, props
FROM events""",
    # one immutable 1-5 rating per (user, image): the earliest
    "fx_ratings": """
SELECT r.id, r.user_id, r.image_id, CAST(1 + (i.label + CASE WHEN r.id % 7 = 0 THEN 1 ELSE 0 END) % 5 AS INT) AS value,
       {SHA}(CONCAT('r', CAST(r.id AS STRING)){BITS}) AS idempotency_key, r.rated_at
FROM (SELECT user_id, image_id, MIN(event_id) AS id, MIN(ts) AS rated_at FROM fx_events
      WHERE event_type IN ('view','purchase') GROUP BY user_id, image_id) r
JOIN fx_images i ON i.image_id = r.image_id""",
    # pairwise choices; a few popular items meet many opponents
    "fx_comparisons": """
SELECT c.id, c.user_id, c.left_id, c.right_id,
       CASE WHEN (CASE WHEN l.label % 5 = r.label % 5 THEN c.id % 2 = 0 ELSE l.label % 5 > r.label % 5 END) <> (c.id % 10 = 3)
            THEN c.left_id ELSE c.right_id END AS winner_id,
       {SHA}(CONCAT('c', CAST(c.id AS STRING)){BITS}) AS idempotency_key, c.created_at
FROM (SELECT event_id AS id, user_id, ((event_id % 23)*(event_id % 23)) % 23 AS left_id,
             CASE WHEN event_id % 3 = 0 THEN 30 + event_id % 9 ELSE (event_id*29+7) % (SELECT COUNT(*) FROM embeddings) END AS right_id,
             ts AS created_at
      FROM fx_events WHERE event_type = 'click') c
JOIN fx_images l ON l.image_id = c.left_id JOIN fx_images r ON r.image_id = c.right_id WHERE c.left_id <> c.right_id""",
    # source actions: six arms, two policy versions
    "fx_actions": """
SELECT event_id AS id, user_id, CAST(FLOOR(event_id / 20.0E0) AS BIGINT) AS worker_job_id, event_id % 20 AS action_index,
       CONCAT('arm', CAST((event_id*7) % 6 AS STRING)) AS arm,
       CASE WHEN event_id % 11 = 0 THEN 'legacy-proxy' ELSE 'direct-rating-exp3-ix-v2' END AS policy_version,
       (1 + event_id % 9)/10.0E0 AS propensity,
       CASE WHEN event_id % 13 = 0 THEN 'failed' WHEN event_id % 17 = 0 THEN 'censored' WHEN event_id % 19 = 0 THEN 'chosen' ELSE 'observed' END AS status,
       CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END AS wants_import,
       CASE WHEN event_id % 4 = 0 AND event_id % 3 = 0 THEN 0.0E0 ELSE NULL END AS zero_reward,
       ts AS chosen_at
FROM fx_events WHERE event_type = 'error'""",
    # one image per importing action, one action per (user, image)
    "fx_discoveries": """
SELECT user_id, MIN(id) AS action_id, image_id FROM (
  SELECT user_id, id, (id*43+5) % (SELECT COUNT(*) FROM embeddings) AS image_id FROM fx_actions
  WHERE wants_import = 1 AND status = 'observed') a
GROUP BY user_id, image_id""",
    # match counts per (user, image)
    "fx_match_counts": """
SELECT user_id, image_id, CAST(COUNT(*) AS BIGINT) AS matches, CAST(SUM(won) AS BIGINT) AS wins FROM (
  SELECT user_id, left_id AS image_id, CASE WHEN winner_id = left_id THEN 1 ELSE 0 END AS won FROM fx_comparisons
  UNION ALL
  SELECT user_id, right_id AS image_id, CASE WHEN winner_id = right_id THEN 1 ELSE 0 END AS won FROM fx_comparisons) e
GROUP BY user_id, image_id""",
    # a user's library: everything they saw, compared or discovered
    "fx_library": """
SELECT user_id, image_id FROM fx_events UNION SELECT user_id, left_id AS image_id FROM fx_comparisons
UNION SELECT user_id, right_id AS image_id FROM fx_comparisons UNION SELECT user_id, image_id FROM fx_discoveries""",
    "fx_user_images": """
SELECT u.user_id, u.image_id, (u.image_id + u.user_id) % 17 <> 0 AS active,
       1500.0E0 + 16.0E0 * (2 * COALESCE(m.wins, 0) - COALESCE(m.matches, 0)) AS elo,
       COALESCE(m.matches, 0) AS matches, COALESCE(m.wins, 0) AS wins, COALESCE(m.matches, 0) - COALESCE(m.wins, 0) AS losses,
       CASE WHEN (u.image_id + u.user_id) % 11 = 0 THEN NULL ELSE ((u.image_id*7 + u.user_id*3) % 41 - 20) / 8.0E0 END AS predicted_utility,
       r.value AS point_rating, r.rated_at AS point_rated_at, CAST(u.image_id % 30 AS BIGINT) AS discovered_day
FROM fx_library u
LEFT JOIN fx_match_counts m ON m.user_id = u.user_id AND m.image_id = u.image_id
LEFT JOIN fx_ratings r ON r.user_id = u.user_id AND r.image_id = u.image_id""",
    # issued up to 29 hours before use; sign-up events leave theirs unanswered
    "fx_rating_issuances": """
SELECT {SHA}(CONCAT('r', CAST(id AS STRING)){BITS}) AS token_hash, user_id, image_id,
       rated_at - CAST(CONCAT(CAST(id % 30 AS STRING), ' hours') AS INTERVAL) AS issued_at, rated_at AS used_at FROM fx_ratings
UNION ALL
SELECT {SHA}(CONCAT('u', CAST(event_id AS STRING)){BITS}) AS token_hash, user_id, image_id, ts AS issued_at, CAST(NULL AS TIMESTAMP) AS used_at
FROM fx_events WHERE event_type = 'signup'""",
    # rating responses as they arrive: replays, conflicting reuse
    "fx_responses": """
SELECT id*10 AS response_id, user_id, image_id, value, idempotency_key AS token_hash, rated_at AS responded_at FROM fx_ratings
UNION ALL
SELECT id*10+1, user_id, image_id, value, idempotency_key, rated_at + CAST('10 minutes' AS INTERVAL) FROM fx_ratings WHERE id % 5 = 0
UNION ALL
SELECT id*10+2, user_id, image_id, CAST(1 + value % 5 AS INT), idempotency_key, rated_at + CAST('20 minutes' AS INTERVAL) FROM fx_ratings WHERE id % 20 = 0
UNION ALL
SELECT event_id*10+3, user_id, image_id, 3, {SHA}(CONCAT('u', CAST(event_id AS STRING)){BITS}), ts + CAST('1 hours' AS INTERVAL) FROM fx_events WHERE event_type = 'signup' AND event_id % 2 = 0""",
    # pair issuances and choices as they arrive
    "fx_pair_issuances": """
SELECT idempotency_key AS token_hash, user_id, left_id, right_id, created_at - CAST(CONCAT(CAST(id % 30 AS STRING), ' hours') AS INTERVAL) AS issued_at, created_at AS used_at FROM fx_comparisons""",
    "fx_choices": """
SELECT id*10 AS response_id, user_id, left_id, right_id, CASE WHEN id % 50 = 0 THEN 9999999 ELSE winner_id END AS winner_id, idempotency_key AS token_hash, created_at AS responded_at FROM fx_comparisons
UNION ALL
SELECT id*10+1, user_id, left_id, right_id, winner_id, idempotency_key, created_at + CAST('10 minutes' AS INTERVAL) FROM fx_comparisons WHERE id % 5 = 0
UNION ALL
SELECT id*10+2, user_id, left_id, right_id, left_id + right_id - winner_id, CASE WHEN id % 40 = 0 THEN 'unknown' ELSE idempotency_key END, created_at + CAST('20 minutes' AS INTERVAL) FROM fx_comparisons WHERE id % 20 = 0""",
    # rewarded imports with the time of their action, and the mixed feedback log
    "fx_imports": """
SELECT d.user_id, d.action_id, d.image_id, a.chosen_at FROM fx_discoveries d JOIN fx_actions a ON a.user_id = d.user_id AND a.id = d.action_id
WHERE a.policy_version = 'direct-rating-exp3-ix-v2' AND a.status = 'observed'""",
    "fx_feedback": """
SELECT user_id, id, 'comparison' AS kind, created_at AS ts FROM fx_comparisons UNION ALL SELECT user_id, id, 'rating' AS kind, rated_at AS ts FROM fx_ratings""",
    # a comparison log with Elo before and after, not always consistent
    "fx_elo_log": """
SELECT id, user_id, left_id, right_id, winner_id, 1500.0E0 + 8 * (id % 3) AS left_elo_before, 1500.0E0 + 8 * (id % 2) AS right_elo_before,
       1500.0E0 + 8 * ((id + 1) % 3) AS left_elo_after, 1500.0E0 + 8 * ((id + 1) % 2) AS right_elo_after,
       CAST(id % 40 AS INT) AS left_matches, CAST(id % 70 AS INT) AS right_matches, created_at FROM fx_comparisons""",
    # provider records
    "fx_candidates": """
SELECT p_partkey AS candidate_id, CONCAT('cat', CAST(p_partkey % 6 AS STRING)) AS source_category,
       CAST(1000 + (p_partkey*37) % 6000 AS INT) AS width, CAST(1000 + (p_partkey*91) % 5000 AS INT) AS height,
       CASE p_partkey % 18 WHEN 0 THEN 'image/tiff' WHEN 1 THEN 'image/png' ELSE 'image/jpeg' END AS mime,
       CONCAT(CASE WHEN p_partkey % 23 = 0 THEN 'http://' ELSE 'https://' END, CASE WHEN p_partkey % 19 = 0 THEN 'example.com/' ELSE 'upload.wikimedia.org/' END, CAST((p_partkey*7) % (SELECT COUNT(*) * 9 / 10 FROM part) AS STRING), '.jpg') AS source_url,
       CASE WHEN p_partkey % 29 = 0 THEN '' ELSE CONCAT('https://commons.wikimedia.org/wiki/File:', CAST(p_partkey AS STRING)) END AS page_url,
       p_partkey + 1 AS provider_page_id,
       CASE WHEN p_partkey % 31 = 0 THEN '' ELSE {SHA}(CAST(p_partkey - p_partkey % 20 + (p_partkey % 20) % 19 AS STRING){BITS}) END AS provider_sha1,
       p_name AS title, CASE WHEN p_partkey % 37 = 0 THEN '' ELSE p_brand END AS creator,
       CASE WHEN p_partkey % 41 = 0 THEN 'true' ELSE 'False' END AS non_free,
       CASE p_partkey % 7 WHEN 0 THEN 'CC BY-SA 3.0' WHEN 1 THEN 'CC BY 4.0' WHEN 2 THEN 'Public domain' WHEN 3 THEN 'GFDL 1.2' WHEN 4 THEN 'CC BY-NC 4.0' WHEN 5 THEN 'FAL' ELSE 'CC0' END AS license,
       CASE p_partkey % 7 WHEN 0 THEN 'https://creativecommons.org/licenses/by-sa/3.0/' WHEN 1 THEN 'https://creativecommons.org/licenses/by/4.0/' WHEN 2 THEN '' WHEN 3 THEN 'https://www.gnu.org/copyleft/fdl.html' WHEN 4 THEN 'https://creativecommons.org/licenses/by-nc/4.0/' WHEN 5 THEN 'https://example.com/license' ELSE 'http://creativecommons.org/publicdomain/zero/1.0/' END AS license_url,
       CASE WHEN p_partkey % 2 = 0 THEN 'pd' ELSE '' END AS license_identifier, 'False' AS copyrighted, 'Public domain' AS usage_terms,
       CAST(CASE WHEN p_partkey % 43 = 0 THEN 'n/a' ELSE CAST(p_size*1000000 AS STRING) END AS STRING) AS bytes,
       CASE WHEN p_partkey % 47 = 0 THEN 'https://example.com/t.jpg' ELSE CONCAT('https://upload.wikimedia.org/thumb/', CAST(p_partkey AS STRING), '.jpg') END AS thumbnail_url,
       CAST(CASE WHEN p_partkey % 53 = 0 THEN 600 ELSE 512 END AS INT) AS thumbnail_width, CAST(300 + p_partkey % 200 AS INT) AS thumbnail_height,
       p_partkey AS discovery_index, CAST(FLOOR(p_partkey/20.0E0) AS BIGINT) AS action_id,
       CAST(FLOOR(p_partkey/200.0E0) AS BIGINT) AS run_id, CAST(FLOOR(p_partkey/200.0E0) % 19 AS BIGINT) AS user_id,
       ((p_partkey*73) % 997) / 100.0E0 - 5.0E0 AS score, (p_partkey % 6 <> 0) AS ok
FROM part""",
    # job log with JSON in and out, over two weeks
    "fx_jobs": """
SELECT id, user_id, kind, status,
       CONCAT('{{"comparison_cutoff":"', CAST(id % 3 AS STRING), CASE WHEN id % 4 = 0 THEN '"' ELSE CONCAT('","rating_cutoff":"', CAST(id % 2 AS STRING), '"') END, ',"run_day":"', CAST(CAST(created_at AS DATE) AS STRING), '"}}') AS input_json,
       CASE WHEN id % 5 = 0 THEN '{{}}' ELSE CONCAT('{{"imported":', CAST(id % 11 AS STRING), ',"comparison_count":', CAST(id % 90 AS STRING), ',"rating_count":', CAST(id % 60 AS STRING), '}}') END AS output_json,
       CASE id % 9 WHEN 0 THEN 'request timed out' WHEN 1 THEN 'postgresql://me:pw@host/db refused   twice' WHEN 2 THEN 'fetch failed ?token=abc&x=1' WHEN 3 THEN '' ELSE 'decoder error' END AS error,
       created_at, created_at + CAST('5 minutes' AS INTERVAL) AS finished_at
FROM (SELECT o_orderkey AS id, CAST(FLOOR(o_custkey / 8.0E0) AS BIGINT) AS user_id, CASE WHEN FLOOR(o_orderkey / 7.0E0) % 2 = 0 THEN 'train' ELSE 'crawl' END AS kind,
             CASE o_orderkey % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' WHEN 2 THEN 'failed' WHEN 3 THEN 'queued' ELSE 'succeeded' END AS status,
             TIMESTAMP '2024-01-15 00:00:00' + CAST(CONCAT(CAST((o_orderkey * 1009) % 20160 AS STRING), ' minutes') AS INTERVAL) AS created_at FROM orders) j""",
    # fitted models per user
    "fx_models": """
SELECT c_custkey AS id, CAST(FLOOR(c_custkey / 9.0E0) AS BIGINT) AS user_id, c_custkey % 60 AS comparison_count, c_custkey % 47 AS rating_count,
       c_custkey % 60 + c_custkey % 47 + CASE WHEN c_custkey % 101 = 0 THEN 1 ELSE 0 END AS feedback_count,
       c_custkey * 3 AS comparison_cutoff, c_custkey * 2 AS rating_cutoff, (c_custkey % 4 <> 0) AS promoted,
       CASE WHEN c_custkey % 10 = 0 THEN 'encoder-b' ELSE 'encoder-a' END AS encoder, c_acctbal
FROM customer""",
    # unit vectors plus slightly shifted copies of every tenth, and a few exact copies
    "fx_vectors": """
SELECT image_id, {SHA}(CAST(image_id AS STRING){BITS}) AS digest, pos, v / SQRT(SUM(v*v) OVER (PARTITION BY image_id)) AS v FROM (
  SELECT image_id, pos, v FROM fx_long
  UNION ALL SELECT image_id + 1000000, pos, CASE WHEN pos = 0 THEN v + 0.03E0 ELSE v END FROM fx_long WHERE image_id % 10 = 0
  UNION ALL SELECT image_id + 2000000, pos, CASE WHEN pos = 0 THEN v + 0.05E0 ELSE v END FROM fx_long WHERE image_id % 20 = 0
  UNION ALL SELECT image_id + 3000000, pos, v FROM fx_long WHERE image_id % 25 = 0) u""",
}

# Vectors in long form: the one definition whose dialects differ.
LONG_SPARK = """
SELECT vec_id AS image_id, pos, CAST(e AS DOUBLE) AS v FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, e"""
LONG_DUCKDB = """
SELECT vec_id AS image_id, CAST(i-1 AS INT) AS pos, CAST(embedding[i] AS DOUBLE) AS v
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding)+1)) AS i FROM embeddings)"""

_LANDED_PATHS: dict[tuple[str, str, str], str] = {}
_DECLARED = {"fx_long": LONG_SPARK, **VIEWS}


def _needed(sql: str) -> list[str]:
    """Views a query uses, with everything they use, in declaration order."""
    seen: set[str] = set()
    todo = [sql]
    while todo:
        for name in re.findall(r"\bfx_[a-z_]+\b", todo.pop()):
            if name in _DECLARED and name not in seen:
                seen.add(name)
                todo.append(_DECLARED[name])
    return [name for name in _DECLARED if name in seen]


def _definition(name: str, digest: str, bits: str, long_form: str) -> str:
    text = long_form if name == "fx_long" else VIEWS[name]
    return f"{name} AS ({text.format(SHA=digest, BITS=bits)})"


def duckdb_sql(sql: str) -> str:
    """Prefix a check query with the views it names."""
    body = sql.strip()
    heads = [_definition(n, "sha256", "", LONG_DUCKDB) for n in _needed(body)]
    if not heads:
        return body
    match = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if match:
        recursive = match.group(1) or ""
        return f"WITH {recursive}{', '.join(heads)}, {body[match.end():]}"
    return f"WITH {', '.join(heads)} {body}"


# Views that cost a shuffle are landed once per application as parquet in the shared folder,
# like the tables at rest they stand for; every query then scans them with column pruning and
# pushed filters. The remaining views are narrow projections and stay inline.
LANDED = (
    "fx_ratings", "fx_comparisons", "fx_discoveries", "fx_user_images", "fx_rating_issuances",
    "fx_responses", "fx_candidates", "fx_match_counts",
)


class Inputs:
    """The tables and derived views of one data directory, as DataFrames."""

    def __init__(self, spark: SparkSession, path: str):
        prepare(spark)
        self.spark = spark
        self.path = path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def _landed(self, name: str) -> str:
        """Path of a landed view, written on first use by this application."""
        key = (self.spark.sparkContext.applicationId, self.path, name)
        if key not in _LANDED_PATHS:
            folder = hashlib.sha256(self.path.encode()).hexdigest()[:12]
            target = f"{checkpoint_dir(self.spark)}/{key[0]}/{folder}/{name}"
            text = VIEWS[name].format(SHA="sha2", BITS=", 256")
            self._run(text).write.mode("overwrite").parquet(target)
            _LANDED_PATHS[key] = target
        return _LANDED_PATHS[key]

    def _run(self, text: str) -> DataFrame:
        inline, landed, todo = [], set(), [text]
        while todo:
            for name in re.findall(r"\bfx_[a-z_]+\b", todo.pop()):
                if name in LANDED:
                    landed.add(name)
                elif name in _DECLARED and name not in inline:
                    inline.append(name)
                    todo.append(_DECLARED[name])
        heads = [_definition(n, "sha2", ", 256", LONG_SPARK) for n in _DECLARED if n in inline]
        body = f"WITH {', '.join(heads)} {text}" if heads else text
        for name in landed:
            body = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 parquet.`{self._landed(name)}`", body)
        for name in BASE_TABLES:
            body = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 parquet.`{self.path}/{name}.parquet`", body)
        return self.spark.sql(body)

    def sql(self, text: str) -> DataFrame:
        """Run Spark SQL over the tables and views of this directory."""
        return self._run(text)

    def stream(self, name: str, files: int | None = None) -> DataFrame:
        """A landed view as a file stream with its declared schema, ``files`` files to a micro-batch."""
        target = self._landed(name)
        reader = self.spark.readStream.schema(self.spark.read.parquet(target).schema)
        return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(target)

    def view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")

    def __getattr__(self, name: str) -> DataFrame:
        if f"fx_{name}" in _DECLARED:
            return self.view(f"fx_{name}")
        raise AttributeError(name)
