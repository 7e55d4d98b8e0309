"""Queries of the operators in this package, with check SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prefloom.llm import (
    decontamination, hamming_search, hash_ring, jaccard, language_id, line_dedup, packing, secrets, suffix_dedup, target_sampling,
    token_counts, toxicity, whitening,
)
from prefloom.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


@query("op1_packing")
def op1(spark: SparkSession, path: str) -> DataFrame:
    return packing.packed_digest(table(spark, path, "documents"))


LINES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, coalesce(k.doc_id <> s.keep, FALSE) AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op7_line_dedup", LINES)
def op7(spark: SparkSession, path: str) -> DataFrame:
    return line_dedup.digest(table(spark, path, "documents"))


@query("op8_toxicity")
def op8(spark: SparkSession, path: str) -> DataFrame:
    return toxicity.score(table(spark, path, "documents"), table(spark, path, "labels"))


@query("op9_jaccard_join")
def op9(spark: SparkSession, path: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, path, "documents"))


@query("op5_decontamination")
def op5(spark: SparkSession, path: str) -> DataFrame:
    return decontamination.contaminated(table(spark, path, "documents"), table(spark, path, "benchmark"))


@query("op6_secret_scan")
def op6(spark: SparkSession, path: str) -> DataFrame:
    return secrets.digest(table(spark, path, "documents"))


@query("op10_language_id")
def op10(spark: SparkSession, path: str) -> DataFrame:
    return language_id.identify(table(spark, path, "documents"))


@query("op4_suffix_dedup")
def op4(spark: SparkSession, path: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, path, "documents"))


@query("op2_token_counts")
def op2(spark: SparkSession, path: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"
    return token_counts.maintained_totals(table(spark, path, "documents"), folder)


NEAREST = """
WITH v AS (
  SELECT vec_id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '')::BIT AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, v.vec_id, bit_count(xor(q.code, v.code)) AS distance FROM v q, v WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, distance::BIGINT AS distance FROM r WHERE rank <= 10
"""


@query("op3_hamming_search", NEAREST)
def op3(spark: SparkSession, path: str) -> DataFrame:
    codes = hamming_search.sign_codes(table(spark, path, "embeddings"))
    found = hamming_search.search(codes, codes.where("id % 50 = 0"))
    return found.withColumnRenamed("id", "vec_id")


@query("op11_hash_ring")
def op11(spark: SparkSession, path: str) -> DataFrame:
    return hash_ring.sharded(table(spark, path, "documents"))


@query("op12_target_sampling")
def op12(spark: SparkSession, path: str) -> DataFrame:
    return target_sampling.resample(table(spark, path, "documents"), table(spark, path, "benchmark"))


@query("op13_whitening")
def op13(spark: SparkSession, path: str) -> DataFrame:
    return whitening.whiten(table(spark, path, "embeddings"))
