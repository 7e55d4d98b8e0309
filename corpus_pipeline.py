"""From raw documents to training sequences, each stage one operator of ``prefloom.llm``.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again
as the next stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.llm import decontamination, jaccard, line_dedup, packing, toxicity
from prefloom.llm.common import NULL_ID, ready, unused
from prefloom.session import checkpoint_dir


def _without(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """The documents whose id is not in ``lost``; a null id is an id like any other."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    own = unused(docs, "__id")
    gone = lost.select(key.alias(own)).distinct()
    return docs.withColumn(own, key).join(gone, own, "left_anti").select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near duplicates, and all without shingles."""
    found = jaccard.near_duplicates(docs)
    return _without(docs, found.where("NOT doc_id <=> component_id"))


def not_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, word by word or re-parameterised."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go from all but the last of them."""
    return line_dedup.drop_shared_lines(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their token ids."""
    return packing.sequences(packing.decompose(docs))


STAGES = [
    ("toxicity", not_toxic),
    ("line dedup", shared_lines),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", not_benchmark),
    ("packing", pack),
]
#: The stages learn, hash and tokenize; SQL does not express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ready(docs)
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
