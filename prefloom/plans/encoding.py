"""Incremental encoding of documents into unit vectors."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.operators.features import cache_misses


def hashing_encoder(rows: DataFrame, dimensions: int = 64) -> DataFrame:
    """Default encoder: hashed term frequencies of the whole text, normalised to length one."""
    tokens = Tokenizer(inputCol="text", outputCol="_tokens").transform(rows.select("image_id", "text"))
    counts = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dimensions).transform(tokens)
    unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(counts)
    return unit.select("image_id", vector_to_array("_unit", "float32").alias("vector"))


def encode_missing(items: DataFrame, cache: DataFrame, encoder: str, encode=hashing_encoder) -> DataFrame:
    """Vectors for items the cache does not hold yet, ready to append.

    ``encode`` maps (image_id, text) rows to (image_id, vector) and runs on the misses only.
    """
    wanted = items.withColumn("encoder", F.lit(encoder))
    vectors = encode(cache_misses(wanted, cache))
    return vectors.select("image_id", F.lit(encoder).alias("encoder"), "vector", F.size("vector").alias("dimensions"))
