"""Landed provider records, image files and stored vectors as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.functions.text import html_to_text
from prefloom.functions.urls import normalized_category, normalized_url
from prefloom.functions.vectors import is_finite
from prefloom.session import prepare
from prefloom.sources.digests import chained_sha256

#: Bytes of the longest file that one task reads as a whole.
WHOLE = 256 << 20

# Provider metadata keys and the candidate columns they fill.
METADATA_COLUMNS = {
    "LicenseShortName": "license",
    "License": "license_identifier",
    "LicenseUrl": "license_url",
    "UsageTerms": "usage_terms",
    "Credit": "credit",
    "Attribution": "attribution",
    "AttributionRequired": "attribution_required",
    "Copyrighted": "copyrighted",
    "NonFree": "non_free",
    "Restrictions": "restrictions",
    "Permission": "permission",
    "ImageDescription": "description",
    "DateTimeOriginal": "date_created",
    "ObjectName": "object_name",
}

PAGE_SCHEMA = (
    "category string, query struct<pages: array<struct<pageid: bigint, title: string, imageinfo: array<struct<"
    "url: string, thumburl: string, thumbwidth: int, thumbheight: int, descriptionurl: string, width: int, height: int, "
    "size: bigint, mime: string, mediatype: string, sha1: string, extmetadata: map<string, struct<value: string>>>>>>>"
)


def read_provider_dump(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of API responses with the declared schema."""
    return spark.read.schema(PAGE_SCHEMA).json(path)


def candidate_rows(dump: DataFrame) -> DataFrame:
    """One candidate per page: first image info, plain-text metadata, normalised links."""
    pages = dump.select("category", F.explode("query.pages").alias("page"))
    info = F.get("page.imageinfo", F.lit(0))
    rows = pages.select("category", "page", info.alias("info"))

    def text(column: Column) -> Column:
        return F.coalesce(column, F.lit(""))

    def metadata(key: str) -> Column:
        return html_to_text(F.try_element_at("info.extmetadata", F.lit(key)).getField("value"))

    plain = rows.select("category", "page", "info", metadata("Artist").alias("artist"), *[metadata(k).alias(v) for k, v in METADATA_COLUMNS.items()])
    creator = F.coalesce(F.nullif("artist", F.lit("")), F.nullif("attribution", F.lit("")), F.col("credit"))
    return plain.select(
        F.regexp_replace(text(F.col("page.title")), "^File:", "").alias("title"),
        normalized_url(F.col("info.url")).alias("source_url"),
        normalized_url(F.col("info.thumburl")).alias("thumbnail_url"),
        F.coalesce("info.thumbwidth", F.lit(0)).alias("thumbnail_width"),
        F.coalesce("info.thumbheight", F.lit(0)).alias("thumbnail_height"),
        normalized_url(F.col("info.descriptionurl")).alias("page_url"),
        text(creator).alias("creator"),
        F.coalesce("info.width", F.lit(0)).alias("width"),
        F.coalesce("info.height", F.lit(0)).alias("height"),
        F.coalesce("info.size", F.lit(0)).alias("bytes"),
        F.lower(text(F.col("info.mime"))).alias("mime"),
        text(F.col("info.mediatype")).alias("media_type"),
        F.col("page.pageid").alias("provider_page_id"),
        text(F.col("info.sha1")).alias("provider_sha1"),
        normalized_category(F.col("category")).alias("source_category"),
        normalized_url(F.col("license_url")).alias("license_url"),
        *[v for v in METADATA_COLUMNS.values() if v != "license_url"],
    )


def scan_files(spark: SparkSession, path: str, pattern: str = "*", whole: int = WHOLE) -> DataFrame:
    """Files below a path with digest, size and extension; each distinct content once per path.

    One task reads a file of up to ``whole`` bytes; of a longer one, which is digested at once, a task
    reads a split. Pixel dimensions need an image decoder and come from metadata instead.
    """

    def below(form: str) -> DataFrame:
        reader = spark.read.format(form).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        return (reader.option("lineSep", "\n") if form == "text" else reader).load(path)

    def described(rows: DataFrame, sha256: Column) -> DataFrame:
        return rows.select(
            "path",
            F.element_at(F.split("path", "/"), -1).alias("filename"),
            F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"),
            F.col("length").alias("bytes"),
            sha256.alias("sha256"),
        )

    files, digest = below("binaryFile"), F.sha2("content", 256)
    size = F.col("_metadata.file_size")
    long = files.where(size > whole)
    if long.select("length").isEmpty():
        return described(files, digest)
    prepare(spark)
    known = chained_sha256(long, below("text").where(size > whole))
    place = F.col("_metadata.file_path")
    given = spark.createDataFrame(list(known.items()), "place string, sha256 string")
    chained = long.select("path", "length", place.alias("place")).join(given, "place")
    return described(files.where((size <= whole) | ~place.isin(list(known))), digest).unionByName(described(chained, F.col("sha256")))


def distinct_content(files: DataFrame) -> DataFrame:
    """The first path of every distinct content, with the number of copies."""
    return files.groupBy("sha256").agg(
        F.min("path").alias("path"), F.min("bytes").alias("bytes"), F.count("*").alias("copies")
    )


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import numpy as np

    for batch in batches:
        raw = batch["vector_bytes"]
        vectors = [None if b is None or len(b) % 4 else np.frombuffer(b, dtype="<f4").tolist() for b in raw]
        yield pd.DataFrame({"image_id": batch["image_id"], "dimensions": batch["dimensions"], "vector": pd.Series(vectors, dtype=object)})


def load_vectors(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Little-endian float32 bytes to arrays: (valid, quarantined) by length and finiteness."""
    rows = stored.select("image_id", "dimensions", "vector_bytes").mapInPandas(
        _decode, "image_id bigint, dimensions int, vector array<float>"
    )
    good = F.coalesce((F.size("vector") == F.col("dimensions")) & (F.col("dimensions") > 0) & is_finite(F.col("vector").cast("array<double>")), F.lit(False))
    return rows.filter(good), rows.filter(~good)
