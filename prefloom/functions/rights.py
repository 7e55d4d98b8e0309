"""Rights, provenance and size gates over candidate rows: one CASE each, first failing rule wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefloom import constants as c
from prefloom.functions.urls import host, https_host_is, path, scheme


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _int(name: str) -> Column:
    """Integer value, 0 when absent and NULL when malformed."""
    return F.coalesce(F.col(name).cast("string"), F.lit("0")).try_cast("bigint")


def license_url_matches(short_name: Column, url: Column) -> Column:
    """The licence link must point to the page family of the named licence."""
    at, where = host(url), path(url)
    commons = at == "creativecommons.org"
    public = (commons & where.contains("/publicdomain/")) | ((at == c.PAGE_HOST) & where.startswith("/wiki/public_domain"))
    return (scheme(url) == "https") & (
        F.when(short_name.startswith("CC BY-SA "), commons & where.contains("/licenses/by-sa/"))
        .when(short_name.startswith("CC BY "), commons & where.contains("/licenses/by/"))
        .when(short_name.isin("CC0", "CC0 1.0", "PDM 1.0", "Public domain"), public)
        .when(short_name.startswith("GFDL"), at.isin("gnu.org", "www.gnu.org") & where.contains("/copyleft/fdl"))
        .when(short_name.isin("FAL", "Free Art License"), at.isin("artlibre.org", "www.artlibre.org"))
        .otherwise(F.lit(False))
    )


def public_domain_evidence() -> Column:
    return (
        (_text("license") == "Public domain")
        & (F.lower(_text("license_identifier")) == "pd")
        & (F.lower(_text("copyrighted")) == "false")
        & (F.lower(_text("usage_terms")) == "public domain")
    )


def license_ok() -> Column:
    url = _text("license_url")
    return license_url_matches(_text("license"), url) | ((url == "") & public_domain_evidence())


def rejection_reason() -> Column:
    """Why a candidate fails the rights and quality gate; NULL when it passes."""
    width, height = _int("width"), _int("height")
    no_page_id = F.coalesce(F.col("provider_page_id").cast("bigint"), F.lit(0)) == 0
    return (
        F.when(width.isNull() | height.isNull(), c.REASON_DIMENSIONS)
        .when((F.least(width, height) < c.MIN_EDGE) | (width * height < c.MIN_PIXELS), c.REASON_RESOLUTION)
        .when(~_text("mime").isin(*c.ALLOWED_MIME), c.REASON_MIME)
        .when(~https_host_is(_text("source_url"), c.FILE_HOST), c.REASON_ORIGIN)
        .when(~https_host_is(_text("page_url"), c.PAGE_HOST), c.REASON_PAGE)
        .when(no_page_id | (_text("provider_sha1") == ""), c.REASON_IDENTIFIERS)
        .when((_text("title") == "") | (_text("creator") == ""), c.REASON_ATTRIBUTION)
        .when(F.lower(F.trim(_text("non_free"))).isin("1", "true", "yes"), c.REASON_NON_FREE)
        .when(~_text("license").isin(*c.FREE_LICENSES), c.REASON_LICENSE)
        .when(~license_ok(), c.REASON_LICENSE_URL)
    )


def thumbnail_reason() -> Column:
    width, height = _int("thumbnail_width"), _int("thumbnail_height")
    source_width, source_height = _int("width"), _int("height")
    fits = (
        (F.least(width, height) >= 1)
        & (F.greatest(width, height) <= c.THUMBNAIL_EDGE)
        & (width <= source_width)
        & (height <= source_height)
    )
    return (
        F.when(~https_host_is(_text("thumbnail_url"), c.FILE_HOST), c.REASON_THUMB_HOST)
        .when(~F.coalesce(fits, F.lit(False)), c.REASON_THUMB_SIZE)
    )


def source_size_reason(max_bytes: int) -> Column:
    size, width, height = _int("bytes"), _int("width"), _int("height")
    return (
        F.when(size.isNull() | width.isNull() | height.isNull(), c.REASON_METADATA)
        .when(size < 1, c.REASON_BYTES)
        .when(size > max_bytes, c.REASON_BYTE_CAP)
        .when((F.greatest(width, height) > c.MAX_EDGE) | (width * height > c.MAX_PIXELS), c.REASON_PIXEL_CAP)
    )


def aspect_agrees(width: Column, height: Column, other_width: Column, other_height: Column) -> Column:
    """Two aspect ratios within the tolerance of the larger one."""
    a, b = width / height, other_width / other_height
    return F.abs(a - b) <= F.lit(c.ASPECT_TOLERANCE) * F.greatest(F.abs(a), F.abs(b))


def download_mismatch() -> Column:
    """Why a measured file disagrees with its declared metadata; NULL when it agrees."""
    suffix = F.element_at(F.split("mime", "/"), -1)
    return (
        F.when((F.col("measured_width") != F.col("width")) | (F.col("measured_height") != F.col("height")),
               "downloaded dimensions differ from source metadata")
        .when(F.col("measured_format") != suffix, "downloaded format differs from source metadata")
        .when(~aspect_agrees(F.col("measured_width"), F.col("measured_height"), F.col("thumbnail_width"), F.col("thumbnail_height")),
              "thumbnail aspect ratio differs from Commons metadata")
    )
