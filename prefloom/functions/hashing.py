"""Digests, reproducible coins and content-addressed paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefloom import constants as c


def digest(*parts: Column | str) -> Column:
    """sha256 hex of the parts joined by colons; strings name columns."""
    return F.sha2(F.concat_ws(":", *[p if isinstance(p, Column) else F.col(p) for p in parts]), 256)


def coin(*parts: Column | str) -> Column:
    """A uniform fraction in [0, 1) that is the same in every run."""
    head = F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("bigint")
    return head / F.lit(4294967296.0)


def token_digest(token: Column) -> Column:
    """Stored form of a well-formed token, NULL otherwise."""
    return F.when(token.rlike(c.TOKEN_PATTERN), F.sha2(token, 256))


def image_path(sha256: Column, extension: Column) -> Column:
    return F.concat(F.lit("images/"), sha256, F.lit("/original."), extension)


def rendition_path(sha256: Column, kind: str) -> Column:
    return F.concat(F.lit("images/"), sha256, F.lit(f"/{kind}.webp"))


def model_path(user_id: Column, cutoff: Column, sha256: Column) -> Column:
    namespace = F.substring(F.sha2(user_id.cast("string"), 256), 1, 24)
    return F.concat(F.lit("models/"), namespace, F.lit("/head-"), cutoff.cast("string"), F.lit("-"), sha256, F.lit(".npz"))
