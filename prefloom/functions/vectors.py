"""Dense vector column expressions over arrays of doubles."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    length = norm(a)
    return F.transform(a, lambda x: x / length)


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def is_finite(vector: Column) -> Column:
    limit = F.lit(float("inf"))
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (x < limit) & (x > -limit))


def directions(count: int, dimensions: int) -> list[list[float]]:
    """Fixed unit directions with pseudo-random signs."""
    size = 1.0 / math.sqrt(dimensions)
    out = []
    for k in range(count):
        bits = b"".join(hashlib.sha256(f"{k}:{block}".encode()).digest() for block in range(dimensions // 256 + 1))
        out.append([size if bits[i // 8] >> (i % 8) & 1 else -size for i in range(dimensions)])
    return out


def sigmoid(x: Column) -> Column:
    """Logistic function; in doubles an overflowing exponential ends in exactly zero."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
