"""Whitening of embeddings from exact integer scatter, counted in bit slices.

Entries become whole numbers. Each dimension, less its smallest value, is cut into bit planes; the bits of a
plane over 64 rows are one machine word. The number of ones that two planes share, weighted by the planes'
place values, gives every cross-product sum exactly, whatever the order of tasks. Sums are
centred as integers before they become doubles, so no rounding enters before the eigenvectors.

Vectors that are null or hold null, non-finite or unrepresentable (64 c beyond 2^53) entries are dropped, and
vectors of another width than most (the wider of two equally common) cannot be compared and are dropped
too. Repeated rows count each time; a null vec_id is kept. Where a component has no variance (one
row, equal or dependent dimensions) whitened and explained are 0, and identity_error leaves it out. An empty table
gives no rows. deviation is null where it does not fit in a long. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import arrow_map, ready

SCALE, SHIFT = 64, 1_000_000
#: Place values that share one sum, so that a task's sum stays far below 2^63.
GROUP = 16
#: Rows whose bits are counted at once.
ROWS = 1 << 14


@dataclass
class Whitening:
    """n, integer sums S, and the directions (columns) with their eigenvalues, shares and the error."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    directions: np.ndarray
    explained: np.ndarray
    identity_error: float


def vectors(frame: DataFrame) -> DataFrame:
    """vec_id, x (whole numbers) of the vectors that are kept, all of one width."""
    vector = F.col("embedding").cast("array<double>")
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= float(1 << 53) / SCALE))
    rows = frame.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("c")).where(F.col("embedding").isNotNull() & fine)
    width = rows.where(F.size("c") > 0).groupBy(F.size("c").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return rows.where(F.size("c") == (width["width"] if width else -1))


def _matrix(batch) -> np.ndarray:
    column = batch.column("c")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat.reshape(batch.num_rows, -1)).astype(np.int64) + SHIFT


def ranges(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, smallest and largest value per dimension."""

    def work(batch):
        x = _matrix(batch)
        yield {"dim": np.arange(x.shape[1]), "n": np.full(x.shape[1], len(x)), "low": x.min(axis=0), "high": x.max(axis=0)}

    per = arrow_map(rows, work, "dim int, n long, low long, high long").groupBy("dim").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = sorted(per.collect(), key=lambda r: r.dim)  # a row per dimension
    return (found[0].n if found else 0), np.array([r.low for r in found], np.int64), np.array([r.high for r in found], np.int64)


def planes(y: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of non-negative columns packed over rows into 64-bit words, with their dimension and place."""
    rows = -(-len(y) // 64) * 64
    dims, places = np.repeat(np.arange(y.shape[1]), bits), np.concatenate([np.arange(b) for b in bits])
    bit = np.zeros((len(dims), rows), np.uint8)
    bit[:, :len(y)] = (y.T[dims] >> places[:, None]) & 1
    return np.packbits(bit, axis=1).view(np.uint64), dims, places


def counted(y: np.ndarray, bits: np.ndarray) -> dict[tuple[int, int, int], int]:
    """(i, j, g) to the sum over i <= j of 2^(place sum - GROUP g) times the ones both planes share."""
    words, dims, places = planes(y, bits)
    out: dict[tuple[int, int, int], int] = {}
    for i in range(y.shape[1]):
        later = np.flatnonzero(dims >= i)
        for p in np.flatnonzero(dims == i):
            shared = np.bitwise_count(words[p] & words[later]).sum(axis=1, dtype=np.int64)
            exponent = places[p] + places[later]
            group = exponent // GROUP
            for g in np.unique(group):
                own = group == g
                sums = np.zeros(y.shape[1], np.int64)
                np.add.at(sums, dims[later[own]], shared[own] << (exponent[own] - GROUP * g))
                for j in np.flatnonzero(sums):
                    out[i, int(j), int(g)] = out.get((i, int(j), int(g)), 0) + int(sums[j])
    return out


def scatter(rows: DataFrame, low: np.ndarray, high: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact sums of x - low and of all its cross-products, as Python integers."""
    bits = np.maximum(1, [int(h - b).bit_length() for h, b in zip(high, low)])
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = "i int, j int, g int, total decimal(38,0)"
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        from decimal import Decimal

        import pyarrow as pa

        total: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            x = _matrix(batch) - low
            for start in range(0, len(x), ROWS):
                block = x[start:start + ROWS]
                for key, value in counted(block, bits).items():
                    total[key] = total.get(key, 0) + value
                for i, value in enumerate(block.sum(axis=0, dtype=object)):
                    total[i, -1, 0] = total.get((i, -1, 0), 0) + int(value)
        keys = list(total)
        columns = [pa.array([k[c] for k in keys], pa.int32()) for c in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([Decimal(total[k]) for k in keys], pa.decimal128(38, 0))], schema=target)

    summed = rows.mapInArrow(run, schema).groupBy("i", "j", "g").agg(F.sum("total").cast("decimal(38,0)").alias("total"))
    width = len(low)
    sums, products = [0] * width, [[0] * width for _ in range(width)]
    for r in summed.collect():  # a few rows per pair of dimensions, whatever the number of vectors
        if r.j < 0:
            sums[r.i] = int(r.total)
        else:
            products[r.i][r.j] += int(r.total) << (GROUP * r.g)
            products[r.j][r.i] = products[r.i][r.j]
    return sums, products


def fit(rows: DataFrame, components: int = 32) -> Whitening | None:
    """The whitening of kept vectors, or none where there are none."""
    n, low, high = ranges(rows)
    if not n:
        return None
    sums, products = scatter(rows, low, high)
    width = len(low)
    centred = [[n * products[i][j] - sums[i] * sums[j] for j in range(width)] for i in range(width)]
    largest = max(1, max(centred[i][i] for i in range(width)))
    # scaled to at most 1 by exact ratios, so that the size of the numbers does not matter
    unit = np.array([[float(Fraction(c, largest)) for c in row] for row in centred])
    values, directions = np.linalg.eigh(unit)
    order = np.argsort(values)[::-1][:components]
    directions, kept = directions[:, order], values[order]
    positive = kept > width * np.finfo(float).eps * max(kept[0], 0)
    scale = float(Fraction(largest, n * n))
    trace = float(Fraction(sum(centred[i][i] for i in range(width)), largest))
    kept = np.where(positive, kept, 0.0)
    explained = kept / trace if trace else np.zeros(len(kept))
    with np.errstate(divide="ignore"):
        factors = np.where(positive, 1 / np.sqrt(kept), 0.0)
    own = directions[:, positive] * factors[positive]
    error = float(np.abs(own.T @ unit @ own - np.eye(positive.sum())).max()) if positive.any() else 0.0
    return Whitening(n, [s + n * int(b) for s, b in zip(sums, low)], kept * scale, directions, explained, error)


def whiten(embeddings: DataFrame, components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every kept vector."""
    spark = ready(embeddings)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors(embeddings)
    model = fit(rows, components)
    if model is None:
        return spark.createDataFrame([], schema)
    k, n, error, explained = len(model.eigenvalues), model.n, model.identity_error, model.explained
    sums = np.array(model.sums, dtype=object)
    with np.errstate(divide="ignore"):
        project = model.directions * np.where(model.eigenvalues > 0, 1 / np.sqrt(model.eigenvalues), 0.0)

    def work(batch):
        x = _matrix(batch)
        far = max(int(np.abs(x).max()), 1)
        if n * far < 1 << 61:
            apart = n * x - sums.astype(np.int64)
        else:
            apart = n * x.astype(object) - sums
        bound = max(int(abs(apart.max())), int(abs(apart.min())))
        if bound * bound * x.shape[1] < 1 << 63:
            exact = (apart * apart).sum(axis=1).tolist()
        else:
            exact = [v if v < 1 << 63 else None for v in (apart.astype(object) ** 2).sum(axis=1)]
        values = (apart.astype(float) / n) @ project
        import pyarrow as pa

        index = np.repeat(np.arange(len(x)), k)
        yield {
            "vec_id": batch.column("vec_id").take(pa.array(index)), "component": np.tile(np.arange(1, k + 1), len(x)), "n": np.full(len(index), n),
            "deviation": pa.array(exact, pa.int64()).take(pa.array(index)), "whitened": values.ravel(),
            "explained": np.tile(explained, len(x)), "identity_error": np.full(len(index), error),
        }

    return arrow_map(rows, work, schema)
