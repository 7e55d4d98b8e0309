"""Order-dependent building blocks that survive one key owning a large share of the rows.

A plain ``Window.partitionBy(key).orderBy(...)`` puts a whole key into one task. Here a key
is cut into consecutive chunks along its order, per-chunk totals are pre-aggregated (map-side
combine), the totals alone are accumulated per key, and rows only ever meet the rows of their
own (key, chunk). Results are exact: no row is dropped, sampled or approximated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefloom.constants import CHUNK_BITS
from prefloom.session import landed

# Above this rank the optimizer no longer cuts groups before the shuffle by itself.
NATIVE_GROUP_LIMIT = 1000


def id_chunk(column: str, bits: int = CHUNK_BITS) -> Column:
    """Chunk of a unique integer id: at most 2**bits rows each."""
    return F.shiftright(F.col(column).cast("bigint"), bits)


def hour_chunk(column: str) -> Column:
    """Chunk of a timestamp order."""
    return F.floor(F.unix_micros(F.col(column)) / F.lit(3_600_000_000))


def grid_chunk(column: str, width: float) -> Column:
    """Chunk of a numeric order on a fixed grid."""
    return F.floor(F.col(column) / F.lit(float(width)))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    chunk: Column,
    sums: Mapping[str, Column],
    *,
    inclusive: bool = True,
) -> DataFrame:
    """Add running sums along ``order``; ``chunk`` must not decrease along it."""
    rows = df.withColumn("_chunk", chunk)
    totals = rows.groupBy(*keys, "_chunk").agg(
        *[F.sum(value).alias(f"_t_{name}") for name, value in sums.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_chunk",
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    frame = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    frame = frame.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = rows.join(offsets, [*keys, "_chunk"])
    for name, value in sums.items():
        inner = F.coalesce(F.sum(value).over(frame), F.lit(0))
        joined = joined.withColumn(name, F.col(f"_o_{name}") + inner)
    return joined.drop("_chunk", *[f"_o_{n}" for n in sums])


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    chunk: Column,
    name: str = "position",
) -> DataFrame:
    """Add a 1-based position along ``order`` for keys of any size."""
    return running(df, keys, order, chunk, {name: F.lit(1).cast("bigint")})


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """Add a 1-based position along any ``order`` for keys of any size.

    One range sort over all keys, written once; a row's place is its place in the file plus the sizes of the files
    before it, less the first place of its key. ``order`` decides every tie that matters; keys are not null.
    """
    files = df.orderBy(*keys, *order).withColumn("_file", F.spark_partition_id())
    rows = landed(files.withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = rows.groupBy("_file").count()  # one row per shuffle partition
    before = F.coalesce(F.sum("count").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sizes.select("_file", before.alias("_before")), "_file").withColumn("_at", F.col("_at") + F.col("_before"))
    first = rows.groupBy(*keys).agg(F.min("_at").alias("_first"))
    return rows.join(first, list(keys)).withColumn(name, F.col("_at") - F.col("_first") + 1).drop("_file", "_at", "_before", "_first")


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    name: str,
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """Value of the preceding row by a unique integer ``order`` (a lag for keys of any size)."""
    rows = df.withColumn("_chunk", id_chunk(order, bits))
    last = rows.groupBy(*keys, "_chunk").agg(F.max_by(value, order).alias("_last"))
    carried = last.select(
        *keys, "_chunk", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carry")
    )
    frame = Window.partitionBy(*keys, "_chunk").orderBy(order)
    first = F.row_number().over(frame) == 1
    return (
        rows.join(carried, [*keys, "_chunk"])
        .withColumn(name, F.when(first, F.col("_carry")).otherwise(F.lag(value).over(frame)))
        .drop("_chunk", "_carry")
    )


def top_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    name: str = "position",
    spread: str | None = None,
    slices: int = 64,
) -> DataFrame:
    """Keep the first ``n`` rows per key, with their 1-based position.

    Up to ``NATIVE_GROUP_LIMIT`` rows Catalyst cuts each group before the shuffle. Beyond it
    every key is first cut inside ``slices`` hash slices of ``spread``, so the last task of a
    hot key sees at most ``slices * n`` rows.
    """
    if n > NATIVE_GROUP_LIMIT and spread is not None:
        piece = F.pmod(F.xxhash64(spread), F.lit(slices))
        local = Window.partitionBy(*keys, piece).orderBy(*order)
        df = df.withColumn("_local", F.row_number().over(local)).filter(F.col("_local") <= n).drop("_local")
    frame = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(frame))
        .filter(F.col("_rn") <= n)
        .withColumn(name, F.col("_rn").cast("bigint"))
        .drop("_rn")
    )


def _best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_of_key", number).filter("_of_key = 1").select(*keys, *rest)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row per key; Catalyst cuts every key to one row per map task before the shuffle."""
    return _best_per_key(df, keys, [(F.col(o) if isinstance(o, str) else o).asc_nulls_first() for o in order])


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row per key, cut like :func:`first_per_key`."""
    return _best_per_key(df, keys, [(F.col(o) if isinstance(o, str) else o).desc_nulls_last() for o in order])
