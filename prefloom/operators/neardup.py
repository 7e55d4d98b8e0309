"""Near-duplicate rejection on unit vectors, exact at any size of library, cluster or chain.

Cosine >= t on unit vectors means a distance of at most r = sqrt(2 - 2t). If a vector is cut into m
parts, one part of two such vectors differs by at most r / sqrt(m). Every part is filed in a tree of cells:
cells of more than ``limit`` rows are split at the median of their widest coordinate, as often as it
takes, so the number of cells follows the number of rows. A row is filed on one side of each cut; a probe visits
both where its ball reaches across. Cells that cannot be split (crowds within the radius) are
dealt out in chunks. Cells hold parts only: these are compared first, as matrices in blocks of bounded size, and
whole vectors come in for the rows of a cell whose parts meet another there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.constants import NEAR_DUPLICATE_COSINE
from prefloom.functions.hashing import coin
from prefloom.operators.components import connected
from prefloom.operators.ordered import top_per_key
from prefloom.session import landed

#: Rows of an open cell that its cuts are taken from, and levels of cuts per round.
SAMPLE, LEVELS = 256, 5
CUTS = "dims array<int>, cuts array<double>"


class Grid:
    """How vectors of one width are filed: parts, rows of a cell, and rows settled at once."""

    def __init__(self, dimensions: int, threshold: float = NEAR_DUPLICATE_COSINE, parts: int = 8, limit: int = 4096, settled: int = 2048):
        self.threshold = threshold
        self.radius = math.sqrt(2.0 - 2.0 * threshold) + 1e-6
        self.width = -(-dimensions // min(parts, dimensions))
        self.parts = -(-dimensions // self.width)
        self.padding = self.parts * self.width - dimensions
        self.reach = self.radius / math.sqrt(self.parts) + 1e-9
        self.limit, self.settled = limit, settled


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


# -- blocks of bounded size -----------------------------------------------------


def _compared(home: DataFrame, probes: DataFrame, by: Sequence[str], limit: int, work: Callable, schema: str) -> DataFrame:
    """``work(home table, probe table)`` on blocks of at most about ``limit`` rows a side that cover each group of ``by``."""
    by = list(by)
    sizes = landed(home.groupBy(*by).agg(F.ceil(F.count("*") / limit).alias("chunks")).join(
        probes.groupBy(*by).agg(F.ceil(F.count("*") / limit).alias("slices")), by
    ))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    left = home.join(sizes, by).select(*home.columns, own("chunks").alias("chunk"), every("slices").alias("slice"))
    right = probes.join(sizes, by).select(*probes.columns, own("slices").alias("slice"), every("chunks").alias("chunk"))
    block = [*by, "chunk", "slice"]
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # both may come from one frame
    return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(work, schema)


def _near(home: DataFrame, probes: DataFrame, by: Sequence[str], keys: Sequence[str], grid: Grid) -> DataFrame:
    """(keys, id) of probes with a home vector of their group at or above the threshold."""
    keys, threshold = list(keys), grid.threshold

    def work(left, right):
        if not left.num_rows:
            return right.select([*keys, "id"]).slice(0, 0)
        hit = (_matrix(right["vector"]) @ _matrix(left["vector"]).T).max(axis=1, initial=-2.0) >= threshold if right.num_rows else []
        return right.select([*keys, "id"]).filter(pa.array(hit, pa.bool_()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in probes.select(*keys, "id").schema)
    return _compared(home, probes, by, grid.limit, work, schema).distinct()


# -- cells ----------------------------------------------------------------------


def _best_cut(x: np.ndarray, reach: float) -> tuple[int, float, np.ndarray] | None:
    """(dimension, value, rows below) of the cut of the widest coordinate that saves most comparisons, if any does.

    Sides are weighed by the rows filed there times the probes that reach there.
    """
    dim = int(np.argmax(x.std(axis=0)))
    value = x[:, dim]
    best, out = 0.95, None
    for at in np.unique(np.quantile(value, (0.1, 0.25, 0.5, 0.75, 0.9))):
        low = value <= at
        work = low.mean() * (value - reach <= at).mean() + (~low).mean() * (value + reach > at).mean()
        if not low.all() and work < best:
            best, out = work, (dim, float(at), low)
    return out


def _cuts(grid: Grid):
    """Cuts for a few levels below a cell, in heap order; dimension -1 where no cut helps or few enough rows are left."""

    def build(key, rows):
        x = _matrix(rows["piece"])
        whole = np.asarray(rows["n"])[0] / len(x)
        dims, cuts = [-1] * (2**LEVELS - 1), [0.0] * (2**LEVELS - 1)

        def cut(node: int, own: np.ndarray) -> None:
            wanted = node < 2**LEVELS and len(own) >= 4 and (node == 1 or len(own) * whole > 0.75 * grid.limit)
            found = _best_cut(own, grid.reach) if wanted else None
            if found:
                dims[node - 1], cuts[node - 1], low = found
                cut(2 * node, own[low])
                cut(2 * node + 1, own[~low])

        cut(1, x)
        cell = {name: rows[name].slice(0, 1) for name in rows.column_names if name not in ("piece", "n")}
        return pa.table({**cell, "dims": pa.array([dims], pa.list_(pa.int32())), "cuts": pa.array([cuts], pa.list_(pa.float64()))})

    return build


def _descended(grid: Grid, names: list[str]):
    """Rows moved down their cell's cuts: filed rows on one side of each, probes on every side they reach."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["piece"])
            has = np.asarray(batch["dims"].is_valid())
            reach = np.where(np.asarray(batch["probe"]), grid.reach, 0.0)
            dims, cuts = np.full((len(x), 2**LEVELS - 1), -1), np.zeros((len(x), 2**LEVELS - 1))
            if has.any():
                dims[has] = _matrix(batch["dims"].filter(pa.array(has)))
                cuts[has] = _matrix(batch["cuts"].filter(pa.array(has)))
            row, node = np.arange(len(x)), np.ones(len(x), np.int64)
            path = np.asarray(batch["path"]).copy()
            moved = np.zeros(len(x), bool)
            for _ in range(LEVELS):
                dim = dims[row, np.minimum(node, 2**LEVELS - 1) - 1]
                cutting = (dim >= 0) & (node < 2**LEVELS)
                at = cuts[row, np.minimum(node, 2**LEVELS - 1) - 1]
                value = x[row, np.maximum(dim, 0)]
                low, high = cutting & (value - reach[row] <= at), cutting & (value + reach[row] > at)
                row = np.concatenate([row[~cutting], row[low], row[high]])
                path = np.concatenate([path[~cutting], 2 * path[low], 2 * path[high] + 1])
                moved = np.concatenate([moved[~cutting], np.ones(low.sum() + high.sum(), bool)])
                node = np.concatenate([np.full((~cutting).sum(), 2**LEVELS), 2 * node[low], 2 * node[high] + 1])
            out = batch.select(names).take(pa.array(row))
            columns = [pa.array(path) if n == "path" else pa.array(moved) if n == "open" else out[n] for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def filed(home: DataFrame, probes: DataFrame, keys: Sequence[str], grid: Grid) -> DataFrame:
    """(keys, part, path, id, piece, probe): the cells of filed rows and those that probes visit, with their part.

    Every pair of a probe and a row of its keys within the radius shares a cell. Rounds take cells up to ``LEVELS`` cuts
    deeper, so their number is the logarithm of the largest group; cuts come from samples, which decide sizes only.
    Rows of cells that are small enough are not written again.
    """
    keys = list(keys)
    cell = [*keys, "part", "path"]
    both = home.select(*keys, "id", "vector", F.lit(False).alias("probe")).unionByName(probes.select(*keys, "id", "vector", F.lit(True).alias("probe")))
    part = F.explode(F.sequence(F.lit(0), F.lit(grid.parts - 1)))
    both = both.select(*keys, part.alias("part"), F.lit(1).cast("bigint").alias("path"), "id", "vector", "probe")
    padded = F.concat("vector", F.array_repeat(F.lit(0.0), grid.padding)) if grid.padding else F.col("vector")
    piece = F.slice(padded, F.col("part") * grid.width + 1, F.lit(grid.width))
    rows = landed(both.select(*cell, "id", piece.alias("piece"), "probe", F.lit(True).alias("open")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*cell).schema)
    full = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    done = []
    while True:
        sizes = landed(rows.where("open AND NOT probe").groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > grid.limit))
        if sizes.isEmpty():
            return reduce(DataFrame.unionByName, [*done, rows]).drop("open")
        drawn = rows.where("NOT probe").join(sizes, cell).where(coin("id", "part", "path") < SAMPLE / F.col("n")).select(*cell, "piece", "n")
        cuts = landed(drawn.groupBy(*cell).applyInArrow(_cuts(grid), f"{schema}, {CUTS}"))
        done.append(rows.join(sizes, cell, "left_anti").select(*rows.columns))
        large = rows.join(sizes, cell, "left_semi").join(cuts, cell, "left")
        rows = landed(large.mapInArrow(_descended(grid, rows.columns), full))


def _meeting(grid: Grid, names: list[str], same: bool):
    """Rows and probes of a block whose parts are within reach of another's; with ``same`` ids, a row is not its own."""

    def work(left, right):
        left_names, right_names = left.select(names), right.select(names)
        if not left.num_rows or not right.num_rows:
            return left_names.slice(0, 0)
        a, b = _matrix(left["piece"]), _matrix(right["piece"])
        apart = b @ a.T
        apart *= -2.0
        apart += (a * a).sum(axis=1)
        apart += (b * b).sum(axis=1)[:, None]
        near = apart <= grid.reach**2 + 1e-9
        if same:
            near &= np.asarray(right["id"])[:, None] != np.asarray(left["id"])
        return pa.concat_tables([left_names.filter(pa.array(near.any(axis=0))), right_names.filter(pa.array(near.any(axis=1)))])

    return work


def _met(home: DataFrame, probes: DataFrame, keys: Sequence[str], grid: Grid, same: bool) -> tuple[DataFrame, DataFrame]:
    """(keys, part, path, id, vector) of the rows, and of the probes, whose parts meet another in a cell.

    Two vectors within the radius have a part within reach, so they are both left in the cell of that part.
    """
    cell = [*keys, "part", "path"]
    names = [*cell, "id", "probe"]
    cells = filed(home, probes, keys, grid)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*names).schema)
    met = landed(_compared(cells.where("NOT probe"), cells.where("probe"), cell, grid.limit, _meeting(grid, names, same), schema).distinct())
    whole = lambda side, of: met.where(side).drop("probe").join(of.select(*keys, "id", "vector"), [*keys, "id"]).select(*cell, "id", "vector")
    return whole("NOT probe", home), whole("probe", probes)


# -- operators ------------------------------------------------------------------


def near_library(candidates: DataFrame, library: DataFrame, keys: Sequence[str], grid: Grid) -> DataFrame:
    """(keys, id) of candidates with a library vector of the same keys at or above the threshold.

    Every candidate meets a first ``limit`` of its keys' library, which settles small libraries and crowds of
    copies; only what is left of larger ones goes to the cells.
    """
    keys = list(keys)
    home = landed(library.groupBy(*keys, F.xxhash64("vector").alias("id"), "vector").agg(F.first(F.lit(1)).alias("_one")).drop("_one"))
    probes = landed(candidates.select(*keys, "id", "vector"))
    ids = landed(top_per_key(home.select(*keys, "id"), keys, [F.col("id")], grid.limit, "_n", spread="id").drop("_n"))
    first = home.join(ids, [*keys, "id"], "left_semi")
    found = landed(_near(first, probes, keys, keys, grid))
    large = landed(home.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > grid.limit).select(*keys))
    if large.isEmpty():
        return found
    open_ = probes.join(found, [*keys, "id"], "left_anti").join(large, keys, "left_semi")
    met = _met(home.join(large, keys, "left_semi"), open_, keys, grid, same=False)
    return found.unionByName(_near(*met, [*keys, "part", "path"], keys, grid)).distinct()


def _forest(grid: Grid, keys: list[str]):
    """Links between rows of a block that join what its similar pairs join; at most one a row.

    They do not depend on the order in which rows arrive, which differs from run to run on a cluster.
    """

    def work(left, right):
        left, right = left.sort_by("id"), right.sort_by("id")
        a, b = [], []
        if left.num_rows and right.num_rows:
            near = _matrix(right["vector"]) @ _matrix(left["vector"]).T >= grid.threshold
            of_left, of_right = np.asarray(left["id"]), np.asarray(right["id"])
            new_left, new_right = np.ones(len(of_left), bool), np.ones(len(of_right), bool)
            for start in range(len(of_right)):
                if not new_right[start]:
                    continue
                front = np.zeros(len(of_right), bool)
                front[start], new_right[start] = True, False
                while front.any():
                    met = near[front].any(axis=0) & new_left
                    new_left &= ~met
                    front = near[:, met].any(axis=1) & new_right
                    new_right &= ~front
                    reached = np.concatenate([of_left[met], of_right[front]])
                    b.append(reached[reached != of_right[start]])
                    a.append(np.full(len(b[-1]), of_right[start]))
        flat = lambda xs: np.concatenate(xs) if xs else np.empty(0, np.int64)
        a, b = flat(a), flat(b)
        group = left.select(keys).take(pa.array(np.zeros(len(a), np.int64))) if len(a) else left.select(keys).slice(0, 0)
        return pa.table({**{k: group[k] for k in keys}, "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return work


def _settled(threshold: float, names: list[str]):
    """The greedy choice among few rows: in rank order a row stays unless a kept earlier one is similar."""

    def work(key, rows):
        order = np.argsort(np.asarray(rows["id"]), kind="stable")
        x = _matrix(rows["vector"])[order]
        near = x @ x.T >= threshold
        blocked, kept = np.zeros(len(x), bool), []
        for i in range(len(x)):
            if not blocked[i]:
                kept.append(i)
                blocked |= near[i]
        return rows.select(names).take(pa.array(order[kept]))

    return work


def _settle(open_: DataFrame, by: Sequence[str], keys: list[str], grid: Grid) -> tuple[DataFrame, DataFrame]:
    """The first rows of every group of ``by`` settled: what they keep, and what stays open behind them."""
    by = list(by)
    largest = open_.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    whole = largest <= grid.settled
    if whole:
        first = open_
    else:
        ids = landed(top_per_key(open_.select(*by, "id"), by, [F.col("id")], grid.settled, "_n", spread="id").drop("_n").select(*keys, "id"))
        first = open_.join(ids, [*keys, "id"], "left_semi").select(*open_.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in open_.schema)
    alone = first.groupBy(*by).agg(F.count("*").alias("_n")).where("_n = 1").select(*by)
    crowd = first.join(alone, by, "left_anti").groupBy(*by).applyInArrow(_settled(grid.threshold, open_.columns), schema)
    kept = landed(first.join(alone, by, "left_semi").select(*open_.columns).unionByName(crowd))
    if whole:
        return kept, open_.limit(0)
    rest = open_.join(ids, [*keys, "id"], "left_anti").select(*open_.columns)
    beaten = landed(_near(kept, rest, by, keys, grid))
    return kept, landed(rest.join(beaten, [*keys, "id"], "left_anti"))


def greedy_distinct(ranked: DataFrame, keys: Sequence[str], grid: Grid) -> DataFrame:
    """Kept (keys, rank): in rank order a row stays unless a *kept* earlier row is similar.

    Exact copies collapse to their first row beforehand, which does not change the outcome. The first
    ``settled`` rows of each key are settled together and drop what is similar to them, which ends
    small keys and large crowds. What is left falls into components of similar rows; each is settled on its own, a
    bounded number of its first rows at a time, so rounds follow its size over that number and not the longest
    chain. ``ranked`` has keys, rank (unique per keys) and vector.
    """
    keys = list(keys)
    distinct = ranked.groupBy(*keys, F.xxhash64("vector").alias("_h"), "vector").agg(F.min("rank").cast("bigint").alias("id"))
    kept, open_ = _settle(landed(distinct.select(*keys, "id", "vector")), keys, keys, grid)
    done = [kept.select(*keys, F.col("id").alias("rank"))]
    if not open_.isEmpty():
        home, probes = _met(open_, open_, keys, grid, same=True)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in open_.select(*keys).schema) + ", a bigint, b bigint"
        links = _compared(home, probes, [*keys, "part", "path"], grid.limit, _forest(grid, keys), schema)
        node = lambda name: F.struct(*keys, F.col(name).alias("id"))
        groups = connected(links.select(node("a").alias("a"), node("b").alias("b")))
        group = groups.select(*[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.id").alias("id"), F.col("component.id").alias("component"))
        open_ = landed(open_.join(group, [*keys, "id"], "left").withColumn("component", F.coalesce("component", "id")))
    while not open_.isEmpty():
        kept, open_ = _settle(open_, [*keys, "component"], keys, grid)
        done.append(kept.select(*keys, F.col("id").alias("rank")))
    return reduce(DataFrame.unionByName, done)
