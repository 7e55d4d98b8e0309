"""Connected components by contraction, in a number of rounds that grows with the logarithm of their size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.session import landed

#: Links, both ways counted, up to which one task joins what is left of them.
FEW = 1 << 18


def _joined(batches):
    """(u, next) for the nodes of few links: the first node met of each component."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    keys = [[tuple(x.values()) if isinstance(x, dict) else x for x in table[c].to_pylist()] for c in ("u", "v")]
    number: dict = {}
    u, v = ([number.setdefault(k, len(number)) for k in column] for column in keys)
    at = np.zeros(len(number), np.int64)
    at[u] = np.arange(len(u))  # links go both ways, so every node is a u
    root = list(range(len(number)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(u, v):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    ends = np.array([find(x) for x in range(len(number))])
    nodes = table["u"].combine_chunks()
    columns = [nodes.take(pa.array(at)), nodes.take(pa.array(at[ends]))]
    yield from pa.table(columns, names=["u", "next"]).to_batches()


def connected(links: DataFrame, a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """(node, component) of every node that ``links`` name; the component is its smallest node.

    Each round every label is drawn to that neighbour which comes first in an order that is hashed anew, if it comes before
    the label itself. At most half the labels are expected to come before all their neighbours, and runs of falling
    hashes are short, so three doublings of the pointers reach their ends. Links are then redrawn between the labels
    that are left. Chains in any order and stars of any size take a logarithmic number of rounds; the last ``few`` links
    are joined by one task. Nodes may be of any orderable type.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    # both ways come from one row: a Python step over shuffled rows, run once for each way, may give other links
    ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    arcs = landed(ends.select(ways.alias("way")).select("way.u", "way.v").distinct())
    labels = arcs.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("label"))
    number = 0
    while not arcs.isEmpty():
        number += 1
        turn = lambda column: F.struct(F.xxhash64(F.lit(number), column).alias("turn"), F.col(column).alias("at"))  # noqa: B023, E731
        if arcs.count() <= few:
            kind = arcs.schema["u"].dataType.simpleString()
            last = arcs.coalesce(1).mapInArrow(_joined, f"u {kind}, next {kind}").withColumnRenamed("u", "label")
            labels = landed(labels.join(last, "label", "left").select("node", F.coalesce("next", "label").alias("label")))
            break
        drawn = arcs.groupBy("u").agg(F.min(turn("v")).alias("first")).where(F.col("first") < turn("u"))
        drawn = landed(drawn.select("u", F.col("first.at").alias("next")))
        for _ in range(3):
            further = drawn.select(F.col("u").alias("next"), F.col("next").alias("further"))
            drawn = drawn.join(further, "next", "left").select("u", F.coalesce("further", "next").alias("next"))
        drawn = landed(drawn)
        to = lambda column: drawn.select(F.col("u").alias(column), F.col("next").alias(f"{column}_next"))  # noqa: B023, E731
        redrawn = arcs.join(to("u"), "u", "left").join(to("v"), "v", "left")
        arcs = landed(redrawn.select(F.coalesce("u_next", "u").alias("u"), F.coalesce("v_next", "v").alias("v")).where("u <> v").distinct())
        labels = landed(labels.join(to("label"), "label", "left").select("node", F.coalesce("label_next", "label").alias("label")))
    smallest = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(smallest, "label").select("node", "component")
