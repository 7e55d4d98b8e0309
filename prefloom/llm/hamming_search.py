"""Exact top-k search of binary codes with an incremental multi-index.

A code is cut into segments and every segment has an index of its own. Codes at distance at most
m * (r + 1) - 1 agree with the query in one of m segments up to r bits, so after all segments have
been searched to radius r everything that near is known. Radii grow until the k-th verified distance
is covered in this way.

Equal codes are one entry that keeps its ``k`` smallest ids, as no answer needs more of them. Entries
are dealt to blocks of bounded size, each with its segment indexes; the distinct query codes go to
the blocks in chunks of bounded size, and the blocks' answers, exact each, are merged.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefloom.llm.common import landed, ready


@dataclass(frozen=True)
class Settings:
    k: int = 10
    #: Bits of a segment; about the logarithm of a block's entries.
    segment: int = 16
    block: int = 1 << 16
    chunk: int = 1 << 12


def sign_codes(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id and code (packed sign bits, a null component counts as not positive) of rows that have both.

    Codes of shorter vectors end in zero bits.
    """
    ready(vectors)
    rows = vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull())
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    size = max(8, -(-width // 64) * 8)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            codes = []
            for v in batch.column("v"):
                bits = np.nan_to_num(v.values.to_numpy(zero_copy_only=False), nan=0.0) > 0
                code = np.packbits(bits).tobytes()
                codes.append(code + bytes(size - len(code)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(codes, pa.binary())], ["id", "code"])

    return rows.mapInArrow(run, "id long, code binary")


def masks(bits: int, radius: int) -> np.ndarray:
    """All numbers of ``bits`` bits with ``radius`` of them set."""
    return np.asarray([sum(1 << b for b in c) for c in combinations(range(bits), radius)], np.int64)


class Block:
    """The segment indexes over the codes of one block."""

    def __init__(self, codes: np.ndarray, segment: int):
        self.codes = codes
        bits = np.unpackbits(codes, axis=1)
        weights = 1 << np.arange(segment, dtype=np.int64)
        self.segments = [np.arange(a, min(a + segment, bits.shape[1])) for a in range(0, bits.shape[1], segment)]
        self.weights = weights
        self.tables = []
        for where in self.segments:
            value = bits[:, where].astype(np.int64) @ weights[: len(where)]
            order = np.argsort(value, kind="stable")
            bounds = np.searchsorted(value[order], np.arange((1 << len(where)) + 1))
            self.tables.append((order, bounds))
        self._masks: dict[tuple[int, int], np.ndarray] = {}

    def masks(self, bits: int, radius: int) -> np.ndarray:
        key = (bits, radius)
        if key not in self._masks:
            self._masks[key] = masks(bits, radius)
        return self._masks[key]

    def nearest(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of all codes as near as the k-th nearest, or nearer."""
        bits = np.unpackbits(query)
        values = [int(bits[w].astype(np.int64) @ self.weights[: len(w)]) for w in self.segments]
        known = np.zeros(len(self.codes), bool)
        place, distance = np.zeros(0, np.int64), np.zeros(0, np.int64)
        m = len(self.segments)
        for radius in range(max(map(len, self.segments)) + 1):
            found = []
            for value, where, (order, bounds) in zip(values, self.segments, self.tables):
                if radius > len(where):
                    continue
                probe = value ^ self.masks(len(where), radius)
                low, high = bounds[probe], bounds[probe + 1]
                full = high > low
                for a, z in zip(low[full].tolist(), high[full].tolist()):
                    found.append(order[a:z])
            if found:
                new = np.concatenate(found)
                new = np.unique(new[~known[new]])
                known[new] = True
                d = np.bitwise_count(self.codes[new] ^ query).sum(axis=1, dtype=np.int64)
                place, distance = np.concatenate([place, new]), np.concatenate([distance, d])
            covered = m * (radius + 1) - 1
            if len(place) >= min(k, len(self.codes)):
                kth = np.partition(distance, min(k, len(distance)) - 1)[min(k, len(distance)) - 1]
                if kth <= covered or len(place) == len(self.codes):
                    near = distance <= kth
                    return place[near], distance[near]
        return place, distance


def search(vectors: DataFrame, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, id, distance: for each row of ``queries`` (id, code) its k nearest rows of ``vectors`` (id, code).

    Ties in distance go to smaller ids; a query that is a row of ``vectors`` finds itself. Fewer than
    k rows give fewer answers; queries with equal ids are answered once per code.
    """
    ready(vectors)
    k = settings.k
    place = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    members = landed(vectors.select("id", "code").distinct().withColumn("place", place).where(F.col("place") <= k).select("code", "id", "place"))
    entries = members.where("place = 1").select("code")
    asked = landed(queries.select(F.col("id").alias("query_id"), "code").distinct())
    wanted = asked.select("code").distinct()
    blocks = max(1, -(-entries.count() // settings.block))
    chunks = max(1, -(-wanted.count() // settings.chunk))
    dealt = entries.select("code", F.pmod(F.xxhash64("code"), F.lit(blocks)).alias("block"))
    dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    spread = wanted.select("code", F.pmod(F.hash("code"), F.lit(chunks)).alias("chunk"))
    spread = spread.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def answer(key, left, right):
        import pyarrow as pa

        codes, queries = (np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, -1) for t in (left, right))
        out = [], [], []
        if len(codes) and len(queries):
            block = Block(codes, settings.segment)
            for query in queries:
                where, distance = block.nearest(query, k)
                # enough for any order of ids among equal distances is the full tie, cut by the merge
                out[0].extend([query.tobytes()] * len(where))
                out[1].extend(codes[p].tobytes() for p in where)
                out[2].extend(distance.tolist())
        return pa.table({"query": pa.array(out[0], pa.binary()), "code": pa.array(out[1], pa.binary()), "distance": pa.array(out[2], pa.int64())})

    near = dealt.groupBy("block", "chunk").cogroup(spread.groupBy("block", "chunk")).applyInArrow(answer, "query binary, code binary, distance long")
    best = Window.partitionBy("query").orderBy("distance", "id")
    ranked = near.join(members, "code").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.withColumnRenamed("code", "query"), "query").select("query_id", "rank", "id", "distance")
