"""Small helpers the operators of this package share.

Every operator reads only the columns it names, so other columns, whatever they are called, are
ignored (filters carry them along). A null ``doc_id`` counts as one more, smallest id; a null text
counts as empty.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.session import checkpoint_dir, prepare

NULL_ID = -(1 << 63)
#: Words that a task's process remembers for each operator.
REMEMBERED = 200_000
#: Rows of an Arrow batch; texts are long, and a process holds a few batches.
BATCH_ROWS = 2000


def ready(frame: DataFrame) -> SparkSession:
    """The session of a frame, with the package shipped to the executors."""
    spark = frame.sparkSession
    prepare(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def keyed(frame: DataFrame, *others: str) -> DataFrame:
    """doc_id and text without nulls, and the other columns asked for."""
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id")
    return frame.select(doc_id, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *others)


def unused(frame: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame has not got, in whatever case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def original_id(name: str = "doc_id") -> Column:
    """The id as it was before ``keyed``."""
    return F.when(F.col(name) != F.lit(NULL_ID), F.col(name)).alias(name)


def landed(frame: DataFrame) -> DataFrame:
    """The frame written once to the shared folder and read back, so that its work is not redone."""
    spark = frame.sparkSession
    path = f"{checkpoint_dir(spark)}/landed-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete what ``landed`` wrote, once nothing will read it again.

    Shuffle files go when the driver's JVM collects the plans that made them, so it is asked to.
    """
    for frame in frames:
        context = frame.sparkSession.sparkContext
        for file in frame.inputFiles()[:1]:
            folder = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
        context._jvm.System.gc()


def arrow_map(frame: DataFrame, work: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """Apply ``work`` to each Arrow batch; it yields dictionaries of equally long columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for columns in work(batch):
                    yield pa.RecordBatch.from_arrays(
                        [x if isinstance(x, pa.Array) else pa.array(x, f.type) for f in target for x in [columns[f.name]]],
                        schema=target,
                    )

    return frame.mapInArrow(run, schema)


def binary(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def parts(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text at most (one row at least)."""
    sizes = np.cumsum([len(x or b"") for x in binary(batch, "text")])
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def runs(batches, columns):
    """Runs of equal first column over sorted batches, as lists of column arrays (memory: one run)."""
    held: list[list] = []
    last = None
    for batch in batches:
        values = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        key = values[0]
        if not len(key):
            continue
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            piece = [v[a:b] for v in values]
            if held and key[a] != last:
                yield [np.concatenate(x) for x in zip(*held)]
                held = []
            last = key[a]
            held.append(piece)
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser over unsigned numbers."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """What a task's process remembers for one operator; the memory of any other is let go first."""
    if name not in _HELD:
        _HELD.clear()
        returned()
        _HELD[name] = make()
    return _HELD[name]


def returned() -> None:
    """Give freed memory back to the system; a worker process lives through many tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


class Hashes(dict):
    """64-bit hashes of words, remembered; emptied when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def components(edges: DataFrame, low: str = "a", high: str = "b") -> DataFrame:
    """Columns node and component (the smallest node that links reach) for all nodes of ``edges``.

    Each round hangs every label below its smallest neighbour, follows pointers twice and contracts
    the links to those between the labels that are left. Stars of any size take one round, chains
    a logarithmic number. Nothing reaches the driver but whether links are left.
    """
    links = edges.select(F.col(low).alias("a"), F.col(high).alias("b")).where("a <> b")
    links = landed(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = landed(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("c")))
    to = labels.select(F.col("node").alias("from"), F.col("c").alias("to"))
    while True:
        ends = links.join(to.toDF("a", "to_a"), "a", "left").join(to.toDF("b", "to_b"), "b", "left")
        contracted = ends.select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
        old, links = links, landed(contracted.where("a <> b").distinct())
        discard(old)
        if links.isEmpty():
            return labels.select("node", F.col("c").alias("component"))
        hung = links.groupBy(F.col("a").alias("from")).agg(F.min("b").alias("to")).where("to < from")
        for _ in range(2):
            hung = hung.join(hung.toDF("to", "next"), "to", "left").select("from", F.coalesce("next", "to").alias("to"))
        to = landed(hung)
        moved = labels.join(to.toDF("c", "to"), "c", "left").select("node", F.coalesce("to", "c").alias("c"))
        old, labels = labels, landed(moved)
        discard(old)
