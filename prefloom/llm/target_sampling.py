"""Importance resampling towards a target distribution.

Features are runs of one to three words, counted in hashed buckets over all documents and over the
target. A bucket's gain is the rounded log ratio of the two; a document's weight is the sum of its
features' gains, and Gumbel noise from the hash of its id makes the highest scores a draw without replacement.
Gains are one array of fixed length, which scores whole batches of text. The draw is a
numeric threshold: the cutoff score, then the cutoff id among its ties, are found by bisection, each step
an exact count over the written scores. Selected rows are range-partitioned for their ranks.

Nulls and empty texts have no features and weight 0; a null id has an empty id text. Rows that repeat are
documents of their own; equal score and id are ranked by the order of the written rows. An
empty table gives no rows, an empty target gives gains like any other. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import arrow_map, binary, discard, keyed, landed, original_id, parts, ready

BUCKETS = 10_000
#: A-Z in lower case, every byte that ends a word as a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
BLOCK = 4 << 20
WORD_END = re.compile(rb"[^ ]*")
TWO_MORE = re.compile(rb" *[^ ]* *[^ ]*")
#: Words longer than this are hashed and shifted one by one.
LONG = 63


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The checksum's byte table, and for each length what appending that many bytes does to each byte of a checksum."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> 1) ^ (np.uint32(0xEDB88320) * (step & 1))
    now = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    shifts = [now]
    for _ in range(LONG + 1):
        now = step[now & 255] ^ (now >> 8)
        shifts.append(now)
    return step, np.stack(shifts)


STEP, SHIFT = _tables()


def _shift(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums as they are after so many more zero bytes, without the bytes' own share."""
    left, out = lengths.astype(np.int64), crc
    while True:
        now = np.minimum(left, LONG + 1)
        out = SHIFT[now, 0, out & 255] ^ SHIFT[now, 1, (out >> 8) & 255] ^ SHIFT[now, 2, (out >> 16) & 255] ^ SHIFT[now, 3, out >> 24]
        left = left - now
        if not left.any():
            return out


def _word_sums(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC32 of every word, letter position by letter position."""
    lengths = ends - starts
    letters = np.frombuffer(data, np.uint8)
    order = np.argsort(np.minimum(lengths, LONG + 1).astype(np.uint8), kind="stable")[::-1]
    first, size = starts[order], np.minimum(lengths[order], LONG + 1)
    counts = len(size) - np.cumsum(np.bincount(size, minlength=LONG + 2))  # words longer than each length
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for i in range(LONG):
        m = int(counts[i])
        if not m:
            break
        now = crc[:m]
        crc[:m] = STEP[(now ^ letters[first[:m] + i]) & 255] ^ (now >> 8)
    crc = ~crc
    for j in range(int(counts[LONG])):
        crc[j] = zlib.crc32(data[first[j]:first[j] + int(lengths[order[j]])])
    out = np.empty_like(crc)
    out[order] = crc
    return out


SPACE = np.uint32(zlib.crc32(b" "))


def features(data: bytes, begins: np.ndarray, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and bucket of every feature that starts before ``core``, and the text number of every word.

    ``data`` is folded text; ``begins`` are the places where texts start in it.
    """
    inside = np.frombuffer(data, np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    text = np.searchsorted(begins, starts, side="right") - 1
    crc, lengths = _word_sums(data, starts, ends), ends - starts
    n = int(np.searchsorted(starts, core))
    texts, sums = [text[:n]], [crc[:n]]
    blank = _shift(np.full(len(crc), SPACE, np.uint32), lengths) ^ crc
    run = crc
    for k in (1, 2):
        run = _shift(run[:len(run) - 1], lengths[k:] + 1) ^ blank[k:] if len(run) > 1 else run[:0]
        whole = text[:len(run)] == text[k:k + len(run)]
        whole[n:] = False
        texts.append(text[:len(run)][whole])
        sums.append(run[whole])
    return np.concatenate(texts), (np.concatenate(sums) % np.uint32(BUCKETS)).astype(np.int64), text[:n]


def blocks(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, int, int]]:
    """(data, begins, core, number of the first text): texts together, or a long one in overlapping pieces."""
    if len(texts) > 1 or len(texts[0]) <= BLOCK:
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        data = b" ".join(texts).translate(FOLD)
        yield data, begins, len(data), 0
        return
    data, start = texts[0].translate(FOLD), 0
    while start < len(data):
        end = WORD_END.match(data, min(start + BLOCK, len(data))).end()
        yield data[start:TWO_MORE.match(data, end).end()], np.zeros(1, np.int64), end - start, 0
        start = end


def bucket_counts(frame: DataFrame) -> DataFrame:
    """bucket, n: features of all texts; every task adds up its own before anything is shuffled."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = "bucket int, n long"
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        import pyarrow as pa

        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in parts(batch):
                for data, begins, core, _ in blocks([x or b"" for x in binary(part, "text")]):
                    total += np.bincount(features(data, begins, core)[1], minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], schema=target)

    texts = frame.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of every bucket, an array of fixed length."""
    spark = documents.sparkSession
    s, t = bucket_counts(documents).toDF("bucket", "s"), bucket_counts(target).toDF("bucket", "t")
    all_ = spark.range(BUCKETS, numPartitions=1).select(F.col("id").cast("int").alias("bucket"))
    both = landed(all_.join(s, "bucket", "left").join(t, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"]))
    source, aim = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1.0) * F.lit(source + BUCKETS) / ((F.col("s") + 1.0) * F.lit(aim + BUCKETS))
    rows = both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain")).collect()
    discard(both)
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r.bucket] = r.gain
    return out


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the hash of the id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0))).cast("long")


def scored(documents: DataFrame, target: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, n_features, n_words, weight, score of every document."""
    ready(documents)
    gain = gains(documents, target)

    def work(batch):
        for part in parts(batch):
            n = part.num_rows
            sizes, words, weights = (np.zeros(n, np.int64) for _ in range(3))
            for data, begins, core, _ in blocks([x or b"" for x in binary(part, "text")]):
                text, bucket, word = features(data, begins, core)
                sizes += np.bincount(text, minlength=n)
                words += np.bincount(word, minlength=n)
                # sums of whole numbers below 2^53 are exact in doubles
                weights += np.bincount(text, gain[bucket], minlength=n).astype(np.int64)
            yield {"doc_id": part.column("doc_id"), "n_features": sizes, "n_words": words, "weight": weights}

    rows = arrow_map(keyed(documents), work, "doc_id long, n_features long, n_words long, weight long")
    return rows.withColumn("score", F.col("weight") + noise(original_id(), seed))


def cutoff(frame: DataFrame, column: str, wanted: int, highest: bool = True, steps: int = 15) -> int:
    """The value at which counting from the top (or the bottom) first reaches ``wanted`` rows.

    Bisection on the value with exact counts; one job counts at ``steps`` evenly spaced thresholds, so it
    does the work of four halvings.
    """
    value = F.col(column) if highest else -F.col(column)
    low, high = frame.agg(F.min(value), F.max(value)).first()
    while low < high:
        gap = high - low
        marks = sorted({low + (gap * i + steps) // (steps + 1) for i in range(1, steps + 1)})
        counts = frame.agg(*[F.count(F.when(value >= m, 1)).alias(f"c{i}") for i, m in enumerate(marks)]).first()
        reached = [m for m, c in zip(marks, counts) if c >= wanted]
        missed = [m for m, c in zip(marks, counts) if c < wanted]
        low, high = max([low, *reached]), min([high, *(m - 1 for m in missed)])
    return low if highest else -low


def ranked(frame: DataFrame) -> DataFrame:
    """Adds rank 1, 2, 3, ... by falling score, doc_id and row: ranges in order, numbered inside and then offset."""
    from pyspark import TaskContext

    order = [F.col("score").desc(), F.col("doc_id"), F.col("row")]
    names = frame.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema) + ", part int, place long"

    def number(batches):
        import pyarrow as pa

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            place = np.arange(seen + 1, seen + 1 + batch.num_rows)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(place), part, np.int32)), pa.array(place)], [*names, "part", "place"])

    numbered = landed(frame.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema))
    from pyspark.sql import Window

    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return numbered.join(F.broadcast(offsets), "part").select(*names, (F.col("offset") + F.col("place")).alias("rank"))


def resample(documents: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those not drawn.

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred are drawn, rounded down.
    """
    rows = landed(scored(documents, target, seed).withColumn("row", F.monotonically_increasing_id()))
    able = rows.where(F.col("n_words") >= least_words)
    wanted = percent * able.count() // 100
    if wanted < 1:
        chosen = rows.where("false").withColumn("rank", F.lit(0).cast("long"))
        rest = rows
    else:
        score = cutoff(able, "score", wanted)
        above = able.where(F.col("score") > score).count()
        doc_id = cutoff(able.where(F.col("score") == score), "doc_id", wanted - above, highest=False)
        taken = (F.col("n_words") >= least_words) & ((F.col("score") > score) | (F.col("score") == score) & (F.col("doc_id") <= doc_id))
        chosen = ranked(rows.where(taken))
        rest = rows.where(~taken)
    # rows that share the last score and id can be more than are wanted
    drawn = F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank")
    columns = [original_id(), "n_features", "weight", "score"]
    return chosen.select(*columns, drawn).unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))
