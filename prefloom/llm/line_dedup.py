"""Removal of lines that many documents share, found with two Bloom filters.

Each scan task fills a once filter and a twice filter with the hashes of its documents' line keys;
filters merge by or, and a bit that two once filters share goes to the twice filter. Only keys that
the merged twice filter holds are shuffled, counted exactly and given their last document.

The filter has a fixed number of bits. Where the corpus outgrows it, more keys are shuffled and the
result stays the same; about ten bits per distinct long line keep suspects few.
"""

from __future__ import annotations

import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import arrow_map, binary, keyed, landed, parts, ready, unused

BLANKS = b" \t\n\x0b\x0c\r"
SLICE = 1 << 13  # bytes of a filter that travel together


def line_key(line: bytes, least: int = 40) -> bytes | None:
    """The line without blanks at its ends and with A-Z lowered; None below ``least`` code points."""
    key = line.strip(BLANKS)
    if len(key) < least or (not key.isascii() and len(key.decode("utf-8", "replace")) < least):
        return None
    return key.lower()


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def places(digests: list[bytes], bits: int) -> np.ndarray:
    """Two filter bits for each 128-bit hash, as an array of two rows."""
    both = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).T
    return (both % np.uint64(bits)).astype(np.int64)


def _merge(one: np.ndarray, two: np.ndarray, once: np.ndarray, twice: np.ndarray) -> None:
    two |= twice
    two |= one & once
    one |= once


def repeat_filter(keys: DataFrame, bits: int) -> bytes:
    """The twice filter over the 128-bit hashes in column ``digests`` (one array per document).

    Tasks hand over the slices in which they set a bit; slices merge by number in a second step.
    The result has ``bits`` / 8 bytes, whatever the input.
    """
    width = SLICE * 8

    def fill(batches):
        import pyarrow as pa

        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            digests = batch.column(0).flatten().to_pylist()
            for at in range(0, len(digests), 100_000):
                spots = places(digests[at:at + 100_000], bits)
                seen = np.ones(spots.shape[1], bool)
                for row in spots:
                    seen &= (once[row >> 3] >> (row & 7) & 1).astype(bool)
                # repeats inside this chunk count as seen too
                pair = spots[0] * np.int64(bits) + spots[1] if bits <= 1 << 31 else spots[0]
                _, first, number = np.unique(pair, return_index=True, return_counts=True)
                again = np.zeros(len(pair), bool)
                again[first[number > 1]] = True
                for row in spots:
                    np.bitwise_or.at(once, row >> 3, (1 << (row & 7)).astype(np.uint8))
                    hit = row[seen | again]
                    np.bitwise_or.at(twice, hit >> 3, (1 << (hit & 7)).astype(np.uint8))
        used = np.flatnonzero(once.reshape(-1, SLICE).any(axis=1))
        for at in range(0, len(used), 128):
            some = used[at:at + 128]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int64()),
                    pa.array([zlib.compress(once[i * SLICE:(i + 1) * SLICE].tobytes(), 1) for i in some], pa.binary()),
                    pa.array([zlib.compress(twice[i * SLICE:(i + 1) * SLICE].tobytes(), 1) for i in some], pa.binary()),
                ],
                ["slice", "once", "twice"],
            )

    def merge(batches):
        import pyarrow as pa

        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for number, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                new = [np.frombuffer(zlib.decompress(x), np.uint8) for x in (once, twice)]
                if number in held:
                    _merge(*held[number], *new)
                else:
                    held[number] = tuple(x.copy() for x in new)
        done = [(n, zlib.compress(two.tobytes(), 1)) for n, (_, two) in held.items() if two.any()]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.int64()), pa.array([t for _, t in done], pa.binary())], ["slice", "twice"])

    if bits % width:
        raise ValueError(f"the filter takes a multiple of {width} bits")
    filled = keys.mapInArrow(fill, "slice long, once binary, twice binary")
    merged = filled.repartition("slice").mapInArrow(merge, "slice long, twice binary")
    whole = bytearray(bits // 8)
    for number, twice in merged.toLocalIterator():
        whole[number * SLICE:(number + 1) * SLICE] = zlib.decompress(bytes(twice))
    return bytes(whole)


def shared_lines(documents: DataFrame, least_chars: int = 40, least_documents: int = 5, bits: int = 1 << 25) -> DataFrame:
    """Keys of at least ``least_documents`` documents: digest (128-bit hash of the key) and keep (largest doc_id)."""
    spark = ready(documents)

    def digests_of(text: bytes) -> list[bytes]:
        return list({key_hash(k) for line in text.split(b"\n") if (k := line_key(line, least_chars)) is not None})

    def scan(batch):
        for part in parts(batch):
            yield {"digests": [digests_of(t) for t in binary(part, "text")]}

    base = keyed(documents)
    twice = spark.sparkContext.broadcast(repeat_filter(arrow_map(base, scan, "digests array<binary>"), bits))

    def suspects(batch):
        table = np.frombuffer(twice.value, np.uint8)
        for part in parts(batch):
            docs, found = [], []
            for doc, text in zip(part.column("doc_id").to_pylist(), binary(part, "text")):
                digests = digests_of(text)
                if digests:
                    spots = places(digests, bits)
                    hit = ((table[spots >> 3] >> (spots & 7)) & 1).all(axis=0)
                    some = [d for d, h in zip(digests, hit) if h]
                    docs += [doc] * len(some)
                    found += some
            yield {"digest": found, "doc_id": docs}

    rows = landed(arrow_map(base, suspects, "digest binary, doc_id long").distinct())
    counted = rows.groupBy("digest").agg(F.count("*").alias("documents"), F.max("doc_id").alias("keep"))
    # landed, so that the join deals both sides anew and a line of very many documents can be split
    kept = landed(counted.where(F.col("documents") >= least_documents).select("digest", "keep"))
    return rows.join(kept, "digest")


def drop_shared_lines(
    documents: DataFrame, least_chars: int = 40, least_documents: int = 5, bits: int = 1 << 25
) -> DataFrame:
    """The documents, all columns, with ``text`` free of shared lines and n_lines and n_dropped added.

    A null or empty text is one empty line. Rows that repeat a doc_id count as one document and lose
    the same lines; a document that keeps no line has an empty text. A frame's own columns named
    n_lines or n_dropped are replaced.
    """
    shared = shared_lines(documents, least_chars, least_documents, bits)
    base = documents.drop("n_lines", "n_dropped")
    own, gone_lines = unused(base, "__id"), unused(base, "__lost")
    lost = shared.where("doc_id <> keep").groupBy(F.col("doc_id").alias(own)).agg(F.collect_list("digest").alias(gone_lines))
    names = base.columns
    held = base.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    joined = held.join(lost, own, "left").drop(own)
    types = {f.name: f.dataType.simpleString() for f in base.schema}

    def strip(batch):
        for part in parts(batch):
            columns = {n: part.column(n) for n in names}
            texts, total, dropped = [], [], []
            for text, gone in zip(part.column("text").cast("binary").to_pylist(), part.column(gone_lines).to_pylist()):
                lines = (text or b"").split(b"\n")
                total.append(len(lines))
                if gone:
                    gone = set(gone)
                    kept = [x for x in lines if (k := line_key(x, least_chars)) is None or key_hash(k) not in gone]
                    dropped.append(len(lines) - len(kept))
                    texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
                else:
                    dropped.append(0)
                    texts.append("" if text is None else text.decode("utf-8", "surrogatepass"))
            yield columns | {"text": texts, "n_lines": total, "n_dropped": dropped}

    schema = ", ".join(f"`{n}` {types[n]}" for n in names) + ", n_lines long, n_dropped long"
    return arrow_map(joined, strip, schema)


def digest(documents: DataFrame) -> DataFrame:
    """Counts and a checksum per document."""
    kept = drop_shared_lines(documents.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
