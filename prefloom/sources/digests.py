"""SHA-256 of long files, split by split.

A digest is a chain over the bytes of its file. The splits of a file follow each other, a task
each, and the next goes on from the state that the last one left; files do not wait for each other.
"""

from __future__ import annotations

import ctypes
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOM = b"\xef\xbb\xbf"
#: Room for OpenSSL's SHA256_CTX, which holds nothing but numbers.
STATE_BYTES = 128


class Chain:
    """A SHA-256 whose state can be handed on, by the OpenSSL that Python's hashlib is built on."""

    def __init__(self, state: bytes | None = None):
        import _hashlib

        self.openssl = ctypes.CDLL(_hashlib.__file__)
        self.held = ctypes.create_string_buffer(state, STATE_BYTES) if state else ctypes.create_string_buffer(STATE_BYTES)
        if not state:
            self.openssl.SHA256_Init(self.held)

    def add(self, data: bytes) -> Chain:
        self.openssl.SHA256_Update(self.held, data, ctypes.c_size_t(len(data)))
        return self

    def state(self) -> bytes:
        return self.held.raw

    def hexdigest(self) -> str:
        out, end = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self.held.raw, STATE_BYTES)
        self.openssl.SHA256_Final(out, end)
        return out.raw.hex()


def can_hand_on() -> bool:
    """Whether a chain that changes hands gives hashlib's digest here."""
    import hashlib

    try:
        start = Chain().add(b"x" * 100).state()
        return Chain(start).add(b"y" * 1000).hexdigest() == hashlib.sha256(b"x" * 100 + b"y" * 1000).hexdigest()
    except (ImportError, OSError, AttributeError):
        return False


def _followed(states: dict, ends: set, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States after the splits named by ``states``, and the bytes added; the last line feed of those in
    ``ends`` is not the file's."""
    chains, last, added = {at: Chain(state) for at, state in states.items()}, {}, defaultdict(int)
    for batch in batches:
        file, start = (batch.column(k).to_numpy() for k in ("file", "start"))
        cuts = [0, *(((file[1:] != file[:-1]) | (start[1:] != start[:-1])).nonzero()[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a < b and (at := (int(file[a]), int(start[a]))) in chains:
                chains[at].add(last.get(at, b""))
                last[at] = _together(batch.column("data").slice(a, b - a))
                added[at] += len(last[at])
    for at, data in last.items():
        state = chains[at].add(data[:-1] if at in ends else data).state()
        yield pa.RecordBatch.from_pydict({"file": [at[0]], "added": [added[at] - (at in ends)], "state": [state]})


def _together(data: pa.Array) -> bytes:
    """All bytes of a binary column, one after the other."""
    data = data.cast(pa.large_binary())
    _, places, held = data.buffers()
    first, end = np.frombuffer(places, np.int64)[[data.offset, data.offset + len(data)]].tolist()
    return held.slice(first, end - first).to_pybytes()


def chained_sha256(files: DataFrame, lines: DataFrame) -> dict[str, str]:
    """SHA-256 of files by their path in ``_metadata``; ``lines`` reads the same files, split at line feeds.

    Files whose lines do not add up to their size, such as compressed ones, are left out. The driver
    holds a state per file.
    """
    if not can_hand_on():
        return {}
    context = lines.sparkSession.sparkContext
    key, start = F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    rows = lines.select(key, start, F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("data"))
    splits, read = defaultdict(list), defaultdict(int)
    counted = lines.select(key, start, F.spark_partition_id().alias("task"), (F.octet_length("value") + 1).alias("n"))
    for file, at, task, n in counted.groupBy("file", "start", "task").agg(F.sum("n")).collect():
        splits[file].append((at, task))
        read[file] += n
    splits = {file: sorted(some) for file, some in splits.items()}
    names = [tuple(r) for r in files.select(key, "_metadata.file_path", "_metadata.file_size").collect()]
    if len({file for file, *_ in names}) < len(names):  # two paths of one key
        return {}
    # the reader leaves out a byte order mark, and every line has a line feed now, also one that ends the file
    more = {file: size - read[file] for file, _, size in names if file in read}
    more = {file: n for file, n in more.items() if n in (0, -1, len(BOM), len(BOM) - 1)}
    states = {file: Chain().add(BOM if n > 0 else b"").state() for file, n in more.items()}
    added = {file: len(BOM) if n > 0 else 0 for file, n in more.items()}
    for turn in range(max((len(splits[file]) for file in more), default=0)):
        now = {file: splits[file][turn] for file in more if turn < len(splits[file])}
        ends = {(file, now[file][0]) for file in now if turn + 1 == len(splits[file]) and more[file] in (-1, len(BOM) - 1)}
        follow = partial(_followed, {(file, now[file][0]): states[file] for file in now}, ends)
        step = rows.mapInArrow(follow, "file long, added long, state binary").rdd
        for file, n, state in context.runJob(step, list, sorted({task for _, task in now.values()})):
            states[file] = bytes(state)
            added[file] += n
    # fewer bytes than the file has: the splits were dealt otherwise on the way
    return {path: Chain(states[file]).hexdigest() for file, path, size in names if added.get(file) == size}
