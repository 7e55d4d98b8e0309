"""Near-duplicate join on word shingles with parity sketches.

A document's shingles are hashed into the segments of a sketch, and the hashes in a segment are
XORed; a shingle that only one of two documents has changes one segment of one of them. With
Jaccard >= 3/4 the symmetric difference of sets of a and b shingles is at most (a + b) / 7, so with
more non-empty segments than that at least one of them is equal in both. A document therefore emits,
for its size band and, where its partner may be in the band below, for that band too, its first
``limit`` + 1 non-empty segments in an order that is the same for all documents (fullest segments
first, as these are the rarest). Equal segments make candidates; a second, short sketch with one bit
per shingle bounds the symmetric difference from below; what remains is verified on the full sets.

Documents with equal sets are one class and join once. Inside a group of equal segments all classes
are first compared with one centre, the class with the largest share of segments in common with
others. Where that leaves a group in more than one component, the classes of different components
are compared by sketch, in blocks, each pair at the first key it shares, and the pairs that pass are verified. No link is lost: any two
classes of a group are in one component, or were compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import REMEMBERED, Hashes, arrow_map, binary, components, discard, held, keyed, landed, mix, original_id, parts, ready, runs

WORDS = 5
#: Similarity as a fraction; 3/4 by contract.
NUMERATOR, DENOMINATOR = 75, 100
BAND = 3.0
BLOCK = 4096
#: A block knows each node's first few torn keys, to leave pairs to the first key they share.
FIRST_KEYS = 8
LAST_KEY = (1 << 63) - 1


@dataclass(frozen=True)
class Band:
    low: int
    high: int

    @property
    def segments(self) -> int:
        """Enough that about two shingles of the largest set share a segment; more for small sets."""
        return self.high * 4 if self.high <= 81 else int(self.high / 2.2)


def band_of(n: int) -> int:
    """Index of the size band [3^i, 3^(i+1)) that holds n."""
    i = 0
    while 3 ** (i + 1) <= n:
        i += 1
    return i


def band(i: int) -> Band:
    return Band(3 ** i, 3 ** (i + 1))


def hashes() -> Hashes:
    return held("shingle words", Hashes)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; with fewer words, of the whole sequence."""
    look = hashes().__getitem__
    split = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter((look(w) for words in split for w in words), np.uint64, int(sizes.sum()))
    rolled = np.zeros(max(len(flat) - WORDS + 1, 0), np.uint64)
    for i in range(WORDS):
        rolled = mix(rolled * np.uint64(0x100000001B3) + flat[i:len(flat) - WORDS + 1 + i], i + 1)
    out, start = [], 0
    for n in sizes:
        if n >= WORDS:
            out.append(np.unique(rolled[start:start + n - WORDS + 1]))
        elif n:
            whole = np.asarray([int(n)], np.uint64)
            for x in flat[start:start + n]:
                whole = mix(whole * np.uint64(0x100000001B3) + x, 77)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
        start += n
    return out


def class_of(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set."""
    return int(mix(shingles, 11).sum(dtype=np.uint64).view(np.int64)), int(mix(shingles, 12).sum(dtype=np.uint64).view(np.int64))


def segment_keys(shingles: np.ndarray, which: int, limit: int) -> np.ndarray:
    """The document's join keys for one band: ``limit`` + 1 non-empty segments, fullest first."""
    k = np.uint64(band(which).segments)
    place = ((mix(shingles, 21) >> np.uint64(32)) * k) >> np.uint64(32)
    order = np.argsort(place, kind="stable")
    place, token = place[order], mix(shingles, 22)[order]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.concatenate([first, [len(place)]])).astype(np.uint64)
    content = np.bitwise_xor.reduceat(token, first)
    key = mix(content ^ mix(place[first], 23) ^ mix(count, 24), 1000 + which)
    chosen = np.lexsort((key, -count.astype(np.int64)))[: limit + 1]
    keys = key[chosen]
    if len(first) <= limit:  # too few to be sure of a common one: such documents meet under one more key
        keys = np.append(keys, mix(np.asarray([which], np.uint64), 25))
    return keys


def join_keys(shingles: np.ndarray) -> np.ndarray:
    n = len(shingles)
    i = band_of(n)
    largest = n * DENOMINATOR // NUMERATOR
    keys = [segment_keys(shingles, i, (n + largest) // 7)]
    below = band(i).low - 1
    if below >= 1 and below * DENOMINATOR >= n * NUMERATOR:
        keys.append(segment_keys(shingles, i - 1, (n + below) // 7))
    return np.concatenate(keys)


def parity(shingles: np.ndarray) -> bytes:
    """One bit flipped per shingle; the Hamming distance of two never exceeds the sets' difference.

    The sketch has a power of two of bits, twice the shingles at least; XORing its halves makes the
    sketch of half the size, so sketches of different sizes can be compared.
    """
    size = max(256, 1 << (2 * len(shingles) - 1).bit_length())
    bits = np.bincount((mix(shingles, 31) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _folded(sketch: np.ndarray) -> np.ndarray:
    half = sketch.shape[-1] // 2
    return sketch[..., :half] ^ sketch[..., half:]


def distance(left: bytes, right: bytes) -> int:
    """Hamming distance of two sketches at the smaller of their sizes."""
    x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
    while len(x) > len(y):
        x = _folded(x)
    while len(y) > len(x):
        y = _folded(y)
    return int(np.bitwise_count(x ^ y).sum())


def sketches(documents: DataFrame) -> DataFrame:
    """doc_id, n, c1, c2 (the class), sketch, keys (null where the task saw the class before)."""

    def run(batches):
        import pyarrow as pa

        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in parts(batch, 2 << 20):
                sets = shingle_sets(binary(part, "text"))
                rows = []
                for s in sets:
                    c1, c2 = class_of(s)
                    new = len(s) > 0 and (c1, c2) not in seen
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    seen.add((c1, c2))
                    rows.append((len(s), c1, c2, parity(s) if new else None, join_keys(s).view(np.int64) if new else None))
                n, c1, c2, sketch, keys = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()),
                     pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n", "c1", "c2", "sketch", "keys"],
                )

    return documents.mapInArrow(run, "doc_id long, n long, c1 long, c2 long, sketch binary, keys array<long>")


def shared_segments(rows: DataFrame) -> DataFrame:
    """(key, node) for keys that two nodes or more have; streams over sorted rows, holding one."""

    def run(batches):
        import pyarrow as pa

        key = node = None
        open_ = False
        for batch in batches:
            k, v = (batch.column(c).to_numpy() for c in ("key", "node"))
            if not len(k):
                continue
            k2 = np.concatenate([[k[0] if key is None else key], k])
            v2 = np.concatenate([[v[0] if key is None else node], v])
            same_key = k2[1:] == k2[:-1]
            new_row = ~(same_key & (v2[1:] == v2[:-1]))
            if key is None:
                same_key[0], new_row[0] = False, True
            carried = key is not None
            # drop repeats of (key, node), then keep a row that has a neighbour of its key
            keep = np.flatnonzero(new_row)
            k3, v3 = k[keep], v[keep]
            joins = same_key[keep] if len(keep) else same_key[:0]
            follows = np.concatenate([joins[1:], [False]]) if len(joins) else joins
            out_k, out_v = [k3[joins | follows]], [v3[joins | follows]]
            if carried and len(joins) and joins[0] and not open_:
                out_k.insert(0, np.asarray([key], np.int64))
                out_v.insert(0, np.asarray([node], np.int64))
            if len(keep):
                # the last row stays pending unless it went out with its key
                open_ = bool(joins[-1])
                key, node = k3[-1], v3[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_k)), pa.array(np.concatenate(out_v))], ["key", "node"])

    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "node")
    return sorted_rows.mapInArrow(run, "key long, node long")


def centre_edges(rows: DataFrame) -> DataFrame:
    """(a, b) from each group's centre, the node of the largest ``weight``, to every other node."""

    def run(batches):
        import pyarrow as pa

        key = centre = None
        for batch in batches:
            k, v = (batch.column(c).to_numpy() for c in ("key", "node"))
            if not len(k):
                continue
            starts = np.concatenate([[k[0] != key if key is not None else True], k[1:] != k[:-1]])
            number = np.cumsum(starts)
            centres = np.concatenate([[0 if centre is None else centre], v[starts]])
            mine = centres[number]
            key, centre = k[-1], mine[-1]
            pairs = np.stack([np.minimum(mine, v), np.maximum(mine, v)])[:, mine != v]
            pairs = np.unique(pairs, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    sorted_rows = rows.repartition("key").sortWithinPartitions("key", F.col("weight").desc(), "node")
    return sorted_rows.mapInArrow(run, "a long, b long")


def _possible(n1, n2, distance):
    """Whether sets of these sizes can still be linked when ``distance`` bounds their difference from below."""
    return (7 * distance <= n1 + n2) & (NUMERATOR * np.maximum(n1, n2) <= DENOMINATOR * np.minimum(n1, n2))


def across_components(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of one block whose components differ and which size and sketch allow.

    ``rows`` has block, key, mine (a node's part of its key), pure (a block of one part), node, component,
    n, sketch and first (the node's ``FIRST_KEYS`` smallest keys, filled up with ``LAST_KEY``); a block holds at
    most two times BLOCK nodes. A block of two parts compares one with the other only, and a pair with
    an earlier key in common among the first ones of both is left to that key, where it is met too.
    """

    def run(batches):
        import pyarrow as pa

        done: set[tuple[int, int]] = set()
        for _, key, side, pure, node_of, comp, n, sketch, first in runs(batches, ("block", "key", "mine", "pure", "node", "component", "n", "sketch", "first")):
            once = np.unique(node_of, return_index=True)[1]
            found = []
            # in order of size, the possible partners of a node are a range above it
            order = once[np.argsort(n[once], kind="stable")]
            node, comp, n, sketch, part = node_of[order], comp[order], n[order], sketch[order], np.where(pure[order], -1 - np.arange(len(order)), side[order])
            early = np.stack(first[order])
            early = np.where(early < key[0], early, LAST_KEY)
            words = np.fromiter(map(len, sketch), np.int64, len(node)) // 8
            above = np.searchsorted(n, DENOMINATOR * n // NUMERATOR, side="right")
            tables: dict[int, tuple[int, np.ndarray]] = {}
            for size in np.unique(words)[::-1]:
                mine = np.flatnonzero(words == size)
                table = np.frombuffer(b"".join(sketch[mine]), np.uint64).reshape(len(mine), -1)
                if 2 * size in tables:  # larger sets follow, folded to this size
                    start, larger = tables[2 * size]
                    own = np.flatnonzero(words == 2 * size)
                    table = np.concatenate([table, _folded(larger[: len(own)])])
                tables[int(size)] = (int(mine[0]), table)
            for i in range(len(node) - 1):
                others = np.flatnonzero((comp[i + 1:above[i]] != comp[i]) & (part[i + 1:above[i]] != part[i])) + i + 1
                if len(others):
                    start, table = tables[int(words[i])]
                    near = np.bitwise_count(table[others - start] ^ table[i - start]).sum(axis=1, dtype=np.int64)
                    others = others[_possible(n[others], n[i], near)]
                    own = early[i][early[i] < LAST_KEY]
                    for j in others[~np.isin(early[others], own).any(axis=1)].tolist():
                        found.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
            fresh = [p for p in found if p not in done]
            if len(done) > REMEMBERED:
                done.clear()
            done.update(fresh)
            if fresh:
                a, b = zip(*fresh)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    joined = pairs.join(left, "a").join(right, "b")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a, b, keep = batch.column("a"), batch.column("b"), []
            left, right = batch.column("left"), batch.column("right")
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_py(), np.uint64) for c in (left, right))
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(DENOMINATOR * common >= NUMERATOR * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return joined.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _sets(nodes: DataFrame, representatives: DataFrame, documents: DataFrame) -> DataFrame:
    """node and its shingles (packed), read again from one document of each class."""
    wanted = nodes.join(representatives.select("node", "rep"), "node").select(F.col("rep").alias("doc_id"), "node")
    text = documents.join(wanted, "doc_id").select("node", "text")

    def work(batch):
        for part in parts(batch, 2 << 20):
            yield {"node": part.column("node"), "shingles": [s.tobytes() for s in shingle_sets(binary(part, "text"))]}

    return arrow_map(text, work, "node long, shingles binary")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``documents``.

    Texts without words (null and empty among them) have no shingles, link with nothing and are
    their own component. Equal texts are linked, repeated rows of one doc_id too. A null doc_id
    counts as the smallest id and comes back as null.
    """
    ready(documents)
    base = keyed(documents)
    wide = landed(sketches(base))
    rows = landed(wide.select("doc_id", "n", "c1", "c2"))
    # rows repeating a doc_id with other texts are told apart below by their class
    classes = rows.where("n > 0").groupBy("c1", "c2", "n").agg(F.min("doc_id").alias("rep"))
    sketch = wide.where("sketch IS NOT NULL").groupBy("c1", "c2", "n").agg(F.first("sketch").alias("sketch"), F.max(F.size("keys")).alias("keys"))
    info = landed(classes.join(sketch, ["c1", "c2", "n"]).withColumn("node", F.col("c1")))
    segments = wide.where("keys IS NOT NULL").select(F.col("c1").alias("node"), F.explode("keys").alias("key")).select("key", "node")
    shared = landed(shared_segments(segments))
    discard(wide)
    popular = shared.groupBy("node").agg(F.count("*").alias("m")).join(info.select("node", "keys"), "node")
    weights = popular.select("node", (F.col("m") / F.col("keys")).alias("weight"))
    pairs = centre_edges(shared.join(weights, "node")).distinct()

    plain = info.select("node", "n", "sketch")
    left = plain.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = plain.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def near(batch):
        bound = np.asarray([distance(x, y) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())], np.int64)
        ok = _possible(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), bound)
        yield {c: batch.column(c).to_numpy()[ok] for c in ("a", "b")}

    first = landed(arrow_map(pairs.join(left, "a").join(right, "b"), near, "a long, b long"))
    sets = landed(_sets(first.select(F.explode(F.array("a", "b")).alias("node")).distinct(), info, base))
    links = landed(verified(first, sets))
    found = components(links)

    placed = shared.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    torn = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"))
    torn = torn.where("lo <> hi").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    split = landed(placed.join(torn, "key"))
    keys = F.array_sort(F.collect_set("key"))
    first_keys = F.slice(F.concat(keys, F.array_repeat(F.lit(LAST_KEY), FIRST_KEYS)), 1, FIRST_KEYS)
    known = plain.join(split.groupBy("node").agg(first_keys.alias("first")), "node")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    blocked = split.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocked = blocked.select(
        F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("block"), "key", "mine",
        (F.col("mine") == F.col("other")).alias("pure"), "node", "component",
    )
    second = across_components(blocked.join(known, "node")).distinct().join(first, ["a", "b"], "left_anti")
    second = landed(second)
    discard(shared, split)
    more = second.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(sets.select("node"), "node", "left_anti")
    sets_too = sets.unionByName(landed(_sets(more, info, base)))
    links_too = landed(verified(second, sets_too))
    final = components(links.unionByName(links_too))

    whole = info.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = whole.join(smallest, "component").select("c1", "c2", F.col("n").alias("size"), "component_id")
    out = rows.select("doc_id", "n", "c1", "c2").join(
        named.withColumnRenamed("size", "n"), ["c1", "c2", "n"], "left"
    )
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")).select(
        original_id(), "n_shingles", original_id("component_id")
    )
