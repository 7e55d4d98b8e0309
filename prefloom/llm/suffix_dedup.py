"""Removal of text that repeats an earlier string of at least ``length`` bytes.

Equal suffixes are found from a sample of them, as in induced sorting, with Spark's external sort as
the disk-backed queue:

1. Sampling. Of the ``length`` - ``GRAM`` + 1 gram positions inside a window of ``length`` bytes the
   one with the smallest hash (the first of equals) is the window's anchor. Equal windows have their
   anchor at the same place, and an anchor owns a run of consecutive windows, so one row stands for
   about ``length`` / 3 suffixes.
2. Naming. Rows are sorted by (gram, context, document, place), where the context is the text that
   all windows of the run cover. The first row of each name is kept; every window of the others
   starts earlier too.
3. Recursion on what is left open. Only grams with more than one context can hold further repeats.
   A table of bits of fixed size marks them; a second scan hands over the contexts of marked grams.
4. Induction. Sorted by (gram, document, place), the windows of a gram's contexts are named in turn;
   a name that was met before in its gram is a repeat. Grams with very many contexts are split: their
   windows are sorted by name themselves.

The windows found are merged to byte runs per document. All sorts spill to disk; a task holds one
document, or the contexts of one gram up to ``HOT`` of them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import binary, keyed, landed, mix, original_id, parts, ready

LENGTH = 100
GRAM = 32
HOT = 50_000
OPEN_BITS = 1 << 26
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64), 51)


def gram_hashes(flat: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place (as many places as fit), by doubling."""
    powers, hashes, n = [1], [_letters()[flat]], 1
    base = _BASE
    while 2 * n <= size:
        h = hashes[-1]
        hashes.append(h[:-n] * np.uint64(base) + h[n:])
        powers.append(2 * n)
        base = base * base & 0xFFFFFFFFFFFFFFFF
        n *= 2
    total = len(flat) - size + 1
    out, at = None, 0
    for h, n in zip(reversed(hashes), reversed(powers)):
        if size - at >= n:
            piece = h[at:at + total]
            out = piece if out is None else mix(out, n) + piece
            at += n
    return mix(out, 52)


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start of each anchor's run, and the anchor's gram hash."""
    if len(text) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = gram_hashes(np.frombuffer(text, np.uint8), GRAM)
    # the upper half of the hash decides, the place below it makes the first of equals win
    low = grams & np.uint64(0xFFFFFFFF00000000) | np.arange(len(grams), dtype=np.uint64)
    span, size = length - GRAM + 1, 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if span > size:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size:])
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    place = (low[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return first, np.concatenate([first[1:], [len(low)]]) - 1, grams[place]


def _row_id(text: bytes) -> int:
    """Tells rows of one doc_id with different texts apart."""
    return xxhash.xxh32_intdigest(text) - (1 << 31)


def sampled(documents: DataFrame) -> DataFrame:
    """gram, context (hash), doc_id, row, start, last, settled for every anchor.

    Rows whose name came earlier in the same slice of documents are settled: repeats already.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in parts(batch, 4 << 20):
                gram, context, doc, row, start, last = [], [], [], [], [], []
                for d, text in zip(part.column("doc_id").to_pylist(), binary(part, "text")):
                    a, z, g = anchors(text)
                    gram.append(g)
                    context += [xxhash.xxh3_64_intdigest(text[i:j]) for i, j in zip(a.tolist(), (z + LENGTH).tolist())]
                    doc.append(np.full(len(a), d, np.int64))
                    row.append(np.full(len(a), _row_id(text), np.int32))
                    start.append(a)
                    last.append(z)
                gram, doc, row, start, last = map(np.concatenate, (gram, doc, row, start, last))
                context = np.asarray(context, np.uint64)
                settled = _later(gram, context, doc, start)
                # a settled row needs no meeting with its gram, so a hot gram's rows are dealt out evenly
                gram[settled] = mix(doc[settled].view(np.uint64) * np.uint64(_BASE) + start[settled].astype(np.uint64), 53)
                context[settled] = 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(doc), pa.array(row),
                     pa.array(start.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(settled)],
                    ["gram", "context", "doc_id", "row", "start", "last", "settled"],
                )

    return documents.mapInArrow(run, "gram long, context long, doc_id long, row int, start int, last int, settled boolean")


def _later(gram: np.ndarray, context: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows whose name an earlier row of the same batch has, at another document or place."""
    order = np.lexsort((start, doc, context, gram))
    g, c, d, s = gram[order], context[order], doc[order], start[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])]) if len(g) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0)) if len(g) else np.zeros(0, np.int64)
    out = np.zeros(len(g), bool)
    out[order] = ~new & ((d != d[lead]) | (s != s[lead]))
    return out


def named(rows: DataFrame) -> DataFrame:
    """Repeats and open grams: (doc_id, row, start, last) of later rows of a name, or (gram, contexts).

    Streams over the sorted rows and keeps only the last one and a count.
    """

    def run(batches):
        import pyarrow as pa

        gram = context = lead = None
        count = 0
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        names = ["doc_id", "row", "start", "last", "gram", "contexts"]
        for batch in batches:
            g, c = batch.column("gram").to_numpy(), batch.column("context").to_numpy()
            if not len(g):
                continue
            new_gram = np.concatenate([[gram is None or g[0] != gram], g[1:] != g[:-1]])
            new_name = new_gram | np.concatenate([[context is None or c[0] != context], c[1:] != c[:-1]])
            d, s = batch.column("doc_id").to_numpy(), batch.column("start").to_numpy()
            at = np.maximum.accumulate(np.where(new_name, np.arange(len(g)), -1))
            first_doc = np.where(at >= 0, d[np.maximum(at, 0)], 0 if lead is None else lead[0])
            first_start = np.where(at >= 0, s[np.maximum(at, 0)], 0 if lead is None else lead[1])
            lead = first_doc[-1], first_start[-1]
            # a row of the same document and place is the same text again, not an earlier one
            settled = batch.column("settled").to_numpy(zero_copy_only=False)
            later = np.flatnonzero(settled | (~new_name & ((d != first_doc) | (s != first_start))))
            doc, row, start, last = (batch.column(n).to_numpy()[later] for n in names[:4])
            none = pa.nulls(len(later), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, t in zip((doc, row, start, last), kinds)), none, none], names)
            # contexts per gram; the last gram stays pending
            heads = np.flatnonzero(new_gram)
            upto = np.cumsum(new_name)
            ends = np.concatenate([heads, [len(g)]])
            grams, counts = [], []
            if not new_gram[0]:
                count += int(upto[ends[0] - 1]) if ends[0] else 0
            if len(heads):
                if gram is not None and count > 1:
                    grams.append(gram)
                    counts.append(count)
                total = upto[ends[1:] - 1] - np.where(heads > 0, upto[np.maximum(heads, 1) - 1], 0)
                closed = np.flatnonzero(total[:-1] > 1)
                grams += g[heads[closed]].tolist()
                counts += total[closed].tolist()
                count = int(total[-1])
            gram, context = g[-1], c[-1]
            yield _open(grams, counts, kinds, names)
        if gram is not None and count > 1:
            yield _open([int(gram)], [count], kinds, names)

    ordered = rows.repartition("gram").sortWithinPartitions("gram", "context", "doc_id", "start")
    return ordered.mapInArrow(run, "doc_id long, row int, start int, last int, gram long, contexts long")


def _open(grams, counts, kinds, names):
    import pyarrow as pa

    empty = [pa.nulls(len(grams), t) for t in kinds[:4]]
    return pa.RecordBatch.from_arrays([*empty, pa.array(grams, pa.int64()), pa.array(counts, pa.int64())], names)


def open_contexts(documents: DataFrame, table) -> DataFrame:
    """gram, doc_id, row, start, last, body for anchors whose gram the bit table marks."""

    def run(batches):
        import pyarrow as pa

        bits = table.value
        for batch in batches:
            for part in parts(batch, 4 << 20):
                out = [[] for _ in range(6)]
                for d, text in zip(part.column("doc_id").to_pylist(), binary(part, "text")):
                    a, z, g = anchors(text)
                    spot = (g % np.uint64(OPEN_BITS)).astype(np.int64)
                    hit = np.flatnonzero(bits[spot >> 6] >> (spot & 63) & 1)
                    if len(hit):
                        row = _row_id(text)
                        for i in hit.tolist():
                            s, e = int(a[i]), int(z[i])
                            for o, v in zip(out, (int(g[i].view(np.int64)), d, row, s, e, text[s:e + LENGTH])):
                                o.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)], ["gram", "doc_id", "row", "start", "last", "body"])

    return documents.mapInArrow(run, "gram long, doc_id long, row int, start int, last int, body binary")


def _windows(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name of every window of every body, the body's number, and the window's place in it."""
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    names = gram_hashes(np.frombuffer(b"".join(bodies), np.uint8), LENGTH)
    number = np.repeat(np.arange(len(bodies)), sizes - LENGTH + 1)
    begin = np.cumsum(sizes) - sizes
    counts = sizes - LENGTH + 1
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return names[begin[number] + place], number, place


def induced(contexts: DataFrame) -> DataFrame:
    """(doc_id, row, start, last) of windows that an earlier context of the gram holds too.

    Later copies of a context are repeats already and are passed over, so that a run of one gram
    holds its distinct contexts, however many copies there are.
    """

    def distinct(columns):
        gram, bodies = columns[0], columns[4]
        names = np.fromiter((xxhash.xxh3_64_intdigest(b) for b in bodies), np.uint64, len(bodies))
        _, first = np.unique(mix(names, 63) ^ mix(gram.view(np.uint64), 62), return_index=True)
        first.sort()
        return [c[first] for c in columns]

    def settle(held):
        import pyarrow as pa

        gram, doc, row, start, bodies = distinct([np.concatenate(x) for x in zip(*held)])
        name, number, place = _windows(bodies.tolist())
        key = mix(name, 61) ^ mix(gram.view(np.uint64), 62)[number]
        # rows come in order of (gram, document, start), so the first of equal names is the earliest
        _, first = np.unique(key, return_index=True)
        repeat = np.ones(len(key), bool)
        repeat[first] = False
        # the same document and start twice (rows repeated in the input) is no repeat
        at = start[number] + place
        order = np.argsort(key, kind="stable")
        same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
        lead = np.maximum.accumulate(np.where(same, -1, np.arange(len(order))))
        origin = np.empty(len(order), np.int64)
        origin[order] = order[lead]
        repeat &= (doc[number] != doc[number[origin]]) | (at != at[origin])
        hit = np.flatnonzero(repeat)
        cut = np.flatnonzero(np.concatenate([[True], (number[hit][1:] != number[hit][:-1]) | (place[hit][1:] != place[hit][:-1] + 1)])) if len(hit) else hit
        end = np.concatenate([cut[1:], [len(hit)]]) - 1 if len(hit) else cut
        b, e = hit[cut], hit[end]
        n = number[b]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[n], pa.int64()), pa.array(row[n], pa.int32()), pa.array(at[b].astype(np.int32)), pa.array(at[e].astype(np.int32))],
            ["doc_id", "row", "start", "last"],
        )

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            gram, doc, row, start = (batch.column(n).to_numpy() for n in ("gram", "doc_id", "row", "start"))
            bodies = np.empty(batch.num_rows, object)
            bodies[:] = batch.column("body").to_pylist()
            cuts = np.flatnonzero(gram[1:] != gram[:-1]) + 1
            whole = int(cuts[-1]) if len(cuts) else 0
            columns = (gram, doc, row, start, bodies)
            if held and gram[0] != held[-1][0][-1]:
                yield settle(held)
                held = []
            if whole:
                held.append([c[:whole] for c in columns])
                yield settle(held)
                held = []
            held.append(distinct([c[whole:] for c in columns]))
        if held:
            yield settle(held)

    ordered = contexts.repartition("gram").sortWithinPartitions("gram", "doc_id", "start")
    return ordered.mapInArrow(run, "doc_id long, row int, start int, last int")


def induced_hot(contexts: DataFrame) -> DataFrame:
    """As ``induced`` for grams of very many contexts: every window is a row and sorted by its name."""

    def spread(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                name, number, place = _windows(some.column("body").to_pylist())
                gram, doc, row, start = (some.column(n).to_numpy() for n in ("gram", "doc_id", "row", "start"))
                key = mix(name, 61) ^ mix(gram.view(np.uint64), 62)[number]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(name.view(np.int64)), pa.array(doc[number]), pa.array(row[number]),
                     pa.array((start[number] + place).astype(np.int32))],
                    ["key", "name", "doc_id", "row", "start"],
                )

    def run(batches):
        import pyarrow as pa

        key = name = lead = None
        for batch in batches:
            k, m, d, s = (batch.column(n).to_numpy() for n in ("key", "name", "doc_id", "start"))
            if not len(k):
                continue
            new = np.concatenate([[key is None or k[0] != key or m[0] != name], (k[1:] != k[:-1]) | (m[1:] != m[:-1])])
            at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            first_doc = np.where(at >= 0, d[np.maximum(at, 0)], 0 if lead is None else lead[0])
            first_start = np.where(at >= 0, s[np.maximum(at, 0)], 0 if lead is None else lead[1])
            hit = np.flatnonzero(~new & ((d != first_doc) | (s != first_start)))
            key, name, lead = k[-1], m[-1], (first_doc[-1], first_start[-1])
            start = pa.array(s[hit], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(d[hit]), pa.array(batch.column("row").to_numpy()[hit]), start, start], ["doc_id", "row", "start", "last"])

    rows = contexts.mapInArrow(spread, "key long, name long, doc_id long, row int, start int")
    ordered = rows.repartition("key").sortWithinPartitions("key", "name", "doc_id", "start")
    return ordered.mapInArrow(run, "doc_id long, row int, start int, last int")


def bit_table(grams: DataFrame, bits: int = OPEN_BITS) -> np.ndarray:
    """Marks the grams in a table of ``bits`` bits; its packed pieces reach the driver one by one."""
    words = 1 << 12

    def run(batches):
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            spot = (batch.column(0).to_numpy().view(np.uint64) % np.uint64(bits)).astype(np.int64)
            for piece in np.unique(spot // (64 * words)):
                mine = spot[spot // (64 * words) == piece] - piece * 64 * words
                np.bitwise_or.at(held.setdefault(int(piece), np.zeros(words, np.int64)), mine >> 6, np.int64(1) << (mine & 63))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["piece", "bits"])

    # bits is a power of two, so the low bits of the signed number are those of the unsigned one
    place = F.floor(F.col("gram").bitwiseAND(F.lit(bits - 1)) / (64 * words))
    packed = grams.select("gram").repartition(place).mapInArrow(run, "piece long, bits binary")
    table = np.zeros(bits // 64, np.int64)
    for piece, content in packed.toLocalIterator():
        table[piece * words:(piece + 1) * words] |= np.frombuffer(bytes(content), np.int64)
    return table


def repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, row, start, last): runs of window starts whose window also starts earlier.

    ``documents`` comes from ``keyed``.
    """
    spark = documents.sparkSession
    found = landed(named(sampled(documents)))
    open_grams = found.where("gram IS NOT NULL").select("gram", "contexts")
    whole = found.where("gram IS NULL").select("doc_id", "row", "start", "last")
    table = spark.sparkContext.broadcast(bit_table(open_grams))
    contexts = landed(open_contexts(documents, table))
    hot = open_grams.where(F.col("contexts") > HOT).select("gram")
    cold = contexts.join(hot, "gram", "left_anti")
    return whole.unionByName(induced(cold)).unionByName(induced_hot(contexts.join(hot, "gram")))


def byte_runs(starts: list[int], lasts: list[int]) -> list[tuple[int, int]]:
    """Maximal byte runs (start, end) that windows starting in these runs cover."""
    out: list[list[int]] = []
    for a, z in sorted(zip(starts, lasts)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z + LENGTH)
        else:
            out.append([a, z + LENGTH])
    return [(a, z) for a, z in out]


def drop_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, text (the bytes that stay), spans (removed byte runs) and n_bytes of every row.

    Null texts are empty. Matches never cross documents; rows repeating a doc_id and its text do not
    remove each other, as nothing in them starts earlier. Texts shorter than ``LENGTH`` stay whole.
    """
    ready(documents)
    base = keyed(documents)
    runs = repeats(base).groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "last")).alias("runs"))

    def identify(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [_row_id(t) for t in binary(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(rows, pa.int32())], ["doc_id", "text", "row"])

    rows = base.mapInArrow(identify, "doc_id long, text string, row int")
    joined = rows.join(runs, ["doc_id", "row"], "left").select("doc_id", "text", "runs")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            kept, spans, size = [], [], []
            for text, found in zip(binary(batch, "text"), batch.column("runs").to_pylist()):
                gone = byte_runs([r["start"] for r in found], [r["last"] for r in found]) if found else []
                at, pieces = 0, []
                for a, z in gone:
                    pieces.append(text[at:a])
                    at = z
                pieces.append(text[at:])
                kept.append(b"".join(pieces))
                spans.append([{"start": a, "end": z} for a, z in gone])
                size.append(len(text))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(spans, span), pa.array(size, pa.int64())], ["doc_id", "text", "spans", "n_bytes"]
            )

    out = joined.mapInArrow(cut, "doc_id long, text binary, spans array<struct<start: long, end: long>>, n_bytes long")
    return out.withColumn("doc_id", original_id())


def digest(documents: DataFrame) -> DataFrame:
    """Counts and a checksum of what stays, per document."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return drop_repeats(documents).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")
    )
