"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders; names and number-unit pairs of several words
become one. Windows of ``WINDOW`` template words are hashed and joined between documents and
benchmark items, so a question with other numbers or names still meets its original. Aligned
windows must fill their slots consistently: one value of the item stands for one value in the
document and back; windows that break this do not count. A document is contaminated by an item if
consistent windows cover at least half of the item's windows, or ``RUN`` of them follow each other.

Windows of mostly slots say too little by their template. An item without any other window, by its
length or its slots, is looked for whole and with its values: its literal word sequence is hashed.
Items of slots alone, such as a list of numbers, are not looked for.

Documents are scanned once. A bit table of fixed size, filled from the benchmark's window hashes,
holds back windows that can't match; where a benchmark outgrows it, more windows are shuffled and
the result stays the same.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import NULL_ID, REMEMBERED, arrow_map, binary, held, keyed, landed, mix, original_id, parts, ready, unused

WINDOW = 8
COVERAGE = 0.5
#: Consistent windows in a row that count as contamination: a passage of RUN + WINDOW - 1 words.
RUN = 6
FILTER_BITS = 1 << 23
#: Unit words, fixed values of the method.
UNITS = frozenset(
    b"mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs oz pound pounds ml l liter liters litre "
    b"litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    b"mph kph dollar dollars cent cents euro euros usd eur percent degree degrees meter meters metre metres gram grams kilogram "
    b"kilograms kilometer kilometers ton tons watt watts volt volts joule joules newton newtons hz khz mhz ghz kb mb gb tb".split()
)
#: Number words, fixed values of the method.
NUMBERS = frozenset(
    b"zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    b"nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen".split()
)
NUMBER = re.compile(rb"[+-]?[0-9][0-9.,:/]*%?")
NUMBER_UNIT = re.compile(rb"[+-]?[0-9][0-9.,]*([a-z]+)")
STRIP = b".,;:!?\"'()[]{}|*#&$%-_"
NUM, NAME, UNIT = 1, 2, 3
CAPITAL, ENDS, SKIP, KIND = 1, 2, 4, 3  # flags in the low bits of a code; KIND is a shift


class Codes(dict):
    """A word's flags, kind and hash in one number, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        core = word.strip(STRIP)
        low = core.decode("utf-8", "replace").lower().encode()
        flags = ENDS if word.rstrip(b"\"')]}*#&$%")[-1:] in (b".", b"!", b"?", b":") else 0
        kind = 0
        if not core:
            flags |= SKIP
        elif NUMBER.fullmatch(core) or low in NUMBERS or ((m := NUMBER_UNIT.fullmatch(low)) and m[1] in UNITS):
            kind = NUM
        elif low in UNITS:
            kind = UNIT
        else:
            text = core.decode("utf-8", "replace")
            if len(text) > 1 and text[0].isupper() and text[1:].islower():
                flags |= CAPITAL
        value = self[word] = (xxhash.xxh3_64_intdigest(low) & ~31 | kind << KIND | flags) & 0x7FFFFFFFFFFFFFFF
        return value


def codes() -> Codes:
    return held("template words", Codes)


def template(text: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Hash and kind of each template word (0: literal), the text's words, and where each starts in them."""
    words = text.split()
    code = np.fromiter(map(codes().__getitem__, words), np.int64, len(words))
    ends = np.concatenate([[True], (code[:-1] & ENDS) > 0]) if len(code) else np.zeros(0, bool)
    kept = np.flatnonzero((code & SKIP) == 0)
    code, after_end = code[kept], ends[kept]
    kind = code >> KIND & 3
    before = np.concatenate([[0], kind[:-1]]) if len(kind) else kind
    kind = np.where((kind == UNIT) & (before != NUM), 0, kind)
    kind = np.where((kind == 0) & ((code & CAPITAL) > 0) & ~after_end, NAME, kind)
    again = np.concatenate([[False], (kind[1:] == NAME) & (kind[:-1] == NAME)]) if len(kind) else np.zeros(0, bool)
    keep = ~again
    value = np.where(kind > 0, kind, code & ~31).astype(np.uint64)
    return mix(value, 5)[keep], kind[keep], words, kept[keep]


def windows(value: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window at each place, and whether it holds enough literal words to count."""
    n = len(value) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    rolled = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + value[i:n + i]
    slots = np.concatenate([[0], np.cumsum(kind > 0)])
    return mix(rolled, 6), 2 * (slots[WINDOW:] - slots[:-WINDOW]) <= WINDOW


def slot_values(kind: np.ndarray, words: list[bytes], where: np.ndarray, at: int) -> list[str]:
    """The words in the slots of the window at ``at``."""
    out = []
    for i in range(at, at + WINDOW):
        if kind[i]:
            end = where[i + 1] if i + 1 < len(where) else len(words)
            text = b" ".join(w for w in (x.strip(STRIP) for x in words[where[i]:end]) if w) if kind[i] == NAME else words[where[i]].strip(STRIP)
            out.append(f"{kind[i]}{text.decode('utf-8', 'replace').lower()}")
    return out


def literal(text: bytes) -> np.ndarray:
    """Hash of each word as it stands, but for case and signs around it."""
    code = np.fromiter(map(codes().__getitem__, text.split()), np.int64)
    return mix((code[(code & SKIP) == 0] & ~31).astype(np.uint64), 7)


def sequences(value: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words at each place."""
    n = len(value) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15  # odd, so that a sum can be moved back to place 0
    powers, backs = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(value) - 1, x, np.uint64), dtype=np.uint64)]) for x in (base, pow(base, -1, 1 << 64)))
    sums = np.cumsum(np.concatenate([np.zeros(1, np.uint64), value * powers]), dtype=np.uint64)
    return mix((sums[size:] - sums[:-size]) * backs[:n], 8 + size)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, hash, item_at, item_slots, total, size for every counting window of every item.

    An item without one has a row for its whole literal sequence, of ``size`` words; size is 0 otherwise.
    """
    ready(benchmark)
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))

    def work(batch):
        out = {k: [] for k in ("item_id", "hash", "item_at", "item_slots", "total", "size")}
        for item, text in zip(batch.column("item_id").to_pylist(), binary(batch, "text")):
            value, kind, words, where = template(text)
            hashed, counts = windows(value, kind)
            places = np.flatnonzero(counts)
            rows = [(item, int(hashed[at].view(np.int64)), int(at), slot_values(kind, words, where, int(at)), len(places), 0) for at in places]
            if not rows and (kind == 0).any():
                whole = literal(text)
                rows = [(item, int(sequences(whole, len(whole))[0].view(np.int64)), 0, [], 1, len(whole))]
            for row in rows:
                for k, v in zip(out, row):
                    out[k].append(v)
        yield out

    return arrow_map(items, work, "item_id long, hash long, item_at int, item_slots array<string>, total int, size int")


def bit_table(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """One bit for each hash (column ``hash``), modulo ``bits``; at most ``bits`` / 64 rows reach the driver."""
    spot = F.pmod("hash", F.lit(bits))
    rows = hashes.groupBy(F.floor(spot / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(pmod(hash, {bits}L), 64) as int))")).alias("set")
    )
    table = np.zeros(bits // 64, np.int64)
    frame = rows.toPandas()
    table[frame["word"].to_numpy(np.int64)] = frame["set"].to_numpy(np.int64)
    return table


def consistent(matches: list[tuple[int, list[str], list[str]]]) -> tuple[list[int], bool]:
    """Places of the item whose aligned windows agree with the most frequent filling of every slot."""
    forth, back = defaultdict(Counter), defaultdict(Counter)
    for _, item, doc in matches:
        for x, y in zip(item, doc):
            forth[x][y] += 1
            back[y][x] += 1
    best = {x: min(c.items(), key=lambda p: (-p[1], p[0]))[0] for x, c in forth.items()}
    tseb = {y: min(c.items(), key=lambda p: (-p[1], p[0]))[0] for y, c in back.items()}
    good, changed = [], False
    for at, item, doc in matches:
        if all(best[x] == y and tseb[y] == x for x, y in zip(item, doc)):
            good.append(at)
            changed |= list(item) != list(doc)
    return good, changed


def longest_run(places: list[int]) -> int:
    """How many of the sorted places follow each other at most."""
    longest = run = 0
    for before, at in zip([None, *places], places):
        run = run + 1 if before is not None and at == before + 1 else 1
        longest = max(longest, run)
    return longest


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, coverage, reworded) for contaminated documents.

    ``reworded`` tells whether a counted window fills a slot with another value than the item. Null
    texts and items without text match nothing; rows repeating a doc_id count as one document; a null doc_id is one more id.
    """
    spark = ready(documents)
    items = landed(item_windows(benchmark))
    table = spark.sparkContext.broadcast(bit_table(items))
    lengths = sorted(r["size"] for r in items.where("size > 0").select("size").distinct().collect())

    def work(batch):
        bits = table.value
        for part in parts(batch):
            out = {k: [] for k in ("doc_id", "hash", "doc_at", "doc_slots")}
            for doc, text in zip(part.column("doc_id").to_pylist(), binary(part, "text")):
                value, kind, words, where = template(text)
                hashed, counts = windows(value, kind)
                signed = hashed.view(np.int64)
                spot = np.mod(signed, np.int64(FILTER_BITS))
                hit = np.flatnonzero(counts & ((bits[spot >> 6] >> (spot & 63)) & 1).astype(bool))
                for at in hit.tolist():
                    for k, v in zip(out, (doc, int(signed[at]), at, slot_values(kind, words, where, at))):
                        out[k].append(v)
                whole = literal(text) if lengths else ()
                for size in lengths:
                    signed = sequences(whole, size).view(np.int64)
                    spot = np.mod(signed, np.int64(FILTER_BITS))
                    for value in set(signed[((bits[spot >> 6] >> (spot & 63)) & 1).astype(bool)].tolist()):
                        for k, v in zip(out, (doc, value, 0, [])):
                            out[k].append(v)
            yield out

    found = arrow_map(keyed(documents), work, "doc_id long, hash long, doc_at int, doc_slots array<string>")
    aligned = found.join(items, "hash").groupBy("doc_id", "item_id", "total", (F.col("doc_at") - F.col("item_at")).alias("shift"))
    # an alignment has at most one entry for each window of its item
    matches = aligned.agg(F.collect_set(F.struct("item_at", "item_slots", "doc_slots")).alias("matches"))

    def check(batch):
        good, changed, run = [], [], []
        for rows in batch.column("matches").to_pylist():
            places, other = consistent(sorted((m["item_at"], tuple(m["item_slots"]), tuple(m["doc_slots"])) for m in rows))
            good.append(sorted(set(places)))
            changed.append(other)
            run.append(longest_run(good[-1]))
        yield {n: batch.column(n) for n in ("doc_id", "item_id", "total")} | {"places": good, "changed": changed, "run": run}

    checked = arrow_map(matches, check, "doc_id long, item_id long, total int, places array<int>, changed boolean, run int")
    whole = checked.select("*", F.explode("places").alias("at")).groupBy("doc_id", "item_id", "total").agg(
        F.count_distinct("at").alias("windows"), F.max("changed").alias("reworded"), F.max("run").alias("run")
    )
    share = F.col("windows") / F.col("total")
    return whole.where((share >= COVERAGE) | (F.col("run") >= RUN)).select(
        original_id(), "item_id", "windows", F.col("total").cast("long").alias("item_windows"), F.round(share, 6).alias("coverage"), "reworded"
    )


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that no item contaminates."""
    found = contaminated(documents.select("doc_id", "text"), benchmark)
    own = unused(documents, "__id")
    ids = found.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias(own)).distinct()
    held = documents.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    return held.join(ids, own, "left_anti").select(*documents.columns)
