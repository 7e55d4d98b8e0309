"""Toxicity from two class-conditional Kneser-Ney models.

Both models spell words letter by letter: the next byte given up to six bytes before it in the word.
The longest contexts, and those that begin with the word, count occurrences in their class; every
shorter context counts its *distinct* continuations to the left, as Kneser and Ney have it. A context
gives ``discount`` of each count to the next shorter one. Contexts of none and one byte are shared:
they count the continuations seen in either class, so a rare expression is equally likely under both
until a class has shown it.

The toxic model of a document draws a ``share`` of its words from the toxic letters and the rest from
the ordinary ones, as toxic texts are ordinary prose for the most part. With a word's ratio e^r the
two log-likelihoods, divided by the number of words, differ by the mean of log(1 - share + share * e^r).
A logistic curve turns this difference into a score.

A *site* is a byte with its context, packed into a long. The distinct words of the corpus with their
counts of both classes are one table, the distinct sites another; both grow with the input. All
contexts of two bytes or more of a site end in the same two bytes, so one shuffle by these brings
every count together that its probabilities need. A scoring task gets the values of the most frequent
words and sites; the others meet theirs in a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import NULL_ID, arrow_map, binary, discard, held, keyed, landed, original_id, parts, ready, returned, runs, unused
from prefloom.llm.decontamination import bit_table

STRIP = b".,;:!?%&$*#\"'()|-"
THRESHOLD = 0.3
#: Control bytes that the packed form uses itself count as another one.
PLAIN = bytes.maketrans(b"\x00\x02\x03", b"\x01\x01\x01")
START = 2
#: Bytes of a site: one and six of context.
ORDER = 7
#: Bits of the filter on labelled ids; a fuller one lets more texts into the join, no other result.
FILTER_BITS = 1 << 23
#: Most frequent words and sites whose values tasks hold; those of all others are joined.
FREQUENT = 1 << 16


@dataclass(frozen=True)
class Settings:
    discount: float = 0.75
    share: float = 0.05
    #: One training row in so many fits the logistic curve instead of the counts.
    curve_share: int = 6
    #: Bins of the curve's histogram; the fit sees counts per bin, of all its rows.
    bins: int = 400


def held_out(column: str = "doc_id") -> Column:
    return (F.crc32(F.col(column).cast("string").cast("binary")) % 4) == 2


def split_words(text: bytes) -> list[bytes]:
    return [w.strip(STRIP) for w in text.lower().translate(PLAIN).split()]


def word_counts(documents: DataFrame, labelled: DataFrame) -> DataFrame:
    """word, n, ordinary, toxic: occurrences in all documents, and in the labelled ones by class."""

    def work(batch):
        from collections import Counter

        for part in parts(batch, 32 << 20):
            both = Counter(), Counter()
            for text, toxic in zip(binary(part, "text"), part.column("toxic").to_pylist()):
                both[toxic].update(split_words(text))
            words = list(both[0] | both[1])
            yield {"word": words, "n": np.zeros(len(words), np.int64), "ordinary": [both[0][w] for w in words], "toxic": [both[1][w] for w in words]}

    def plain(batch):
        from collections import Counter

        for part in parts(batch, 32 << 20):
            found = Counter()
            for text in binary(part, "text"):
                found.update(split_words(text))
            none = np.zeros(len(found), np.int64)
            yield {"word": list(found), "n": list(found.values()), "ordinary": none, "toxic": none}

    kind = "word binary, n long, ordinary long, toxic long"
    rows = arrow_map(documents.select("text"), plain, kind).unionByName(arrow_map(labelled.select("text", "toxic"), work, kind))
    return rows.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "ordinary", "toxic")))


def slices(words: list[bytes], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of words of about ``limit`` bytes at most (one word at least)."""
    sizes = np.cumsum([len(w) + 2 for w in words])
    start = 0
    while start < len(words):
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + limit, side="right")))
        yield start, end
        start = end


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def packed_sites(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The site of every position behind a word's start sign, and its word number.

    A site is the position's byte and the six bytes before it, newest lowest; 0 where the word has
    not begun. The start sign is the oldest byte of a word and stands nowhere else.
    """
    flat = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.int64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    site = np.zeros(len(flat), np.int64)
    for k in range(min(ORDER, len(flat))):
        earlier = np.concatenate([np.zeros(k, np.int64), flat[:len(flat) - k]])
        site |= np.where(place >= k, earlier, 0) << 8 * k
    kept = np.flatnonzero(place > 0)
    return site[kept], word[kept]


def site_counts(words: DataFrame) -> DataFrame:
    """site, n, ordinary, toxic: summed over the distinct words, ``n`` as the number of words."""

    def cut(batch):
        listed = batch.column("word").to_pylist()
        counts = [batch.column(c).to_numpy() for c in ("ordinary", "toxic")]
        for at, end in slices(listed):
            site, word = packed_sites(listed[at:end])
            named, inverse = np.unique(site, return_inverse=True)
            sums = [np.bincount(inverse, n[at + word], len(named)).astype(np.int64) for n in counts]
            yield {"site": named, "n": np.bincount(inverse, minlength=len(named)), "ordinary": sums[0], "toxic": sums[1]}

    rows = arrow_map(words.select("word", "ordinary", "toxic"), cut, "site long, n long, ordinary long, toxic long")
    return rows.groupBy("site").agg(*(F.sum(c).alias(c) for c in ("n", "ordinary", "toxic")))


def _low(k: int) -> int:
    """Mask of a site's byte and ``k`` bytes of context."""
    return (1 << 8 * min(k + 1, ORDER)) - 1


def _named(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    named, inverse = np.unique(keys, return_inverse=True)
    return named, np.bincount(inverse, n, len(named))


def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    named, n = table
    if not len(named):
        return np.zeros(len(keys))
    place = np.minimum(np.searchsorted(named, keys), len(named) - 1)
    return np.where(named[place] == keys, n[place], 0.0)


def refined(sites: np.ndarray, k: int, table: tuple[np.ndarray, np.ndarray], shorter: np.ndarray, discount: float) -> np.ndarray:
    """Probability of each site by ``k`` bytes of context, from those by one byte less; unseen contexts add nothing."""
    grams, n = table
    kept = np.maximum(n - discount, 0)
    key = sites & _low(k)
    total = _look(_named(grams >> 8, n), key >> 8)
    left = total - _look(_named(grams >> 8, kept), key >> 8)
    return np.where(total > 0, (_look((grams, kept), key) + left * shorter) / np.maximum(total, 1e-9), shorter)


def continuations(sites: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams with ``k`` bytes of context and their Kneser-Ney counts, from sites that were seen.

    Occurrences for the longest contexts and those that begin with the word, distinct bytes to the left for others.
    """
    oldest = (sites >> 8 * k) & 255
    whole = (oldest == START) if k < ORDER - 1 else (oldest != 0)
    longer = np.unique(sites[(oldest != 0) & ~whole] & _low(k + 1)) & _low(k)
    return _named(np.concatenate([sites[whole] & _low(k), longer]), np.concatenate([n[whole].astype(float), np.ones(len(longer))]))


class Shared:
    """Probability of each site by one byte of context: at most 2^16 n-grams, of both classes."""

    def __init__(self, sites: DataFrame, discount: float):
        site = F.col("site")
        # three bytes, then two: distinct bytes to the left, but occurrences behind the start sign
        three = sites.where("ordinary + toxic > 0").groupBy(site.bitwiseAND(_low(2)).alias("gram")).agg(F.sum(F.col("ordinary") + F.col("toxic")).alias("n"))
        begins = F.shiftright("gram", 8).bitwiseAND(255) == START
        two = three.groupBy(F.col("gram").bitwiseAND(_low(1)).alias("key")).agg(F.sum(F.when(begins, F.col("n")).otherwise(1)).alias("n")).toPandas()
        keys = two["key"].to_numpy(np.int64)
        order = np.argsort(keys)
        self.pairs = keys[order], two["n"].to_numpy(float)[order]
        self.bytes = _named(keys & 255, np.ones(len(keys)))
        self.discount = discount

    def probabilities(self, sites: np.ndarray) -> np.ndarray:
        p = np.full(len(sites), 1 / 256)
        for k, table in enumerate((self.bytes, self.pairs)):
            p = refined(sites, k, table, p, self.discount)
        return p


def log_ratios(sites: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray, base: np.ndarray, discount: float) -> np.ndarray:
    """Log of the toxic over the ordinary probability of each site.

    ``sites`` are all that share their two bytes of context, ``base`` their shared probabilities.
    """
    logs = []
    for n in (ordinary, toxic):
        seen = n > 0
        p = base
        for k in range(2, ORDER):
            reaches = (sites >> 8 * k) & 255 != 0
            p = np.where(reaches, refined(sites, k, continuations(sites[seen], n[seen], k), p, discount), p)
        logs.append(np.log(np.maximum(p, 1e-30)))
    return logs[1] - logs[0]


def site_ratios(sites: DataFrame, settings: Settings) -> DataFrame:
    """site, n, ratio for every distinct site; memory: the sites of one pair of bytes."""
    sent = sites.sparkSession.sparkContext.broadcast(Shared(sites, settings.discount))

    def run(batches):
        import pyarrow as pa

        for _, site, n, ordinary, toxic in runs(batches, ("pair", "site", "n", "ordinary", "toxic")):
            ratio = log_ratios(site, ordinary, toxic, sent.value.probabilities(site), settings.discount)
            yield pa.RecordBatch.from_arrays([pa.array(site), pa.array(n), pa.array(ratio)], ["site", "n", "ratio"])

    pair = F.shiftright("site", 8).bitwiseAND(0xFFFF).cast("int").alias("pair")
    dealt = sites.select(pair, "site", "n", "ordinary", "toxic").repartition("pair").sortWithinPartitions("pair")
    return dealt.mapInArrow(run, "site long, n long, ratio double")


def word_values(words: DataFrame, settings: Settings) -> DataFrame:
    """word (hash), value: the mixture evidence of every word.

    Tasks know the ratios of the ``FREQUENT`` most common sites; a word's other sites meet theirs in a join.
    """
    context = words.sparkSession.sparkContext
    sites = landed(site_counts(words))
    ratios = landed(site_ratios(sites, settings))
    discard(sites)
    frame = ratios.orderBy(F.desc("n"), "site").limit(FREQUENT).select("site", "ratio").toPandas().sort_values("site")
    told = context.broadcast((frame["site"].to_numpy(np.int64), frame["ratio"].to_numpy(float)))

    def add(batch):
        listed = batch.column("word").to_pylist()
        known, ratio = told.value
        for at, end in slices(listed):
            site, word = packed_sites(listed[at:end])
            place = np.minimum(np.searchsorted(known, site), len(known) - 1)
            hit = known[place] == site
            others = np.split(site[~hit], np.searchsorted(word[~hit], np.arange(1, end - at)))
            yield {"word": word_hashes(listed[at:end]), "known": np.bincount(word, np.where(hit, ratio[place], 0.0), end - at), "others": others}

    rows = landed(arrow_map(words.select("word"), add, "word long, known double, others array<long>"))
    others = rows.select("word", F.explode("others").alias("site")).join(ratios.select("site", "ratio"), "site")
    more = others.groupBy("word").agg(F.sum("ratio").alias("more"))
    ratio = F.col("known") + F.coalesce("more", F.lit(0.0))
    clipped = F.least(F.greatest(ratio, F.lit(-50.0)), F.lit(50.0))
    values = landed(rows.join(more, "word", "left").select("word", F.log1p(settings.share * F.expm1(clipped)).alias("value")))
    discard(ratios, rows)
    return values


def evidence(documents: DataFrame, words: DataFrame, values: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), evidence of every row: the mean of its words' values; 0 without words.

    Tasks know the ``FREQUENT`` most frequent words; the others meet their values in a join.
    """
    named = words.orderBy(F.desc("n"), "word").limit(FREQUENT)
    hashed = arrow_map(named.select("word"), lambda b: iter([{"text": b.column("word"), "word": word_hashes(b.column("word").to_pylist())}]), "text binary, word long")
    frame = hashed.join(values, "word", "left").select("text", F.coalesce("value", F.lit(0.0)).alias("value")).toPandas()
    sent = documents.sparkSession.sparkContext.broadcast(dict(zip(map(bytes, frame["text"]), frame["value"].tolist())))

    def work(batch):
        held("toxicity", dict)  # lets another operator's memory go
        known = sent.value
        for part in parts(batch):
            out = {k: [] for k in ("known", "words", "others")}
            for text in binary(part, "text"):
                split = split_words(text)
                out["known"].append(math.fsum(known[w] for w in split if w in known))
                out["words"].append(len(split))
                out["others"].append(word_hashes([w for w in split if w not in known]))
            yield {n: part.column(n) for n in ("doc_id", "digest")} | out

    kind = "doc_id long, digest long, known double, words long, others array<long>"
    marked = documents.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    rows = landed(arrow_map(marked, work, kind).withColumn("row", F.monotonically_increasing_id()))
    others = rows.select("row", F.explode("others").alias("word")).join(values, "word").groupBy("row").agg(F.sum("value").alias("more"))
    total = F.col("known") + F.coalesce("more", F.lit(0.0))
    mean = F.when(F.col("words") > 0, total / F.col("words")).otherwise(0.0)
    return landed(rows.drop("others").join(others, "row", "left").select("doc_id", "digest", mean.alias("evidence")))


def logistic(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and shift of a ridge logistic fit on (value, rows, toxic rows)."""
    if not bins:
        return 10.0, -1.0
    x, n, y = (np.asarray(v, float) for v in zip(*bins))
    middle, width = np.average(x, weights=n), max(np.sqrt(np.average((x - np.average(x, weights=n)) ** 2, weights=n)), 1e-6)
    z, w = (x - middle) / width, np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w[0] * z + w[1], -30, 30)))
        gradient = np.asarray([((y - n * p) * z).sum() - 0.1 * w[0], (y - n * p).sum() - 0.1 * w[1]])
        h = n * p * (1 - p)
        hessian = np.asarray([[(h * z * z).sum() + 0.1, (h * z).sum()], [(h * z).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(hessian, gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / width), float(w[1] - w[0] * middle / width)


def hinted(documents: DataFrame, marks: DataFrame) -> DataFrame:
    """The documents whose id may be among ``marks``: all that are, and few others."""
    sent = documents.sparkSession.sparkContext.broadcast(bit_table(marks.select(F.xxhash64("doc_id").alias("hash")), FILTER_BITS))

    def run(batches):
        for batch in batches:
            spot = np.mod(batch.column("hash").to_numpy(), np.int64(FILTER_BITS))
            yield batch.filter((sent.value[spot >> 6] >> (spot & 63)) & 1 == 1)

    rows = documents.select("doc_id", "text", F.xxhash64("doc_id").alias("hash"))
    return rows.mapInArrow(run, "doc_id long, text string, hash long").drop("hash")


def judged(documents: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, digest, score of every row, learned from the labelled documents that are not held out.

    A document labelled more than once is toxic if any label says so. Without labels every text gets
    the score of no evidence.
    """
    ready(documents)
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.greatest(F.lit(0), F.least(F.lit(1), F.max("toxic"))).cast("int").alias("toxic")
    )
    part = F.shiftright(F.crc32(F.col("doc_id").cast("string").cast("binary")), 2) % settings.curve_share
    base = keyed(documents)
    # labels grow with the corpus and are not broadcast at any size; a filter keeps texts without labels from the shuffle
    marked = marks.where(~held_out()).where(part != 0)
    labelled = hinted(base.where(~held_out()).where(part != 0), marked).join(marked.hint("merge"), "doc_id").select("text", "toxic")
    words = landed(word_counts(base, labelled))
    returned()
    values = word_values(words, settings)
    seen = evidence(base, words, values)
    discard(words)
    curve = seen.where(~held_out()).where(part == 0).join(marks, "doc_id")
    width = 4.0 / settings.bins
    binned = curve.groupBy(F.least(F.greatest(F.floor(F.col("evidence") / width), F.lit(-settings.bins)), F.lit(settings.bins)).alias("bin"))
    rows = binned.agg(F.count("*").alias("n"), F.sum("toxic").alias("t"), F.avg("evidence").alias("x")).collect()
    slope, shift = logistic([(r["x"], r["n"], r["t"]) for r in rows])
    return seen.select("doc_id", "digest", (1 / (1 + F.exp(-(F.col("evidence") * slope + shift)))).alias("score"))


def score(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``documents``.

    A null or empty text has the score of no evidence; repeated rows are scored each.
    """
    return judged(documents, labels, settings).select(
        original_id(), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def clean(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents, all columns, whose score stays below the threshold."""
    toxic = judged(documents, labels, settings).where(F.col("score") >= THRESHOLD)
    own, text = unused(documents, "__id"), unused(documents, "__digest")
    gone = toxic.select(F.col("doc_id").alias(own), F.col("digest").alias(text)).distinct()
    keys = {
        own: F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)),
        text: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))),
    }
    return documents.withColumns(keys).join(gone, [own, text], "left_anti").select(*documents.columns)
