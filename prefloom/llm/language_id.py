"""Language identification with error-correcting output codes.

Every language has a codeword of bits; for each bit a binary classifier over byte n-grams tells
languages with the bit from those without. A classifier is linear: its weights are log ratios of
smoothed n-gram frequencies of the two sides, so all of them follow from one table of n-gram counts
per language, summed over all training rows. Decoding adds up, for each codeword, the logistic loss
of every bit, weighted by how well its classifier separates the training counts, and takes the
codeword of the smallest loss. The score compares that loss with the others; close calls are
flagged as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import arrow_map, binary, keyed, mix, original_id, parts, ready

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    #: n-gram lengths in bytes, counted inside words with a blank at both ends.
    lengths: tuple[int, ...] = (2, 3, 4)
    bits: int = 14
    code_length: int = 31
    smoothing: float = 0.5
    #: Score below which a prediction is flagged.
    ambiguous: float = 0.6


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce((F.crc32(F.col(column).cast("string").cast("binary")) % 4) == 2, F.lit(False))


def codewords(n: int, length: int) -> np.ndarray:
    """n words of ``length`` bits that differ pairwise in about half of them; no bit is constant.

    Candidates for columns are drawn from a fixed stream of hashes; each step keeps the one that
    leaves the closest pair of words farthest apart.
    """
    if n < 2:
        return np.zeros((n, length), np.int8)
    chosen = np.zeros((n, 0), np.int8)
    upper = np.triu_indices(min(n, 512), 1)
    for step in range(length):
        best, best_value = None, None
        for trial in range(16):
            bits = (mix(np.arange(n, dtype=np.uint64), step * 16 + trial + 1) & np.uint64(1)).astype(np.int8)
            if bits.min() == bits.max():
                bits[trial % n] ^= 1
            words = np.concatenate([chosen, bits[:, None]], axis=1)[:512]
            apart = (words[:, None, :] != words[None, :, :]).sum(axis=2)[upper]
            value = (apart.min(), apart.mean())
            if best_value is None or value > best_value:
                best, best_value = bits, value
        chosen = np.concatenate([chosen, best[:, None]], axis=1)
    return chosen


@lru_cache(maxsize=4)
def _lower() -> bytes:
    """A-Z to a-z; blanks, digits and ASCII signs to one blank."""
    return bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: bytes, settings: Settings) -> np.ndarray:
    """Slots of all n-grams of a text that hold a letter."""
    low = text.decode("utf-8", "replace").lower().encode().translate(_lower())
    flat = np.frombuffer(b" " + b" ".join(low.split()) + b" ", np.uint8)
    blank, out = flat == 32, []
    for n in settings.lengths:
        m = len(flat) - n + 1
        if m < 1:
            continue
        gram = np.full(m, n, np.uint64)
        inner = np.zeros(m, bool)
        for i in range(n):
            gram = gram * np.uint64(257) + flat[i:m + i].astype(np.uint64)
            if 0 < i < n - 1:
                inner |= blank[i:m + i]
        letters = ~(blank[:m] & blank[n - 1:]) if n == 2 else ~inner
        out.append((mix(gram[letters], 41) >> np.uint64(64 - settings.bits)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Model:
    def __init__(self, settings: Settings, languages: list[str], counts: np.ndarray):
        self.settings, self.languages = settings, languages
        self.code = codewords(len(languages), settings.code_length)
        total = counts.sum(axis=1, keepdims=True)
        rate = (counts + settings.smoothing) / (total + settings.smoothing * counts.shape[1])
        self.weights = np.zeros((counts.shape[1], self.code.shape[1]), np.float32)
        for b in range(self.code.shape[1]):
            one, zero = rate[self.code[:, b] == 1], rate[self.code[:, b] == 0]
            if len(one) and len(zero):
                self.weights[:, b] = np.log(one.mean(axis=0)) - np.log(zero.mean(axis=0))
        # margin of each language's own text under each bit, and how surely a bit is told
        margins = (rate @ self.weights) * np.where(self.code == 1, 1, -1) if len(languages) else np.zeros((0, 1))
        self.trust = np.maximum(margins.min(axis=0), 1e-3) if len(languages) else np.ones(self.code.shape[1])
        self.trust = self.trust / self.trust.sum()

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        signs = np.where(self.code == 1, 1.0, -1.0)
        for text in texts:
            if not has_letter(text) or not self.languages:
                out.append((UNKNOWN, 0.0))
                continue
            slots = features(text.encode("utf-8", "surrogatepass"), self.settings)
            if not len(slots):
                out.append((self.languages[0], 1 / len(self.languages)))
                continue
            seen = np.bincount(slots, minlength=1 << self.settings.bits)
            used = np.flatnonzero(seen)
            margin = seen[used].astype(np.float32) @ self.weights[used] / np.sqrt(len(slots))
            loss = (np.logaddexp(0, -signs * margin) * self.trust).sum(axis=1)
            chance = np.exp(-4 * (loss - loss.min()))
            best = int(np.argmin(loss))
            out.append((self.languages[best], float(chance[best] / chance.sum())))
        return out


def fit(documents: DataFrame, settings: Settings = Settings()) -> Model:
    """n-gram counts per language over all rows that are not held out and have a language."""
    rows = documents.where(~held_out()).where("lang IS NOT NULL AND text IS NOT NULL").select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    size = 1 << settings.bits

    def run(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in parts(batch):
                for lang, text in zip(part.column("lang").to_pylist(), binary(part, "text")):
                    if lang not in sums:
                        sums[lang] = np.zeros(size, np.int64)
                    sums[lang] += np.bincount(features(text, settings), minlength=size)
        for lang, counts in sums.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], ["lang", "slot", "n"]
            )

    counted = rows.mapInArrow(run, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    frame = counted.toPandas()  # languages times 2 ** bits rows at most
    languages = sorted(frame["lang"].unique().tolist())
    counts = np.zeros((len(languages), size))
    if languages:
        counts[frame["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(), frame["slot"].to_numpy()] = frame["n"].to_numpy()
    return Model(settings, languages, counts)


def identify(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous for every row of ``documents``.

    A null text and one without letters is ``und`` with score 0; so is every text if no training row
    has a language. Equal scores go to the language first in order. Rows repeating a doc_id are
    judged each by its own text.
    """
    spark = ready(documents)
    model = spark.sparkContext.broadcast(fit(documents, settings))

    def work(batch):
        for part in parts(batch):
            lang, score = zip(*model.value.predict(part.column("text").to_pylist()))
            yield {"doc_id": part.column("doc_id"), "lang_pred": list(lang), "score": list(score)}

    found = arrow_map(keyed(documents), work, "doc_id long, lang_pred string, score double").select(original_id(), "lang_pred", "score")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", (F.col("score") < settings.ambiguous).alias("ambiguous"))
