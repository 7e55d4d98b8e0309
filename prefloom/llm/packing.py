"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the binary digits of n, the largest
allowed length repeated as often as needed. Every piece is a sequence of its own, so no sequence
crosses documents and, as all lengths are powers of two, none is padded. Sequences of one length
form a bucket; a training batch takes its sequences from one bucket.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import REMEMBERED, arrow_map, held, keyed, original_id, parts, ready

TOKENIZER = "word_bpe_49k.json"
#: Pieces of one call to the tokenizer, and words of plain letters that it takes as one text.
CALL = 10_000
WORDS = 1000
#: The last token of a word ends with this sign, no other one does.
WORD_END = "</w>"
#: Letters below this one are the same letters to Python and to the tokenizer.
PLAIN = "\u0250"
#: The sign that stands for each byte in the merges: itself if it is printed, else the next one from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: b for b in _PRINTED} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
#: Signs that the tokenizer always separates from letters before them.
SIGNS = '.,;:!?%&$*#"()|-'
#: What the tokenizer takes as white space; Python's also has the separators 1C to 1F.
BLANKS = re.compile(r"[^\S\x1c-\x1f]+")
SEPARATORS = re.compile(r"[\x1c-\x1f]")


def little(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class WordIds(dict):
    """Token ids of words between blanks, as little-endian unsigned 32-bit numbers, remembered.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    words in turn. A word of letters and signs is the ids of its lower-case letters, then of the
    signs; anything else goes to the tokenizer as it is. What a batch of texts has of unknown pieces is
    tokenized in few calls; plain letters, which the tokenizer would leave as they are and in one, go to
    its merges alone.
    """

    def __init__(self, path: str, limit: int = REMEMBERED):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.model.model)
        vocabulary = self.model.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.pieces: dict[str, bytes] = {}
        self.long: dict[str, bytes] = {}
        self.limit = limit

    @staticmethod
    def split(text: str) -> list[str]:
        return [w for w in BLANKS.split(text) if w] if SEPARATORS.search(text) else text.split()

    @staticmethod
    def cut(word: str) -> tuple[str, ...]:
        """The pieces of a word that are tokenized apart."""
        if word.isascii() and word.isalpha():
            return (word.lower(),)
        letters = word.rstrip(SIGNS)
        low = letters.lower()
        if low.isalpha() and "Σ" not in letters and (low.isascii() or unicodedata.is_normalized("NFC", letters)):
            signs = word[len(letters):]
            return (low, signs) if signs else (low,)
        return (word,)

    def tokenized(self, pieces: list[str]) -> None:
        """Ids of these pieces, into ``pieces``."""
        plain = [p for p in pieces if p.isalpha() and max(p) < PLAIN and p.islower()]
        calls = [plain[k:k + WORDS] for k in range(0, len(plain), WORDS)]
        signs = [[p if p.isascii() else p.encode().decode("latin-1").translate(BYTE_SIGNS) for p in call] for call in calls]
        for call, found in zip(calls, self.merges.encode_batch_fast(signs, is_pretokenized=True, add_special_tokens=False)):
            ids = found.ids
            ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            if len(ends) == len(call):  # else a tokenizer that marks no ends
                packed = little(ids)
                self.pieces.update(zip(call, [packed[a:b] for a, b in zip([0, *ends], ends)]))
        rest = [p for p in pieces if p not in self.pieces]
        for piece, found in zip(rest, self.model.encode_batch_fast(rest, add_special_tokens=False)):
            self.pieces[piece] = little(found.ids)

    def learn(self, words: Iterable[str]) -> None:
        """Ids of all these words, until the next call at least; words of 64 signs or more only until then."""
        self.long.clear()
        if len(self) > self.limit:
            self.clear()
        if len(self.pieces) > 2 * self.limit:
            self.pieces.clear()
        cut = {w: self.cut(w) for w in words if w not in self}
        unknown = list({p for ps in cut.values() for p in ps} - self.pieces.keys())
        for start in range(0, len(unknown), CALL):
            self.tokenized(unknown[start:start + CALL])
        for word, ps in cut.items():
            (self if len(word) < 64 else self.long)[word] = b"".join([self.pieces[p] for p in ps])
        for piece in {p for w in self.long for p in cut[w] if len(p) >= 64}:
            del self.pieces[piece]

    def __missing__(self, word: str) -> bytes:
        return self.long[word]

    def ids_of(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of each text; every distinct word of them is looked up once."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if pc.any(pc.match_substring_regex(column, SEPARATORS.pattern)).as_py():
            split = pa.array([self.split(t) for t in column.to_pylist()], pa.list_(pa.string()))
        else:  # at the white space that Python knows; the ends of a text may be empty words, without ids
            split = pc.utf8_split_whitespace(column)
        coded = split.values.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        self.learn(words)
        ids = pa.array([self[w] for w in words], pa.large_binary()).take(coded.indices)
        if not len(ids):
            return [b""] * len(column)
        _, places, packed = ids.buffers()
        ends = np.frombuffer(places, np.int64)[split.offsets.to_numpy()].tolist()
        return [packed[a:b].to_pybytes() for a, b in zip(ends, ends[1:])]

    def ids(self, text: str) -> bytes:
        return self.ids_of([text])[0]


def word_ids(path: str) -> WordIds:
    return held(f"token ids of {path}", lambda: WordIds(path))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_lengths(n: int, longest: int) -> list[int]:
    """``longest`` as often as it fits, then the binary digits of the rest, large to small."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def decompose(documents: DataFrame, longest: int = 4096, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, bucket (log2 of length), ids (packed), doc_tokens.

    A null or empty text is the end token alone; repeated rows are packed once per row; an empty
    table gives no piece. ``longest`` must be a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    ready(documents)
    where = path or tokenizer_path()

    def work(batch):
        words = word_ids(where)
        end = np.asarray([end_id], "<u4").tobytes()
        for part in parts(batch):
            out = {k: [] for k in ("doc_id", "start", "length", "bucket", "ids", "doc_tokens")}
            for doc, ids in zip(part.column("doc_id").to_pylist(), words.ids_of(part.column("text"))):
                ids += end
                n, start = len(ids) // 4, 0
                for length in piece_lengths(n, longest):
                    for k, v in zip(out, (doc, start, length, length.bit_length() - 1, ids[4 * start:4 * (start + length)], n)):
                        out[k].append(v)
                    start += length
            yield out

    schema = "doc_id long, start long, length long, bucket int, ids binary, doc_tokens long"
    return arrow_map(keyed(documents), work, schema).withColumn("doc_id", original_id())


def sequences(pieces: DataFrame) -> DataFrame:
    """Adds sequence_id and offset: each piece is one sequence.

    The id is the piece's place among the pieces of its input partition, below the partition's
    number; a task that runs again gives the same ids.
    """
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def batches(packed: DataFrame, tokens: int = 1 << 16) -> DataFrame:
    """Adds batch_id: sequences of one bucket, ``tokens`` tokens to a full batch.

    Sequences are numbered inside each (partition, bucket), so a batch never mixes lengths and no
    bucket has to meet in one task; each partition ends with at most one short batch per bucket.
    """
    per = F.greatest(F.lit(1), F.floor(F.lit(tokens) / F.col("length")).cast("long"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("partition", "bucket").orderBy("sequence_id")) - 1
    numbered = packed.withColumn("partition", F.shiftright("sequence_id", 33)).withColumn("batch_id", F.floor(place / per))
    return numbered.withColumn("batch_id", F.concat_ws("-", "bucket", "partition", "batch_id")).drop("partition")


def packed_digest(documents: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return sequences(decompose(documents)).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )
