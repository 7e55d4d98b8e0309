"""Packing and line dedup against direct computation, with nulls, empties, repeats and odd columns."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from prefloom.llm import line_dedup, packing

DOCS = [
    (1, "Hello, world! It's a test of U.S. naïve café 12345 co-op."),
    (2, None),
    (3, ""),
    (4, "ΑΣ ς İstanbul ÀÉÎ éclair <|endoftext|> x" * 40),
    (5, "word " * 9000),
    (6, "　tab\tand nbsp\nnew line"),
    (6, "　tab\tand nbsp\nnew line"),
    (None, "no id"),
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def test_pieces_hold_every_id_once(spark, tokenizer):
    frame = spark.createDataFrame([(a, b, "x", 1) for a, b in DOCS], "doc_id long, text string, length string, sequence_id int")
    pieces = packing.sequences(packing.decompose(frame)).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    want = sorted((d is None, d or 0, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in DOCS)
    rows = defaultdict(list)
    for p in pieces:
        assert p.length <= 4096 and p.length & (p.length - 1) == 0 and p.offset == 0 and p.bucket == p.length.bit_length() - 1
        rows[p.doc_id].append(p)
    got = []
    for d, some in rows.items():
        some.sort(key=lambda p: p.sequence_id)
        current = []
        for p in some:
            if p.start == 0 and current:
                got.append((d is None, d or 0, tuple(current)))
                current = []
            assert p.start == len(current)
            current += np.frombuffer(bytes(p.ids), "<u4").tolist()
        got.append((d is None, d or 0, tuple(current)))
    assert sorted(got) == want


def test_separators_are_not_blanks():
    from tokenizers import Tokenizer

    plain, words = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path())
    for text in ("a\x1cb", "\x1d x\x1e \x1f", "one\x85two\u2028three\u3000\x0b\x1cfour"):
        assert np.frombuffer(words.ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_plain_call():
    import random

    from tokenizers import Tokenizer

    plain, words = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path(), limit=50)
    rng = random.Random(2)
    signs = ["a", "Zw", "é", "ß", "Σ", "ſ", "日", "1", "'", "...", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " ", "\n", "\x1c", "x" * 90, "#", "_"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(600)]
    for start in range(0, 600, 30):
        found = words.ids_of(texts[start:start + 30])
        assert [np.frombuffer(f, "<u4").tolist() for f in found] == [plain.encode(t, add_special_tokens=False).ids for t in texts[start:start + 30]]


class Watched(packing.WordIds):
    """Counts the words looked up and keeps what the whole tokenizer is called with."""

    def __init__(self, path):
        super().__init__(path)
        self.looked_up, self.called, whole = 0, [], self.model

        class Whole:
            def encode_batch_fast(_, call, **options):  # noqa: N805
                self.called += call
                return whole.encode_batch_fast(call, **options)

        self.model = Whole()

    def __getitem__(self, word):
        self.looked_up += 1
        return super().__getitem__(word)


def test_words_are_looked_up_once_and_plain_ones_go_to_the_merges(tokenizer):
    words = Watched(packing.tokenizer_path())
    texts = ["Über den naïve tests, tests, " * 500, "", " ", "the 12 über, Σας"] * 3
    assert [np.frombuffer(f, "<u4").tolist() for f in words.ids_of(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert words.looked_up <= 10 and set(words.called) - {""} == {",", "12", "Σας"}
    assert words.ids_of([]) == [] and words.ids_of(["", " \n"]) == [b"", b""]


def test_plain_letters_are_those_of_the_tokenizer(tokenizer):
    words = packing.WordIds(packing.tokenizer_path())
    texts = [f"{a}{c}{b}" for c in map(chr, range(ord(packing.PLAIN))) for a, b in (("", ""), ("x", "yz"), (" ", "."), ("Ä", "É"))]
    assert [np.frombuffer(f, "<u4").tolist() for f in words.ids_of(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_digest_and_batches(spark, tokenizer):
    frame = spark.createDataFrame(DOCS[:5], "doc_id long, text string")
    rows = {(r.doc_id, r.start): r for r in packing.packed_digest(frame).collect()}
    ids = np.asarray(tokenizer.encode(DOCS[4][1], add_special_tokens=False).ids + [2], "<u4")
    assert rows[(5, 0)].ids_crc32 == zlib.crc32(ids[:4096].tobytes()) and rows[(5, 0)].doc_tokens == len(ids)
    batched = packing.batches(packing.sequences(packing.decompose(frame)), 8192).collect()
    tokens = defaultdict(list)
    for r in batched:
        tokens[r.batch_id].append(r.length)
    assert all(len(set(v)) == 1 and sum(v) <= max(8192, v[0]) for v in tokens.values())
    assert packing.piece_lengths(0, 8) == [] and packing.piece_lengths(21, 8) == [8, 8, 4, 1]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_lines int")
    assert packing.packed_digest(empty).count() == 0
    assert line_dedup.drop_shared_lines(empty).count() == 0


def _lines_directly(docs, least=5):
    key = lambda x: (lambda k: k.lower() if len(k.decode()) >= 40 else None)(x.strip(line_dedup.BLANKS))
    holders = defaultdict(set)
    low = -(1 << 63)
    for d, t in docs:
        for line in (t or "").encode().split(b"\n"):
            if key(line):
                holders[key(line)].add(low if d is None else d)
    shared = {k: max(v) for k, v in holders.items() if len(v) >= least}
    out = []
    for d, t in docs:
        lines = (t or "").encode().split(b"\n")
        kept = [x for x in lines if shared.get(key(x), low if d is None else d) == (low if d is None else d)]
        out.append((str(d), len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("bits", [1 << 16, 1 << 20])
def test_shared_lines(spark, bits):
    a, b, c = "A line that is quite long enough to count here", "ÄÖ" + "é" * 38, "Á short one of thirty-nine letters, alas"
    docs = [(i, f"own {i}\n{a}\n \t{a.upper()}\r\n{b if i % 2 else c}\nend") for i in range(12)]
    docs += [(3, f"{a}\nsame id, other text"), (None, a), (50, None), (51, ""), (52, "\n\n"), (53, a + "\n" + a)] + [(60 + i, c[:39]) for i in range(6)]
    docs += [(100 + i, f"unique text number {i} that is long enough to be a key") for i in range(300)]
    frame = spark.createDataFrame([(d, t, 7, "x") for d, t in docs], "doc_id long, text string, n_dropped int, keep string")
    kept = line_dedup.drop_shared_lines(frame, bits=bits)
    assert kept.columns == ["doc_id", "text", "keep", "n_lines", "n_dropped"]
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in kept.collect())
    assert got == _lines_directly(docs)
