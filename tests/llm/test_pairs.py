"""Near-duplicate join, repeated substrings, components and Hamming search against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from prefloom.llm import hamming_search, jaccard, suffix_dedup
from prefloom.llm.common import components

FRAME = "doc_id long, text string, n long, key string"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 1, "k") for d, t in docs], FRAME)


def root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def family_documents():
    random.seed(5)
    words = [f"w{i}" for i in range(2000)]
    texts = []
    for size in (6, 12, 40, 150, 400):
        base = [random.choice(words) for _ in range(size)]
        for _ in range(25):
            copy = list(base)
            for _ in range(random.randrange(0, max(2, size // 18))):
                copy[random.randrange(size)] = random.choice(words)
            texts.append(" ".join(copy))
    passage = [random.choice(words) for _ in range(60)]
    for _ in range(40):
        texts.append(" ".join([random.choice(words) for _ in range(20)] + passage + [random.choice(words) for _ in range(20)]))
    return texts + ["", " \t", "one two", "ONE\x0btwo", "one two", None, "Ünï cödé wörds here now", "ünï cödé wörds here now"]


@pytest.mark.parametrize("block, first", [(4096, 8), (5, 2), (3, 0)])
def test_near_duplicates(spark, monkeypatch, block, first):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "FIRST_KEYS", first + 1)
    texts = family_documents()
    random.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, enumerate(texts))).collect()}
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = root(parent, i), root(parent, j)
                parent[max(x, y)] = min(x, y)
    assert got == {i: (len(s), root(parent, i)) for i, s in enumerate(sets)}


def test_near_duplicates_odd_rows(spark):
    docs = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "something else in this row"), (None, "a b c d e f"), (9, None), (None, None)]
    rows = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, docs)).collect())
    assert rows == {(5, 2, None): 2, (5, 1, 5): 1, (None, 2, None): 1, (9, 0, 9): 1, (None, 0, None): 1}
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0


def test_sketch_bounds():
    random.seed(1)
    for _ in range(200):
        a = {random.getrandbits(60) for _ in range(random.randrange(1, 400))}
        b = set(random.sample(sorted(a), random.randrange(len(a) + 1))) | {random.getrandbits(60) for _ in range(random.randrange(200))}
        x, y = (np.asarray(sorted(s), np.uint64) for s in (a, b or {1}))
        assert jaccard.distance(jaccard.parity(x), jaccard.parity(y)) <= len(a ^ (b or {1}))
        if b and 100 * len(a & b) >= 75 * len(a | b):
            assert set(jaccard.join_keys(x).tolist()) & set(jaccard.join_keys(y).tolist())


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(200, 200), (301, 300), (302, 301)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {300: 300, 301: 300, 302: 300}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def removal(docs):
    seen, out = {}, []
    for d, t in sorted(docs):
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if seen.setdefault(b[i:i + 100], (d, i)) != (d, i):
                gone[i:i + 100] = b"\1" * 100
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2000, 3])
def test_repeated_substrings(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    random.seed(7)
    text = lambda n: "".join(random.choice("abcdefghij é") for _ in range(n))
    passage, line = text(260), text(99)
    docs = [(i, text(50) + passage[random.randrange(80):180 + random.randrange(80)] + text(60) + line + text(30)) for i in range(30)]
    docs += [(40, "ab" * 300), (41, "x" * 500), (42, ""), (43, text(99)), (44, docs[3][1]), (45, passage), (46, passage + passage), (47, "ß" * 150)]
    rows = suffix_dedup.digest(frame(spark, docs + [(48, None)])).collect()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)
    assert got == removal(docs + [(48, "")])


def test_repeated_rows_stay(spark):
    random.seed(8)
    t = "".join(random.choice("abcdef") for _ in range(300))
    rows = suffix_dedup.digest(frame(spark, [(1, t), (1, t), (2, t), (None, t[:150])])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in rows) == [("1", 150), ("1", 150), ("2", 300), ("None", 0)]
    assert suffix_dedup.digest(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [64, 1 << 16])
def test_hamming_search(spark, block):
    random.seed(3)
    vectors = [(i, [random.gauss(0, 1) for _ in range(20)]) for i in range(300)]
    vectors += [(400 + i, vectors[0][1]) for i in range(20)] + [(500, None), (None, vectors[1][1]), (501, [float("nan")] + [1.0] * 19), (502, [1.0] * 7)]
    table = hamming_search.sign_codes(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    settings = hamming_search.Settings(k=5, segment=8, block=block, chunk=16)
    rows = hamming_search.search(table, table.where("id % 50 = 0"), settings).collect()
    code = {i: [x > 0 for x in v] + [False] * (20 - len(v)) for i, v in vectors if i is not None and v is not None}
    want = set()
    for q in (i for i in code if i % 50 == 0):
        near = sorted((sum(a != b for a, b in zip(code[q], c)), i) for i, c in code.items())[:5]
        want |= {(q, n + 1, i, d) for n, (d, i) in enumerate(near)}
    assert {(r.query_id, r.rank, r.id, r.distance) for r in rows} == want
    none = table.where("id < 0")
    assert hamming_search.search(none, table, settings).count() == 0 and hamming_search.search(table, none, settings).count() == 0
