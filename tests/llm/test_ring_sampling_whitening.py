"""Ring shards, resampling and whitening against direct computation, with nulls, repeats and odd columns."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from prefloom.llm import hash_ring, target_sampling, whitening

random.seed(5)


def _place(name):
    return int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)


def _rooms_kept(rows, shards, replicas, rooms):
    """Every row stands at the first shard clockwise from its cell that is not full."""
    nodes = sorted((_place(f"shard:{s}:{r}") >> 12, s, r) for s in range(shards) for r in range(replicas))
    cells = [c for c, _, _ in nodes]
    load = Counter(s for _, s in rows)
    assert all(load[s] <= rooms[s] for s in range(shards))
    for doc, shard in rows:
        at = bisect.bisect_left(cells, _place(str(-(1 << 63) if doc is None else doc)) >> 12) % len(nodes)
        while nodes[at][1] != shard:
            assert load[nodes[at][1]] == rooms[nodes[at][1]]
            at = (at + 1) % len(nodes)


@pytest.mark.parametrize("load,hot", [(None, 1 << 20), (1.25, 1 << 20), (1.0, 50), (None, 3)])
def test_ring(spark, load, hot):
    docs = [(i, f"text {i} é") for i in range(1500)] + [(7, "again")] * 700 + [(None, None), (None, "x"), (1 << 40, "")]
    frame = spark.createDataFrame([(d, t, "a", 1, 2) for d, t in docs], "doc_id long, text string, shard string, cell int, row int")
    rows = hash_ring.assign(frame, 12, load, 16, hot).collect()
    size = lambda t: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, *size(t)) for d, t in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    n = len(docs)
    rooms = [n // 12 + (s < n % 12) if load is None else math.ceil(load * n / 12) for s in range(12)]
    if load is None:
        assert [len(slots[s]) for s in range(12)] == rooms
    _rooms_kept([(r.doc_id, r.shard) for r in rows], 12, 16, rooms)


def test_ring_moves_little(spark):
    frame = spark.createDataFrame([(i, "") for i in range(4000)], "doc_id long, text string")
    before, after = ({r.doc_id: r.shard for r in hash_ring.assign(frame, m, 1.25).collect()} for m in (20, 21))
    moved = sum(before[d] != after[d] for d in before)
    assert moved < 4000 * 0.2  # a fresh modulo would move 95 in 100
    assert hash_ring.sharded(frame.where("doc_id < 0")).count() == 0
    few = hash_ring.sharded(frame.where("doc_id < 3")).collect()
    assert len({r.shard for r in few}) == 3 and {(r.law, r.slot, r.grown_shard) for r in few} == {("rows", 0, None)}


def _bucketed(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    runs = [" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return [zlib.crc32(r.encode()) % 10000 for r in runs], len(words)


def _resampled(docs, target, percent=5, least=20):
    counts = [Counter(b for _, t in rows for b in _bucketed(t)[0]) for rows in (docs, target)]
    S, T = (sum(c.values()) for c in counts)
    gain = lambda b: math.floor(1000 * math.log((counts[1][b] + 1.0) * (S + 10000.0) / ((counts[0][b] + 1.0) * (T + 10000.0))))
    out = []
    for d, t in docs:
        buckets, words = _bucketed(t)
        h = _place(f"42:{'' if d is None else d}")
        weight = sum(map(gain, buckets))
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(buckets), weight, score, None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -(1 << 63) if r[0] is None else r[0]))
    for i, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("percent,block", [(5, 4 << 20), (40, 64), (100, 1000)])
def test_resampling(spark, monkeypatch, percent, block):
    monkeypatch.setattr(target_sampling, "BLOCK", block)
    vocabulary = ["Alpha", "beta", "naïve", "x1", "ß", "日本語", "gamma-ray", "A" * 80, "q" * 64, "r" * 63, "s" * 300]
    docs = [(i, random.choice([" ", "\n", "--"]).join(random.choices(vocabulary, k=random.randrange(60)))) for i in range(300)]
    docs += [(None, None), (None, "one two"), (500, ""), (501, "... !"), (502, "beta " * 30), (502, "beta " * 30), (502, "beta " * 30)]
    target = [(1, "alpha beta x1 beta"), (2, None), (3, "ß gamma ray")]
    frame = spark.createDataFrame([(d, t, "a", 0) for d, t in docs], "doc_id long, text string, score string, row int")
    aim = spark.createDataFrame(target, "item_id long, text string")
    got = [tuple(r) for r in target_sampling.resample(frame, aim, percent).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(_resampled(docs, target, percent), key=key)
    for text in (t for _, t in docs if t):  # pieces of a long text give the features of the whole
        found = Counter()
        for data, begins, core, _ in target_sampling.blocks([text.encode()]):
            found.update(target_sampling.features(data, begins, core)[1].tolist())
        assert found == Counter(_bucketed(text)[0])


def test_resampling_of_ties(spark):
    docs = [(9, "word " * 25)] * 200 + [(8, "word " * 25)] * 3
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = target_sampling.resample(frame, frame, 50).collect()
    assert sorted(r.rank for r in rows if r.rank) == list(range(1, 102))
    none = frame.where("doc_id < 0")
    assert target_sampling.resample(none, frame).count() == 0
    assert all(r.rank is None for r in target_sampling.resample(frame.limit(3), none).collect())


def _whitened(vectors, components=32):
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    n = len(x)
    exact = [[int(v) for v in row] for row in x]
    sums = [sum(c) for c in zip(*exact)]
    apart = [[n * v - s for v, s in zip(row, sums)] for row in exact]
    centred = np.array(apart, float) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:components]
    white = centred @ directions[:, order] / np.sqrt(values[order])
    return white, values[order] / values.sum(), [sum(a * a for a in row) for row in apart]


@pytest.mark.parametrize("width,scale", [(5, 1.0), (40, 0.3), (3, 1e6)])
def test_whitening(spark, width, scale):
    rng = np.random.default_rng(3)
    data = (rng.normal(size=(300, width)) * (1 + np.arange(width)) * scale).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(data)]
    odd = [(900, None, 1), (901, [None] + [0.0] * (width - 1), 1), (902, [math.nan] * width, 1), (903, [math.inf] * width, 1), (904, [1.0], 1), (905, [], 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n int").repartition(5)
    got = whitening.whiten(frame).collect()
    white, explained, deviation = _whitened(data.tolist())
    k = min(32, width)
    assert len(got) == 300 * k and {r.n for r in got} == {300}
    mine = np.zeros((300, k))
    for r in got:
        mine[r.vec_id, r.component - 1] = r.whitened
        fits = deviation[r.vec_id] < 1 << 63
        assert r.deviation == (deviation[r.vec_id] if fits else None) and r.identity_error < 1e-9
        assert abs(r.explained - explained[r.component - 1]) < 1e-9
    signs = np.sign((mine * white).sum(axis=0))
    assert np.allclose(mine * signs, white, atol=1e-6)
    assert np.abs(mine.T @ mine / 300 - mine.mean(0)[:, None] * mine.mean(0) - np.eye(k)).max() < 1e-6


def test_scatter_is_exact(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 1 << 40, size=(200, 4))
    bits = np.array([40, 41, 40, 40])
    found = defaultdict(int)
    for (i, j, g), v in whitening.counted(y, bits).items():
        found[i, j] += v << (whitening.GROUP * g)
    assert found == {(i, j): sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for i in range(4) for j in range(i, 4)}


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert {(r.whitened, r.explained, r.deviation, r.vec_id) for r in whitening.whiten(one).collect()} == {(0.0, 0.0, 0, None)}
    assert whitening.whiten(one.where("false")).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<float>")
    rows = whitening.whiten(flat).collect()
    assert len(rows) == 27 and {r.whitened for r in rows if r.component > 1} == {0.0}
    assert max(r.identity_error for r in rows) < 1e-9
