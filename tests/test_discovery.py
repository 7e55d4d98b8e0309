import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prefloom.functions import rights, text, urls
from prefloom.functions.vectors import as_double, unit
from prefloom.operators import blur, candidates as cand, neardup
from prefloom.operators.components import connected

GOOD = {
    "width": "3000", "height": "2000", "mime": "image/jpeg", "source_url": "https://upload.wikimedia.org/a.jpg",
    "page_url": "https://commons.wikimedia.org/wiki/File:a", "provider_page_id": 5, "provider_sha1": "s", "title": "t", "creator": "c",
    "non_free": "", "license": "CC BY 4.0", "license_url": "https://creativecommons.org/licenses/by/4.0/", "license_identifier": "", "copyrighted": "", "usage_terms": "",
}
SCHEMA = ", ".join(f"{k} {'bigint' if k == 'provider_page_id' else 'string'}" for k in GOOD)


def test_rejection_reasons(spark):
    cases = [
        ({}, None),
        ({"width": "abc"}, "invalid dimensions"),
        ({"width": "1100"}, "insufficient resolution"),
        ({"mime": "image/tiff"}, "unsupported media type"),
        ({"source_url": "http://upload.wikimedia.org/a.jpg"}, "invalid original-file provenance"),
        ({"page_url": ""}, "missing Commons description page"),
        ({"provider_sha1": ""}, "missing Commons identifiers"),
        ({"creator": ""}, "missing title or creator attribution"),
        ({"non_free": " TRUE "}, "non-free work"),
        ({"license": "CC BY-NC 4.0"}, "license is not allowlisted"),
        ({"license_url": "https://example.com/licenses/by/"}, "license URL does not match license"),
        ({"license": "Public domain", "license_url": "", "license_identifier": "pd", "copyrighted": "False", "usage_terms": "Public domain"}, None),
        ({"license": "Public domain", "license_url": ""}, "license URL does not match license"),
        ({"width": None, "mime": "x"}, "insufficient resolution"),
    ]
    df = spark.createDataFrame([tuple({**GOOD, **change}.values()) for change, _ in cases], SCHEMA)
    assert [r[0] for r in df.select(rights.rejection_reason()).collect()] == [want for _, want in cases]


def test_urls(spark):
    cases = [("//a.b/c", "https://a.b/c"), (" http://www.gnu.org/x ", "https://www.gnu.org/x"), ("http://a.b/c", "http://a.b/c"), (None, ""), ("HTTP://CreativeCommons.org/x", "https://CreativeCommons.org/x")]
    df = spark.createDataFrame(cases, "u string, want string")
    assert all(a == b for a, b in df.select(urls.normalized_url(F.col("u")), "want").collect())


def test_redaction_removes_every_secret(spark):
    raw = (
        "postgresql://u:p@h/db vercel_blob_rw_abc GOCSPX-zzz Authorization: Bearer abc.def "
        "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK https://x/?token=t0ken&x=1 {\"password\": \"pw pw\"} api_key='k k' hunter2"
    )
    out = spark.createDataFrame([(raw,)], "t string").select(text.redact(F.col("t"), ["hunter2"])).first()[0]
    for secret in ("u:p@", "rw_abc", "GOCSPX", "abc.def", "eyJ", "t0ken", "pw pw", "k k", "hunter2"):
        assert secret not in out
    blank = spark.createDataFrame([("  \n ",), ("plain   text",)], "t string").select(text.safe_error_message(F.col("t"))).collect()
    assert [r[0] for r in blank] == ["Unknown error", "plain text"]


def test_text_after_an_old_name_is_kept_whole(spark):
    out = spark.createDataFrame([("&amp" + "a1" * 100,), ("&lt" + "b" * 62 + " c",)], "h string").select(text.html_to_text("h")).collect()
    assert [r[0] for r in out] == ["&" + "a1" * 100, "<" + "b" * 62 + " c"]


def test_html_keeps_script_text_and_decodes_entities(spark):
    html = "<p>A &amp; B</p><div>C<br>D</div><script>var t='<p>';</script>&#233;<b>x</b>y"
    out = spark.createDataFrame([(html,), (None,)], "h string").select(text.html_to_text("h")).collect()
    assert [r[0] for r in out] == ["A & B C D var t='<p>';éxy", ""]


def test_numeric_references(spark):
    import html

    codes = [0, 1, 8, 9, 10, 11, 13, 14, 31, 65, 127, *range(128, 161), 233, 0x3B1, 0xD800, 0xFDD0, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000, 10**9, 10**30]
    refs = [f"&#{c};" for c in codes] + [f"&#x{c:x};" for c in codes] + ["&#0000000000065;", "&#x00000000000000e9;", "&#65", "&#x41 ", "&#150;&#x80;"]
    rows = spark.createDataFrame([(i, f"a{r}b") for i, r in enumerate(refs)], "i int, h string")
    got = {r["i"]: r["t"] for r in rows.select("i", text._decoded(F.col("h")).alias("t")).collect()}
    assert got == {i: html.unescape(f"a{r}b") for i, r in enumerate(refs)}


def test_first_seen_equals_sequential_scan(spark):
    rng = random.Random(7)
    rows = [(r, i, rng.choice(["", *map(str, range(25))]), rng.choice(["", *map(str, range(30))]), rng.choice(["", *map(str, range(35))])) for r in (1, 2) for i in range(60)]
    want = set()
    for run in (1, 2):
        seen = [set(), set(), set()]
        for r, i, *keys in rows:
            if r != run or any(k and k in s for k, s in zip(keys, seen)):
                continue
            for k, s in zip(keys, seen):
                s.add(k)
            want.add((r, i))
    df = spark.createDataFrame(rows, "run_id bigint, i bigint, a string, b string, c string")
    got = {(x["run_id"], x["i"]) for x in cand.first_seen(df, ["run_id"], "i", ["a", "b", "c"]).collect()}
    assert got == want


def brute_greedy(vectors, threshold):
    kept = []
    for rank, v in vectors:
        if all(float(np.dot(v, w)) < threshold for _, w in kept):
            kept.append((rank, v))
    return {rank for rank, _ in kept}


def test_greedy_distinct_with_chains_and_a_copy_cluster(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    base /= np.linalg.norm(base)
    other = rng.normal(size=16)
    other -= other @ base * base
    other /= np.linalg.norm(other)
    rows = [math.cos(t) * base + math.sin(t) * other for t in np.arange(0, 2.0, 0.03)]  # a chain of neighbours
    rows += [base + 1e-3 * rng.normal(size=16) for _ in range(60)] + [base] * 30  # a third are copies
    rows += list(rng.normal(size=(40, 16)))
    rows = [r / np.linalg.norm(r) for r in rows]
    order = rng.permutation(len(rows))
    data = [(1, int(k), [float(x) for x in rows[j]]) for k, j in enumerate(order)]
    df = spark.createDataFrame(data, "g bigint, rank bigint, vector array<double>")
    grid = neardup.Grid(16)
    got = {r["rank"] for r in neardup.greedy_distinct(df, ["g"], grid).collect()}
    assert got == brute_greedy([(r, np.array(v)) for _, r, v in data], grid.threshold)
    library = df.filter("rank < 60").select("g", "vector")
    probes = df.filter("rank >= 60").select("g", F.col("rank").alias("id"), "vector")
    hit = {r["id"] for r in neardup.near_library(probes, library, ["g"], grid).collect()}
    want = {r for _, r, v in data if r >= 60 and any(np.dot(v, w) >= grid.threshold for _, k, w in data if k < 60)}
    assert hit == want


def unit_rows(rng, n, width):
    rows = rng.normal(size=(n, width))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@pytest.mark.parametrize("limit,settled", [(16, 8), (64, 32)])
def test_near_duplicates_through_cells(spark, limit, settled):
    rng = np.random.default_rng(limit)
    base = unit_rows(rng, 260, 24)
    near = base[:120] + rng.normal(size=(120, 24)) * 0.012
    crowd = base[0] + rng.normal(size=(90, 24)) * 0.006
    rows = np.concatenate([base, near, crowd])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    order = rng.permutation(len(rows))
    data = [(k % 2 if k < 300 else 0, int(k), rows[j].tolist()) for k, j in enumerate(order)]
    df = spark.createDataFrame(data, "g bigint, rank bigint, vector array<double>")
    grid = neardup.Grid(24, limit=limit, settled=settled)
    got = {(r["g"], r["rank"]) for r in neardup.greedy_distinct(df, ["g"], grid).collect()}
    want = {(g, r) for g in (0, 1) for r in brute_greedy([(r, np.array(v)) for h, r, v in data if h == g], grid.threshold)}
    assert got == want
    library, probes = df.filter("rank < 350"), df.filter("rank >= 300").withColumnRenamed("rank", "id")
    hit = {(r["g"], r["id"]) for r in neardup.near_library(probes, library, ["g"], grid).collect()}
    assert hit == {(g, r) for g, r, v in data if r >= 300 and any(np.dot(v, w) >= grid.threshold for h, k, w in data if k < 350 and h == g)}


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_rows_of_a_cell_stay_bounded(spark, scale):
    images = spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet").dropna()
    rows = images.select(F.lit(1).alias("g"), F.col("vec_id").alias("id"), unit(as_double(F.col("embedding"))).alias("vector"))
    grid = neardup.Grid(64, limit=100)
    cells = neardup.filed(rows, rows, ["g"], grid).groupBy("part", "path").agg(F.count_if(~F.col("probe")).alias("n")).filter("n > 0").collect()
    assert max(r["n"] for r in cells) <= 100 and sum(r["n"] for r in cells) == 8 * rows.count()


def test_cells_hold_parts_and_few_rows_meet(spark):
    rng = np.random.default_rng(8)
    rows = unit_rows(rng, 900, 10)  # the last of five parts is as wide as the others
    rows[800:] = rows[:100] + rng.normal(size=(100, 10)) * 1e-3
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    df = spark.createDataFrame([(1, k, v.tolist()) for k, v in enumerate(rows)], "g bigint, id bigint, vector array<double>")
    grid = neardup.Grid(9, limit=200)
    assert (grid.parts, grid.width, grid.padding) == (5, 2, 1)
    grid = neardup.Grid(10, parts=2, limit=200)
    cells = neardup.filed(df, df, ["g"], grid)
    assert "vector" not in cells.columns and {len(r["piece"]) for r in cells.collect()} == {5}
    met, probes = neardup._met(df, df, ["g"], grid, same=True)
    ids = {r["id"] for r in met.collect()}
    assert ids >= {*range(100), *range(800, 900)} and len(ids) < 400
    assert {r["id"] for r in probes.collect()} == ids
    for size in (9, 10):
        ranked = df.select("g", F.col("id").alias("rank"), F.slice("vector", 1, size).alias("vector"))
        got = {r["rank"] for r in neardup.greedy_distinct(ranked, ["g"], neardup.Grid(size, limit=64, settled=32, threshold=0.999)).collect()}
        assert got == brute_greedy([(k, v[:size]) for k, v in enumerate(rows)], 0.999) if size == 10 else got


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    settle = neardup._settle
    monkeypatch.setattr(neardup, "_settle", lambda *a: rounds.append(1) or settle(*a))
    turn = 0.06
    rows = [(1, i, [float(x) for k in range(1, 3) for x in (math.cos(turn * i * k / 40), math.sin(turn * i * k / 40))] + [3 * math.cos(turn * i), 3 * math.sin(turn * i)]) for i in range(5000)]
    rows = [(g, i, (np.array(v) / np.linalg.norm(v)).tolist()) for g, i, v in rows]
    df = spark.createDataFrame(rows, "g bigint, rank bigint, vector array<double>")
    grid = neardup.Grid(6)
    got = {r["rank"] for r in neardup.greedy_distinct(df, ["g"], grid).collect()}
    assert got == brute_greedy([(r, np.array(v)) for _, r, v in rows], grid.threshold) and len(rounds) < 20
    pairs = spark.range(5000).selectExpr("1L AS g", "id AS i", "CONCAT('k', id) AS a", "CONCAT('k', id + 1) AS b")
    both = pairs.selectExpr("g", "i", "a", "b", "'' AS c").unionByName(pairs.selectExpr("2L AS g", "i", "a", "CONCAT('m', i) AS b", "'same' AS c"))
    linked = both.selectExpr("g", "i", "CONCAT('p', i DIV 2) AS a", "CONCAT('q', (i + 1) DIV 2) AS b", "c")
    kept = {(r["g"], r["i"]) for r in cand.first_seen(linked, ["g"], "i", ["a", "b", "c"], settled=2000).collect()}
    assert kept == {(1, i) for i in range(0, 5000, 2)} | {(2, 0)}


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_components(spark, few):
    rng = random.Random(3)
    n = 400 if few else 20
    links = [(i, i + 1) for i in range(n)] + [(2000, 2001 + i) for i in range(n)] + [(rng.randrange(5000, 5000 + n), rng.randrange(5000, 5000 + n)) for _ in range(n)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    loops = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(links, "a bigint, b bigint"), few=few).collect()}
    assert got == {x: find(x) for x in parent if x not in loops}
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_components_of_links_that_differ_between_runs(spark, few):
    def turned(batches):  # a link's direction is drawn anew each time it is computed
        rng = np.random.default_rng()
        for batch in batches:
            x = batch["id"].to_numpy()
            turn = rng.random(len(x)) < 0.5
            yield pa.RecordBatch.from_arrays([pa.array(np.where(turn, x, x + 1000)), pa.array(np.where(turn, x + 1000, x))], ["a", "b"])

    links = spark.range(100).mapInArrow(turned, "a bigint, b bigint")
    got = sorted(tuple(r) for r in connected(links, few=few).collect())
    assert got == sorted((x + y, x) for x in range(100) for y in (0, 1000))


def test_greedy_distinct_in_any_order_of_arrival(spark, monkeypatch):
    rng = np.random.default_rng(21)
    base = unit_rows(rng, 40, 16)
    rows = np.repeat(base, 6, axis=0) + rng.normal(size=(240, 16)) * 0.015
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    grid, rows = neardup.Grid(16, settled=8), rows[rng.permutation(240)]
    block = pa.table({"g": [1] * 240, "id": list(range(240)), "vector": rows.tolist()})
    links = lambda left, right: {(r["a"], r["b"]) for r in neardup._forest(grid, ["g"])(left, right).to_pylist()}
    for _ in range(3):
        assert links(block.take(rng.permutation(240)), block.take(rng.permutation(240))) == links(block, block)
    compared = neardup._compared

    def mixed(home, probes, by, limit, work, schema):
        def any_order(left, right):
            draw = np.random.default_rng()
            return work(*(t.take(pa.array(draw.permutation(t.num_rows))) for t in (left, right)))

        return compared(home, probes, by, limit, any_order, schema)

    monkeypatch.setattr(neardup, "_compared", mixed)
    df = spark.createDataFrame([(1, k, v.tolist()) for k, v in enumerate(rows)], "g bigint, rank bigint, vector array<double>")
    got = [r["rank"] for r in neardup.greedy_distinct(df, ["g"], grid).collect()]
    assert sorted(got) == sorted(brute_greedy(list(enumerate(rows)), grid.threshold))


def finalists(spark, rows):
    return spark.createDataFrame(rows, "run_id bigint, user_id string, action_id bigint, discovery_index bigint, score double, provider_sha1 string, source_url string, ok boolean")


def test_selection_quota(spark):
    rows = [(1, "u", i, i, float(20 - i), f"s{i}", "", True) for i in range(15)]
    modes = [r["mode"] for r in cand.select_candidates(finalists(spark, rows), 10, "2024-01-01").collect()]
    assert modes.count("taste") == 8 and modes.count("exploration") == 2


def test_one_per_action(spark):
    rows = [(1, "u", a, i, 0.0, f"s{i}", "", True) for i, a in enumerate((1, 1, 2, 3))]
    got = sorted(r["discovery_index"] for r in cand.one_per_action(finalists(spark, rows), cand.rank_order()).collect())
    assert got == [0, 2, 3]


def loop_admission(rows, allowance, day):
    import hashlib

    ranked = sorted(rows, key=lambda r: (-r[4], r[3]))
    desired = min(allowance, len({r[2] for r in rows}))
    explore = min(desired, max(1, math.ceil(allowance * 0.2)))
    admitted, used, tried = [], set(), set()

    def attempt(r):
        if r[2] in used or r[3] in tried:
            return False
        tried.add(r[3])
        if not r[7]:
            return False
        used.add(r[2])
        admitted.append(r[3])
        return True

    taste = 0
    for r in ranked:
        if taste >= desired - explore:
            break
        taste += attempt(r)
    drawn = 0
    for r in sorted(ranked, key=lambda r: hashlib.sha256(f"{r[1]}:{day}:{r[5] or r[6] or r[3]}".encode()).hexdigest()):
        if drawn >= explore:
            break
        drawn += attempt(r)
    return set(admitted)


def test_admission_equals_the_loop(spark):
    rng = random.Random(11)
    for _ in range(4):
        rows = [(1, "u", rng.randint(1, 9), i, rng.random(), f"s{i}", "", rng.random() < 0.6) for i in range(40)]
        got = {r["discovery_index"] for r in cand.admit(finalists(spark, rows), 7, "2024-01-01").collect()}
        assert got == loop_admission(rows, 7, "2024-01-01")


def test_round_robin(spark):
    rows = [("A", 0, "1"), ("A", 1, "2"), ("B", 2, "3"), ("B", 3, "1")]
    df = spark.createDataFrame(rows, "source_category string, discovery_index bigint, provider_sha1 string").withColumn("source_url", F.lit(""))
    got = [r["discovery_index"] for r in cand.round_robin(df, 3).collect()]
    assert got == [0, 2, 1]
    listed = [r["discovery_index"] for r in cand.round_robin(df, 2, ["B", "A"]).collect()]
    assert listed == [2, 0]


def test_byte_budget_of_a_long_run(spark):
    rng = random.Random(9)
    rows = [(run, i, rng.randint(1, 900)) for run in (1, 2) for i in range(5200)]
    want, used = set(), {1: 0, 2: 0}
    for run, i, size in rows:
        if used[run] + size <= 1_500_000:
            used[run] += size
            want.add((run, i))
    df = spark.createDataFrame(rows, "run_id bigint, discovery_index bigint, size bigint")
    assert {tuple(r) for r in cand.byte_budget_skipping(df, 1_500_000).collect()} == want


def test_blur(spark):
    flat, ramp = [100] * 64, [(x * x) % 251 for x in range(64)]
    df = spark.createDataFrame([(1, flat), (2, ramp)], "id int, p array<int>")
    energy = blur.edge_energy(F.col("p"), F.lit(8), F.lit(8))
    got = [(r[0], r[1]) for r in df.select(blur.blur_reason(energy), energy).collect()]
    image = np.array(ramp).reshape(8, 8).astype(float)
    lap = 4 * image[1:-1, 1:-1] - image[:-2, 1:-1] - image[2:, 1:-1] - image[1:-1, :-2] - image[1:-1, 2:]
    assert got[0][0] == "severely blurry or blank" and got[1][0] is None and abs(got[1][1] - np.sqrt((lap**2).mean())) < 1e-9
    assert spark.range(1).select(blur.edge_energy(F.array(F.lit(1), F.lit(9)), F.lit(2), F.lit(1))).first()[0] == 0.0
