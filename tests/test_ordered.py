"""Chunked order operators against plain single-key computations, with one key owning most rows."""

import random

import pandas as pd
from pyspark.sql import functions as F

from prefloom.operators.ordered import first_per_key, grid_chunk, id_chunk, last_per_key, previous, ranked, running, top_per_key


def hot_rows(n=3000, seed=1):
    rng = random.Random(seed)
    ids = rng.sample(range(n * 3), n)
    return [(1 if rng.random() < 0.6 else rng.randint(2, 40), i, rng.randint(0, 9)) for i in ids]


def test_running_sums_equal_plain_windows(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k bigint, id bigint, v bigint")
    got = running(df, ["k"], ["id"], id_chunk("id", 6), {"s": F.col("v")}).toPandas().sort_values(["k", "id"])
    want = pd.DataFrame(rows, columns=["k", "id", "v"]).sort_values(["k", "id"])
    want["s"] = want.groupby("k")["v"].cumsum()
    assert got["s"].tolist() == want["s"].tolist()
    before = running(df, ["k"], ["id"], id_chunk("id", 6), {"s": F.col("v")}, inclusive=False).toPandas().sort_values(["k", "id"])
    assert before["s"].tolist() == (want["s"] - want["v"]).tolist()


def test_positions_on_a_numeric_grid(spark):
    rng = random.Random(2)
    rows = [(1, i, rng.uniform(1200, 1800)) for i in range(2000)]
    got = ranked(spark.createDataFrame(rows, "k bigint, id bigint, e double"), ["k"], ["e", "id"], grid_chunk("e", 10)).toPandas()
    want = sorted(rows, key=lambda r: (r[2], r[1]))
    assert got.sort_values("position")["id"].tolist() == [r[1] for r in want]


def test_previous_value_crosses_chunks(spark):
    rows = hot_rows(seed=3)
    df = spark.createDataFrame(rows, "k bigint, id bigint, v bigint")
    got = previous(df, ["k"], "id", "v", "p", bits=5).toPandas().sort_values(["k", "id"])
    want = pd.DataFrame(rows, columns=["k", "id", "v"]).sort_values(["k", "id"])
    want["p"] = want.groupby("k")["v"].shift()
    assert got["p"].fillna(-1).tolist() == want["p"].fillna(-1).tolist()


def test_top_per_key_beyond_the_native_limit(spark):
    rows = hot_rows(6000, 4)
    df = spark.createDataFrame(rows, "k bigint, id bigint, v bigint")
    got = top_per_key(df, ["k"], [F.col("id").desc()], 1500, spread="id", slices=8).toPandas()
    want = pd.DataFrame(rows, columns=["k", "id", "v"]).sort_values("id", ascending=False).groupby("k").head(1500)
    assert set(got["id"]) == set(want["id"])
    hot = got[got["k"] == 1].sort_values("position")
    assert hot["position"].tolist() == list(range(1, len(hot) + 1)) and hot["id"].is_monotonic_decreasing


def test_group_limit_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame(hot_rows(), "k bigint, id bigint, v bigint").repartition(4)
    plan = top_per_key(df, ["k"], [F.col("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_first_and_last_rows(spark):
    df = spark.createDataFrame(hot_rows(seed=5), "k bigint, id bigint, v bigint")
    want = df.toPandas().sort_values("id")
    first = first_per_key(df, ["k"], ["id"]).toPandas().set_index("k")["id"].to_dict()
    last = last_per_key(df, ["k"], ["id"]).toPandas().set_index("k")["id"].to_dict()
    assert first == want.groupby("k")["id"].min().to_dict() and last == want.groupby("k")["id"].max().to_dict()


def test_places_of_any_order(spark):
    from prefloom.operators.ordered import placed

    rng = random.Random(8)
    rows = [(1 if rng.random() < 0.6 else rng.randint(2, 9), f"{rng.random():.3f}", k) for k in range(2000)]
    got = placed(spark.createDataFrame(rows, "k bigint, s string, id bigint").repartition(7), ["k"], ["s", "id"]).collect()
    want = {}
    for k in range(1, 10):
        want.update({r[2]: n for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1:]), 1)})
    assert {r["id"]: r["position"] for r in got} == want


def test_kendall_equals_pairs(spark):
    from prefloom.operators import metrics

    rng = random.Random(9)
    rows = [(1, rng.randint(0, 40), rng.randint(0, 60)) for _ in range(600)] + [(2, k % 5, k % 5) for k in range(30)]
    rows += [(3, 1, k) for k in range(5)] + [(4, k, -k) for k in range(20)] + [(5, 1, 1), (6, 1, None), (6, 2, 4), (6, 3, 3)]
    cells = metrics.contingency(spark.createDataFrame(rows, "k bigint, a bigint, b bigint"), ["k"], "a", "b")
    got = {r["k"]: r["kendall"] for r in metrics.kendall(cells, ["k"], "a", "b").collect()}
    sign = lambda v: (v > 0) - (v < 0)
    for key in range(1, 7):
        own = [(a, b) for k, a, b in rows if k == key and b is not None]
        both = [(sign(p[0] - q[0]), sign(p[1] - q[1])) for p in own for q in own]
        over, sx, sy = sum(a * b for a, b in both), sum(a * a for a, _ in both), sum(b * b for _, b in both)
        if sx * sy == 0:
            assert got[key] is None
        else:
            assert abs(got[key] - over / (sx * sy) ** 0.5) < 1e-12


def test_budget_rounds_equal_the_loop(spark):
    from prefloom.operators import candidates as cand

    rng = random.Random(10)
    rows = [(1, k, rng.randint(0, 3000)) for k in range(100_000)]
    rows += [(2, k, 2 ** rng.randint(0, 19)) for k in range(3000)] + [(3, k, rng.choice((0, 1, 499_999, 500_000))) for k in range(3000)]
    rows += [(4, k, 1 if k % 2 else 500_000 - k) for k in range(3000)] + [(5, k, 600_000) for k in range(2000)] + [(6, k, 100_000) for k in range(30)]
    rows += [(7, k, -5 if k % 3 else 400_000) for k in range(2000)] + [(8, k, None) for k in range(2000)]
    frame = spark.createDataFrame(rows, "run_id bigint, discovery_index bigint, size bigint").repartition(6)
    for budget in (500_000, 0):
        want, used = set(), {}
        for run, at, size in rows:
            if used.get(run, 0) + (size or 0) <= budget:
                used[run] = used.get(run, 0) + (size or 0)
                want.add((run, at))
        got = [tuple(r) for r in cand.byte_budget_skipping(frame, budget, fold_rows=1000).collect()]
        assert len(got) == len(want) and set(got) == want
