"""The five stages against direct computation on a small folder, and the entry point's guard."""

import random
import subprocess
import sys
import tempfile
from collections import defaultdict
from pathlib import Path

import numpy as np

import __spark_entry__ as contract
import corpus_pipeline
from prefloom.llm import decontamination, line_dedup, packing, toxicity

ITEM = "the red fox and the blue bird went over nine green hills to find seven old stones under a tree"


def folder(spark):
    random.seed(4)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ten", "ru", "sha") for b in ("vor", "pel", "dun", "ix", "om", "ei")]
    line = "this line of text is found in very many documents of the table"
    docs, labels = [], []
    for i in range(160):
        text = " ".join(random.choice(words) for _ in range(random.randrange(8, 90)))
        if i % 8 == 0:
            text = " ".join(f"{w} scum" if k % 4 == 0 else w for k, w in enumerate(text.split()))
        if i % 5 == 1:
            text += "\n" + line
        if i % 16 == 3:
            text = f"{text} {ITEM} {text}"
        docs.append((i, text, "en", "s", len(text), "x"))
        labels.append((i, int(i % 8 == 0)))
    docs += [(500 + i, docs[10 * i + 2][1] + (" extra" if i % 2 else ""), "en", "s", 1, "x") for i in range(8)]
    docs += [(600, None, None, None, None, "x"), (601, "", "en", "s", 0, "x"), (602, line, "en", "s", 1, "x"), (603, "", "en", "s", 0, "x")]
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, pieces string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {d[0]: d[1] or "" for d in docs}


def without_shared_lines(docs):
    holders = defaultdict(set)
    for d, t in docs.items():
        for x in t.split("\n"):
            if len(x.strip()) >= 40:
                holders[x.strip().lower()].add(d)
    keep = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    return {d: "\n".join(x for x in t.split("\n") if keep.get(x.strip().lower(), d) == d) for d, t in docs.items()}


def one_of_each(docs):
    sets = {}
    for d, t in docs.items():
        w = t.lower().split()
        sets[d] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {d: d for d in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in docs:
        for b in docs:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: t for d, t in docs.items() if root(d) == d}


def test_stages(spark):
    path, docs = folder(spark)
    table = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, path).columns == table.columns, name
    scored = toxicity.score(table, spark.read.parquet(f"{path}/labels.parquet")).collect()
    toxic = {r.doc_id for r in scored if r.predicted}
    assert len(toxic & set(range(0, 160, 8))) >= 15 and len(toxic - set(range(0, 160, 8))) <= 2
    left = one_of_each(without_shared_lines({d: t for d, t in docs.items() if d not in toxic}))
    left = {d: t for d, t in left.items() if ITEM not in t}
    words = packing.word_ids(packing.tokenizer_path())
    want = {d: words.ids(t) + np.asarray([2], "<u4").tobytes() for d, t in left.items()}
    got = defaultdict(dict)
    for r in corpus_pipeline.run(spark, path).collect():
        got[r.doc_id][r.start] = bytes(r.ids)
    assert {d: b"".join(v for _, v in sorted(p.items())) for d, p in got.items()} == want
    assert {600, 601, 603} <= set(want) and line_dedup.BLANKS


def test_entry_without_the_package():
    names = contract.queries()
    assert {"pipeline", *(n for n in names if n.startswith("op"))} <= set(names) and len([n for n in names if n[:2] == "op"]) == 13
    script = (
        "import sys; sys.modules['prefloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; "
        "assert len(e.queries()) > 100 and not [n for n in e.queries() if n[:2] == 'op' or n == 'pipeline'] and e.oracle_sql()"
    )
    subprocess.run([sys.executable, "-c", script], check=True, cwd=Path(__file__).resolve().parents[2])


def test_columns_of_any_name_come_through(spark):
    line = "this line is long enough to be shared by all of the documents"
    texts = [f"{line}\nown words of number {i} " + " ".join(f"w{i}x{k}" for k in range(30)) for i in range(8)] + [None]
    rows = [(i, t, 70 + i, f"d{i}", [i], i, "s") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __id int, __Digest string, __lost array<int>, row int, spans string")
    labels = spark.createDataFrame([(i, 0) for i in range(8)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "an item that no document has in any form at all here")], "item_id long, text string")
    from corpus_pipeline import _without

    kept = [
        line_dedup.drop_shared_lines(frame), decontamination.clean(frame, bench), toxicity.clean(frame, labels),
        _without(frame, frame.where("doc_id = 3").select("doc_id")),
    ]
    for out in kept:
        got = out.collect()
        assert all((r["__id"], r["__Digest"], r["__lost"], r["row"], r["spans"]) == rows[r["doc_id"]][2:] for r in got)
    assert [len(out.collect()) for out in kept[:2]] == [9, 9] and kept[3].count() == 8
