import gzip
import hashlib
import struct

import numpy as np
from pyspark.sql import functions as F

from prefloom.operators import quality
from prefloom.sources import digests, provider, sinks


def test_provider_dump(spark, tmp_path):
    page = '{"category":"birds  ","query":{"pages":[{"pageid":7,"title":"File:A.jpg","imageinfo":[{"url":"//up/a.jpg","width":9,"mime":"IMAGE/JPEG","extmetadata":{"Artist":{"value":""},"Attribution":{"value":"<p>Me</p>"},"LicenseUrl":{"value":"http://artlibre.org/x"}}}]},{"pageid":8,"title":"B"}]}}'
    (tmp_path / "dump.json").write_text(page + "\n")
    rows = provider.candidate_rows(provider.read_provider_dump(spark, str(tmp_path / "dump.json"))).orderBy("provider_page_id").collect()
    a, b = rows
    assert (a["title"], a["source_url"], a["creator"], a["mime"], a["source_category"], a["license_url"]) == (
        "A.jpg", "https://up/a.jpg", "Me", "image/jpeg", "Category:birds", "https://artlibre.org/x")
    assert (b["title"], b["creator"], b["width"], b["source_url"]) == ("B", "", 0, "")


def test_file_scan_finds_copies(spark, tmp_path):
    for name, data in (("a.JPG", b"x"), ("b.png", b"x"), ("c.png", b"y")):
        (tmp_path / name).write_bytes(data)
    files = provider.scan_files(spark, str(tmp_path))
    assert {r["extension"] for r in files.collect()} == {"jpg", "png"}
    assert sorted(r["copies"] for r in provider.distinct_content(files).collect()) == [1, 2]


def test_long_files_are_read_split_by_split(spark, tmp_path):
    random = np.random.default_rng(5)
    noise = random.integers(0, 256, 300_000, np.uint8).tobytes()
    (tmp_path / "a b [x]").mkdir()
    data = {
        "noise.bin": noise + b"x", "feed.bin": noise[::-1] + b"\n", "mark.bin": digests.BOM + noise, "mark_feed.bin": digests.BOM + noise + b"\n",
        "one_line.bin": b"\x00" * 200_000, "feeds.bin": b"\n" * 70_000, "returns.bin": b"\r\n\xff\xfe" * 50_000, "packed.gz": gzip.compress(noise),
        "short.bin": b"short", "just.bin": noise[:50_000], "more.bin": noise[:50_001], "a b [x]/%20 é.bin": noise + b"x",
    }
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        files = provider.scan_files(spark, str(tmp_path), whole=50_000)
        got = {r["filename"]: (r["bytes"], r["sha256"]) for r in files.collect()}
        # the contents of long files are read by splits only, compressed ones aside
        long = [spark.read.format(f).option("recursiveFileLookup", "true").option("lineSep", "\n").load(str(tmp_path)).where("_metadata.file_size > 50000")
                for f in ("binaryFile", "text")]
        chained = digests.chained_sha256(*long)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {n.split("/")[-1]: (len(c), hashlib.sha256(c).hexdigest()) for n, c in data.items()}
    assert len(chained) == 9 and not any(p.endswith(".gz") for p in chained)
    assert sorted(r["copies"] for r in provider.distinct_content(files).collect()) == [1] * 10 + [2]


def test_vector_load_quarantines(spark):
    rows = [(1, 2, struct.pack("<2f", 1, 2)), (2, 3, struct.pack("<2f", 1, 2)), (3, 1, struct.pack("<f", float("inf"))), (4, 1, b"abc"), (5, 1, None)]
    good, bad = provider.load_vectors(spark.createDataFrame(rows, "image_id bigint, dimensions int, vector_bytes binary"))
    assert [r["image_id"] for r in good.collect()] == [1] and {r["image_id"] for r in bad.collect()} == {2, 3, 4, 5}


def test_upsert_policies(spark):
    old = spark.createDataFrame([(1, "a", "a", "a"), (2, "b", "b", "b")], "id int, o string, c string, k string")
    new = spark.createDataFrame([(1, None, None, "z"), (3, "n", "n", "n")], "id int, o string, c string, k string")
    merged = sinks.upsert(old, new, ["id"], {"o": sinks.OVERWRITE, "c": sinks.COALESCE})
    assert sorted(tuple(r) for r in merged.collect()) == [(1, None, "a", "a"), (2, "b", "b", "b"), (3, "n", "n", "n")]
    twice = new.unionByName(new.withColumn("o", F.lit(None).cast(new.schema["o"].dataType)))
    assert sinks.upsert(old, twice, ["id"], {"o": sinks.OVERWRITE, "c": sinks.COALESCE}).count() == merged.count()
    again = sinks.new_rows(new, merged, ["id"])
    assert again.count() == 0


def test_violations_and_quarantine(spark):
    df = spark.createDataFrame([(1, 2, 1, "x" * 64), (3, 3, 9, "f" * 64)], "left_id int, right_id int, winner_id int, idempotency_key string")
    counts = {r["check"]: r["violations"] for r in quality.violations(df, quality.comparison_rules()).collect()}
    assert counts == {"distinct_sides": 1, "winner_in_pair": 1, "key_is_digest": 1}
    assert {tuple(r["broken"]) for r in quality.quarantine(df, quality.comparison_rules()).collect()} == {("key_is_digest",), ("distinct_sides", "winner_in_pair")}


def test_recount(spark):
    events = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 5)], "user_id bigint, id bigint")
    models = spark.createDataFrame([(1, 1, 49, 50), (2, 1, 60, 50), (3, 2, 5, 1), (4, 3, 5, 0)], "id bigint, user_id bigint, cut bigint, n bigint")
    got = [(r["id"], r["recounted"]) for r in quality.recount(models, events, "cut", "n").collect()]
    assert got == [(2, 61)]


def test_planted_credentials_are_removed(spark):
    # each module-level name of the catalog has one meaning, also when a query is built later
    from prefloom.catalog import tables
    from prefloom.sources.derived import Inputs

    i = Inputs(spark, "/root/testdata/sf0.001")
    assert tables.planted(i).filter("text like '%postgres://u:p@h/db%'").count() > 0
    assert tables.redacted(i).filter("text like '%postgres://u:p@h/db%' or text like '%correct horse%'").count() == 0
