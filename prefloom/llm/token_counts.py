"""Token totals by source, language and tokenizer version, kept up to date by signed changes.

A ledger is a folder of committed batches. A batch brings documents in, takes them out, or revises
their counts; from its changes and what earlier batches left of the same documents it derives signed
entries (+1 for what holds now, -1 for what no longer does) and their sums per group. Totals are the
sum of all batches' sums, so nothing is ever recounted. A batch is written beside the ledger and
moved into it under its id in one step: a batch whose id is there already is not applied again, and
one that broke off leaves nothing.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefloom.llm.common import arrow_map, keyed, parts, ready
from prefloom.llm.packing import TOKENIZER, tokenizer_path, word_ids

GROUP = ("source", "lang", "tokenizer_version")
KEY = ("doc_id", "tokenizer_version")
ENTRY = "doc_id long, tokenizer_version string, source string, lang string, tokens long, sign int"
SUMS = "source string, lang string, tokenizer_version string, documents long, tokens long"


def count_tokens(documents: DataFrame, version: str = TOKENIZER) -> DataFrame:
    """doc_id, source, lang, tokenizer_version, tokens for every row; a null text has no token.

    ``version`` names the tokenizer file.
    """
    ready(documents)
    where = tokenizer_path(version)
    base = keyed(documents, F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))

    def work(batch):
        words = word_ids(where)
        for part in parts(batch):
            tokens = [len(ids) // 4 for ids in words.ids_of(part.column("text"))]
            yield {n: part.column(n) for n in ("doc_id", "source", "lang")} | {"tokens": tokens}

    counted = arrow_map(base, work, "doc_id long, source string, lang string, tokens long")
    return counted.withColumn("tokenizer_version", F.lit(version))


class Ledger:
    """Committed batches under ``folder``, a path that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/batches"))

    def _read(self, what: str, schema: str) -> DataFrame:
        committed = [s.getPath().toString() for s in self._fs.listStatus(self._path(f"{self.folder}/batches"))]
        if not committed:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{p}/{what}" for p in sorted(committed)])

    def entries(self) -> DataFrame:
        return self._read("entries", ENTRY)

    def has(self, batch_id: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/batches/{batch_id}"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (doc_id, tokenizer_version, source, lang, tokens, deleted[, seq]) once.

        A document and version has one state: its last change in the batch wins, by ``seq`` where the
        frame has that column, then by all other columns, so repeated rows count once. A deletion of
        something unknown changes nothing. Null ids form one document; null sources and languages
        are groups of their own. Returns whether the batch was new.
        """
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch_id):
            raise ValueError("a batch id is made of letters, digits and _ . -")
        if self.has(batch_id):
            return False
        seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")
        named = changes.select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), "tokenizer_version", "source", "lang",
            F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long")).alias("tokens"), F.coalesce("deleted", F.lit(False)).alias("deleted"), seq.alias("seq"),
        )
        order = [F.col(c).desc_nulls_last() for c in ("seq", "deleted", "tokens", "source", "lang")]
        last = named.withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))).where("place = 1")
        touched = last.select(*KEY)
        live = self.entries().join(touched, list(KEY), "left_semi").groupBy(*KEY, "source", "lang", "tokens").agg(F.sum("sign").alias("sign"))
        gone = live.where("sign > 0").select(*KEY, "source", "lang", "tokens", F.lit(-1).alias("sign"))
        come = last.where("NOT deleted").select(*KEY, "source", "lang", "tokens", F.lit(1).alias("sign"))
        staged = f"{self.folder}/staged-{uuid.uuid4().hex}"
        gone.unionByName(come).write.parquet(f"{staged}/entries")
        written = self.spark.read.schema(ENTRY).parquet(f"{staged}/entries")
        sums = written.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        sums.where("documents <> 0 OR tokens <> 0").select("source", "lang", "tokenizer_version", "documents", "tokens").write.parquet(f"{staged}/sums")
        moved = not self.has(batch_id) and self._fs.rename(self._path(staged), self._path(f"{self.folder}/batches/{batch_id}"))
        if not moved:  # another attempt was first
            self._fs.delete(self._path(staged), True)
        return bool(moved)

    def totals(self) -> DataFrame:
        """documents and tokens per group, from the batches' sums alone; empty groups are left out."""
        sums = self._read("sums", SUMS).groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 OR tokens <> 0")


def _changes(counted: DataFrame, deleted: bool = False) -> DataFrame:
    return counted.select("doc_id", "tokenizer_version", "source", "lang", "tokens", F.lit(deleted).alias("deleted"))


def maintained_totals(documents: DataFrame, folder: str) -> DataFrame:
    """Totals after four commits over ``documents``, one of them repeated.

    All documents come in; those whose text an earlier id has too go out; documents in which a line
    repeats are counted again without the repeats; the second batch comes once more and has no effect.
    """
    spark = ready(documents)
    ledger = Ledger(spark, folder)
    base = documents.select("doc_id", "text", "source", "lang")
    ledger.commit("insert", _changes(count_tokens(base)))
    first = base.groupBy(F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("s")).agg(F.min("doc_id").alias("first"))
    marked = base.select("doc_id", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("s")).join(first, ["h", "s"])
    copies = marked.where("doc_id <> first").select("doc_id").distinct()
    gone = copies.select("doc_id", F.lit(TOKENIZER).alias("tokenizer_version"), F.lit(None).cast("string").alias("source"),
                         F.lit(None).cast("string").alias("lang"), F.lit(0).alias("tokens"), F.lit(True).alias("deleted"))
    ledger.commit("copies", gone)
    lines = F.split("text", "\n")
    shorter = base.withColumn("lines", lines).where(F.size(F.array_distinct("lines")) < F.size("lines"))
    shorter = shorter.join(copies, "doc_id", "left_anti").select("doc_id", F.array_join(F.array_distinct("lines"), "\n").alias("text"), "source", "lang")
    ledger.commit("lines", _changes(count_tokens(shorter)))
    ledger.commit("copies", gone)
    return ledger.totals()
