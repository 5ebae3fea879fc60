"""Delta-maintained token totals by source, language and tokenizer version.

A batch is a set of signed changes: +1 for a document that is inserted, -1 for one that is deleted, and both for one whose count is
revised. A commit aggregates the changes to one additive row per group, writes that as a new folder, and then creates the batch's
commit record, which names the folder; creating it fails if it exists. So a batch counts once however often it is committed, and a
commit that breaks off leaves only a folder that no record names. Totals are the sums over all committed folders; compact() folds them.

Nulls and odd rows: a null source, language or version is a group of its own. A null text has no tokens. Repeated rows are summed. Groups whose
documents and tokens are all withdrawn are left out of the totals. An empty batch commits and adds nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import key_of, new_folder, table, written

KEYS = ("source", "lang", "tokenizer")
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class TokenRollup:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._text = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils.toString
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _record(self, name: str) -> str:
        return f"{self.folder}/commits/{name}.json"

    def _create(self, name: str, record: dict) -> bool:
        """Creates the record; False if there is one."""
        at = self._path(self._record(name))
        if self._fs.exists(at):
            return False
        try:
            out = self._fs.create(at, False)
        except Exception:
            if self._fs.exists(at):  # another writer was first
                return False
            raise
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        return True

    def _records(self) -> dict[str, dict]:
        at = self._path(f"{self.folder}/commits")
        if not self._fs.exists(at):
            return {}
        out = {}
        for s in self._fs.listStatus(at):
            name = s.getPath().getName()
            if name.endswith(".json"):
                stream = self._fs.open(s.getPath())
                try:
                    out[name[:-5]] = json.loads(self._text(stream, "UTF-8"))
                finally:
                    stream.close()
        return out

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._path(self._record(f"batch-{batch}")))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """changes: KEYS, sign (+1 or -1) and tokens. False if the batch is committed already: then nothing changes."""
        if self.committed(batch):
            return False
        at = f"{self.folder}/deltas/{batch}-{uuid.uuid4().hex}"
        sign = F.col("sign").cast("long")
        delta = changes.groupBy(*(F.col(k).cast("string").alias(k) for k in KEYS)).agg(F.sum(sign).alias("n_docs"), F.sum(sign * F.coalesce(F.col("tokens"), F.lit(0))).alias("n_tokens"))
        delta.write.parquet(at)
        return self._create(f"batch-{batch}", {"kind": "batch", "batch": batch, "data": at})

    def totals(self, records: dict[str, dict] | None = None) -> DataFrame:
        """TOTALS over all committed batches, or over those of the given records."""
        records = self._records() if records is None else records
        bases = [r for r in records.values() if r["kind"] == "base"]
        base = max(bases, key=lambda r: len(r["batches"]), default=None)
        paths = [r["data"] for r in records.values() if r["kind"] == "batch" and not (base and r["batch"] in base["batches"])] + ([base["data"]] if base else [])
        if not paths:
            return self.spark.createDataFrame([], TOTALS)
        rows = self.spark.read.schema(TOTALS).parquet(*paths)
        out = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return out.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def compact(self) -> None:
        """Folds the batches that are committed now into one folder; they stay known, so they still can't be committed again. A batch that
        is committed meanwhile isn't in it, and counts by itself."""
        records = self._records()
        batches = [r["batch"] for r in records.values() if r["kind"] == "batch"]
        at = f"{self.folder}/bases/{uuid.uuid4().hex}"
        self.totals(records).write.parquet(at)
        self._create(f"base-{len(batches):09d}-{uuid.uuid4().hex}", {"kind": "base", "batches": batches, "data": at})


def inserted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sign", F.lit(1))


def deleted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sign", F.lit(-1))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    return deleted(old).unionByName(inserted(new))


def words(text: Column) -> Column:
    """Tokenizer words-1: maximal runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def words_and_marks(text: Column) -> Column:
    """Tokenizer words-2: runs of letters, runs of digits, and each other character that isn't ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\p{L}+|[0-9]+|[^\p{L}0-9\x20\x09-\x0D]")), F.lit(0)).cast("long")


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` inserted under words-1; those not in English revised to words-2; copies of a text withdrawn; batches sent twice."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    counts = written(docs.select(key_of("doc_id").alias("id"), "source", "lang", F.sha2(text, 256).alias("content"), words(text).alias("n1"), words_and_marks(text).alias("n2")), "counts")
    one = counts.select("source", "lang", F.lit("words-1").alias("tokenizer"), F.col("n1").alias("tokens"))
    foreign = F.coalesce(F.col("lang"), F.lit("")) != "en"
    two = counts.where(foreign)
    now = (F.when(foreign, "words-2").otherwise("words-1").alias("tokenizer"), F.when(foreign, F.col("n2")).otherwise(F.col("n1")).alias("tokens"))
    # withdrawn copies: every row goes, and the first of each text returns; no join, and a group of copies is one partial aggregate
    first = counts.groupBy("content").agg(F.min(F.struct("id", "source", "lang", "n1", "n2")).alias("r")).select("r.*")
    rollup = TokenRollup(spark, new_folder(spark, "rollup"))
    for _ in range(2):  # the second time changes nothing
        rollup.commit("load", inserted(one))
        rollup.commit("recount", revised(two.select("source", "lang", F.lit("words-1").alias("tokenizer"), F.col("n1").alias("tokens")), two.select("source", "lang", F.lit("words-2").alias("tokenizer"), F.col("n2").alias("tokens"))))
        rollup.commit("withdraw", revised(counts.select("source", "lang", *now), first.select("source", "lang", *now)))
    return rollup.totals()


OP6_SQL = r"""
WITH counts AS (
    SELECT source, lang,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n1,
           len(regexp_extract_all(coalesce(text, ''), '\p{L}+|[0-9]+|[^\p{L}0-9\x20\x09-\x0D]')) AS n2,
           row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id NULLS FIRST, source NULLS FIRST, lang NULLS FIRST) AS copy
    FROM documents
)
SELECT source, lang, CASE WHEN lang = 'en' THEN 'words-1' ELSE 'words-2' END AS tokenizer,
       count(*) AS n_docs, CAST(sum(CASE WHEN lang = 'en' THEN n1 ELSE n2 END) AS BIGINT) AS n_tokens
FROM counts WHERE copy = 1 GROUP BY 1, 2, 3
"""
