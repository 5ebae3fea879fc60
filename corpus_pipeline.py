"""A corpus pipeline of five stages over `documents`; every stage's result is written as Parquet and read again as the next one's docs.

Nulls and odd rows, besides what the operators' modules say: a null text is scored as an empty one, and goes or stays as its score says; what
stays keeps its null through the stages, and takes one sequence's place of one token in the last. Rows with a null doc_id take part and count
as smaller than any other. Of rows with one doc_id and near-equal texts one stays. Empty tables give an empty result. The first four stages
return the columns of their docs, extra ones included, whatever their names; n_chars follows a text that was cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import table, written
from quillstack.llm.decontaminate import decontaminated
from quillstack.llm.packing import pack_documents
from quillstack.llm.quality import keep_good
from quillstack.llm.repeats import without_repeats
from quillstack.llm.simhash import drop_near_duplicates
from quillstack.shipping import ship


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each component one document stays, the one with the smallest doc_id."""
    ship(spark)
    return drop_near_duplicates(docs)


def without_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: strings of 50 bytes that an earlier document has are cut out; documents of which nothing is left go."""
    ship(spark)
    out = without_repeats(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents in which a benchmark item is found go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: one row for each piece of a document, with its place in a sequence of at most 1024 tokens."""
    import public_tokenizers

    ship(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", good_documents),
    ("simhash near-dedup", one_of_each_group),
    ("suffix-array dedup", without_repeated_strings),
    ("benchmark decontamination", without_benchmarks),
    ("best-fit packing", packed_sequences),
]

#: SQL can't express the stages (trained model, hashes, tokenizer); tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
