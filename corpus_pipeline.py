"""A corpus pipeline: five stages, each one operator on all that the stage before it kept.

All stages but the last return the columns of documents. Rows that two stages could disagree about keep
their operator's defined results: null texts count as empty, rows without a doc_id are documents like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshwork.llm.mixing import mixed
from meshwork.llm.queries import op2_encode
from meshwork.llm.quality import keep_good
from meshwork.llm.rules import kept_documents
from meshwork.llm.simhash import one_of_each
from meshwork.llm.text import table
from meshwork.session import work_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger keeps."""
    return kept_documents(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that of the smallest doc_id; every text is represented."""
    return one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the mix takes them; those it doesn't take go."""
    return mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: its ids' number and digest, and the digest of the decoded text."""
    return op2_encode(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]
#: Hash votes, trained weights and piece merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows are written once, as Parquet in the shared folder, and read by the next."""
    docs, folder = table(spark, sf_dir, "documents"), work_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
