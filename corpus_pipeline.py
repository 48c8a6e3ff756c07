"""From raw documents to token ids: quality rules, near-duplicates, decontamination, mixing, token output."""

from pyspark.sql import DataFrame, SparkSession

from tripleweft.llm import decontaminate, mixing, near_copies, quality_rules, wavelet
from tripleweft.llm.common import keep
from tripleweft.llm.queries import VOCABULARY


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and whose host passes."""
    return quality_rules.passed(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group linked at a five-word Jaccard similarity of 0.8 or more."""
    return near_copies.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in wavelet matrices, and for each document its place and checksum as read back from them."""
    return wavelet.round_trip(docs, VOCABULARY)


STAGES = [("quality_rules", rules), ("simhash_near_dedup", near_duplicates), ("decontamination", decontamination), ("mixing", mixture), ("token_output", tokens)]

#: SQL has neither XXH64 nor the tokenizer; tests/llm/test_pipeline.py holds the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else keep(docs), sf_dir)
    return docs
