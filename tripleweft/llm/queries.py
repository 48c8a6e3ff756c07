"""The numbered operators as queries: (spark, sf_dir) -> DataFrame, and SQL where it can say the same."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontaminate, html_extract, language, licenses, mixing, packing, prefix_trie, quality_model, quality_rules, simhash, suffix_dedup, wavelet

#: The vocabulary files; parameters of the operators, kept out of the repository.
VOCABULARY = str(public_tokenizers.path("word_bpe_49k.json"))
BYTE_VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.json"))


def _table(name: str):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents, benchmark, pages, labels, conversations, embeddings = (_table(x) for x in ("documents", "benchmark", "pages", "labels", "conversations", "embeddings"))


def op1_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(pages(spark, sf_dir))


def op2_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(documents(spark, sf_dir))


def op3_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op4_simhash_vantage_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_longest_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(documents(spark, sf_dir), keep_first=False).drop("text")


def op7_capped_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op8_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(documents(spark, sf_dir), VOCABULARY)


def op9_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op10_greedy_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(conversations(spark, sf_dir))


def op12_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), BYTE_VOCABULARY)


def op13_kd_tree_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(embeddings(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | {"pipeline": pipeline}


def oracle_sql() -> dict:
    return {"op2_host_quality_rules": quality_rules.ORACLE, "op7_capped_water_filling": mixing.ORACLE}
