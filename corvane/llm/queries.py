"""Registered queries of the corpus operators and, where SQL can express one, its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import forest, mixing, packing, pivots, secrets, simhash, sitetree, surrogates, tokens, toxicity
from corvane.llm.common import spread_table, table


def op1_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.TARGET)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(spread_table(spark, sf_dir, "documents", "doc_id"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents", "doc_id")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(spread_table(spark, sf_dir, "pages", "page_id"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(spread_table(spark, sf_dir, "documents", "doc_id"))


def op7_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.in_ranges(table(spark, sf_dir, "documents")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread_table(spark, sf_dir, "documents", "doc_id"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_pii(spread_table(spark, sf_dir, "documents", "doc_id"))


QUERIES = {
    "op1_hash_prefix_forest": op1_hash_prefix_forest,
    "op2_mix_sources": op2_mix_sources,
    "op3_secret_scan": op3_secret_scan,
    "op4_toxicity": op4_toxicity,
    "op5_html_extraction": op5_html_extraction,
    "op6_token_counts": op6_token_counts,
    "op7_pivot_dedup": op7_pivot_dedup,
    "op8_packing": op8_packing,
    "op9_simhash": op9_simhash,
    "op10_pii_surrogates": op10_pii_surrogates,
}

ORACLES = {"op2_mix_sources": mixing.ORACLE}
