"""Queries over the test tables, one for each operator with its production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import hilbert_sharding, linear_grouping, multiprobe_lsh, ordinal_quality, recompression, simhash_vptree, string_tiling, temporal_urls, toxicity_chain, trie_unigram
from .common import read


def op1_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return recompression.repeated_passages(read(spark, d, "documents"))


def op2_nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 50 asks all of them."""
    vectors = read(spark, d, "embeddings")
    return multiprobe_lsh.nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"))


def op3_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return trie_unigram.token_counts(read(spark, d, "documents"), trie_unigram.load_vocabulary())


def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return toxicity_chain.score(docs, toxicity_chain.fit_chain(docs, read(spark, d, "labels")))


def op5_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    return linear_grouping.pack(read(spark, d, "documents"))


def op6_hilbert_sharding(spark: SparkSession, d: str) -> DataFrame:
    return hilbert_sharding.shards(read(spark, d, "documents"))


def op7_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return ordinal_quality.score(docs, ordinal_quality.fit_quality(docs, read(spark, d, "labels")))


def op8_url_filter(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages")
    return temporal_urls.judge(temporal_urls.sample_captures(pages), temporal_urls.sample_entries(pages))


def op9_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return string_tiling.contamination_report(read(spark, d, "documents"), read(spark, d, "benchmark"))


def op10_simhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return simhash_vptree.near_duplicates(read(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_substring_dedup, op2_nearest_neighbours, op3_token_counts, op4_toxicity, op5_best_fit_packing, op6_hilbert_sharding, op7_quality, op8_url_filter, op9_decontamination, op10_simhash_near_dedup]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": recompression.sql(), "op6_hilbert_sharding": hilbert_sharding.shards_sql(), "op8_url_filter": temporal_urls.SQL}
