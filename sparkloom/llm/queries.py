"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .html import extract_pages
from .langid import language_scores
from .licenses import license_scan, license_sql
from .mixing import mixing_order, mixing_sql
from .quality import quality_scores
from .resample import importance_scores, importance_sql
from .simhash import near_duplicates
from .tokenfiles import id_checksums
from .tokens import token_digests
from .topk import top_k, top_k_sql
from .trie import trie_nodes, trie_sql
from .urls import judge_urls, verdict_sql
from .vectors import near_vectors, near_vectors_sql


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(read(spark, sf_dir, "documents"))


def op3_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))


def op4_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"))


def op5_norm_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_order(read(spark, sf_dir, "documents"))


def op8_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_subspace_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(read(spark, sf_dir, "conversations"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_checksums(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


_ALL = (
    op1_pu_quality, op2_subword_language, op3_template_extraction, op4_url_vocabulary, op5_norm_sorted_topk,
    op6_simhash_near_dedup, op7_pfair_mixing, op8_bpe_chunk_reuse, op9_subspace_near_dedup, op10_license_rules,
    op11_prefix_trie, op12_importance_resampling, op13_token_files,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

ORACLE_SQL: dict[str, str] = {
    "op4_url_vocabulary": verdict_sql(), "op5_norm_sorted_topk": top_k_sql(), "op7_pfair_mixing": mixing_sql(), "op9_subspace_near_dedup": near_vectors_sql(),
    "op10_license_rules": license_sql(), "op11_prefix_trie": trie_sql(), "op12_importance_resampling": importance_sql(),
}
