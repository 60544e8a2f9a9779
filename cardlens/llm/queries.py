"""Registered queries of the thirteen operators.  Each reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import radix_groups
from .langid import predict_held_out
from .lookup_clusters import centroid_clusters
from .mixing import mix_sources
from .ngram_join import ngram_components
from .pieces import encode_digests
from .pii import find_pii
from .quality import quality_features
from .repeats import remove_repeats
from .secrets import find_secrets
from .site_style import extract_main_text
from .spelling import spelling_groups
from .warc import page_derivatives

MODEL = "piece_bpe_32k.model"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir), count_links=True).drop("text_hash")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("row.doc_id", "source", "tokens", "block", "place")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path as tokenizer_path  # the vocabulary files: only this query needs them
    return encode_digests(documents(spark, sf_dir), tokenizer_path(MODEL))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_features(documents(spark, sf_dir)).drop("failed")


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_derivatives(pages(spark, sf_dir)).withColumn("record_sha256", F.sha2(F.col("record"), 256)).drop("record")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(pages(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_groups(documents(spark, sf_dir)).drop("row")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_held_out(documents(spark, sf_dir))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_source_mixing, op3_secret_scan, op4_sentencepiece, op5_pii, op6_quality_rules,
    op7_warc_derivatives, op8_substring_dedup, op9_html_extraction, op10_exact_dedup,
    op11_language_id, op12_centroid_clustering, op13_spelling_variants)}
