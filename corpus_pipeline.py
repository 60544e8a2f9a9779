"""Corpus pipeline: quality rules, exact dedup, near dedup, mixing, encoding.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read back as the next one's
``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from public_tokenizers import path as tokenizer_path

from cardlens.llm.common import Tables
from cardlens.llm.exact_dedup import radix_groups
from cardlens.llm.mixing import mix_sources
from cardlens.llm.ngram_join import ngram_components
from cardlens.llm.pieces import encode_decode
from cardlens.llm.quality import keep_good

MODEL = "piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return radix_groups(docs, carry=docs.columns).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: the smallest
    doc_id.  Rows whose doc_id is null are linked with nothing and stay."""
    gone = ngram_components(docs).where("component_id <> doc_id").select("doc_id", "text_hash").distinct()
    lost = (F.col("d.doc_id") == F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.text_hash"))
    return docs.alias("d").join(gone.alias("g"), lost, "left_anti").select(*[f"d.`{c}`" for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that the sources have their target weights; one that
    is drawn in several blocks is there several times."""
    return mix_sources(docs).select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded) of each document."""
    return encode_decode(docs, tokenizer_path(MODEL))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("source mixing", source_mixing),
    ("SentencePiece encoding", encoding),
]

#: SentencePiece encoding has no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each read back from its written result."""
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = tables.write(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            tables.drop(f"stage-{k - 1}")
    return docs
