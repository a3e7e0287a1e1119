"""Queries of the two near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ngram_join, substring_dedup


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    words = F.regexp_replace(F.col("kept_text"), r"[\x20\x09-\x0D]+", " ")  # the digest is of words, the operator keeps untouched texts as they are
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.trim(words).cast("binary"), 256).alias("kept_sha256"))
