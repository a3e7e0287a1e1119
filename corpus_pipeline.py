"""The corpus pipeline: toxicity, near-duplicates, repeated passages, mixture, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is written as
Parquet before the next one reads it. All but the last return the columns of documents. A stage leaves only
its result in the shared folder; run() removes that once the next one has been written. In every stage a null
text counts as empty, rows of equal ids are rows, further columns of any name are carried and an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import byte_bpe, mixing, ngram_join, substring_dedup, toxicity
from tramline.llm.common import drop_stage, is_staged, result_only, stage

TOXIC = 0.3


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; it learns from the labelled rows among docs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.learn(docs, labels), TOXIC)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least id stays."""
    return result_only(lambda: ngram_join.keep_first(docs), spark, "one-of-each-group")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; a document of which nothing is left goes too."""
    return result_only(lambda: substring_dedup.without_repeats(docs), spark, "cut-repeats")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target shares; a document comes once for each pass that takes it."""
    return result_only(lambda: mixing.mixture(docs), spark, "mixture")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = F.col("ids")
    # no sample: after the other stages' plans, the driver has no memory for a second one with the rank table
    return byte_bpe.encode(docs, path, sample_bytes=0).select("doc_id", F.size(ids).cast("long").alias("n_tokens"), ids, byte_bpe.decode(ids, path).cast("string").alias("text"))


STAGES = [
    ("toxicity", remove_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", to_tokens),
]

#: SQL can't express the first and the last stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        out = step(spark, docs, sf_dir)
        docs = out if is_staged(out) else stage(out, f"pipeline-{name}")
        if before is not None:
            drop_stage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
