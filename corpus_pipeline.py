"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, tokens.

Each stage is written as Parquet and read again as the next one's documents. A stage works on all that the one before
it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmart.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from quillmart.llm.common import arrow_batches, table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold. The model is trained on these documents and their labels."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.where(F.col("toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines of its source; ``n_chars`` follows the text."""
    arrow_batches(spark)
    kept = line_dedup.drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of similar ones: five-word shingles, similarity 0.8 or more."""
    arrow_batches(spark)
    return simhash.one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` of each document left."""
    arrow_batches(spark)
    return bpe.tokenized(docs, public_tokenizers.path("byte_bpe_50k.json"), extra="ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe", token_stage),
]

#: SQL can't express the trained score, the edit distances or the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents below ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
