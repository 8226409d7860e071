"""The registered queries ``opN_<name>`` of the thirteen operators, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmart.llm import bpe, chat, decontaminate, fim, hamming_topk, line_dedup, periodic_runs, quality, secret_scan, simhash, token_store, toxicity, warc
from quillmart.llm.common import table, written
from quillmart.shared import fresh_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_store.write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_store.read_store(spark, path)


def op2_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = hamming_topk.sign_codes(table(spark, sf_dir, "embeddings"))
    return hamming_topk.top_k(codes, codes.where(F.col("id") % 50 == 0), k=10)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path, versions=(1, 2))
    return warc.read_archives(spark, path).drop("record_id", "refers_to_id", "date")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    predicted = (F.col("toxicity") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity").alias("score"), predicted.alias("predicted"))


def op7_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.digest(written(chat.examples(turns.unionByName(probe)), "chat-examples"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenized(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.examples(table(spark, sf_dir, "documents"), seed=1))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.collapse(table(spark, sf_dir, "documents"), loops=True))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = quality.score(docs, model)
    predicted = (F.col("quality_score") >= quality.THRESHOLD).cast("int")
    return scored.select("doc_id", quality.held_out().alias("held_out"), F.col("quality_score").alias("score"), predicted.alias("predicted"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_store,
        op2_hamming_top_k,
        op3_line_dedup,
        op4_benchmark_leaks,
        op5_warc_archive,
        op6_toxicity,
        op7_chat_examples,
        op8_bpe_round_trip,
        op9_secret_scan,
        op10_simhash_near_duplicates,
        op11_fill_in_middle,
        op12_periodic_runs,
        op13_quality,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_hamming_top_k": hamming_topk.ORACLE_SQL,
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op5_warc_archive": warc.ORACLE_SQL,
    "op7_chat_examples": chat.ORACLE_SQL,
    "op11_fill_in_middle": fim.ORACLE_SQL,
}
