"""The registered queries of this folder and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.llm import binary_ids, bpe_chunks, chat, distinct_words, exact_dedup, merkle, mixing, secrets, simhash, token_counts, topk, toxicity, turn_repair
from landloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


@query("op4_source_mix", mixing.ORACLE)
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op8_exact_dedup", exact_dedup.ORACLE)
def exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("n_code_points")


@query("op2_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


@query("op7_bpe_chunk_reuse")
def bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.encode(table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


@query("op6_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, with_hits=False)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op10_token_id_files")
def token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_ids.round_trip(table(spark, sf_dir, "documents"))


@query("op9_exact_top_k", topk.ORACLE)
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op5_chat_format", chat.ORACLE)
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(*more.columns).unionByName(more)
    return chat.read_back(chat.format_turns(rows))


@query("op3_token_counts")
def token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query("op1_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).withColumn("value", F.sha2("value", 256))


@query("op12_distinct_word_bpe")
def distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_words.encode(table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


@query("op11_turn_repair", turn_repair.ORACLE)
def turn_repair_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_summary(table(spark, sf_dir, "conversations"))


@query("op13_merkle_manifest", merkle.ORACLE)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))
