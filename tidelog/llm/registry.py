"""Queries and SQL of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, jaccard, linededup, packing, prefixcount, quality, toxicity, urlrules

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
COUNT_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("items")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_read(spark, sf_dir, "documents"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.filter_urls(_read(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_conversations(rows.unionByName(chat.check_conversation(rows))))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.assign(_read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(_read(spark, sf_dir, "documents").select("doc_id", "text"), BPE_RANKS)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixcount.count_tokens(_read(spark, sf_dir, "documents").select("doc_id", "text"), COUNT_TOKENIZER)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_quality, op3_urls, op4_toxicity, op5_linededup, op6_chat, op7_sharding, op8_bpe, op9_jaccard, op10_tokens)}
SQL = {"op1_decontamination": decontaminate.ORACLE, "op2_quality": quality.ORACLE, "op3_urls": urlrules.ORACLE, "op6_chat": chat.ORACLE, "op9_jaccard": jaccard.ORACLE}
