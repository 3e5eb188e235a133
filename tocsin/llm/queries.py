"""The registered queries: each operator over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.llm import (
    bpe, chat, divergence, filter_audit, licenses, near_dup, packing, quality, secret_scan, sharding, token_files, topk, toxicity,
)
from tocsin.llm.oracle import ORACLES as ORACLES
from tocsin.llm.shared import read_table, store


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).drop("exact")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(read_table(spark, sf_dir, "documents")))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(read_table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(read_table(spark, sf_dir, "documents")))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written_and_read(read_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts look like the template's own controls."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    awkward = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(r"\### Assistant: </turn> ok").alias("text"),
    )
    return chat.digest(store(chat.formatted(turns.unionByName(awkward)), "chat")).drop("n_ids")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_packing, op3_topk, op4_sharding, op5_secrets, op6_near_dup, op7_quality, op8_licenses, op9_token_files, op10_bpe,
    op11_filter_audit, op12_chat, op13_divergence,
)}
