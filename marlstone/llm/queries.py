"""The thin queries over the driver's tables, one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embed_dedup, exact_dedup, langid, minhash, mixing, packing, quality, secrets, warc
from .common import id_bucket, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_bucket(F.col("doc_id"), 4) == 2
    model = langid.learn(docs, ~held_out)
    found = langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.written_masks(chat.rotate(table(spark, sf_dir, "conversations")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op6_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_bucket(F.col("doc_id"), 3) == 1
    machine = quality.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    found = quality.score(docs.select("doc_id", held_out.alias("held_out"), "text", "n_chars"), machine, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "score", "predicted")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), words=3, num=85, den=100)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_rotation": chat.ORACLE_SQL, "op5_warc_round_trip": warc.ORACLE_SQL, "op7_source_mixing": mixing.oracle_sql(), "op8_embedding_near_dup": embed_dedup.ORACLE_SQL, "op9_minhash_near_dup": minhash.ORACLE_SQL, "op10_exact_dedup": exact_dedup.ORACLE_SQL}
