"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, language, mixing, packing, quality, simhash, token_counts, token_store, toxicity
from .shared import table, written


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return told.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(table(spark, sf_dir, "documents"))
    base = quality.POLICIES["base", 1].mask
    told = quality.apply_policy(entries, quality.POLICIES["prose", 1])
    return told.select("doc_id", *quality.MEASURES, "failed_bits", (F.col("failed_bits").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), "kept")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_tokens(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=0)
    return token_store.read_tokens(spark, path)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), 2048, 0).drop("uid")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def _remainder(n: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.learn(docs.where(_remainder(3) != 1), key=F.col("doc_id"))
    rows = docs.select("doc_id", "text", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"))
    return language.identify(rows, profiles, keep=["doc_id", "held_out"])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, _ = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])
    return told.selectExpr("* EXCEPT (order_key)", "order_key.block AS order_block", "order_key.place AS order_place")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    hard = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    segments = written(chat.format_chat(rows.unionByName(hard)), "chat")
    return chat.read_chat(segments)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), limit=1024)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    open_ = docs.where(_remainder(5) != 0).select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(_remainder(5) != 0).select("doc_id", "toxic")
    scorer = toxicity.learn(labels, open_)
    return toxicity.score(docs, scorer, more={"held_out": F.coalesce(_remainder(5) == 0, F.lit(False))})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_quality_rules, op3_token_store, op4_packing, op5_simhash, op6_language_id, op7_mixing, op8_chat, op9_token_counts, op10_toxicity)}
