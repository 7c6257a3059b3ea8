"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, source mixing, packing.

Every stage decides row by row, never by doc_id, and gives back its input's columns as they were: only the columns that an operator reads
keep their names on the way through it, the others are put aside under private ones. Repeated rows are rows like any other until exact
dedup leaves one of them; an empty table gives an empty table; texts of any length are taken whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm import exact_dedup, language, mixing, packing, simhash
from windrow.llm.queries import _tokenizer
from windrow.llm.shared import drop_since, mark, shared_dir, table

#: Documents whose best language is further off than this are rejected: from LETTERS[1] letters on, and up to LETTERS[0], where clean
#: texts score like noise; in proportion between. README has the measured scores.
LEAST_COSINE, LEAST_SHORT, LETTERS = 0.2, 0.02, (16, 48)


def _aside(docs: DataFrame, *read: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with private names for all columns but those that are read, and what gives its result docs' columns again."""
    there = {c: c if c in read else f"aside_{i}__" for i, c in enumerate(docs.columns)}

    def back(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(f"`{name}`").alias(c) for c, name in there.items()))

    return docs.select(*(F.col(f"`{c}`").alias(name) for c, name in there.items())), back


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null, have no letter, or are like no language of the labelled documents. Rows are judged by their text
    alone, so equal texts fare alike."""
    rows, back = _aside(docs, "text", "lang")
    told = language.identify(rows, language.learn(rows), keep=rows.columns)
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (letters - LETTERS[0]) / (LETTERS[1] - LETTERS[0])))
    like = F.when(F.col("score") >= LEAST_COSINE, True).otherwise(F.col("score") >= LEAST_SHORT + (LEAST_COSINE - LEAST_SHORT) * share)
    return back(told.where((F.col("lang_pred") != language.UNDETERMINED) & like))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts are equal but for white space one stays: the longest, then of the smallest doc_id, then any."""
    rows, back = _aside(docs, "doc_id", "text")
    return back(exact_dedup.exact_dedup(rows).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts with 0.8 or more of their five-word shingles in common one stays, the row of the smallest doc_id."""
    return simhash.near_copies_dropped(docs, words=5, least=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: small sources repeat, up to four times; no document is lost, as every source has one
    whole pass."""
    rows, back = _aside(docs, "doc_id", "source", "text")
    told, _ = mixing.mix(rows)
    return back(told.where("copies > 0").withColumn("nth__", F.explode(F.expr("sequence(1L, copies)"))))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2048 tokens. Rows that share a doc_id are packed each by itself."""
    return packing.pack_documents(docs, _tokenizer("word_bpe_49k.json"), 2048, 0).drop("uid")


_before: dict[str, int] = {}


def _alone(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, dropping first what the stages before it wrote on the way: their results are written when it is called."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if stage is not language_id and "since" in _before:
            drop_since(spark, _before["since"])
        _before["since"] = mark()
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", _alone(language_id)),
    ("exact_dedup", _alone(exact)),
    ("simhash_near_dedup", _alone(near)),
    ("mixing", _alone(mixed)),
    ("packing", _alone(packed)),
]
#: Packing, hyperdimensional profiles and the trie join are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/windrow-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{top}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
