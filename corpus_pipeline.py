"""A training corpus from documents: language, exact and near copies, mixing, encoding."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm import bpe, common, exact_dedup, langid, mixing, near_dedup


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the network can't tell: those without a letter, and those of a score under langid.LEAST_SCORE."""
    return langid.drop_unknown(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with identical texts, the one with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at 0.8 of five-word shingles, the document with the smallest doc_id stays."""
    return near_dedup.drop_near_duplicates(docs, words=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows repeat."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256 and decoded_sha256 of every row."""
    return bpe.encode_bpe(docs, bpe.public_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mix),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each is written to the folder of spark.checkpoint.dir and read again as the next one's input."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        with common.Owner(spark):  # a stage's own tables go once its result is written
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
        if i:
            common.delete(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs


#: The language model's predictions aren't expressible in SQL; tests hold the other stages against brute force.
ORACLE_SQL = None
