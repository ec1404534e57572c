"""A training corpus from raw documents: language, exact and near copies, mixing, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from digestflow.llm import bpe_codec, exact_dedup, jaccard_join, language_id, mixing
from digestflow.llm._shared import staged


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter, or too uncertain, go."""
    return language_id.keep_known(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the least id."""
    return exact_dedup.drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8), the one with the least id."""
    return jaccard_join.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; n_chars follows the text."""
    return mixing.Mix(docs, weights=(5, 2, 1), block=64).mixed().selectExpr(
        *["cast(char_length(text) AS bigint) AS n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns]
    )


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of ids and of the decoded text."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe_codec.encode(docs, path, carry=("lang", "source")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language ID", known_language),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources", mixed),
    ("BPE encoding", tokens),
]

#: SQL can't express chosen language models, permuted blocks or BPE; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
