"""From raw documents to token ids: quality, toxicity, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run`` writes every stage's rows as
Parquet and reads them again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stopflow.llm import bpe, mixing, quality_model, simhash, toxicity
from stopflow.llm.common import settle, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the perplexity threshold of their language."""
    settle(spark)
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted to be toxic."""
    settle(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id."""
    settle(spark)
    return simhash.representatives(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source as often as its target weight asks for."""
    settle(spark)
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row in place of its text."""
    settle(spark)
    coded = bpe.tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.selectExpr("doc_id", "lang", "source", "n_chars", "size(ids) AS n_tokens", "ids")


STAGES = [("quality", quality), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

# Models and hash draws can't be written in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
