"""The corpus pipeline: language, exact copies, near copies, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next one's documents. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fleetgauge.llm.bpe import token_digests
from fleetgauge.llm.common import pinned
from fleetgauge.llm.exact_dedup import keep_first
from fleetgauge.llm.language_id import with_language
from fleetgauge.llm.mixing import mixture
from fleetgauge.llm.simhash import one_of_each

VOCABULARY = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; the model is learned from the labelled ones among them."""
    return with_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it; a document may come up to three times, or not."""
    return mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each document of the mix."""
    return token_digests(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mix", mix), ("tokens", tokens)]
#: SQL can express neither the language model nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
