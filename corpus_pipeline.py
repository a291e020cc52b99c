"""The corpus pipeline: documents through five stages, the last of which packs them into sequences.

Every stage takes null ids, texts and languages, empty texts, repeated rows and empty tables as its operator does: a document without
words goes with the first stage, so no later one meets it; of rows that are alike in everything one stays after the third.
Columns besides those of documents are not carried on.
"""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sandpiper.llm.lines import drop_lines
from sandpiper.llm.packing import pack
from sandpiper.llm.quality import keep_good
from sandpiper.llm.simhash import one_of_each
from sandpiper.llm.substrings import drop_repeats
from sandpiper.session import remove, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their language's perplexity band keep."""
    return keep_good(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one equals but for a word; n_chars follows."""
    return counted(drop_lines(docs.select(*COLUMNS)))


def simhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return one_of_each(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 20 words or more that start earlier; n_chars follows."""
    return counted(drop_repeats(docs.select(*COLUMNS)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of 1024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def counted(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS BIGINT) AS n_chars")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_neardup", simhash_neardup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: The perplexity model, SimHash and the token ids can't be expressed in SQL; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. Each stage's result is written as Parquet to a new folder in the shared directory and read again by the next.

    A stage's files go once the next stage's are written; those of the last but one stay, as the result is read from them.
    """
    home = f"{shared_dir(spark)}/pipeline-{uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
        if before:
            remove(spark, before)
        before = f"{home}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
