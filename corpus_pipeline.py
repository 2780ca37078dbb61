"""Corpus pipeline: quality rules, exact dedup, near-duplicate join, personal data,
packing. Each stage works on all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, all but the last with the columns of its input. ``run``
applies them to the documents table, each stage's rows written as Parquet in the
shared folder and read again. Rows of every stage are judged as the operators'
docstrings say (nulls, empty and very long texts, repeated rows, empty tables,
extra columns)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from caseflow.llm import exact_dedup, ngram_join, packing, pii, quality_rules
from caseflow.llm.common import table, written
from caseflow.session import configure


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    configure(spark)
    return quality_rules.filter_quality(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased), the one with the largest id."""
    configure(spark)
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard 0.8), the one
    with the smallest id."""
    configure(spark)
    return ngram_join.keep_one(docs)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts replaced by its kind in brackets."""
    configure(spark)
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences with their ids."""
    configure(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near),
          ("personal data", personal), ("packing", packed)]

# Model decisions (personal data) and tokenizer ids are beyond SQL; tests/llm
# compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
