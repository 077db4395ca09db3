"""Corpus pipeline: quality, near duplicates, benchmark passages, personal data, mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm.common import table, written
from framewright.llm.decontam import clean
from framewright.llm.mixing import mix
from framewright.llm.pii import key_of, pseudonymise
from framewright.llm.quality import keep_good
from framewright.llm.shingles import first_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return first_of_each(docs, prints=True)  # the links of op8_simhash, and those of near copies that its 4 bits leave


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonymise(docs, key_of(spark))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages), ("personal_data", personal_data), ("mixture", mixture)]

#: Fitted trees, fingerprints and min-hash bands of XXH64 and keyed permutations have no SQL form; tests/llm holds the stages' operators against brute force or
#: planted cases, tests/llm/test_pipeline.py what the stages keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each over what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
