"""From raw documents to packed sequences, in five stages.

1. quality: documents that the compression classifier rejects go.
2. near_duplicates: of each group of near copies the smallest id stays.
3. decontamination: documents that hold a window of a benchmark item go.
4. secrets: secrets become marks; every document stays.
5. packing: what is left, as pieces with their places in sequences.

Each stage works on all that the one before kept; its result is written as
Parquet and read again.  SQL can express none of stages 1, 4 and 5, so there is
no ORACLE_SQL; tests hold every stage against brute force.  Rows are judged one by
one: ids may be absent or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heddle.llm.common import bound_batches, settle, table
from heddle.llm.decontaminate import keep_clean
from heddle.llm.ngram_join import one_of_each
from heddle.llm.packing import pack
from heddle.llm.quality import keep_good, train_quality
from heddle.llm.secret_scan import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)  # for the training too
    return keep_good(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
