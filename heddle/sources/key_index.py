"""Which files of a history hold a key.

A history's files follow time, so a key's least and greatest value in a file rule out
nothing.  The index holds (key, file) once each, sorted by key: a lookup reads the few
row groups that can hold the key, then only the files it names.  New files are added
as they come; each addition is a folder of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import exists


def extend_key_index(spark: SparkSession, history: str, index: str, *, key: str) -> int:
    """Index the files that the index lacks; how many there were."""
    known = {r[0] for r in spark.read.parquet(f"{index}/files").distinct().collect()} if exists(spark, f"{index}/files") else set()
    new = sorted(set(spark.read.parquet(history).inputFiles()) - known)
    if not new:
        return 0
    rows = spark.read.option("basePath", history).parquet(*new)
    pairs = rows.select(F.col(key).alias("key"), F.col("_metadata.file_path").alias("file")).filter("key IS NOT NULL").distinct()
    # A key of very many files is cut like any other: the file is the second key of the ranges.
    sorted_pairs = pairs.repartitionByRange("key", "file").sortWithinPartitions("key", "file")
    sorted_pairs.write.option("parquet.bloom.filter.enabled#key", "true").mode("append").parquet(f"{index}/keys")
    # Written last: files of a run that broke off are indexed again, which the reader's distinct allows.
    spark.createDataFrame([(f,) for f in new], "file string").write.mode("append").parquet(f"{index}/files")
    return len(new)


def files_with(spark: SparkSession, index: str, keys: list) -> list[str]:
    """The files that hold any of the keys; there are no more names than files."""
    found = spark.read.parquet(f"{index}/keys").filter(F.col("key").isin(keys)).select("file").distinct()
    return sorted(r.file for r in found.collect())


def search_keys(spark: SparkSession, history: str, index: str, *, key: str, keys: list) -> DataFrame:
    """The history's rows with these keys, from the files that hold them."""
    files = files_with(spark, index, keys)
    if not files:
        return spark.read.parquet(history).limit(0)
    return spark.read.option("basePath", history).parquet(*files).filter(F.col(key).isin(keys))
