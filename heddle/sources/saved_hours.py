"""Partial results by hour, saved with a fingerprint of what they were made from.

The source is a folder with ``hour=<n>`` below it.  An hour's fingerprint covers its
files' paths, lengths and times.  A refresh recomputes the hours whose fingerprint is
new and forgets those that are gone; the others are not read.  Parts are written before
their fingerprints, so a refresh that broke off is done again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import exists, removed


@dataclass(frozen=True)
class Refreshed:
    """The hours that were recomputed and those that were forgotten."""

    stale: list[int]
    gone: list[int]


def fingerprints(spark: SparkSession, source: str) -> DataFrame:
    """(hour, print) of the source's files; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(source)
    facts = F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    return files.groupBy(F.col("hour").cast("bigint").alias("hour")).agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(facts))), 256).alias("print"))


def saved_prints(spark: SparkSession, saved: str) -> DataFrame:
    """(hour, print) as the last refresh that touched the hour left it."""
    if not exists(spark, f"{saved}/prints"):
        return spark.createDataFrame([], "hour bigint, print string")
    log = spark.read.schema("hour bigint, print string, number bigint").parquet(f"{saved}/prints")
    return log.groupBy("hour").agg(F.max_by("print", "number").alias("print")).filter("print IS NOT NULL")


def refresh(spark: SparkSession, source: str, saved: str, compute: Callable[[DataFrame], DataFrame]) -> Refreshed:
    """Bring the saved parts up to date.  ``compute`` maps rows with their ``hour`` to parts with ``hour``.

    What comes to the driver is numbers of hours and their fingerprints.
    """
    both = fingerprints(spark, source).withColumnRenamed("print", "is").join(saved_prints(spark, saved).withColumnRenamed("print", "was"), "hour", "full")
    changed = both.filter(~F.col("is").eqNullSafe(F.col("was"))).collect()
    stale = sorted(r["hour"] for r in changed if r["is"] is not None)
    gone = sorted(r["hour"] for r in changed if r["is"] is None)
    # Parts of hours that had some, as they may have none any more.
    for hour in sorted(r["hour"] for r in changed if r["was"] is not None):
        removed(spark, f"{saved}/parts/hour={hour}")
    if stale:
        made = compute(spark.read.parquet(source).filter(F.col("hour").isin(stale)))
        made.repartition("hour").write.partitionBy("hour").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{saved}/parts")
    if changed:
        log = f"{saved}/prints"
        number = 1 + (spark.read.parquet(log).agg(F.max("number")).first()[0] if exists(spark, log) else 0)
        spark.createDataFrame([(r["hour"], r["is"], number) for r in changed], "hour bigint, print string, number bigint").repartition(1).write.mode("append").parquet(log)
    return Refreshed(stale, gone)


def parts(spark: SparkSession, saved: str, *, first: int | None = None, last: int | None = None) -> DataFrame:
    """The saved parts of a window of hours; other hours' folders are not opened."""
    df = spark.read.parquet(f"{saved}/parts")
    df = df.filter(F.col("hour") >= first) if first is not None else df
    return df.filter(F.col("hour") <= last) if last is not None else df
