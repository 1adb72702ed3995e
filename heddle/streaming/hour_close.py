"""Hours that close as time passes, and what becomes of rows that come after.

The mark is the latest event time of all earlier batches.  An hour is closed once it ended
``grace`` before the mark.  A row of a closed hour is a patch to it, or is dropped (and counted) if its hour
ended more than ``horizon`` before the mark.  Every batch writes its sums and its mark
under its number, so a batch that is replayed writes the same again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import exists

HOUR_US = 3_600_000_000
KINDS = ("on_time", "patch", "dropped")


def mark_before(spark: SparkSession, path: str, number: int) -> int | None:
    """The latest event time of the batches before this one."""
    if not exists(spark, f"{path}/marks"):
        return None
    return spark.read.parquet(f"{path}/marks").filter(F.col("batch") < number).agg(F.max("mark")).first()[0]


def closing(path: str, *, us: str, cls: str, cost: str, grace_us: int, horizon_us: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: sums by hour, class and kind, and the batch's mark."""

    def write(batch: DataFrame, number: int) -> None:
        mark = mark_before(batch.sparkSession, path, number)
        hour = F.floor(F.col(us) / HOUR_US).cast("bigint")
        end = (hour + 1) * HOUR_US
        kind = F.lit("on_time") if mark is None else F.when(end > mark - grace_us, "on_time").when(end > mark - horizon_us, "patch").otherwise("dropped")
        sums = batch.groupBy(hour.alias("hour"), F.col(cls).alias("cls"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(cost).cast("decimal(18,4)")).alias("cost"), F.max(us).alias("last"))
        sums.write.mode("overwrite").parquet(f"{path}/sums/batch={number}")
        # A batch of late rows alone doesn't move the mark back: readers take the greatest.
        batch.sparkSession.read.parquet(f"{path}/sums/batch={number}").agg(F.max("last").alias("mark")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    return write


def closed_hours(spark: SparkSession, path: str, *, grace_us: int) -> DataFrame:
    """(hour, cls, n, cost, patched, dropped) of the hours closed by now; n and cost hold the patches, not what was dropped."""
    mark = spark.read.parquet(f"{path}/marks").agg(F.max("mark").alias("mark"))
    sums = spark.read.parquet(f"{path}/sums").join(F.broadcast(mark)).filter((F.col("hour") + 1) * HOUR_US <= F.col("mark") - grace_us)
    held = F.col("kind") != "dropped"
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    out = sums.groupBy("hour", "cls").agg(F.coalesce(F.sum(F.when(held, F.col("n"))), F.lit(0)).alias("n"), F.sum(F.when(held, F.col("cost"))).cast("double").alias("cost"), of("patch").alias("patched"), of("dropped").alias("dropped"))
    return out
