"""Structured Streaming: minute bins with a watermark, late patches, and keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.measures import exact_sum


def file_stream(spark: SparkSession, path: str, *, files_per_trigger: int = 64) -> DataFrame:
    """A stream of a folder of Parquet files, or of one file, with the batch reader's schema."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)


def guard_clock(records: DataFrame, *, us: str, now_us: int, skew_us: int = 120_000_000) -> DataFrame:
    """Records from beyond the allowed skew go; those within it move to now."""
    return records.filter(F.col(us) <= now_us + skew_us).withColumn(us, F.least(F.col(us), F.lit(now_us)))


def minute_bins(stream: DataFrame, *, us: str, cls: str, cost: str, width: str = "1 minute", grace: str = "5 minutes") -> DataFrame:
    """Windowed counts and costs by class, closed ``grace`` after their end."""
    timed = stream.withColumn("_at", F.timestamp_micros(us)).withWatermark("_at", grace)
    return timed.groupBy(F.window("_at", width).alias("w"), F.col(cls).alias("cls")).agg(F.count(F.lit(1)).alias("n"), exact_sum(cost).alias("cost"))


def upsert_bins(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: partial sums of each batch, written under its number, so a replayed batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def partial_bins(batch: DataFrame, *, us: str, cls: str, cost: str, width_us: int) -> DataFrame:
    """Partial sums of a batch that add up over batches: late records only add to their bin."""
    return batch.groupBy(F.floor(F.col(us) / width_us).cast("bigint").alias("bin"), F.col(cls).alias("cls")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(cost).cast("decimal(18,4)")).alias("cost"))


def merged_bins(parts: DataFrame) -> DataFrame:
    return parts.groupBy("bin", "cls").agg(F.sum("n").alias("n"), F.sum("cost").cast("double").alias("cost"))


def running_state(stream: DataFrame, *, key: str, us: str, cost: str, idle_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Running count, cost and last time of each key, kept until event time has passed it by a day."""
    kind = dict(stream.dtypes)[key]
    schema = f"key {kind}, n bigint, cost double, last_us bigint"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total, last = state.get if state.exists else (0, 0.0, 0)
        for f in frames:
            n, total, last = n + len(f), total + float(f["cost"].fillna(0).sum()), max(last, int(f["us"].max()))
        state.update((n, total, last))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"key": [k[0]], "n": [n], "cost": [total], "last_us": [last]})

    own = stream.select(F.col(key).alias("key"), F.col(us).alias("us"), F.col(cost).alias("cost"), F.timestamp_micros(us).alias("at")).withWatermark("at", "1 day")
    return own.groupBy("key").applyInPandasWithState(step, T._parse_datatype_string(schema), "n bigint, cost double, last_us bigint", "update", GroupStateTimeout.EventTimeTimeout)
