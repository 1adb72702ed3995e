"""Readers and writers: day-partitioned JSON lines, Parquet history, accounting exports."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.measures import any_of

_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")


def day_files(spark: SparkSession, root: str, days: set[str] | None = None) -> list[str]:
    """Files under dated folders; where a stream has a plain and a ``.gz`` file, the plain one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, str] = {}
    for folder in fs.listStatus(path):
        day = folder.getPath().getName().removeprefix("day=")
        if not folder.isDirectory() or not _DAY.fullmatch(day) or (days is not None and day not in days):
            continue
        for f in fs.listStatus(folder.getPath()):
            name = f.getPath().toString()
            if name.endswith((".jsonl", ".jsonl.gz")):
                stem = name.removesuffix(".gz")
                if stem not in found or not name.endswith(".gz"):
                    found[stem] = name
    return sorted(found.values())


def read_jsonl(spark: SparkSession, paths: list[str] | str, schema: T.StructType, *, holds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Good records, and the lines that are none (malformed, blank or torn).

    With ``holds``, lines that hold none of these texts are not parsed at all; they must be
    in every line that is wanted, as the writer spells it.
    """
    bad = "_bad_line"
    full = T.StructType([*schema, T.StructField(bad, T.StringType())])
    lines = spark.read.text(paths).filter(F.trim("value") != "")
    if holds:
        lines = lines.filter(any_of([F.col("value").contains(t) for t in holds]))
    parsed = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("r"))
    is_bad = F.col(f"r.{bad}").isNotNull() | F.col("r").isNull() | ~F.trim("value").startswith("{")
    return parsed.filter(~is_bad).select("r.*").drop(bad), parsed.filter(is_bad).select("value")


def write_history(df: DataFrame, path: str, *, ts: str, kind: str | None = None) -> None:
    """Parquet history by day (and record kind), rows in time order within files, zstd."""
    out = df.withColumn("day", F.col(ts).cast("date").cast("string"))
    by = ["day", *([kind] if kind else [])]
    # Ranges of time, not one task a day: a day that outgrows a task is cut.
    out = out.repartitionByRange(*by, ts).sortWithinPartitions(*by, ts)
    out.write.partitionBy(*by).option("compression", "zstd").mode("overwrite").parquet(path)


def read_history(spark: SparkSession, path: str, *, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """History with whole days pruned by folder."""
    df = spark.read.parquet(path)
    if first_day:
        df = df.filter(F.col("day") >= first_day)
    return df.filter(F.col("day") <= last_day) if last_day else df


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, n: rows that one has more often than the other; both 0 on an exact round trip."""
    both = a.withColumn("_side", F.lit(1)).unionByName(b.select(*a.columns).withColumn("_side", F.lit(-1)))
    left = both.groupBy(*a.columns).agg(F.sum("_side").alias("_n"))
    n = lambda sign: F.coalesce(F.sum(F.greatest(F.lit(0), sign * F.col("_n"))), F.lit(0)).alias("n")
    sums = left.agg(F.array(F.struct(F.lit("missing").alias("side"), n(1)), F.struct(F.lit("extra").alias("side"), n(-1))).alias("s"))
    return sums.select(F.explode("s").alias("s")).select("s.*")


def read_accounting(spark: SparkSession, paths: list[str], *, sep: str = "____") -> DataFrame:
    """Accounting exports whose columns may differ; what a file lacks is null."""
    parts = [spark.read.option("header", True).option("sep", sep).csv(p) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_lookup(spark: SparkSession, path: str, *, key: str, take: list[str]) -> DataFrame:
    """A lookup table from CSV with a header; of repeated keys the least row counts."""
    rows = spark.read.option("header", True).csv(path)
    return rows.groupBy(key).agg(F.min(F.struct(*take)).alias("_v")).select(key, "_v.*")


def with_lookup(records: DataFrame, lookup: DataFrame, *, on: str, key: str) -> DataFrame:
    """The records with what the lookup tells, null where it lacks the key; Spark broadcasts it below its own threshold."""
    told = lookup.withColumnRenamed(key, "_key").withColumn("_key", F.col("_key").cast(records.schema[on].dataType))
    return records.join(told, records[on] == told["_key"], "left").drop("_key")


def newest_snapshots(snapshots: DataFrame, *, host: str, ts: str, key: str, n: int = 2) -> DataFrame:
    """The newest n snapshots of each host; of equal times the greater key comes first."""
    from ..operators.live import newest

    return newest(snapshots, by=[host], order=[F.desc(ts), F.desc(key)], n=n)


def feed_status(feeds: DataFrame, *, as_of_us: int, stale_us: int) -> DataFrame:
    """status of each feed from newest_us, files and bad: missing, empty, stale, degraded, ok."""
    status = (
        F.when(F.col("files") == 0, "missing")
        .when(F.col("newest_us").isNull(), "empty")
        .when(F.col("newest_us") < as_of_us - stale_us, "stale")
        .when(F.col("bad") > 0, "degraded")
        .otherwise("ok")
    )
    return feeds.withColumns({"status": status, "lag_us": as_of_us - F.col("newest_us")})


def amplified(df: DataFrame, *, key: str, times: int, step: int) -> DataFrame:
    """Rows repeated with shifted keys, to make a larger feed."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    return df.withColumn("_copy", copies).withColumn(key, F.col(key) + F.col("_copy") * step).drop("_copy")
