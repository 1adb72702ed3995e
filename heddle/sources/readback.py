"""The newest rows of a history, without opening older days.

Days are tried newest first, twice as many each time, until they hold enough rows; then
those days alone are read and sorted.  A page goes on where the one before ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import folders


def history_days(spark: SparkSession, history: str) -> list[str]:
    """The days that have a folder, oldest first."""
    return sorted(name.removeprefix("day=") for name in folders(spark, history) if name.startswith("day="))


def newest_rows(spark: SparkSession, history: str, n: int, *, at: str, key: str, where: Column | None = None, before: tuple | None = None) -> DataFrame:
    """The n newest rows, by ``at`` and then ``key``, that ``where`` admits.

    ``before`` is the (at, key) of a row: what follows it, newest first, is the next page.
    """
    days = history_days(spark, history)
    held = spark.read.option("basePath", history)
    wanted = F.lit(True) if where is None else where
    if before is not None:
        last_at, last_key = F.lit(before[0]), F.lit(before[1])
        wanted = wanted & ((F.col(at) < last_at) | ((F.col(at) == last_at) & (F.col(key) < last_key)))
        days = [d for d in days if d <= str(before[0])[:10]]
    first, step, found = len(days), 1, 0
    while first > 0 and found < n:
        upto, first = first, max(0, first - step)
        found += held.parquet(*(f"{history}/day={d}" for d in days[first:upto])).filter(wanted).count()
        step *= 2
    if not days:
        return spark.read.parquet(history).limit(0)
    rows = held.parquet(*(f"{history}/day={d}" for d in days[first:]))
    return rows.filter(wanted).orderBy(F.desc(at), F.desc(key)).limit(n)
