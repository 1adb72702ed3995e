"""Children that wait for their parents: a stateful join whose state ages.

A process ends before its parent does, so a child's record waits for the first record
of its parent at or after it.  One that waits longer than ``wait`` of event time is
given up and counted.  State is kept by key, in a processor with event-time timers:
nothing outlives the wait, whatever arrives.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HOUR_MS = 3_600_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


CHUNK = 1 << 16  # rows of a piece of state at most


class Waiting(StatefulProcessor):
    """Of one key: children that wait, parents whose time the watermark hasn't passed.

    A parent takes the children at or before it, once the watermark has passed it: no
    earlier parent can then come.  Rows are held as arrays in few pieces, and a key has one timer,
    at the first time that any of its rows is due: a batch reads a key's rows once, however many are due.
    """

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("held", "is_parent binary, id binary, ms binary")
        self.due = handle.getValueState("due", "ms bigint")

    def pieces(self, is_parent: np.ndarray, ids: np.ndarray, ms: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
        return [tuple(x[a : a + CHUNK].tobytes() for x in (is_parent, ids, ms)) for a in range(0, len(ms), CHUNK)]

    def first_due(self, is_parent: np.ndarray, ms: np.ndarray) -> int:
        return int((ms + np.where(is_parent, 0, self.wait_ms)).min())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due = []
        for frame in rows:
            is_parent, ids, ms = frame["is_parent"].astype(bool).to_numpy(), frame["id"].astype("int64").to_numpy(), frame["ms"].astype("int64").to_numpy()
            if len(ms):
                self.rows.appendList(self.pieces(is_parent, ids, ms))
                due.append(self.first_due(is_parent, ms))
        before = self.due.get()
        if due and (before is None or min(due) < before[0]):
            if before is not None:
                self.handle.deleteTimer(before[0])
            self.handle.registerTimer(min(due))
            self.due.update((min(due),))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = list(self.rows.get())
        is_parent, ids, ms = (np.concatenate([np.frombuffer(piece[i], kind) for piece in held]) for i, kind in enumerate((bool, np.int64, np.int64)))
        order = np.lexsort((ids, ms))
        is_parent, ids, ms = is_parent[order], ids[order], ms[order]
        passed = is_parent & (ms <= now)
        parent_ids, parent_ms = ids[passed], ms[passed]
        at = np.searchsorted(parent_ms, ms)  # the first that passed at or after each row
        next_ids, next_ms = (np.append(x, 0)[at] for x in (parent_ids, parent_ms))
        found = ~is_parent & (at < len(parent_ms)) & (next_ms <= ms + self.wait_ms)
        done = found | (~is_parent & (ms + self.wait_ms <= now))
        left = ~done & ~passed
        if left.any():
            self.rows.put(self.pieces(is_parent[left], ids[left], ms[left]))
            due = self.first_due(is_parent[left], ms[left])
            self.handle.registerTimer(due)
            self.due.update((due,))
        else:
            self.rows.clear()
            self.due.clear()
        if done.any():
            parent, waited = (pd.array(x[done], "Int64") for x in (next_ids, next_ms - ms))
            parent[~found[done]] = waited[~found[done]] = pd.NA
            yield pd.DataFrame({"child": pd.array(ids[done], "Int64"), "parent": parent, "waited_ms": waited})

    def close(self) -> None:
        pass


OUT = "child bigint, parent bigint, waited_ms bigint"


def keep_state_on_disk(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def waiting_join(stream: DataFrame, *, key: list[str], is_parent: str, row_id: str, at: str, wait_ms: int = 24 * HOUR_MS, late: str = "1 hour") -> DataFrame:
    """(child, parent, waited_ms) of each child that found its parent, or with null parent was given up.

    ``at`` is a timestamp; rows more than ``late`` behind the newest are dropped by the watermark.
    """
    keep_state_on_disk(stream.sparkSession)
    rows = stream.select(*key, F.col(is_parent).alias("is_parent"), F.col(row_id).alias("id"), F.unix_millis(at).alias("ms"), F.col(at).alias("_at")).withWatermark("_at", late)
    return rows.groupBy(*key).transformWithStateInPandas(Waiting(wait_ms), OUT, "append", "eventTime")


def waited(records: DataFrame, *, key: list[str], is_parent: str, row_id: str, at: str, wait_ms: int = 24 * HOUR_MS) -> DataFrame:
    """The same over all records at once: the next parent at or after each child, if it came in time.

    Time is cut into stretches of the wait, so that a child's parent stands in its stretch or the next; parents
    are written to both.  A task then sorts the stretches of keys, however few keys there are, and looks
    back over each once.
    """
    stretch = F.floor(F.col("ms") / F.lit(max(1, wait_ms)))
    rows = records.select(*key, F.col(is_parent).alias("is_parent"), F.col(row_id).alias("id"), F.unix_millis(at).alias("ms"))
    rows = rows.withColumn("_stretch", F.explode(F.when(F.col("is_parent"), F.array(stretch, stretch - 1)).otherwise(F.array(stretch))))
    # From the last row back: of equal times the parents come first, of them the smaller id last.
    after = Window.partitionBy(*key, "_stretch").orderBy(F.desc("ms"), F.desc("is_parent"), F.desc("id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parent = F.when(F.col("is_parent"), F.struct("id", "ms"))
    found = rows.withColumn("p", F.last(parent, ignorenulls=True).over(after)).filter(~F.col("is_parent"))
    in_time = F.col("p.ms") <= F.col("ms") + wait_ms
    return found.select(F.col("id").alias("child"), F.when(in_time, F.col("p.id")).alias("parent"), F.when(in_time, F.col("p.ms") - F.col("ms")).alias("waited_ms"))
