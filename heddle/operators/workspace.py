"""Where agents worked: directories rolled up to a few rows, and pieces of tasks merged to a few a day."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import written

# How deep rows go below the anchor; how many a directory may have before the quiet ones fold, and how many it keeps then: right below the anchor, and deeper.
DEPTH, TOP, BELOW = 4, (16, 8), (6, 3)


def rolled_up(dirs: DataFrame, *, by: str, path: str, anchor: str, measures: list[str], activity: Column, depth: int = DEPTH, top: tuple[int, int] = TOP, below: tuple[int, int] = BELOW) -> DataFrame:
    """(by, anchor, path, level, raw, measures): paths cut ``depth`` levels below their anchor, quiet siblings folded into their parents.

    Levels are done from the deepest up, each written: what folds joins its parent, which then
    counts among its own siblings with that activity. ``raw`` counts the paths that a row stands for. Of
    equal activity the first path stays. A directory of very many children is counted and cut by
    aggregates that combine before they shuffle.
    """
    below_anchor = F.substring(F.col("path"), F.length("anchor") + 1, F.length("path"))
    steps = F.filter(F.split(below_anchor, "/"), lambda s: s != "")
    own = dirs.select(F.col(by).alias("by"), F.rtrim(F.col(path), F.lit("/")).alias("path"), F.rtrim(F.col(anchor), F.lit("/")).alias("anchor"), *measures).withColumn("kept", F.slice(steps, 1, depth))
    own = own.withColumn("level", F.size("kept")).withColumn("path", F.when(F.col("level") > 0, F.concat("anchor", F.lit("/"), F.array_join("kept", "/"))).otherwise(F.col("anchor")))
    keys, sums = ["by", "anchor", "path", "level"], lambda raw: [raw.alias("raw"), *(F.sum(m).alias(m) for m in measures)]
    open_rows = written(own.groupBy(*keys).agg(*sums(F.count(F.lit(1)))), "dirs")
    done = []
    for level in range(depth, 0, -1):
        most, keep = top if level == 1 else below
        here = open_rows.filter(F.col("level") == level).withColumn("parent", F.regexp_replace("path", "/[^/]*$", ""))
        n = here.groupBy("by", "anchor", "parent").agg(F.count(F.lit(1)).alias("siblings"))
        busiest = here.withColumn("rank", F.row_number().over(Window.partitionBy("by", "anchor", "parent").orderBy(F.desc(activity), "path"))).filter(F.col("rank") <= most).select("by", "anchor", "path", "rank")
        placed = here.join(n, ["by", "anchor", "parent"]).join(busiest, ["by", "anchor", "path"], "left")
        placed = written(placed.withColumn("stays", (F.col("siblings") <= most) | F.coalesce(F.col("rank") <= keep, F.lit(False))), "placed")
        done.append(placed.filter("stays").select(*keys, "raw", *measures))
        folded = placed.filter("NOT stays").select("by", "anchor", F.col("parent").alias("path"), F.lit(level - 1).alias("level"), "raw", *measures)
        open_rows = written(open_rows.filter(F.col("level") < level).unionByName(folded).groupBy(*keys).agg(*sums(F.sum("raw"))), "dirs")
    for part in done:
        open_rows = open_rows.unionByName(part)
    return open_rows.withColumnRenamed("by", by)


def jaccard(a: set, b: set) -> float:
    """The share of the names in either that are in both; 0 without any."""
    return len(a & b) / len(a | b) if a or b else 0.0


def merged_pieces(days: list[int], stretches: list[int], names: list[set], cap: int) -> list[int]:
    """Of each piece, in order, the first piece of the one it ends up in.

    While a day holds more than ``cap`` pieces, its two neighbours most alike become one. Neighbours lie in one
    stretch, the later on the full day and the earlier on that day or the one before; of equal
    likeness a pair within the day goes first, then the earlier. The pairs wait in a heap; an entry
    whose pieces have changed since is passed over.
    """
    n = len(days)
    held: dict[int, int] = {}
    for d in days:
        held[d] = held.get(d, 0) + 1
    own = [set(x) for x in names]
    after, before, head, made = [*range(1, n), -1][:n], list(range(-1, n - 1)), list(range(n)), [0] * n
    heap: list[tuple] = []

    def push(a: int, b: int) -> None:
        if a >= 0 and b >= 0 and stretches[a] == stretches[b] and held[days[b]] > cap and days[a] in (days[b], days[b] - 1):
            heapq.heappush(heap, (-jaccard(own[a], own[b]), days[a] != days[b], a, b, made[a], made[b]))

    for b in range(1, n):
        push(b - 1, b)
    while heap:
        _, _, a, b, made_a, made_b = heapq.heappop(heap)
        if head[b] != b or head[a] != a or (made[a], made[b]) != (made_a, made_b) or held[days[b]] <= cap:
            continue
        if len(own[a]) < len(own[b]):
            own[a], own[b] = own[b], own[a]
        own[a] |= own[b]
        head[b], held[days[b]], made[a] = a, held[days[b]] - 1, made[a] + 1
        after[a] = after[b]
        if after[a] >= 0:
            before[after[a]] = a
        push(before[a], a)
        push(a, after[a])
    for i in range(n):
        head[i] = head[head[i]]  # heads lie to the left and are settled
    return head


def merged_tasks(pieces: DataFrame, *, by: str, at: str, day: str, stretch: str, names: str, cap: int = 10) -> DataFrame:
    """(by, at, task_at): each piece with the start of the task it becomes part of.

    A piece is a row that stands for its calls, so a session's pieces are few; sessions are dealt over tasks.
    """
    own = pieces.select(F.col(by).alias("grp"), F.col(at).alias("at"), F.col(day).cast("bigint").alias("day"), F.col(stretch).cast("bigint").alias("stretch"), F.col(names).alias("names"))

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at", kind="stable").reset_index(drop=True)
        head = merged_pieces(part["day"].tolist(), part["stretch"].tolist(), [set(x) if x is not None else set() for x in part["names"]], cap)
        return pd.DataFrame({"grp": part["grp"], "at": part["at"], "task_at": part["at"].iloc[head].to_numpy()})

    kinds = dict(own.dtypes)
    return own.groupBy("grp").applyInPandas(merge, f"grp {kinds['grp']}, at {kinds['at']}, task_at {kinds['at']}")
