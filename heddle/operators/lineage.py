"""Parents and children: own costs, owners, folds, closures and as-of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import written


def own_cost(parents: DataFrame, children: DataFrame, *, key: str, parent: str, cost: str, child_cost: str, accept: Column | None = None) -> DataFrame:
    """Each parent's cost without what its children carried, never under 0; clamped rows are flagged.

    ``accept`` is a condition on parent columns and children's columns prefixed
    with ``c_``; rejected children are counted and subtract nothing.
    """
    c = children.select(*(F.col(x).alias(f"c_{x}") for x in children.columns))
    both = parents.select(key, *[x for x in parents.columns if x != key]).join(c, F.col(key) == F.col(f"c_{parent}"), "left")
    ok = F.col(f"c_{parent}").isNotNull() & (accept if accept is not None else F.lit(True))
    taken = F.sum(F.when(ok, F.col(f"c_{child_cost}").cast("decimal(18,4)")))
    sums = both.groupBy(key).agg(
        F.first(F.col(cost).cast("decimal(18,4)")).alias("_whole"), F.coalesce(taken, F.lit(0)).alias("_held"),
        F.count_if(ok).alias("children"), F.count_if(F.col(f"c_{parent}").isNotNull() & ~ok).alias("rejected"),
    )
    left = F.col("_whole") - F.col("_held")
    return sums.select(key, F.greatest(F.lit(0), left).cast("double").alias("own"), F.col("_held").cast("double").alias("held"), "children", "rejected", (left < 0).alias("clamped"))


def without_wrappers(records: DataFrame, *, key: str, parent: str, session: str, token: str, wrapper: Column) -> DataFrame:
    """Records without those wrappers of which a child in the same session bears the same token."""
    child = records.select(F.col(parent).alias("_p"), F.col(session).alias("_s"), F.col(token).alias("_t")).distinct()
    match = (F.col(key) == F.col("_p")) & (F.col(session) == F.col("_s")) & (F.col(token) == F.col("_t")) & wrapper
    return records.join(child, match, "left_anti")


def owners(records: DataFrame, *, key: str, parent: str, is_owner: Column, hops: int = 64, link: Column | None = None) -> DataFrame:
    """(key, owner, hops, provenance): the nearest owner up the chain of parents.

    Pointers double, so a chain of 64 takes seven joins; each round is written
    (else the plan would double too), and rounds end when no chain goes on.
    ``link`` can refuse a step (parent's columns prefixed with ``p_``).
    Provenance is ``self``, ``parent``, ``ancestor``, or ``unknown`` without owner.
    """
    if link is None:
        own = records.select(F.col(key).alias("key"), F.col(parent).alias("up"), is_owner.alias("own"))
    else:
        p = records.select(*(F.col(c).alias(f"p_{c}") for c in records.columns))
        own = records.join(p, F.col(parent) == F.col(f"p_{key}"), "left").select(F.col(key).alias("key"), F.when(link, F.col(parent)).alias("up"), is_owner.alias("own"))
    state = own.select("key", F.when(F.col("own"), F.col("key")).alias("owner"), F.lit(0).alias("n"), F.when(~F.col("own"), F.col("up")).alias("next"), F.lit(1).alias("reach"))
    done = 1
    while done <= hops:
        up = state.select(F.col("key").alias("_k"), F.col("owner").alias("_owner"), F.col("n").alias("_n"), F.col("next").alias("_next"), F.col("reach").alias("_reach"))
        joined = state.join(up, F.col("next") == F.col("_k"), "left")
        state = joined.select(
            "key",
            F.coalesce("owner", "_owner").alias("owner"),
            F.when(F.col("owner").isNull() & F.col("_owner").isNotNull(), F.col("reach") + F.col("_n")).otherwise(F.col("n")).alias("n"),
            F.when(F.col("owner").isNull() & F.col("_owner").isNull(), F.col("_next")).alias("next"),
            (F.col("reach") + F.coalesce("_reach", F.lit(0))).alias("reach"),
        )
        state = written(state, "owners")
        done *= 2
        if state.filter("next IS NOT NULL").isEmpty():
            break
    within = F.col("owner").isNotNull() & (F.col("n") <= hops)
    how = F.when(~within, "unknown").when(F.col("n") == 0, "self").when(F.col("n") == 1, "parent").otherwise("ancestor")
    return state.select("key", F.when(within, F.col("owner")).alias("owner"), F.when(within, F.col("n")).cast("bigint").alias("hops"), how.alias("provenance"))


def fold(records: DataFrame, owner_of: DataFrame, *, key: str, measures: list[Column]) -> DataFrame:
    """Measures of the records by owner; those without one under their own key."""
    own = records.join(owner_of.select(F.col("key").alias(key), "owner"), key, "left")
    return own.groupBy(F.coalesce("owner", key).alias("session")).agg(*measures)


def closure(edges: DataFrame, *, key: str, parent: str, depth: int) -> DataFrame:
    """(root, key, depth) of all nodes under each node, itself included, to a depth."""
    base = edges.select(F.col(key).alias("root"), F.col(key).alias("key"), F.lit(0).alias("depth"))
    levels, step = [base], base
    down = edges.select(F.col(key).alias("_child"), F.col(parent).alias("_up"))
    for d in range(1, depth + 1):  # each level is written: one join a level
        step = written(step.join(down, F.col("key") == F.col("_up")).select("root", F.col("_child").alias("key"), F.lit(d).alias("depth")), "level")
        levels.append(step)
    return reduce(DataFrame.unionByName, levels)


def as_of(left: DataFrame, right: DataFrame, *, by: list[str], left_at: str, right_at: str, take: list[str], key: str, stretch: int | None = None) -> DataFrame:
    """Of each left row the latest right row at or before it, by union and a running last value: one shuffle, no range join.

    With ``stretch`` (times are then numbers), few values of ``by`` don't make large tasks: time is cut into stretches,
    and each is given the last right row before it, from the last ones of all stretches.
    """
    values = F.struct(F.col(right_at).alias("_at"), *take)
    r = right.select(*by, F.col(right_at).alias("_t"), F.lit(0).alias("_side"), F.col(key).alias("_k"), values.alias("_v"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"))
    left_rows = left.select(*by, F.col(left_at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(dict(right.dtypes)[key]).alias("_k"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), F.struct(*left.columns).alias("_row"))
    w = Window.partitionBy(*by).orderBy("_t", "_side", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = r.unionByName(left_rows)
    if stretch:
        rows = rows.withColumn("_s", F.floor(F.col("_t") / F.lit(stretch)))
        mine = F.col("_side") == 0
        ends = rows.groupBy(*by, "_s").agg(F.max(F.when(mine, F.struct(F.col("_t"), F.col("_k"), F.col("_v")))).alias("_end"))
        earlier = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*by, "_s", F.last("_end._v", ignorenulls=True).over(earlier).alias("_v")).filter("_v IS NOT NULL")
        # Before all rows of its stretch: times sort nulls first.
        typed = {f.name: f.dataType for f in rows.schema}
        rows = rows.unionByName(carried.select(*by, "_s", "_v", F.lit(-1).alias("_side"), *(F.lit(None).cast(typed[c]).alias(c) for c in ("_t", "_k", "_row"))))
        w = Window.partitionBy(*by, "_s").orderBy("_t", "_side", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.withColumn("_held", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return both.select("_row.*", F.col("_held._at").alias("held_at"), *(F.col(f"_held.{c}").alias(f"held_{c}") for c in take))
