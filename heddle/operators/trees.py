"""Process trees: an index of processes, what happens below a wrapper, parents by evidence, a budget of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import written
from .lineage import closure


def process_index(records: DataFrame, *, host: str, pid: str, parent: str, at: str, key: str, take: list[str], wanted: Column, hops: int = 8) -> DataFrame:
    """First-seen facts of each wanted process and of the ancestors that lead up from it, up to ``hops``."""
    facts = F.min_by(F.struct(F.col(parent).alias("parent"), *take), F.struct(at, key))
    known = records.groupBy(F.col(host).alias("host"), F.col(pid).alias("pid")).agg(facts.alias("f"), F.max(wanted.cast("int")).alias("tagged"))
    known = written(known.select("host", "pid", "f.*", (F.col("tagged") == 1).alias("tagged")), "known")
    levels = [known.filter("tagged")]
    for _ in range(hops):  # each level is written, so a hop is one join whatever their number
        up = levels[-1].select("host", F.col("parent").alias("pid")).distinct()
        levels.append(written(known.join(up, ["host", "pid"], "left_semi").filter("NOT tagged"), "hop"))
        if levels[-1].isEmpty():
            break
    return reduce(DataFrame.unionByName, levels).distinct()


def wrapper_outcomes(records: DataFrame, *, key: str, parent: str, wrapper: Column, isolated: Column, unknown: Column, code: Column, signal: Column, depth: int = 4) -> DataFrame:
    """Of each wrapper: isolated, not_isolated, unknown, failed or no_payload, from itself and all below it.

    Isolated where itself or anything below is. Else a payload that ran decides, before any exit code: what
    runs below a wrapper and is none was not isolated, or one cannot tell where the state of any is
    ``unknown``. Without payload the wrapper's own end tells: failed by a signal or a code other than 0,
    no payload by code 0, unknown without a code.
    """
    own = records.select(F.col(key).alias("key"), F.when(F.col(parent) != F.col(key), F.col(parent)).alias("parent"), wrapper.alias("w"), isolated.alias("i"), unknown.alias("u"), code.alias("code"), signal.alias("sig"))
    below = closure(own.select("key", "parent"), key="key", parent="parent", depth=depth)
    facts = below.join(own.select("key", "w", "i", "u"), "key").withColumn("p", (F.col("key") != F.col("root")) & ~F.col("w"))
    facts = facts.groupBy("root").agg(F.bool_or("i").alias("any_i"), F.bool_or("p").alias("payload"), F.bool_or(F.col("p") & F.coalesce("u", F.lit(False))).alias("any_u"))
    out = own.filter("w").join(facts, F.col("key") == F.col("root"))
    failed = (F.coalesce("sig", F.lit(0)) != 0) | (F.coalesce("code", F.lit(0)) != 0)
    outcome = F.when(F.col("any_i"), "isolated").when(F.col("payload"), F.when(F.col("any_u"), "unknown").otherwise("not_isolated")).when(failed, "failed").when(F.col("code") == 0, "no_payload").otherwise("unknown")
    return out.select("key", outcome.alias("outcome"))


def session_verdicts(outcomes: DataFrame, *, by: str, outcome: str = "outcome") -> DataFrame:
    """sandboxed, partial, failed, unsandboxed, unknown or no_calls of each session, by how its calls came out."""
    n = lambda *names: F.count_if(F.col(outcome).isin(*names))
    sums = outcomes.groupBy(by).agg(n("isolated").alias("isolated"), n("not_isolated").alias("open"), n("failed").alias("failed"), n("unknown").alias("unknown"))
    known = F.col("isolated") + F.col("open") + F.col("failed")
    verdict = (
        F.when((known > 0) & (F.col("isolated") == known), "sandboxed")
        .when(F.col("isolated") > 0, "partial")
        .when(F.col("failed") > 0, "failed")
        .when(known > 0, "unsandboxed")
        .when(F.col("unknown") > 0, "unknown")
        .otherwise("no_calls")
    )
    return sums.withColumn("verdict", verdict)


def parents_by_evidence(nodes: DataFrame, evidence: list[DataFrame], *, key: str) -> DataFrame:
    """(key, parent, via): the first piece of evidence, in the order given, that names a parent other than the node itself.

    Each piece is (key, parent, via).  A link whose parent has the node as its own parent is a
    cycle: of the two, the node with the smaller key becomes a root.
    """
    ranked = reduce(DataFrame.unionByName, [e.select(key, "parent", "via", F.lit(i).alias("_rank")) for i, e in enumerate(evidence)])
    best = ranked.filter(F.col("parent").isNotNull() & (F.col("parent") != F.col(key))).groupBy(key).agg(F.min_by(F.struct("parent", "via"), F.struct("_rank", "parent")).alias("p"))
    found = nodes.select(key).join(best, key, "left").select(key, "p.parent", "p.via")
    other = found.select(F.col(key).alias("_k"), F.col("parent").alias("_p"))
    met = found.join(other, F.col("parent") == F.col("_k"), "left")
    cycle = F.coalesce((F.col("_p") == F.col(key)) & (F.col(key) < F.col("parent")), F.lit(False))
    return met.select(key, F.when(~cycle, F.col("parent")).alias("parent"), F.coalesce(F.when(cycle, F.lit("cycle")), F.col("via"), F.lit("root")).alias("via"))


def budget_cut(nodes: DataFrame, *, tree: str, key: str, depth: str, at: str, budget: int) -> DataFrame:
    """The nodes of each tree that fit its budget, breadth first, and how many more there are."""
    w = Window.partitionBy(tree).orderBy(depth, at, key)
    placed = nodes.withColumns({"place": F.row_number().over(w), "_all": F.count(F.lit(1)).over(Window.partitionBy(tree))})
    return placed.filter(F.col("place") <= budget).withColumn("more", F.greatest(F.lit(0), F.col("_all") - budget).cast("bigint")).drop("_all")
