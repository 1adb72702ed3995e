"""Panels: resources and stalls by class, hosts, command lines, phases, tiers of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measures import exact_sum, pct

RUN_SLACK, RUN_EXTRA = 1.05, 0.001  # a process cannot have run for longer than it lived


def resources_by_class(records: DataFrame, *, cls: str, run: str, duration: str, waits: list[str]) -> DataFrame:
    """Share of life on the processor, without records that ran longer than they lived (counted); waits with their coverage."""
    known = F.col(run).isNotNull() & F.col(duration).isNotNull()
    odd = known & (F.col(run) > F.col(duration) * RUN_SLACK + RUN_EXTRA)
    kept = known & ~odd
    measures = [
        F.count(F.lit(1)).alias("n"),
        F.count_if(odd).alias("excluded"),
        exact_sum(F.when(kept, F.col(run))).alias("run"),
        pct(exact_sum(F.when(kept, F.col(run))), exact_sum(F.when(kept, F.col(duration)))).alias("on_cpu_pct"),
    ]
    for w in waits:
        measures += [exact_sum(F.col(w)).alias(f"{w}_sum"), pct(F.count(w), F.count(F.lit(1))).alias(f"{w}_coverage_pct")]
    return records.groupBy(F.col(cls).alias("cls")).agg(*measures)


def on_cpu(run: Column, duration: Column) -> Column:
    """The share of its life that a process ran, at most 1; null where not told, or where it ran longer than it lived."""
    odd = run > duration * RUN_SLACK + RUN_EXTRA
    return F.when((duration > 0) & ~odd, F.least(F.lit(1.0), run / duration))


def stalls_by_class(records: DataFrame, *, cls: str, wait: str, episodes: str, longest: str, source: str) -> DataFrame:
    """Of each class: records that told a wait, those that stalled, sums, the longest single wait, and how waits were measured."""
    sources = records.filter(F.col(source).isNotNull()).groupBy(F.col(cls).alias("cls"), F.col(source).alias("s")).agg(F.count(F.lit(1)).alias("k"))
    named = sources.groupBy("cls").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "s", "k"))), ",").alias("sources"))
    sums = records.groupBy(F.col(cls).alias("cls")).agg(
        F.count(F.lit(1)).alias("seen"), F.count(wait).alias("n"), pct(F.count(wait), F.count(F.lit(1))).alias("coverage_pct"), F.count_if(F.col(wait) > 0).alias("stalled"),
        exact_sum(wait).alias("wait"), F.sum(episodes).alias("episodes"), F.coalesce(F.max(longest), F.lit(0.0)).alias("longest"),
    )
    return sums.join(named.withColumnRenamed("cls", "_c"), F.col("cls").eqNullSafe(F.col("_c")), "left").drop("_c").withColumn("sources", F.coalesce("sources", F.lit("")))


def stalls_by_tool(records: DataFrame, *, tool: str, wait: str, n: int = 20) -> DataFrame:
    """The tools that waited longest, with their longest single wait; tools that never told are left out."""
    sums = records.groupBy(F.col(tool).alias("tool")).agg(F.count(wait).alias("n"), exact_sum(F.col(wait)).alias("total"), F.max(wait).alias("most"))
    return sums.filter("n > 0").orderBy(F.desc("total"), "tool").limit(n)


def worst(records: DataFrame, *, measures: list[str], key: str, n: int = 12) -> DataFrame:
    """(measure, rank, key, value): the records with the highest of each measure, from one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures)))
    each = records.select(F.col(key).alias("key"), pairs.alias("p")).select("key", "p.*").filter("value IS NOT NULL")
    w = Window.partitionBy("measure").orderBy(F.desc("value"), "key")
    return each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def host_table(ticks: DataFrame, *, host: str, at: str, key: str, cls: str, measures: list[str]) -> DataFrame:
    """A row a host: its newest tick, and its records by class with null-aware sums (null where no class told)."""
    newest = ticks.groupBy(F.col(host).alias("host")).agg(
        F.max_by(F.struct(F.col(at).alias("at"), F.col(key).alias("key"), F.col(cls).alias("cls")), F.struct(at, key)).alias("t"),
        F.count(F.lit(1)).alias("ticks"),
        F.count_distinct(cls).alias("classes"),
        *(exact_sum(F.col(m)).alias(m) for m in measures),
    )
    return newest.select("host", F.col("t.at").alias("last_at"), F.col("t.key").alias("last_key"), F.col("t.cls").alias("last_cls"), "ticks", "classes", *measures)


def command_lines(records: DataFrame, *, line: Column, user: str, at: str, measures: list[str], order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of all distinct command lines: count, users, first and last, sums."""
    sums = records.groupBy(line.alias("line")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(user).alias("users"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), *(exact_sum(F.col(m)).alias(m) for m in measures))
    return sums.orderBy(*order).offset(offset).limit(limit)


def tool_calls(records: DataFrame, *, tree: str, line: str, at: str, key: str, cwd: str, cap: int = 400) -> DataFrame:
    """Of each tree: its distinct command lines in the order of their first start, with the first folder, up to the cap."""
    first = records.groupBy(F.col(tree).alias("tree"), F.col(line).alias("line")).agg(F.min(F.struct(F.col(at).alias("at"), F.col(key).alias("key"), F.col(cwd).alias("cwd"))).alias("f"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("tree").orderBy("f.at", "f.key")
    return first.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= cap).select("tree", "place", "line", F.col("f.cwd").alias("cwd"), F.col("f.at").alias("at"), "n")


def requested_hours(jobs: DataFrame, *, by: str, units: Column, limit_s: Column, at: Column, since: Column, until: Column) -> DataFrame:
    """Units times the time limit in hours of jobs in the window that tell both, and how many do not."""
    inside = jobs.filter((at >= since) & (at < until)).withColumns({"_u": units, "_l": limit_s})
    known = F.col("_u").isNotNull() & F.col("_l").isNotNull()
    return inside.groupBy(F.col(by).alias("grp")).agg(exact_sum(F.when(known, F.col("_u") * F.col("_l") / 3600)).alias("hours"), F.count_if(known).alias("known"), F.count_if(~known).alias("unknown"))


def snapshots_once(snapshots: DataFrame, *, by: list[str]) -> DataFrame:
    """Snapshots that were read again are kept once; for streams too."""
    return snapshots.dropDuplicates(by)


def two_tiers(counts: DataFrame, *, at: str, n: str, now: int, fine: int, coarse: int, keep: int) -> DataFrame:
    """Sums by bins of ``fine`` within ``keep`` of now, by bins of ``coarse`` before; no bin is in both tiers."""
    edge = (now - keep) // coarse * coarse
    size = F.when(F.col(at) >= edge, F.lit(fine)).otherwise(F.lit(coarse))
    binned = counts.select((F.col(at) - F.pmod(F.col(at), size)).alias("bin"), size.alias("size"), F.col(n).alias("n"))
    return binned.groupBy("bin", "size").agg(F.sum("n").alias("n"))


def joined_runs(left: DataFrame, right: DataFrame, *, by: str, token: str = "token") -> DataFrame:
    """Runs of two stretches of time: the last run of the first and the first of the second are one if they hold one token."""
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(by).orderBy("_side", "run")
    same = (F.lag("_side").over(w) < F.col("_side")) & F.lag(token).over(w).eqNullSafe(F.col(token))
    numbered = both.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w).cast("bigint"))
    return numbered.groupBy(by, F.col("_run").alias("run")).agg(F.first(token).alias(token), F.sum("length").alias("length"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))


def rework_loops(calls: DataFrame, *, by: str, order: list[str], edit: Column, run: Column, reading: Column, least: int = 2) -> DataFrame:
    """(grp, first, last, command, rounds, calls): stretches that repeat one command, each round after an edit.

    ``run`` is the command of a test or run, else null. Between two runs of a loop lie edits, at least one,
    and reading alone; another command, or anything else, ends it. ``first`` and ``last`` are places in the
    sequence, and ``calls`` counts all that lie between.
    """
    w = Window.partitionBy("grp").orderBy(*order)
    own = calls.select(F.col(by).alias("grp"), *order, F.coalesce(edit, F.lit(False)).alias("edit"), run.alias("command"), F.coalesce(reading, F.lit(False)).alias("reading")).withColumn("at", F.row_number().over(w))
    edits = own.filter("NOT reading OR edit").withColumn("edits", F.sum(F.col("edit").cast("int")).over(w))
    # What is left after edits: runs, and all that ends a loop.
    v = Window.partitionBy("grp").orderBy("at")
    stops = edits.filter("NOT edit").withColumns({"was": F.lag("command").over(v), "before": F.lag("edits").over(v)})
    goes_on = F.coalesce((F.col("command") == F.col("was")) & (F.col("edits") > F.col("before")), F.lit(False))
    chains = stops.withColumn("on", goes_on).withColumn("chain", F.sum((~F.col("on")).cast("int")).over(v)).filter("command IS NOT NULL")
    loops = chains.groupBy("grp", "chain").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.min("command").alias("command"), F.count_if("on").alias("rounds"))
    return loops.filter(F.col("rounds") >= least).select("grp", "first", "last", "command", "rounds", (F.col("last") - F.col("first") + 1).alias("calls"))


def session_use(records: DataFrame, *, by: str, category: str, spent: Column, most: float = 0.5, also: float = 0.1) -> DataFrame:
    """What a session was for: the category with half its time or more, else ``mixed``; others above a tenth, by share."""
    sums = records.groupBy(F.col(by).alias("grp"), F.col(category).alias("category")).agg(F.sum(spent.cast("decimal(18,4)")).alias("s"))
    sums = sums.withColumn("total", F.sum("s").over(Window.partitionBy("grp")))
    share = F.when(F.col("total") > 0, F.round(F.col("s").cast("double") / F.col("total").cast("double"), 4)).otherwise(F.lit(0.0))
    sums = sums.withColumn("share", share)
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("share")).alias("r"), "category")))
    out = sums.groupBy("grp").agg(ranked.alias("x"), F.max("total").cast("double").alias("spent"))
    top = F.col("x")[0]
    chief = F.when((F.col("spent") > 0) & (-top["r"] >= most), top["category"]).otherwise("mixed")
    other = F.array_join(F.transform(F.filter("x", lambda c: (-c["r"] >= also) & (c["category"] != F.col("chief"))), lambda c: c["category"]), ", ")
    return out.withColumn("chief", chief).select("grp", "chief", other.alias("also"), "spent")


def placed_in_phases(calls: DataFrame, phases: DataFrame, *, by: str, at: str, start: str = "start_us", end: str = "end_us") -> DataFrame:
    """Each call with the phase that began last before it and had not ended, or none (phases of one sequence do not overlap)."""
    marks = phases.select(F.col(by), F.col(start).alias("_at"), F.struct(F.col("phase"), F.col(end).alias("end")).alias("_p"), F.lit(0).alias("_kind"))
    own = calls.withColumns({"_at": F.col(at), "_kind": F.lit(1)})
    both = own.unionByName(marks, allowMissingColumns=True)
    last = F.last("_p", ignorenulls=True).over(Window.partitionBy(by).orderBy("_at", "_kind"))
    out = both.withColumn("_last", last).filter("_kind = 1")
    return out.withColumn("phase", F.when(F.col(at) <= F.col("_last.end"), F.col("_last.phase"))).drop("_at", "_kind", "_p", "_last")


def residency(ticks: DataFrame, *, host: str, root: str, session: str, at: str, rss: str) -> DataFrame:
    """Of each tree root the state of its newest session alone: memory peak, mean and count of ticks, first and last tick.

    A root that is used again has another session; ticks of earlier ones do not count.
    """
    w = Window.partitionBy(host, root)
    newest = F.max_by(F.col(session), F.struct(at, session)).over(w)
    now = ticks.withColumn("_s", newest).filter(F.col(session).eqNullSafe(F.col("_s")))
    sums = exact_sum(F.col(rss)) / F.count(rss)
    return now.groupBy(F.col(host).alias("host"), F.col(root).alias("root")).agg(F.max(session).alias("session"), F.max(rss).alias("rss_peak"), F.round(sums, 4).alias("rss_mean"), F.count(rss).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def live_roots(records: DataFrame, *, host: str, pid: str, at: str, key: str, exited: Column, parent: str) -> DataFrame:
    """Processes whose newest record is no exit, with the first parent that was told."""
    out = records.groupBy(F.col(host).alias("host"), F.col(pid).alias("pid")).agg(
        F.max_by(F.struct(exited.alias("gone"), F.col(at).alias("at")), F.struct(at, key)).alias("x"),
        F.min_by(F.col(parent), F.when(F.col(parent).isNotNull(), F.struct(at, key))).alias("parent"),
    )
    return out.filter(~F.col("x.gone")).select("host", "pid", F.col("x.at").alias("last_at"), "parent")
