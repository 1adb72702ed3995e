"""Shares, sketches, ranks, unions of top lists and concentration."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measures import exact_sum, pct, rank_index
from ..plans.scratch import written

GAMMA = 1.01 / 0.99
TINY = 1e-9
SKETCH_RANKS = (0.01, 0.10, 0.25, 0.50, 0.75, 0.90, 0.99)


def sketch_quantiles(records: DataFrame, *, by: str, value: str, ranks: tuple[float, ...] = SKETCH_RANKS) -> DataFrame:
    """Quantiles from exact counts of logarithmic buckets, which add up over any partition.

    Buckets are ``ceil(log_gamma |v|)``; the value is the bucket's midpoint kept
    within the exact range, at rank ``floor(q * (n - 1))``.
    """
    v = F.col(value)
    index = F.ceil(F.log(F.abs(v)) / F.log(F.lit(GAMMA))).cast("bigint")
    sign = F.when(F.abs(v) <= TINY, 0).otherwise(F.signum(v)).cast("int")
    held = records.filter(v.isNotNull()).select(F.col(by).alias("cls"), v.alias("v"), sign.alias("sign"), F.when(sign == 0, 0).otherwise(index).cast("bigint").alias("idx"))
    buckets = held.groupBy("cls", "sign", "idx").agg(F.count(F.lit(1)).alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    order = Window.partitionBy("cls").orderBy("sign", F.col("sign") * F.col("idx"))
    whole = Window.partitionBy("cls")
    buckets = buckets.withColumns({"cum": F.sum("k").over(order), "n": F.sum("k").over(whole), "min": F.min("lo").over(whole), "max": F.max("hi").over(whole)})
    middle = F.col("sign") * 2 * F.pow(F.lit(GAMMA), "idx") / (GAMMA + 1)
    middle = F.round(F.least(F.greatest(middle, F.col("min")), F.col("max")), 4)
    picks = [F.min(F.when(F.col("cum") > rank_index(q, F.col("n"), "floor"), F.struct("cum", middle.alias("v"))))["v"].alias(f"p{round(q * 100)}") for q in ranks]
    return buckets.groupBy("cls").agg(F.sum("k").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"), *picks)


def sketches(records: DataFrame, *, by: str, measures: dict[str, Column], ranks: tuple[float, ...] = SKETCH_RANKS) -> DataFrame:
    """(cls, measure, seen, n, coverage_pct, zero_pct, all_zero, mean, min, max, p..) of several measures in one pass.

    A null is not measured. Where all that is measured is zero, ``all_zero`` says so, as such a
    counter may never have worked; a measure that no record of a class tells has null quantiles.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), c.cast("double").alias("value")) for k, c in measures.items())))
    each = records.select(F.col(by).alias("cls"), pairs.alias("m")).select("cls", "m.*")
    zeros = F.count_if(F.abs("value") <= TINY)
    counts = each.groupBy("cls", "measure").agg(
        F.count(F.lit(1)).alias("seen"), F.count("value").alias("n"), pct(F.count("value"), F.count(F.lit(1))).alias("coverage_pct"), pct(zeros, F.count("value")).alias("zero_pct"),
        ((zeros > 0) & (zeros == F.count("value"))).alias("all_zero"), F.round(exact_sum("value") / F.nullif(F.count("value"), F.lit(0)), 4).alias("mean"),
    )
    found = sketch_quantiles(each.select(F.struct("cls", "measure").alias("grp"), "value"), by="grp", value="value", ranks=ranks)
    found = found.select(F.col("cls.cls").alias("_c"), F.col("cls.measure").alias("_m"), "min", "max", *(f"p{round(q * 100)}" for q in ranks))
    return counts.join(found, F.col("cls").eqNullSafe(F.col("_c")) & (F.col("measure") == F.col("_m")), "left").drop("_c", "_m")


def nearest_ranks(records: DataFrame, *, by: str, value: str, qs: tuple[float, ...], rules: tuple[str, ...] = ("floor", "half_even", "ceil")) -> DataFrame:
    """Exact nearest-rank quantiles under each rank rule."""
    counts = records.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("grp"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    # Ranges of values, cut anywhere: how many lie below a range is known from the ranges' own counts.
    placed = written(counts.repartitionByRange("grp", "v").sortWithinPartitions("grp", "v").withColumn("part", F.spark_partition_id()), "ranks")
    own = placed.groupBy("grp", "part").agg(F.sum("k").alias("held"))
    whole = Window.partitionBy("grp")
    below = own.select("grp", "part", (F.sum("held").over(whole.orderBy("part")) - F.col("held")).alias("below"), F.sum("held").over(whole).alias("n"))
    upto = F.col("below") + F.sum("k").over(Window.partitionBy("grp", "part").orderBy("v"))
    ranked = placed.join(below, ["grp", "part"]).withColumn("upto", upto)
    picks = [F.min(F.when(F.col("upto") > rank_index(q, F.col("n"), rule), F.col("v"))).alias(f"{rule}_p{round(q * 100)}") for rule in rules for q in qs]
    return ranked.groupBy("grp").agg(F.max("n").alias("n"), *picks)


def shares(records: DataFrame, *, cls: str, tag: str, bucket: str, cost: str) -> DataFrame:
    """Count and cost of each bucket, side by side, with shares in its population.

    Every record counts for its class, and again for ``agent:<tag>`` where tagged.
    """
    populations = F.array_compact(F.array(F.col(cls), F.when(F.coalesce(F.col(tag), F.lit("")) != "", F.concat(F.lit("agent:"), F.col(tag)))))
    each = records.select(F.explode(populations).alias("population"), F.col(bucket).alias("bucket"), F.col(cost).alias("_c"))
    sums = each.groupBy("population", "bucket").agg(F.count(F.lit(1)).alias("calls"), exact_sum("_c").alias("cost"))
    whole = Window.partitionBy("population")
    return sums.select("population", "bucket", "calls", "cost", pct(F.col("calls"), F.sum("calls").over(whole)).alias("calls_pct"), pct(F.col("cost"), F.sum(F.col("cost").cast("decimal(28,4)")).over(whole).cast("double")).alias("cost_pct"))


def top_union(rows: DataFrame, *, key: str, measures: list[str], n: int, within: list[str] | None = None) -> DataFrame:
    """Rows that are among the n largest by any measure; ties by key."""
    within = within or []
    if within:
        ranks = {f"rank_{m}": F.row_number().over(Window.partitionBy(*within).orderBy(F.desc_nulls_last(m), F.asc(key))) for m in measures}
        ranked = rows.withColumns(ranks)
        keep = F.least(*(F.col(r) for r in ranks)) <= n if len(ranks) > 1 else F.col(next(iter(ranks))) <= n
        return ranked.filter(keep).drop(*ranks)
    # Without groups each list is a distributed top-n; their keys pick the rows.
    lists = [rows.orderBy(F.desc_nulls_last(m), F.asc(key)).limit(n).select(key) for m in measures]
    keys = lists[0]
    for other in lists[1:]:
        keys = keys.unionByName(other)
    return rows.join(F.broadcast(keys.distinct()), key, "left_semi")  # at most n rows a measure


def subset_top(sums: DataFrame, *, cls: str, key: str, measures: list[str], classes: list[str], n: int) -> DataFrame:
    """Keys that are among the n largest for some non-empty subset of classes, by some measure."""
    subsets = [s for r in range(1, len(classes) + 1) for s in combinations(classes, r)]
    named = F.array(*(F.struct(F.lit("+".join(s)).alias("name"), F.array(*map(F.lit, s)).alias("members")) for s in subsets))
    own = sums.withColumn("_s", F.explode(F.filter(named, lambda s: F.array_contains(s["members"], F.col(cls)))))
    totals = own.groupBy(F.col("_s.name").alias("subset"), key).agg(*(F.sum(m).alias(m) for m in measures))
    return top_union(totals, key=key, measures=measures, n=n, within=["subset"]).select(key).distinct()


def rankings(rows: DataFrame, *, key: str, user: str, measures: dict[str, Column], weights: dict[str, Column] | None = None, only: dict[str, Column] | None = None, n: int = 15) -> DataFrame:
    """(ranking, rank, key, user, value, user_share_pct, dominant_pct) of several top lists in one pass.

    A null counts as 0, ties go to the smaller key. ``weights`` says what a user's share of a list is of
    where that is not the measure, ``only`` which rows a list may hold. Each task keeps ``n`` rows a list.
    """
    weights, only = weights or {}, only or {}
    entry = lambda m, c: F.when(only.get(m, F.lit(True)), F.struct(F.lit(m).alias("ranking"), F.coalesce(c.cast("double"), F.lit(0.0)).alias("value"), F.coalesce(weights.get(m, c).cast("decimal(28,4)"), F.lit(0)).alias("w")))
    each = rows.select(F.col(key).alias("key"), F.col(user).alias("user"), F.explode(F.array_compact(F.array(*(entry(m, c) for m, c in measures.items())))).alias("m")).select("key", "user", "m.*")
    top = each.withColumn("rank", F.row_number().over(Window.partitionBy("ranking").orderBy(F.desc("value"), "key"))).filter(F.col("rank") <= n)
    whole = Window.partitionBy("ranking")  # at most ``n`` rows
    shared = top.withColumns({"own": F.sum("w").over(Window.partitionBy("ranking", "user")).cast("double"), "all": F.sum("w").over(whole).cast("double")})
    share = shared.withColumn("user_share_pct", pct(F.col("own"), F.col("all")))
    return share.withColumn("dominant_pct", F.max("user_share_pct").over(whole)).select("ranking", "rank", "key", "user", "value", "user_share_pct", "dominant_pct")


def largest_rows(records: DataFrame, *, by: str, value: str, key: str, columns: list[str]) -> DataFrame:
    """The row behind the largest value of each group; the smaller key of a tie."""
    best = F.max_by(F.struct(*columns), F.struct(F.col(value), -F.col(key)))
    return records.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("grp")).agg(best.alias("_b")).select("grp", "_b.*")


def gini(records: DataFrame, *, of: str, top: float = 0.1) -> DataFrame:
    """Concentration of rows over a key: Gini, share of the top tenth, number of keys."""
    per = records.groupBy(F.col(of).alias("key")).agg(F.count(F.lit(1)).alias("x"))
    # Keys with equal counts are one row, so that ranks come from a small table.
    sizes = per.groupBy("x").agg(F.count(F.lit(1)).alias("m"))
    up = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.withColumn("upto", F.sum("m").over(up))
    # Ranks upto - m + 1 .. upto share the count x.
    ranks = F.col("m") * (2 * F.col("upto") - F.col("m") + 1) / 2
    whole = Window.partitionBy()
    n = F.sum("m").over(whole)
    sizes = sizes.withColumns({"ranks": ranks, "n": n, "k": F.greatest(F.lit(1), F.ceil(F.lit(top) * n))})
    in_top = F.greatest(F.lit(0), F.least(F.col("m"), F.col("upto") - (F.col("n") - F.col("k"))))
    total = F.sum(F.col("x") * F.col("m"))
    return sizes.agg(
        F.first("n").alias("keys"),
        total.alias("rows"),
        F.round(2 * F.sum(F.col("ranks") * F.col("x")) / (F.first("n") * total) - (F.first("n") + 1) / F.first("n"), 3).alias("gini"),
        pct(F.sum(in_top * F.col("x")), total).alias("top_pct"),
    )


def drift(records: DataFrame, *, by: str, token: str, order: list[str], least: int = 30) -> DataFrame:
    """Jensen-Shannon divergence (base 2) between the first and the last third of each sequence."""
    w = Window.partitionBy(by)
    ranked = records.select(F.col(by).alias("grp"), F.col(token).alias("tok"), F.row_number().over(w.orderBy(*order)).alias("r"), F.count(F.lit(1)).over(w).alias("n")).filter(F.col("n") >= least)
    third = F.floor(F.col("n") / 3)
    part = F.when(F.col("r") <= third, 0).when(F.col("r") > F.col("n") - third, 1)
    sums = ranked.withColumn("part", part).filter("part IS NOT NULL").groupBy("grp", "tok").agg((F.sum(1 - F.col("part")) / F.first(third)).alias("p"), (F.sum("part") / F.first(third)).alias("q"), F.first("n").alias("n"))
    mid = (F.col("p") + F.col("q")) / 2
    term = lambda x: F.when(x > 0, x * F.log2(x / mid)).otherwise(0.0)
    return sums.groupBy("grp").agg(F.first("n").alias("n"), F.round((F.sum(term(F.col("p"))) + F.sum(term(F.col("q")))) / 2, 6).alias("jsd"))


def upper_medians(records: DataFrame, *, by: str, value: str) -> DataFrame:
    """The exact upper median of each group: ranks are counted by buckets first, then by values within the one bucket that holds it."""
    bucket = F.when(F.col(value) == 0, 0).otherwise(F.signum(value) * (F.floor(F.log2(F.abs(value)) * 16) + 100_000)).cast("bigint")
    own = records.filter(F.col(value).isNotNull()).select(F.col(by).alias("grp"), F.col(value).alias("v"), bucket.alias("b"))
    w = Window.partitionBy("grp").orderBy("b")
    sums = own.groupBy("grp", "b").agg(F.count(F.lit(1)).alias("n"))
    sums = sums.withColumns({"upto": F.sum("n").over(w), "at": F.floor(F.sum("n").over(Window.partitionBy("grp")) / 2)})
    held = sums.filter((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at"))).select("grp", "b", (F.col("at") - F.col("upto") + F.col("n")).alias("at"))
    inside = own.join(held, ["grp", "b"]).groupBy("grp", "v").agg(F.count(F.lit(1)).alias("n"), F.first("at").alias("at"))
    inside = inside.withColumn("upto", F.sum("n").over(Window.partitionBy("grp").orderBy("v")))
    return inside.filter("upto > at").groupBy("grp").agg(F.min("v").alias("upper_median"))
