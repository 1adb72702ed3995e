"""Time series over bins: gap-honest spines, grids and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measures import exact_sum
from ..plans.scratch import written

#: Widths in seconds from which a window's bin is chosen (fixed values).
WIDTHS = (60, 120, 300, 600, 900, 1800, 3600, 7200, 10800, 21600, 43200, 86400)


def bin_for(window_s: int, most: int = 240) -> int:
    """The first width with at most ``most`` bins."""
    return next((w for w in WIDTHS if window_s <= w * most), WIDTHS[-1])


def bin_of(us: Column, width_s: int) -> Column:
    return F.floor(us / (width_s * 1_000_000)).cast("bigint")


def spine(df: DataFrame, column: str) -> DataFrame:
    """All whole numbers from the smallest to the largest of a column."""
    ends = df.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    return ends.filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias(column))


def bins_by_class(records: DataFrame, *, us: str, cls: str, cost: str, width_s: int = 3600) -> DataFrame:
    """bin, class, n, cost: a bin without records is null for all; one with any has measured zeros.

    A class whose records in a bin all lack the cost has a null cost there.
    """
    binned = records.select(bin_of(F.col(us), width_s).alias("bin"), F.col(cls).alias("cls"), F.col(cost).alias("_cost"))
    held = binned.groupBy("bin", "cls").agg(F.count(F.lit(1)).alias("n"), exact_sum("_cost").alias("cost"))
    any_ = held.select("bin").distinct().withColumn("live", F.lit(True))
    grid = spine(held, "bin").crossJoin(F.broadcast(held.select("cls").distinct()))  # classes are few
    full = grid.join(any_, "bin", "left").join(held, ["bin", "cls"], "left")
    live = F.col("live").isNotNull()
    return full.select(
        "bin",
        "cls",
        F.when(live, F.coalesce("n", F.lit(0))).cast("bigint").alias("n"),
        F.when(live & F.col("n").isNull(), F.lit(0.0)).otherwise(F.col("cost")).alias("cost"),
    )


def slice_totals(bins: DataFrame, first: Column, last: Column) -> DataFrame:
    """Totals of a run of bins by class, with how many held anything."""
    own = bins.filter(F.col("bin").between(first, last))
    return own.groupBy("cls").agg(F.sum("n").alias("n"), exact_sum("cost").alias("cost"), F.count("n").alias("bins_held"), F.count(F.lit(1)).alias("bins"))


def resident_series(ticks: DataFrame, *, us: str, host: str, value: str, width_s: int = 3600) -> DataFrame:
    """Of each bin: the sum over hosts of each host's mean over its ticks."""
    per_host = ticks.groupBy(bin_of(F.col(us), width_s).alias("bin"), F.col(host).alias("_h")).agg((exact_sum(value) / F.count(F.lit(1))).alias("mean"), F.count(F.lit(1)).alias("ticks"))
    return per_host.groupBy("bin").agg(exact_sum("mean", 6).alias("resident"), F.count(F.lit(1)).alias("hosts"), F.sum("ticks").alias("ticks"))


MOST_BINS = 960  # fixed value


def _newest_bins(held: DataFrame, most: int) -> DataFrame:
    """(lo, hi) of the bins, at most ``most`` of the newest."""
    ends = held.agg(F.min("bin").alias("a"), F.max("bin").alias("hi")).filter("hi IS NOT NULL")
    return ends.select(F.greatest("a", F.col("hi") - most + 1).alias("lo"), "hi")


def measured_series(records: DataFrame, *, us: str, cls: str, fields: list[str], width_s: int, most: int = MOST_BINS) -> DataFrame:
    """(bin, cls, n, fields): every class at every bin of the span; a bin without the class's records is null, and so is a field that none of them tells.

    A longer span keeps its newest bins. Sums come first, so the grid is joined to what is already small.
    """
    held = records.groupBy(bin_of(F.col(us), width_s).alias("bin"), F.col(cls).alias("cls")).agg(F.count(F.lit(1)).alias("n"), *(exact_sum(f).alias(f) for f in fields))
    held = written(held, "series")
    span = _newest_bins(held, most).select(F.explode(F.sequence("lo", "hi")).alias("bin"))  # one row, at most ``most`` bins
    kept = held.join(F.broadcast(span), "bin", "left_semi")
    grid = F.broadcast(span).crossJoin(kept.select("cls").distinct())
    return grid.join(kept, ["bin", "cls"], "left")


def stall_series(records: DataFrame, *, us: str, tool: str, wait: str, width_s: int, tools: int = 6, most: int = MOST_BINS) -> DataFrame:
    """(bin, tool, wait): the tools that waited longest, all others as null, at every bin; 0 where waits were measured and it had none, null where none was."""
    held = records.groupBy(bin_of(F.col(us), width_s).alias("bin"), F.col(tool).alias("tool")).agg(F.count(wait).alias("told"), exact_sum(wait).alias("wait"))
    held = written(held, "stalls")
    span = _newest_bins(held, most).select(F.explode(F.sequence("lo", "hi")).alias("bin"))
    top = held.groupBy("tool").agg(exact_sum("wait").alias("total")).filter("total > 0").orderBy(F.desc("total"), "tool").limit(tools).select("tool", F.lit(True).alias("named"))
    placed = held.filter("told > 0").join(F.broadcast(top), "tool", "left").select("bin", F.when(F.col("named"), F.col("tool")).alias("tool"), "wait")
    sums = placed.groupBy("bin", "tool").agg(exact_sum("wait").alias("wait"))
    measured = placed.select("bin").distinct().withColumn("measured", F.lit(True))
    lines = top.select("tool").unionByName(top.limit(1).select(F.lit(None).cast("string").alias("tool")))
    grid = F.broadcast(span).crossJoin(lines).join(measured, "bin", "left").alias("g")
    found = grid.join(sums.alias("s"), (F.col("g.bin") == F.col("s.bin")) & F.col("g.tool").eqNullSafe(F.col("s.tool")), "left")
    return found.select("g.bin", "g.tool", F.when(F.col("g.measured"), F.coalesce("s.wait", F.lit(0.0))).alias("wait"))


def hour_grid(records: DataFrame, *, ts: str, us: str) -> DataFrame:
    """weekday (1 is Monday) x hour: distinct active minutes."""
    minutes = records.select((F.weekday(ts) + 1).alias("weekday"), F.hour(ts).alias("hour"), F.floor(F.col(us) / 60_000_000).alias("m")).distinct()
    return minutes.groupBy("weekday", "hour").agg(F.count(F.lit(1)).alias("minutes"))


def daily_trend(records: DataFrame, *, ts: str, us: str, cls: str, cost: str, user: str) -> DataFrame:
    """day x class: n, cost, users, held minutes; null on a day that holds nothing at all."""
    day = F.unix_date(F.col(ts).cast("date")).cast("bigint")
    own = records.select(day.alias("day"), F.col(cls).alias("cls"), F.col(cost).alias("_c"), F.col(user).alias("_u"), F.floor(F.col(us) / 60_000_000).alias("_m"))
    held = own.groupBy("day", "cls").agg(F.count(F.lit(1)).alias("n"), exact_sum("_c").alias("cost"), F.countDistinct("_u").alias("users"))
    minutes = own.groupBy("day").agg(F.countDistinct("_m").alias("held_minutes"))
    grid = spine(held, "day").crossJoin(F.broadcast(held.select("cls").distinct()))  # classes are few
    live = F.col("held_minutes").isNotNull()
    full = grid.join(minutes, "day", "left").join(held, ["day", "cls"], "left")
    return full.select(
        "day", "cls",
        F.when(live, F.coalesce("n", F.lit(0))).cast("bigint").alias("n"),
        F.when(live, F.coalesce("cost", F.lit(0.0))).alias("cost"),
        F.when(live, F.coalesce("users", F.lit(0))).cast("bigint").alias("users"),
        "held_minutes",
    )


def node_series(snapshots: DataFrame, *, host: str, us: str, field: str, newest: int = 64, least_s: int = 3600) -> DataFrame:
    """Max and mean of a field per host and bin; bins are at least twice the host's median interval."""
    by_host = Window.partitionBy(host).orderBy(us)
    gaps = snapshots.select(host, us, (F.col(us) - F.lag(us).over(by_host)).alias("gap"))
    latest = gaps.filter("gap IS NOT NULL").withColumn("_r", F.row_number().over(Window.partitionBy(host).orderBy(F.desc(us)))).filter(F.col("_r") <= newest)
    interval = latest.groupBy(host).agg(F.median("gap").alias("interval_us"))
    width = F.greatest(F.lit(least_s * 1_000_000).cast("double"), 2 * F.col("interval_us"))
    own = snapshots.join(F.broadcast(interval), host).withColumn("bin", F.floor(F.col(us) / width).cast("bigint"))
    return own.groupBy(F.col(host).alias("host"), "bin").agg(F.max(field).alias("most"), (exact_sum(field) / F.count(field)).alias("mean"), F.count(F.lit(1)).alias("n"))


def node_history(snapshots: DataFrame, *, host: str, us: str, fields: dict[str, str], now_us: int, window_us: int, newest: int = 64) -> DataFrame:
    """(host, bin, bin_s, snapshots, fields): every host seen in the window at every one of its bins; a hole is null.

    ``fields`` says ``max`` or ``mean`` of each. Bins are the first width that is the window's own and at least
    twice the usual gap: the median of the newest gaps of all hosts.
    """
    by_host = Window.partitionBy(host)
    gaps = snapshots.filter(F.col(us).isNotNull()).select(host, us).distinct().withColumns({"gap": F.col(us) - F.lag(us).over(by_host.orderBy(us)), "r": F.row_number().over(by_host.orderBy(F.desc(us)))})
    usual = gaps.filter((F.col("r") <= newest) & F.col("gap").isNotNull()).agg((F.median("gap") / 1_000_000).alias("every"))
    least = bin_for(window_us // 1_000_000)
    want = F.greatest(F.lit(least).cast("double"), 2 * F.round("every", 1))
    width = F.coalesce(*(F.when(want <= w, F.lit(w)) for w in WIDTHS), F.lit(WIDTHS[-1])).cast("bigint")
    size = usual.select(width.alias("bin_s"))  # one row
    edges = size.select("bin_s", F.floor((F.lit(now_us) - window_us) / (F.col("bin_s") * 1_000_000)).alias("lo"), F.floor(F.lit(now_us) / (F.col("bin_s") * 1_000_000)).alias("hi"))
    own = snapshots.crossJoin(F.broadcast(edges)).withColumn("bin", F.floor(F.col(us) / (F.col("bin_s") * 1_000_000))).filter("bin BETWEEN lo AND hi")
    how = {"max": lambda f: F.max(f), "mean": lambda f: exact_sum(f) / F.nullif(F.count(f), F.lit(0))}
    sums = own.groupBy(F.col(host).alias("host"), "bin").agg(F.count(F.lit(1)).alias("snapshots"), *(how[h](f).alias(f) for f, h in fields.items()))
    sums = written(sums, "nodes")
    spine = edges.select("bin_s", F.explode(F.sequence("lo", "hi")).alias("bin"))
    return F.broadcast(spine).crossJoin(sums.select("host").distinct()).join(sums, ["host", "bin"], "left")


def density(records: DataFrame, *, us: str, kind: str, key: str, widths: tuple[int, ...] = WIDTHS, most: int = 2400) -> DataFrame:
    """Starts per bin and kind, in the finest width that keeps to ``most`` bins."""
    span = records.agg(((F.max(us) - F.min(us)) / 1_000_000).alias("span"))
    choice = F.coalesce(*(F.when(F.col("span") <= w * most, F.lit(w)) for w in widths), F.lit(widths[-1]))
    own = records.crossJoin(F.broadcast(span.select(choice.alias("width"))))  # one row
    binned = own.groupBy("width", F.floor(F.col(us) / (F.col("width") * 1_000_000)).cast("bigint").alias("bin"), F.col(kind).alias("kind"))
    return binned.agg(F.count(F.lit(1)).alias("starts"), F.min(key).alias("first_key"))


def local_days(records: DataFrame, *, us: str, zone: str) -> DataFrame:
    """(day, start_us, end_us, hours) of each local day from the first record's to the last's.

    A day runs from one local midnight to the next: 23 or 25 hours where clocks change, and
    from the first moment there is where midnight is skipped. Sessions run in UTC.
    """
    ends = records.agg(F.min(us).alias("a"), F.max(us).alias("b")).filter("a IS NOT NULL")
    first, last = (F.to_date(F.from_utc_timestamp(F.timestamp_micros(c), zone)) for c in ("a", "b"))
    days = ends.select(F.explode(F.sequence(first, last)).alias("day"))
    midnight = lambda day: F.unix_micros(F.to_utc_timestamp(day.cast("timestamp"), zone))
    days = days.select("day", midnight(F.col("day")).alias("start_us"), midnight(F.date_add("day", 1)).alias("end_us"))
    return days.withColumn("hours", ((F.col("end_us") - F.col("start_us")) / 3_600_000_000).cast("double"))


def by_local_day(records: DataFrame, *, us: str, zone: str, cost: str) -> DataFrame:
    """(day, hours, n, cost) of every local day; a day without records has 0 and null."""
    day = F.to_date(F.from_utc_timestamp(F.timestamp_micros(us), zone))
    sums = records.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"), exact_sum(cost).alias("cost"))
    return local_days(records, us=us, zone=zone).join(sums, "day", "left").select("day", "hours", F.coalesce("n", F.lit(0)).alias("n"), "cost")
