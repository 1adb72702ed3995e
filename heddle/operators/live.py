"""Latest state, rosters, censuses and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measures import exact_sum


def latest(records: DataFrame, *, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The newest row of each key, as a partial aggregate (no window, no sort)."""
    return records.groupBy(*by).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_v")).select(*by, "_v.*")


def newest(records: DataFrame, *, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The newest n rows of each key, ranked from 1."""
    ranked = records.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n)


def roster(records: DataFrame, *, user: str, cls: str, cost: str) -> DataFrame:
    """One row a user: count, cost, and counts by class in the order of their names."""
    per = records.groupBy(F.col(user).alias("user"), F.col(cls).alias("cls")).agg(F.count(F.lit(1)).alias("k"), exact_sum(cost).alias("c"))
    rows = per.groupBy("user").agg(F.sum("k").alias("n"), exact_sum("c").alias("cost"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "cls", F.col("k").cast("string")))), ",").alias("by_class"))
    return rows


def least_census(ticks: DataFrame, *, by: str, tick: str, name: str, count: str) -> DataFrame:
    """(by, name, n): the element-wise minimum over a group's ticks; a name missing from one drops out."""
    n_ticks = ticks.groupBy(F.col(by).alias("grp")).agg(F.countDistinct(tick).alias("ticks"))
    per = ticks.groupBy(F.col(by).alias("grp"), F.col(name).alias("name")).agg(F.countDistinct(tick).alias("seen"), F.min(count).alias("n"))
    return per.join(n_ticks, "grp").filter("seen = ticks").select("grp", "name", "n")


def census_above(now: DataFrame, base: DataFrame, *, top: int = 5) -> DataFrame:
    """(grp, name, n): counts now over the baseline, the largest of each group."""
    over = now.join(base.withColumnRenamed("n", "_b"), ["grp", "name"], "left").select("grp", "name", (F.col("n") - F.coalesce("_b", F.lit(0))).alias("n")).filter("n > 0")
    return newest(over, by=["grp"], order=[F.desc("n"), F.asc("name")], n=top)


START_AGE_US = 150_000_000  # a baseline began with its session if the root was this young, at most (fixed value)


def running_state(sessions: DataFrame, above: DataFrame, *, fresh_us: int, start_age_us: int = START_AGE_US) -> DataFrame:
    """(grp, state, commands) of each session: running, idle or unknown.

    ``sessions``: grp, at_us of the newest census (null without one), told (whether it names commands) and
    base_age_us of its baseline; ``above`` as from ``census_above``. A census that is missing or old tells
    nothing; what runs beyond the baseline is told whatever its age; idle only of a baseline that began with
    the session, since an older one may hold a call that was already up.
    """
    listed = above.groupBy("grp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.concat_ws(":", "name", "n").alias("c")))), lambda x: x["c"]), ",").alias("commands"))  # five at most
    both = sessions.join(listed, "grp", "left")
    read = F.coalesce((F.col("at_us") >= fresh_us) & F.col("told"), F.lit(False))
    state = F.when(~read, "unknown").when(F.col("commands").isNotNull(), "running").when(F.col("base_age_us") <= start_age_us, "idle").otherwise("unknown")
    return both.withColumn("state", state).select("grp", "state", F.when(F.col("state") == "running", F.col("commands")).alias("commands"))


def health(hosts: DataFrame, *, as_of_us: int, heartbeat_us: int, lost_pct: float = 0.1) -> DataFrame:
    """verdict of each host from last_us, stopped, n and lost: stopped, silent, degraded, ok, unknown."""
    verdict = (
        F.when(F.col("last_us").isNull(), "unknown")
        .when(F.col("stopped"), "stopped")
        .when(F.col("last_us") < as_of_us - heartbeat_us, "silent")
        .when(F.col("lost") * 100.0 > F.col("n") * lost_pct, "degraded")
        .otherwise("ok")
    )
    return hosts.withColumn("verdict", verdict)


def alive(records: DataFrame, *, by: list[str], us: str, as_of_us: int, within_us: int) -> DataFrame:
    """How many distinct keys have a record within the time; null if there is none at all."""
    recent = records.filter((F.col(us) > as_of_us - within_us) & (F.col(us) <= as_of_us))
    n = F.countDistinct(*by)
    return recent.agg(F.when(F.count(F.lit(1)) > 0, n).alias("alive"))


CENSUS = "n_procs bigint, threads bigint, rss_mb double, d_state bigint, users bigint"
LIVE_US = 600_000_000
FINE_US, COARSE_US, FINE_SPAN_US, RETENTION_US, SKEW_US = 600_000_000, 3_600_000_000, 86_400_000_000, 7 * 86_400_000_000, 120_000_000


def newest_census(ticks: DataFrame, *, host: str, at: str, key: str, census: str) -> DataFrame:
    """(host, last_at, cls, n_procs, ...): each host's newest tick by class, from a map of class to ``CENSUS``; a host whose map is empty keeps a row without class."""
    last = ticks.groupBy(F.col(host).alias("host")).agg(F.max_by(F.struct(F.col(at).alias("at"), F.col(census).alias("census")), F.struct(at, key)).alias("t"))
    return last.select("host", F.col("t.at").alias("last_at"), F.explode_outer("t.census").alias("cls", "c")).select("host", "last_at", "cls", "c.*")


def hosts_by_class(census: DataFrame) -> DataFrame:
    """One row a host: sums over its classes, null memory as unmeasured, and its processes by class (classes that told none are 0)."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    split = F.array_join(F.sort_array(F.collect_list(F.when(F.col("cls").isNotNull(), F.concat_ws(":", "cls", F.coalesce("n_procs", F.lit(0)))))), ",")
    return census.groupBy("host").agg(
        F.max("last_at").alias("last_at"), split.alias("by_class"), zero("n_procs").alias("procs"), zero("threads").alias("threads"), zero("d_state").alias("d_state"), zero("users").alias("users"),
        F.round(F.nullif(exact_sum("rss_mb") / 1024, F.lit(0.0)), 2).alias("rss_gb"),
    )


def plates(census: DataFrame) -> DataFrame:
    """One row a class: sums over the hosts' newest ticks; null where no host told."""
    return census.filter("cls IS NOT NULL").groupBy("cls").agg(F.count_distinct("host").alias("hosts"), F.sum("n_procs").alias("procs"), F.sum("threads").alias("threads"), F.round(F.nullif(exact_sum("rss_mb") / 1024, F.lit(0.0)), 2).alias("rss_gb"), F.sum("d_state").alias("d_state"), F.sum("users").alias("users"))


def usage(records: DataFrame, *, now_us: int, window_us: int, measures: list[str]) -> DataFrame:
    """(user, cls, type, n, sums): what each account ran in the window, whole bins of ten minutes in the last day and of an hour before.

    ``records``: user, cls, type, us and the measures, null as 0. A bin counts when it overlaps the
    window; a record at most two minutes ahead of the clock counts as now; one without a user, further
    ahead, or older than a week is left out.
    """
    us = F.least("us", F.lit(now_us))
    size = F.when(us >= now_us - FINE_SPAN_US, FINE_US).otherwise(COARSE_US)
    end = us - F.pmod(us, size) + size
    own = records.filter((F.col("user") != "") & (F.col("us") <= now_us + SKEW_US) & (F.col("us") >= now_us - RETENTION_US) & (end > now_us - min(window_us, RETENTION_US)))
    return own.groupBy("user", "cls", F.coalesce("type", F.lit("")).alias("type")).agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(exact_sum(m), F.lit(0.0)).alias(m) for m in measures), F.max(us).alias("last_us"))


def running_sessions(ticks: DataFrame, *, now_us: int, within_us: int = LIVE_US) -> DataFrame:
    """(user, cls, type, live, procs): sessions whose newest tick is within ten minutes; ``ticks``: host, root, user, cls, type, us, procs."""
    last = ticks.filter(F.col("us") <= now_us).groupBy("host", "root").agg(F.max_by(F.struct("user", "cls", "type", "us", "procs"), F.struct("us", "procs")).alias("t")).select("host", "root", "t.*")
    return last.filter((F.col("us") >= now_us - within_us) & F.col("user").isNotNull()).groupBy("user", "cls", F.coalesce("type", F.lit("")).alias("type")).agg(F.count(F.lit(1)).alias("live"), F.sum("procs").alias("procs"))


def _whole_roster(used: DataFrame, running: DataFrame) -> DataFrame:
    return used.join(running, ["user", "cls", "type"], "full")


def ranked_roster(used: DataFrame, running: DataFrame, *, measures: list[str], limit: int, name: str | None = None) -> DataFrame:
    """The first accounts with their usage by class and type: those with most running agents first, then the busiest, then by name.

    A person is one row, whatever classes they show up in; ``name`` keeps accounts that hold it, in any case.
    """
    both = _whole_roster(used, running)
    if name:
        both = both.filter(F.contains(F.lower("user"), F.lit(name.lower())))
    part = F.concat_ws(":", F.concat_ws("/", "cls", F.nullif("type", F.lit(""))), F.coalesce("n", F.lit(0)))
    up = F.when(F.col("live") > 0, F.concat_ws(":", F.concat_ws("/", "cls", F.nullif("type", F.lit(""))), "live"))
    rows = both.groupBy("user").agg(
        F.coalesce(F.sum(F.when(F.col("cls") == "agent", F.col("live"))), F.lit(0)).alias("running_agents"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *(F.coalesce(exact_sum(m), F.lit(0.0)).alias(m) for m in measures),
        F.array_join(F.sort_array(F.collect_list(part)), ",").alias("by_class"), F.array_join(F.sort_array(F.collect_list(up)), ",").alias("running"), F.max("last_us").alias("last_us"),
    )
    order = [F.desc("running_agents"), F.desc("n"), F.asc("user")]
    first = rows.orderBy(*order).limit(limit)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def roster_counts(used: DataFrame, running: DataFrame) -> DataFrame:
    """(part, name, users): all accounts, those of each class, those with a running agent, and those that run each type."""
    both = _whole_roster(used, running)
    parts = F.array(F.struct(F.lit("all").alias("part"), F.lit("").alias("name")), F.struct(F.lit("class").alias("part"), F.col("cls").alias("name")))
    live = F.when(F.col("live") > 0, F.array(F.struct(F.lit("running").alias("part"), F.concat_ws("/", "cls", "type").alias("name"))))
    agent = F.when((F.col("live") > 0) & (F.col("cls") == "agent"), F.array(F.struct(F.lit("live_agent").alias("part"), F.lit("").alias("name"))))
    none = F.array().cast("array<struct<part:string,name:string>>")
    each = both.select("user", F.explode(F.concat(parts, F.coalesce(live, none), F.coalesce(agent, none))).alias("p")).select("user", "p.*")
    return each.groupBy("part", "name").agg(F.count_distinct("user").alias("users"))


def sessions_of(ticks: DataFrame, *, user: str, now_us: int, within_us: int = LIVE_US) -> DataFrame:
    """One account's running sessions, agents first, then the largest: host, root, cls, type, age since the first tick, processes, peak and mean memory.

    ``ticks``: host, root, user, cls, type, us, procs, rss. The user's filter reaches the scan.
    """
    own = ticks.filter((F.col("user") == user) & (F.col("us") <= now_us)).groupBy("host", "root").agg(
        F.max_by(F.struct("cls", "type", "procs", "us"), F.struct("us", "procs")).alias("t"), F.min("us").alias("first_us"), F.max("rss").alias("rss_peak"), F.round(exact_sum("rss") / F.count("rss"), 1).alias("rss_mean"), F.count("rss").alias("rss_ticks")
    )
    live = own.select("host", "root", "t.*", "first_us", "rss_peak", "rss_mean", "rss_ticks").filter(F.col("us") >= now_us - within_us)
    order = Window.orderBy((F.coalesce("cls", F.lit("")) != "agent"), F.desc_nulls_last("procs"), "host", "root")  # one account's sessions
    return live.select("host", "root", "cls", "type", "procs", (F.lit(now_us) - F.col("first_us")).alias("age_us"), "rss_peak", "rss_mean", "rss_ticks", F.row_number().over(order).alias("rank"))
