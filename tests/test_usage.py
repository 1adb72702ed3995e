"""Sketches, stalls, series, hosts, rosters and accounting on small tables, and their empty cases."""

import random

from pyspark.sql import functions as F

from heddle.operators import jobs, live, panels, series, stats

M, H, DAY = 60_000_000, 3_600_000_000, 86_400_000_000


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_sketches_of_several_measures(spark):
    r = random.Random(3)
    values = [r.lognormvariate(0, 3) for _ in range(400)]
    data = [("a", v, 0.0, None) for v in values] + [("a", None, 0.0, None), ("b", -2.0, None, None), (None, 3.0, 1.0, None)]
    df = spark.createDataFrame(data, "c string, x double, y double, z double")
    got = {(q.cls, q.measure): q for q in stats.sketches(df, by="c", measures={m: F.col(m) for m in "xyz"}).collect()}
    assert len(got) == 9
    x, y, z = got["a", "x"], got["a", "y"], got["a", "z"]
    assert (x.seen, x.n, x.zero_pct, x.all_zero) == (401, 400, 0.0, False) and (x.min, x.max) == (min(values), max(values))
    s = sorted(values)
    for q in stats.SKETCH_RANKS:  # within a hundredth of the exact rank
        assert abs(x[f"p{round(q * 100)}"] - s[int(q * 399)]) <= 0.0101 * s[int(q * 399)] + 1e-4
    assert (y.n, y.zero_pct, y.all_zero, y.mean, y.p50) == (401, 100.0, True, 0.0, 0.0)
    assert (z.seen, z.n, z.all_zero, z.mean, z.p50, z.min) == (401, 0, False, None, None, None)
    assert got["b", "x"].p50 == -2.0 and got[None, "x"].p50 == 3.0, "negative values and a null class stay"
    assert stats.sketches(df.limit(0), by="c", measures={"x": F.col("x")}).count() == 0


def test_on_cpu(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.05, 2.0), (2.2, 2.0), (1.0, 0.0), (None, 2.0), (1.0, None)], "r double, d double")
    assert [x[0] for x in df.select(panels.on_cpu(F.col("r"), F.col("d"))).collect()] == [0.5, 1.0, None, None, None, None]


def test_stalls_by_class(spark):
    data = [("a", 0.0, 0, 0.0, "t"), ("a", 2.5, 3, 2.0, "p"), ("a", None, None, None, None), ("b", None, None, None, None), (None, 1.0, 1, 1.0, "t")]
    df = spark.createDataFrame(data, "c string, w double, e int, l double, s string")
    got = rows(panels.stalls_by_class(df, cls="c", wait="w", episodes="e", longest="l", source="s"), "cls", "seen", "n", "stalled", "wait", "episodes", "longest", "sources")
    assert got == sorted([("a", 3, 2, 1, 2.5, 3, 2.0, "p:1,t:1"), ("b", 1, 0, 0, None, None, 0.0, ""), (None, 1, 1, 1, 1.0, 1, 1.0, "t:1")], key=str)


def test_series_keep_gaps(spark):
    """No record is null, no value is null, and zero is measured; a long span keeps its newest bins."""
    df = spark.createDataFrame([(0, "a", 1.0), (0, "b", None), (2 * H, "a", 0.0), (2 * H + 1, "a", None)], "us bigint, c string, x double")
    got = rows(series.measured_series(df, us="us", cls="c", fields=["x"], width_s=3600), "bin", "cls", "n", "x")
    assert got == sorted([(0, "a", 1, 1.0), (0, "b", 1, None), (1, "a", None, None), (1, "b", None, None), (2, "a", 2, 0.0), (2, "b", None, None)], key=str)
    got = rows(series.measured_series(df, us="us", cls="c", fields=["x"], width_s=3600, most=2), "bin", "cls", "n")
    assert got == [(1, "a", None), (2, "a", 2)], "a class of clipped bins alone goes with them"
    assert series.measured_series(df.limit(0), us="us", cls="c", fields=["x"], width_s=3600).count() == 0


def test_stall_series_zero_only_if_measured(spark):
    data = [(0, "a", 5.0), (0, "b", 1.0), (0, None, 2.0), (1 * H, "a", None), (2 * H, "b", 0.0), (3 * H, "c", 7.0)]
    df = spark.createDataFrame(data, "us bigint, t string, w double")
    got = {(r.bin, r.tool): r.wait for r in series.stall_series(df, us="us", tool="t", wait="w", width_s=3600, tools=2).collect()}
    assert got == {(0, "c"): 0.0, (0, "a"): 5.0, (0, None): 3.0, (1, "c"): None, (1, "a"): None, (1, None): None, (2, "c"): 0.0, (2, "a"): 0.0, (2, None): 0.0, (3, "c"): 7.0, (3, "a"): 0.0, (3, None): 0.0}
    assert series.stall_series(df.limit(0), us="us", tool="t", wait="w", width_s=3600).count() == 0


def test_hosts_and_plates(spark):
    kind = f"h string, us bigint, k int, c map<string, struct<{live.CENSUS.replace(' ', ':').replace(',:', ',')}>>"
    block = lambda *v: dict(zip(("n_procs", "threads", "rss_mb", "d_state", "users"), v))
    data = [("x", 1, 1, {"old": block(9, 9, 9.0, 9, 9)}), ("x", 2, 1, {"agent": block(3, 4, 512.0, 0, 1), "human": block(None, 1, None, 2, 1)}), ("x", 2, 0, {"old": block(9, 9, 9.0, 9, 9)}), ("y", 1, 1, {}), ("z", 1, 1, None), ("w", 1, 1, {"agent": None})]
    census = live.newest_census(spark.createDataFrame(data, kind), host="h", at="us", key="k", census="c")
    hosts = {r.host: r for r in live.hosts_by_class(census).collect()}
    assert (hosts["x"].by_class, hosts["x"].procs, hosts["x"].threads, hosts["x"].d_state, hosts["x"].rss_gb, hosts["x"].last_at) == ("agent:3,human:0", 3, 5, 2, 0.5, 2)
    assert all((hosts[h].by_class, hosts[h].procs, hosts[h].rss_gb) == ("", 0, None) for h in "yz") and hosts["w"].by_class == "agent:0"
    assert rows(live.plates(census), "cls", "hosts", "procs", "rss_gb", "users") == [("agent", 2, 3, 0.5, 1), ("human", 1, None, None, 1)]
    assert live.hosts_by_class(census.limit(0)).count() == 0 and live.plates(census.limit(0)).count() == 0


def roster(spark, used, ticks, now=10 * DAY, window=DAY):
    records = spark.createDataFrame(used, "user string, cls string, type string, us bigint, cpu double")
    ticks = spark.createDataFrame(ticks, "host string, root int, user string, cls string, type string, us bigint, procs bigint, rss double")
    return live.usage(records, now_us=now, window_us=window, measures=["cpu"]), live.running_sessions(ticks, now_us=now), ticks


def test_usage_of_whole_bins(spark):
    now = 10 * DAY + 7 * M
    own = [("a", "agent", "t", us, 1.0) for us in (now + 3 * M, now + M, now, now - DAY + M, now - 2 * DAY, now - 2 * DAY - 6 * M, now - 2 * DAY - 8 * M, now - 8 * DAY)]
    got = roster(spark, own + [(None, "agent", "t", now, 1.0), ("", "agent", "t", now, 1.0), ("b", "human", None, now, None)], [], now=now, window=2 * DAY)[0]
    assert rows(got, "user", "type", "n", "cpu", "last_us") == [("a", "t", 5, 5.0, now), ("b", "", 1, 0.0, now)], "the hour that the window cuts counts whole, the one before not"


def test_roster_order_and_counts(spark):
    now = 10 * DAY
    own = [("a", "agent", "t", now - 1, 1.0)] * 3 + [("b", "human", None, now - 1, 2.0)] * 3 + [("c", "agent", "t", now - 1, 0.5)] + [("a", "human", None, now - 1, 1.0)]
    ticks = [("h", 1, "c", "agent", "t", now - 5, 2, 1.0), ("h", 2, "d", "agent", "s", now - 5, 2, 1.0), ("h", 2, "a", "agent", "s", now - 9, 2, 1.0), ("h", 3, "b", "ide", "v", now - 11 * M, 2, 1.0), ("h", 4, "b", "agent", "v", now + 5, 2, 1.0), ("h", 5, None, "agent", "v", now, 1, 1.0)]
    used, running, _ = roster(spark, own, ticks)
    first = live.ranked_roster(used, running, measures=["cpu"], limit=3).orderBy("rank").collect()
    assert [(r.user, r.running_agents, r.n, r.by_class, r.running) for r in first] == [("c", 1, 1, "agent/t:1", "agent/t:1"), ("d", 1, 0, "agent/s:0", "agent/s:1"), ("a", 0, 4, "agent/t:3,human:1", "")]
    assert [r.user for r in live.ranked_roster(used, running, measures=["cpu"], limit=9, name="B").collect()] == ["b"]
    assert rows(live.roster_counts(used, running), "part", "name", "users") == [("all", "", 4), ("class", "agent", 3), ("class", "human", 2), ("live_agent", "", 2), ("running", "agent/s", 1), ("running", "agent/t", 1)]
    assert live.roster_counts(used.limit(0), running.limit(0)).count() == 0


def test_sessions_of_an_account(spark):
    now = 10 * DAY
    ticks = [("h", 1, "a", "ide", "v", now - 5, 9, 1.0), ("h", 1, "a", "ide", "v", now - 9, 9, 4.0), ("h", 2, "a", "agent", "t", now - 5, 2, None), ("h", 3, "a", "agent", "t", now - 5, 3, 2.0), ("h", 4, "a", "agent", "t", now - 11 * M, 3, 2.0), ("h", 5, "b", "agent", "t", now, 3, 2.0), ("h", 6, "a", None, None, now, None, None)]
    got = rows(live.sessions_of(roster(spark, [], ticks)[2], user="a", now_us=now), "rank", "root", "age_us", "rss_peak", "rss_mean", "rss_ticks")
    assert got == [(1, 3, 5, 2.0, 2.0, 1), (2, 2, 5, None, None, 0), (3, 1, 9, 4.0, 2.5, 2), (4, 6, 0, None, None, 0)]


JOBS = "cls string, job bigint, array bigint, user string, work_dir string, state string, submit_us bigint, start_us bigint, elapsed_s bigint, cpus int, limit_min int, cpu_s double, rss double, mem double, gpus int, gpus_asked int, gpu_util double, generations int"


def test_account(spark):
    data = [
        ("a", 1, 7, "u", "d", "COMPLETED", 5 * H, 6 * H, 3600, 2, 30, 7200.0, 5.0, 10.0, 1, 1, 50.0, 2), ("a", 2, 7, "u", "", "FAILED", 5 * H, 5 * H - 1, 60, 1, 60, 60.0, None, 10.0, 1, 1, 0.0, 1),
        ("a", 3, None, None, None, None, None, None, None, None, None, None, None, None, 2, None, None, None), ("b", 4, None, "u", "d", "COMPLETED", 0, 31 * DAY, 0, 4, 0, 1.0, 1.0, 0.0, 0, 1, None, 1),
    ]
    df = spark.createDataFrame(data, JOBS)
    got = {r.cls: r for r in jobs.account(df).collect()}
    a, b = got["a"], got["b"]
    assert (a.jobs, a.submissions, a.users, a.work_dirs, a.core_hours, a.gpu_hours, a.gpu_jobs, a.array_collapse) == (3, 2, 2, 1, 2.0167, 1.0167, 3, 1.5)
    assert (a.gpu_used, a.gpu_idle, a.gpu_util_unknown, a.gpu_requested_unmet, a.state_completed, a.state_failed, a.requeued, a.single_core_pct) == (1, 1, 1, 0, 1, 1, 1, 33.33) and a.hours[5] == 2 and sum(a.hours) == 2
    assert (b.gpu_requested_unmet, b.core_hours, b.hours[0]) == (1, 0.0, 1)
    told = df.select("job", *(c.alias(k) for k, c in jobs.account_measures().items())).orderBy("job").collect()
    none = (None,) * 6
    assert [tuple(r)[1:] for r in told] == [(1.5, 1.0, 0.5, 3600.0, 3600.0, 1800.0), (60 / 3600, None, None, None, 60.0, 3600.0), none, none]
    assert rows(jobs.per_capita(df), "cls", "jobs_per_user", "jobs_per_work_dir") == sorted([("a", 2.0, None), ("a", 1.0, None), ("a", None, 1.0), ("b", 1.0, None), ("b", None, 1.0)], key=str)
    lookup = spark.createDataFrame([("u", "physics"), ("z", "art")], "user string, domain string")
    assert rows(jobs.domains(df, lookup), "cls", "rank", "domain", "jobs") == [("a", 1, "physics", 2), ("a", 2, "unknown", 1), ("b", 1, "physics", 1)]
    assert rows(jobs.rank_size(df), "rank", "user", "jobs", "cls") == [(1, "u", 3, "mixed"), (2, "?", 1, "a")]
    empty = df.limit(0)
    assert jobs.account(empty).count() == jobs.per_capita(empty).count() == jobs.domains(empty, lookup).count() == jobs.rank_size(empty).count() == 0
