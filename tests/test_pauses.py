"""Pauses, rankings, states, reasons, node histories and small text functions, and their empty cases."""

import hashlib
import hmac

from pyspark.sql import functions as F

from heddle.functions import taxonomy, text
from heddle.operators import live, sequences, series, stats

S, M, H = 1_000_000, 60_000_000, 3_600_000_000


def pause(spark, steps):
    """Steps (start s, end s, kind, command) of one sequence."""
    df = spark.createDataFrame([("g", i, a * S, None if b is None else b * S, k, c) for i, (a, b, k, c) in enumerate(steps)], "g string, i int, a bigint, b bigint, k string, c string")
    got = sequences.pauses(df, by="g", order=["i"], start="a", end="b", kind="k", command="c")
    return sorted(((r["from_us"] // S, r["to_us"] // S, r["what"], r["why"]) for r in got.collect()))


def test_pauses(spark):
    assert pause(spark, [(0, 10, "test", "p"), (30, 40, "test", "p")]) == [(10, 30, "edit_guess", "between_runs")]
    assert pause(spark, [(0, 10, "test", "p"), (29, 40, "test", "p")]) == [], "19 seconds are too few"
    assert pause(spark, [(0, 10, "test", "p"), (30, 40, "test", "q")]) == [], "another command, and nothing read"
    assert pause(spark, [(0, 10, "test", "p"), (11, 12, "explore", ""), (40, 41, "run", "q")]) == [(12, 40, "edit_guess", "after_reading")]
    assert pause(spark, [(0, 10, "test", "p"), (11, 12, "git", ""), (40, 41, "test", "p")]) == [(12, 40, "edit_guess", "between_runs")]
    assert pause(spark, [(0, 10, "test", "p"), (11, 12, "build", "m"), (40, 41, "test", "p")]) == [], "a build lies between"
    assert pause(spark, [(0, 1, "edit", ""), (2, 3, "explore", ""), (40, 41, "test", "p")]) == [], "an edit was seen"
    assert pause(spark, [(0, 1, "edit", ""), (2, 3, "test", "p"), (40, 41, "test", "p")]) == [(3, 40, "edit_guess", "between_runs")], "an edit before the last run does not count"
    assert pause(spark, [(0, 10, "test", "p"), (310, 320, "test", "p")]) == [(10, 310, "idle", None)], "a long pause is idle alone"
    assert pause(spark, [(0, 5000, "run", "p"), (10, 20, "git", ""), (400, 401, "git", "")]) == [(20, 400, "idle", None)], "an earlier step that still runs holds no gap"
    assert pause(spark, [(0, None, "run", "p"), (400, 401, "git", "")]) == [] and pause(spark, [(0, 1, None, None), (400, 401, None, None)]) == [(1, 400, "idle", None)] and pause(spark, []) == []


def test_rankings(spark):
    rows = [(1, "u", 5.0, 9, True), (2, "u", 5.0, 8, False), (3, "v", None, 7, True), (4, None, 2.0, None, None)]
    df = spark.createDataFrame(rows, "k int, u string, x double, at bigint, real boolean")
    got = stats.rankings(df, key="k", user="u", measures={"x": F.col("x"), "at": F.col("at")}, weights={"at": F.lit(1)}, only={"at": F.col("real")}, n=3)
    by = {(r.ranking, r["rank"]): (r.key, r.value, r.user_share_pct, r.dominant_pct) for r in got.collect()}
    assert by == {("x", 1): (1, 5.0, 83.33, 83.33), ("x", 2): (2, 5.0, 83.33, 83.33), ("x", 3): (4, 2.0, 16.67, 83.33), ("at", 1): (1, 9.0, 50.0, 50.0), ("at", 2): (3, 7.0, 50.0, 50.0)}
    assert stats.rankings(df.limit(0), key="k", user="u", measures={"x": F.col("x")}).count() == 0
    assert all(r.user_share_pct == 0 for r in stats.rankings(df.withColumn("x", F.lit(0.0)), key="k", user="u", measures={"x": F.col("x")}).collect()), "shares of nothing are 0"


def test_running_state(spark):
    sessions = [(1, 9, True, 0), (2, 9, True, live.START_AGE_US), (3, 9, True, live.START_AGE_US + 1), (4, 9, True, None), (5, 7, True, 0), (6, None, True, 0), (7, 9, False, 0), (8, 9, None, 0)]
    s = spark.createDataFrame(sessions, "grp int, at_us bigint, told boolean, base_age_us bigint")
    above = spark.createDataFrame([(1, "make", 3, 1), (1, "gcc", 1, 2), (3, "ls", 1, 1), (5, "ls", 1, 1)], "grp int, name string, n bigint, rank int")
    got = {r.grp: (r.state, r.commands) for r in live.running_state(s, above, fresh_us=8).collect()}
    unknown = ("unknown", None)
    assert got == {1: ("running", "make:3,gcc:1"), 2: ("idle", None), 3: ("running", "ls:1"), 4: unknown, 5: unknown, 6: unknown, 7: unknown, 8: unknown}
    assert live.running_state(s.limit(0), above.limit(0), fresh_us=8).count() == 0


def test_reason(spark):
    rows = [("a\nsbatch: error: bad 12\nlast", 1, None), ("one\ntwo 3\n\n", 1, 0), ("", None, None), (None, 2, 9), ("x --password=hunter2x", 1, None), ("\x1b[1msrun: error: Unable to allocate\x1b[0m\r\n", 1, None)]
    df = spark.createDataFrame(rows, "t string, c int, s int").coalesce(1)
    got = [tuple(r) for r in df.select(taxonomy.reason(F.col("t"), F.col("c"), F.col("s")), taxonomy.refused(F.col("t"))).collect()]
    assert got == [
        ("sbatch: error: bad N", True), ("two N", False), ("exit None, nothing printed", False), ("exit 2, signal 9, nothing printed", False), (f"x --password={text.MARK}", False), ("srun: error: Unable to allocate", True),
    ]


def test_keyed_alias(spark):
    for key in ("salt", "k" * 64, "k" * 65, "schlüssel"):
        df = spark.createDataFrame([("ada",), ("żółw",), ("",), (None,)], "n string").coalesce(1)
        want = [None if n is None else "user-" + hmac.new(key.encode(), f"user:{n}".encode(), hashlib.sha256).hexdigest()[:8] for n in ("ada", "żółw", "", None)]
        assert [r[0] for r in df.select(text.keyed_alias("user", F.col("n"), key)).collect()] == want


def test_resources_and_durations(spark):
    df = spark.createDataFrame([("cpu=4,gres/gpu=2,xcpu=9", 59.5), ("gres/gpu:a=1", 60.5), ("", 86399.6), (None, None), ("cpu=", 180000.0)], "t string, s double").coalesce(1)
    got = [tuple(r) for r in df.select(text.resource(F.col("t"), "cpu"), text.resource(F.col("t"), "gres/gpu"), text.as_duration(F.col("s"))).collect()]
    assert got == [("4", "2", "00:01:00"), (None, None, "00:01:00"), (None, None, "1-00:00:00"), (None, None, None), (None, None, "2-02:00:00")]


def test_node_history(spark):
    rows = [("a", 0, 1.0, 2.0), ("a", H + M, None, 4.0), ("a", H + 2 * M, 7.0, None), ("b", 2 * H + M, 3.0, 1.0), ("old", -40 * H, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "h string, us bigint, x double, y double")
    got = series.node_history(df, host="h", us="us", fields={"x": "max", "y": "mean"}, now_us=2 * H + 5 * M, window_us=2 * H + 5 * M)
    r = got.collect()  # gaps of 3660 and 60 seconds: bins of at least twice 1860
    assert {(x.host, x.bin * x.bin_s // 60, x.snapshots, x.x, x.y) for x in r if x.snapshots} == {("a", 0, 3, 7.0, 3.0), ("b", 120, 1, 3.0, 1.0)} and {x.host for x in r} == {"a", "b"}
    assert {x.bin_s for x in r} == {7200} and all(x.x is None and x.y is None for x in r if x.snapshots is None) and len(r) == 2 * len({x.bin for x in r})
    assert series.node_history(df.limit(0), host="h", us="us", fields={"x": "max"}, now_us=H, window_us=H).count() == 0


def test_a_reason_reads_the_lines_once(spark):
    df = spark.createDataFrame([("a\nb", 1, 9)], "t string, c int, s int").select(taxonomy.reason(F.col("t"), F.col("c"), F.col("s")).alias("why"))
    assert df._jdf.queryExecution().analyzed().toString().count("split(") == 1 and df.first()[0] == "b"
