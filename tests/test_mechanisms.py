"""Growing files, waiting joins and ancestors in valid time, on small cases and against brute force."""

import random
import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F

from heddle.operators import ancestry, events, series, workspace
from heddle.plans import scratch
from heddle.sources import key_index, readback, saved_hours
from heddle.streaming import hour_close, tail, waiting

S = 1_000_000


# --- files that grow


def all_lines(files, split):
    files.split = split
    whole = files.whole()
    return [(b["file"], b["at"], b["line"]) for s in files.stretches({}, whole) for batch in files.lines(s) for b in batch.to_pylist()]


@pytest.mark.parametrize("split", [1, 2, 3, 7, 1 << 20])
def test_stretches_hold_each_whole_line_once(tmp_path, split):
    r = random.Random(split)
    (tmp_path / "day").mkdir()
    texts = {"a.jsonl": "one\ntwo\n\nthree\ntorn", "day/b.jsonl": "".join("x" * r.randint(0, 9) + "\n" for _ in range(50)), "c.jsonl": "no end", "d.jsonl": "", "e.txt": "other\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    want = []
    for name in sorted(texts):
        at = 0
        for line in texts[name].split("\n")[:-1] if name.endswith("l") else []:
            want.append((name, at, line))
            at += len(line) + 1
    assert sorted(all_lines(tail.Files({"path": f"file://{tmp_path}", "glob": "*.jsonl"}), split)) == sorted(want)


def test_blocks_smaller_than_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "BLOCK", 3)
    (tmp_path / "a").write_text("a long line\nb\nanother long one\ntorn tail of a line")
    files = tail.Files({"path": str(tmp_path)})
    assert [x[2] for x in all_lines(files, 4)] == ["a long line", "b", "another long one"]


def test_a_torn_line_waits_and_a_new_file_is_read_from_its_start(tmp_path):
    files = tail.Files({"path": str(tmp_path)})
    read = lambda a, b: [x["line"] for s in files.stretches(a, b) for batch in files.lines(s) for x in batch.to_pylist()]
    f = tmp_path / "f"
    f.write_text("1\n2")
    first = files.whole()
    assert first == {"f": 2} and read({}, first) == ["1"]
    with f.open("a") as out:
        out.write("2\n3\n4")
    second = files.whole()
    assert read(first, second) == ["22", "3"] and read(second, files.whole()) == []
    f.write_text("n\n")
    third = files.whole()
    assert read(second, third) == ["n"]
    f.unlink()
    assert files.whole() == {} and files.stretches(third, {}) == []


def test_a_stream_follows_a_file(spark, tmp_path):
    spark.dataSource.register(tail.TailSource)
    feed = tmp_path / "feed"
    feed.mkdir()

    def run():
        stream = spark.readStream.format("heddle_tail").option("split_bytes", 4).load(str(feed))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return [r.line for r in spark.read.parquet(str(tmp_path / "out")).orderBy("file", "at").collect()]

    (feed / "a").write_text("first\nsec")
    assert run() == ["first"]
    with (feed / "a").open("a") as out:
        out.write("ond\nthird\nfo")
    assert run() == ["first", "second", "third"] == run()
    assert sorted(r.line for r in spark.read.format("heddle_tail").load(str(feed)).collect()) == ["first", "second", "third"]


# --- children that wait


def test_waiting_is_brute_force(spark):
    r = random.Random(4)
    rows = [(i, r.choice("ab"), r.randint(0, 400), r.random() < 0.15) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, k string, hour bigint, is_parent boolean").withColumn("at", F.timestamp_seconds(F.col("hour") * 3600))
    got = {x.child: (x.parent, x.waited_ms) for x in waiting.waited(df, key=["k"], is_parent="is_parent", row_id="id", at="at").collect()}
    for i, k, hour, is_parent in rows:
        if not is_parent:
            ahead = sorted((h, j) for j, kk, h, p in rows if p and kk == k and h >= hour)
            assert got.pop(i) == ((ahead[0][1], (ahead[0][0] - hour) * 3_600_000) if ahead and ahead[0][0] - hour <= 24 else (None, None))
    assert not got


class Handle:
    """State of one key in memory, with its timers."""

    def __init__(self):
        self.held, self.now, self.timers, self.registered, self.reads = [], None, set(), 0, 0

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        h = self
        return type("Value", (), {"get": lambda _: h.now, "update": lambda _, v: setattr(h, "now", v), "clear": lambda _: setattr(h, "now", None)})()

    def get(self):
        self.reads += 1
        return iter(self.held)

    def put(self, rows):
        self.held = list(rows)

    def appendList(self, rows):
        self.held += rows

    def appendValue(self, row):
        self.held.append(row)

    def clear(self):
        self.held = []

    def registerTimer(self, at):
        self.registered += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_a_key_that_waits_reads_its_state_once_a_batch():
    r = random.Random(6)
    wait, handle = 40, Handle()
    waits = waiting.Waiting(wait)
    waits.init(handle)
    rows = [(i, 10 * batch + r.randint(0, 14), r.random() < 0.1) for batch in range(50) for i in range(40 * batch, 40 * batch + 40)]
    got, clock = {}, type("Clock", (), {"getCurrentWatermarkInMs": lambda self: self.now})()
    for batch in range(51):
        frame = pd.DataFrame(rows[40 * batch : 40 * batch + 40], columns=["id", "ms", "is_parent"])
        handle.registered = handle.reads = 0
        list(waits.handleInputRows(("k",), iter([frame] if len(frame) else []), None))
        clock.now = 10 * batch - 1 if batch < 50 else 10_000
        for due in sorted(t for t in handle.timers if t <= clock.now):
            handle.timers.discard(due)
            for out in waits.handleExpiredTimer(("k",), clock, None):
                assert not got.keys() & set(out["child"])
                got |= {c: (None, None) if pd.isna(p) else (p, w) for c, p, w in zip(out["child"], out["parent"], out["waited_ms"])}
        assert handle.reads <= 1 and handle.registered <= 2
    for i, ms, is_parent in rows:
        if not is_parent:
            ahead = min(((m, j) for j, m, p in rows if p and m >= ms), default=(10_000, None))
            assert got.pop(i) == ((ahead[1], ahead[0] - ms) if ahead[0] - ms <= wait else (None, None))
    assert not got and not handle.held and not handle.timers


def test_waiting_looks_back_once_and_cuts_time(spark):
    rows = spark.range(1).selectExpr("id", "true AS p", "current_timestamp() AS at", "'a' AS k")
    plan = waiting.waited(rows, key=["k"], is_parent="p", row_id="id", at="at")._jdf.queryExecution().analyzed().toString().lower()
    assert "unboundedfollowing" not in plan and "_stretch" in plan  # a frame to the end is summed anew for each row


def test_waiting_over_the_ends_of_stretches(spark):
    rows = [(1, 23, False), (2, 47, True), (3, 48, False), (4, 72, True), (5, 72, True), (6, 72, False), (7, 73, False), (8, -1, False), (9, 22, False)]
    df = spark.createDataFrame([(i, "a", h, p) for i, h, p in rows], "id bigint, k string, hour bigint, is_parent boolean").withColumn("at", F.timestamp_seconds(F.col("hour") * 3600))
    got = {x.child: x.parent for x in waiting.waited(df, key=["k"], is_parent="is_parent", row_id="id", at="at").collect()}
    assert got == {1: 2, 3: 4, 6: 4, 7: None, 8: None, 9: None}


# --- ancestors

NAMES = ancestry.Process()
ROWS = "key bigint, host string, pid bigint, parent_pid bigint, user string, start bigint, `end` bigint"


def nodes(spark, rows, node, daemon=()):
    df = spark.createDataFrame([(k, "h", pid, up, user, a * S, None if b is None else b * S) for k, pid, up, user, a, b in rows], ROWS)
    got = ancestry.nearest_nodes(df, NAMES, is_node=F.col("key").isin(*node), is_daemon=F.col("key").isin(*daemon) if daemon else F.lit(False))
    return {r.key: (r.ancestor, r.n) for r in got.collect()}


def test_ancestors_through_processes_that_are_no_nodes(spark):
    rows = [(1, 10, 1, "u", 0, 100), (2, 11, 10, "u", 5, 50), (3, 12, 11, None, 6, 50), (4, 13, 12, "u", 7, 50)]
    assert nodes(spark, rows, [1, 4]) == {1: (None, None), 4: (1, 3)}


def test_a_pid_that_is_used_again(spark):
    # pid 10 belonged to 1 until 20 and to 2 from 30 on
    rows = [(1, 10, 0, "u", 0, 20), (2, 10, 0, "u", 30, 60), (3, 11, 10, "u", 10, 90), (4, 12, 10, "u", 40, 90), (5, 13, 10, "u", 25, 90), (6, 14, 10, "u", 80, 90)]
    assert nodes(spark, rows, [1, 2, 3, 4, 5, 6]) == {1: (None, None), 2: (None, None), 3: (1, 1), 4: (2, 1), 5: (None, None), 6: (None, None)}


def test_users_that_conflict_break_the_chain(spark):
    rows = [(1, 10, 0, "a", 0, None), (2, 11, 10, "b", 1, None), (3, 12, 11, "a", 2, None), (4, 13, 11, None, 2, None), (5, 14, 11, "root", 2, None), (6, 15, 11, "b", 2, None)]
    assert nodes(spark, rows, [1, 3, 4, 5, 6]) == {1: (None, None), 3: (None, None), 4: (1, 2), 5: (1, 2), 6: (None, None)}


def test_a_daemon_roots_itself_and_long_chains_end(spark):
    rows = [(i, 10 + i, 9 + i, "u", i, None) for i in range(1, 100)]
    assert nodes(spark, rows, [1, 50, 60], daemon=[50]) == {1: (None, None), 50: (None, None), 60: (50, 10)}
    assert nodes(spark, rows, [1, 65, 67]) == {1: (None, None), 65: (1, 64), 67: (65, 2)}
    assert nodes(spark, rows, [1, 66]) == {1: (None, None), 66: (None, None)}


def test_processes_that_start_each_other(spark):
    rows = [(1, 10, 11, "u", 0, None), (2, 11, 10, "u", 0, None), (3, 12, 11, "u", 1, None)]
    assert nodes(spark, rows, [3]) == {3: (None, None)}


@pytest.mark.parametrize("seed", range(4))
def test_cycles_of_any_length(spark, seed):
    r = random.Random(seed)
    n = 60
    parent = {i: r.choice([None, i, r.randrange(n), r.randrange(n), r.randrange(n)]) for i in range(n)}
    if seed == 0:
        parent = {i: (i + 1) % n for i in range(n)}
    got = {x.key: (x.parent, x.cut) for x in ancestry.cut_cycles(spark.createDataFrame(list(parent.items()), "key bigint, parent bigint")).collect()}
    for k in range(n):
        way, at = [], k
        while at is not None and at not in way:
            way.append(at)
            at = parent[at]
        first = at == k and k == min(way)
        assert got[k] == ((None, True) if first else (parent[k], False))


def test_late_children(spark):
    notes = [(1, "h", 10, 9, "u", 0, 50 * S, "pend"), (2, "h", 9, 8, "u", 0, 60 * S, "call"), (3, "h", 20, 19, "u", 0, 9 * S, "pend"), (4, "h", 30, 1, "v", 0, 90 * S, "hk"), (5, "h", 40, 1, "u", 30 * S, 90 * S, "hk")]
    notes += [(100 + i, "h", 100 + i, 101 + i, "u", 0, None, "pend" if i < 20 else "root") for i in range(21)]
    children = [(50, "h", 1000, 10), (51, "h", 1001, 20), (52, "h", 1002, 30), (53, "h", 1003, 40), (54, "h", 1004, 77), (55, "h", 1005, 9), (56, "h", 1006, 100), (57, "h", 1007, 112), (58, "h", 1008, 111), (59, "h", 1009, 1)]
    n = spark.createDataFrame(notes, ROWS + ", fate string").withColumn("what", F.col("key"))
    c = spark.createDataFrame([(*x, "u", 5 * S, None) for x in children] + [(60, "h", 1, 20, "u", 30 * S, None)], ROWS)
    got = {r.key: (r.status, r.fate, r.what, r.n) for r in ancestry.late_children(c, n, NAMES, fate="fate", what="what").collect()}
    assert got == {
        50: ("routed", "call", 2, 1), 51: ("running", None, None, None), 52: ("unplaced", None, None, None), 53: ("unplaced", None, None, None), 54: ("running", None, None, None),
        55: ("routed", "call", 2, 0), 56: ("hops_out", None, None, None), 57: ("routed", "root", 120, 8), 58: ("hops_out", None, None, None), 59: ("running", None, None, None), 60: ("running", None, None, None),
    }


# --- the key index


def test_a_search_reads_the_files_that_hold_the_key(spark, tmp_path):
    history, index = f"file://{tmp_path}/history", f"file://{tmp_path}/index"
    rows = spark.range(4000).select(F.col("id"), (F.col("id") % 20).alias("day"), F.concat(F.lit("s"), F.floor(F.col("id") / 4)).alias("session"))
    rows.filter("id < 3000").repartition(4, "day").write.partitionBy("day").parquet(history)
    files = len(spark.read.parquet(history).inputFiles())
    assert key_index.extend_key_index(spark, history, index, key="session") == files
    assert key_index.extend_key_index(spark, history, index, key="session") == 0
    rows.filter("id >= 3000").repartition(4, "day").write.mode("append").partitionBy("day").parquet(history)
    assert key_index.extend_key_index(spark, history, index, key="session") == len(spark.read.parquet(history).inputFiles()) - files
    for keys in (["s7"], ["s7", "s999"], ["nowhere"], []):
        got = key_index.search_keys(spark, history, index, key="session", keys=keys)
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in rows.filter(F.col("session").isin(keys) if keys else F.lit(False)).collect())
        assert set(got.columns) == {"id", "day", "session"}
    assert len(key_index.search_keys(spark, history, index, key="session", keys=["s7"]).inputFiles()) <= 4 < files


# --- saved hours


def test_a_refresh_makes_changed_hours_alone(spark, tmp_path):
    source, saved = f"file://{tmp_path}/source", f"file://{tmp_path}/saved"
    rows = spark.range(100).select((F.col("id") % 5).alias("hour"), F.col("id").alias("v"))
    rows.repartition("hour").write.partitionBy("hour").parquet(source)
    seen = []

    def compute(df):
        seen.append(sorted(r.hour for r in df.select("hour").distinct().collect()))
        return df.filter("v < 1000").groupBy("hour").agg(F.sum("v").alias("v"))

    def state():
        return {r.hour: r.v for r in saved_hours.parts(spark, saved).collect()}

    assert saved_hours.refresh(spark, source, saved, compute) == saved_hours.Refreshed([0, 1, 2, 3, 4], [])
    first = state()
    assert saved_hours.refresh(spark, source, saved, compute) == saved_hours.Refreshed([], []) and seen == [[0, 1, 2, 3, 4]]
    spark.createDataFrame([(3, 7), (9, 1), (8, 5000)], "hour bigint, v bigint").write.partitionBy("hour").mode("append").parquet(source)
    shutil.rmtree(tmp_path / "source" / "hour=1")
    assert saved_hours.refresh(spark, source, saved, compute) == saved_hours.Refreshed([3, 8, 9], [1])
    assert seen[1] == [3, 8, 9] and state() == {h: v for h, v in {**first, 3: first[3] + 7, 9: 1}.items() if h != 1}
    shutil.rmtree(tmp_path / "source" / "hour=9")
    spark.createDataFrame([(3, 5000)], "hour bigint, v bigint").write.partitionBy("hour").mode("append").parquet(source)
    assert saved_hours.refresh(spark, source, saved, compute) == saved_hours.Refreshed([3], [9])
    assert state() == {h: v for h, v in {**first, 3: first[3] + 7}.items() if h != 1}
    assert {r.hour for r in saved_hours.parts(spark, saved, first=2, last=3).collect()} == {2, 3}


# --- hours that close


def test_hours_close_and_late_rows_patch_or_drop(spark, tmp_path):
    path, hour = f"file://{tmp_path}/closed", hour_close.HOUR_US
    write = hour_close.closing(path, us="us", cls="cls", cost="cost", grace_us=hour, horizon_us=5 * hour)
    batch = lambda *rows: spark.createDataFrame([(int(h * hour), "a", 1.5) for h in rows], "us bigint, cls string, cost double")
    write(batch(0.5, 1.5, 8.5), 0)
    late = batch(0.7, 1.7, 5.5, 6.9, 7.9)  # ends 1, 2, 6, 7, 8 against a mark of 8.5
    write(late, 1)
    write(late, 1)  # replayed
    write(batch(3.5, 10.0), 2)
    got = {r.hour: (r.n, r.cost, r.patched, r.dropped) for r in hour_close.closed_hours(spark, path, grace_us=hour).collect()}
    assert got == {0: (1, 1.5, 0, 1), 1: (1, 1.5, 0, 1), 3: (1, 1.5, 1, 0), 5: (1, 1.5, 1, 0), 6: (1, 1.5, 1, 0), 7: (1, 1.5, 0, 0), 8: (1, 1.5, 0, 0)}


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Fake:
        master = "spark://host:7077"

    class Session:
        sparkContext, conf = Fake(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch(Session(), "x")


# --- the newest rows, local days, nested far ends


def test_newest_rows_open_the_newest_days_alone(spark, tmp_path):
    history = f"file://{tmp_path}/history"
    rows = [(i, f"2024-01-{1 + i // 10:02d} 00:00:{i % 10:02d}", i % 3) for i in range(100)]
    spark.createDataFrame(rows, "id int, ts string, k int").withColumn("ts", F.to_timestamp("ts")).withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(history)
    got = readback.newest_rows(spark, history, 5, at="ts", key="id")
    assert [r.id for r in got.collect()] == [99, 98, 97, 96, 95] and all("day=2024-01-10" in f for f in got.inputFiles())
    third = readback.newest_rows(spark, history, 5, at="ts", key="id", where=F.col("k") == 0)
    assert [r.id for r in third.collect()] == [99, 96, 93, 90, 87] and {f.split("day=")[1][:10] for f in third.inputFiles()} <= {"2024-01-10", "2024-01-09", "2024-01-08"}
    last = third.collect()[-1]
    assert [r.id for r in readback.newest_rows(spark, history, 3, at="ts", key="id", where=F.col("k") == 0, before=(last.ts, last.id)).collect()] == [84, 81, 78]
    assert readback.newest_rows(spark, history, 500, at="ts", key="id").count() == 100
    assert readback.newest_rows(spark, history, 5, at="ts", key="id", where=F.col("k") == 9).count() == 0


def test_local_days_of_23_and_25_hours(spark):
    us = lambda t: F.unix_micros(F.lit(t).cast("timestamp"))
    df = spark.range(2).select(F.when(F.col("id") == 0, us("2024-03-09 12:00:00")).otherwise(us("2024-11-04 12:00:00")).alias("us"), F.lit(1.5).alias("cost"))
    days = {str(r.day): r for r in series.by_local_day(df, us="us", zone="America/New_York", cost="cost").collect()}
    assert len(days) == 241 and {d for d, r in days.items() if r.hours != 24} == {"2024-03-10", "2024-11-03"}
    assert days["2024-03-10"].hours == 23 and days["2024-11-03"].hours == 25 and days["2024-03-10"].n == 0 and days["2024-03-10"].cost is None and days["2024-03-09"].n == 1
    spans = series.local_days(df, us="us", zone="America/New_York").orderBy("day").collect()
    assert all(a.end_us == b.start_us for a, b in zip(spans, spans[1:]))
    assert series.by_local_day(df.limit(0), us="us", zone="America/New_York", cost="cost").count() == 0


def test_far_ends(spark):
    schema = f"key int, cls string, ends array<struct<{events.ENDPOINT}>>, lost struct<{events.LOST}>, sent bigint, received bigint"
    rows = [
        (1, "a", [("h", 80, "tcp", False, None, None, 1, 10, 5), ("h", 443, "tcp", None, True, "p2", 3, 1, -4), None, ("", 1, "x", True, True, "no", 9, 9, 9)], (1, 2, 3), 7, 7),
        (2, "a", [("h", 80, "tcp", False, False, "p1", 2, None, 1), ("g", None, None, True, False, "", 1, 1, 1)], None, None, None),
        (3, "b", None, (5, 5, 5), 4, None), (4, "b", [], None, 4, 4), (5, "b", None, None, 0, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {(r.addr, r.inbound, r.cls): (r.calls, r.tx, r.rx, r.records, r.port, r.ports, r.external, r.provider) for r in events.nested_endpoints(df, key="key", cls="cls", endpoints="ends").collect()}
    assert got == {("h", False, "a"): (6, 11, 6, 2, "tcp/443", 2, True, "p2"), ("g", True, "a"): (1, 1, 1, 1, "?/?", 1, False, None)}
    cover = {r.cls: r.asDict() for r in events.endpoint_coverage(df, key="key", cls="cls", endpoints="ends", lost="lost", sent="sent", received="received").collect()}
    assert cover["a"] == {"cls": "a", "records": 2, "lost_calls": 1, "lost_tx": 2, "lost_rx": 3, "missing": 0, "missing_bytes": 0, "calls": 7, "tx": 12, "rx": 7}
    assert cover["b"] == {"cls": "b", "records": 1, "lost_calls": 0, "lost_tx": 0, "lost_rx": 0, "missing": 1, "missing_bytes": 4, "calls": 0, "tx": 0, "rx": 0}


# --- where agents worked


def rolled(dirs, depth, top, below):
    """The same, row by row: dirs {path: procs} below one anchor '/a'."""
    rows = {}
    for path, n in dirs.items():
        steps = [s for s in path[2:].split("/") if s][:depth]
        raw, procs = rows.get(tuple(steps), (0, 0))
        rows[tuple(steps)] = (raw + 1, procs + n)
    for level in range(depth, 0, -1):
        most, keep = top if level == 1 else below
        for parent in {p[:-1] for p in rows if len(p) == level}:
            kids = sorted((p for p in rows if len(p) == level and p[:-1] == parent), key=lambda p: (-rows[p][1], p))
            for p in kids[keep:] if len(kids) > most else []:
                raw, procs = rows.pop(p)
                a, b = rows.get(parent, (0, 0))
                rows[parent] = (a + raw, b + procs)
    return {"/a" + "".join(f"/{s}" for s in p): v for p, v in rows.items()}


@pytest.mark.parametrize("seed", range(3))
def test_directories_roll_up(spark, seed):
    r = random.Random(seed)
    dirs = {"/a" + "".join(f"/{r.choice('bcdefgh')}" for _ in range(r.randint(0, 6))): r.randint(1, 5) for _ in range(150)}
    df = spark.createDataFrame([("x", p + ("/" if i % 5 == 0 else ""), "/a", n) for i, (p, n) in enumerate(dirs.items())], "agent string, path string, anchor string, procs bigint")
    got = workspace.rolled_up(df, by="agent", path="path", anchor="anchor", measures=["procs"], activity=F.col("procs"), depth=3, top=(4, 2), below=(3, 1))
    assert {x.path: (x.raw, x.procs) for x in got.collect()} == rolled(dirs, 3, (4, 2), (3, 1))


def merged_one_by_one(days, stretches, names, cap):
    """Look at all pairs before each merge."""
    flat = [(d, s, set(x), [i]) for i, (d, s, x) in enumerate(zip(days, stretches, names))]
    while True:
        held = {}
        for d, *_ in flat:
            held[d] = held.get(d, 0) + 1
        pairs = [(workspace.jaccard(a[2], b[2]), a[0] == b[0], -k, k) for k, (a, b) in enumerate(zip(flat, flat[1:])) if a[1] == b[1] and held[b[0]] > cap and a[0] in (b[0], b[0] - 1)]
        if not pairs:
            return [next(g[3][0] for g in flat if i in g[3]) for i in range(len(days))]
        k = max(pairs)[3]
        a, b = flat[k], flat.pop(k + 1)
        flat[k] = (a[0], a[1], a[2] | b[2], a[3] + b[3])


@pytest.mark.parametrize("seed", range(30))
def test_pieces_merge_as_one_by_one(seed):
    r = random.Random(seed)
    n = r.randint(0, 40)
    days = sorted(r.randint(0, 5) for _ in range(n))
    stretches = sorted(r.randint(0, 3) for _ in range(n))
    names = [{r.choice("abcdef") for _ in range(r.randint(0, 4))} for _ in range(n)]
    for cap in (1, 2, 5):
        assert workspace.merged_pieces(days, stretches, names, cap) == merged_one_by_one(days, stretches, names, cap)


def test_tasks_merge_by_session(spark):
    r = random.Random(3)
    rows = [(s, t, t // 10, t // 40, [r.choice("abcd") for _ in range(3)]) for s in "xyz" for t in sorted(r.sample(range(100), 30))]
    df = spark.createDataFrame(rows, "s string, t bigint, day bigint, stretch bigint, names array<string>")
    got = {(x.grp, x.at): x.task_at for x in workspace.merged_tasks(df, by="s", at="t", day="day", stretch="stretch", names="names", cap=2).collect()}
    for s in "xyz":
        own = [x for x in rows if x[0] == s]
        head = merged_one_by_one([x[2] for x in own], [x[3] for x in own], [set(x[4]) for x in own], 2)
        assert [got[s, x[1]] for x in own] == [own[h][1] for h in head]


def test_as_of_by_stretches_is_as_of(spark):
    from heddle.operators import lineage

    r = random.Random(8)
    some = lambda n, *xs: [(i, r.choice([1, 2, None]), r.choice([None, *range(0, 300, 7)]) if r.random() < 0.9 else r.randint(-50, 400), *xs) for i in range(n)]
    left, right = spark.createDataFrame(some(300), "id bigint, g int, at bigint"), spark.createDataFrame(some(80), "k bigint, g int, since bigint")
    plain, cut = (lineage.as_of(left, right, by=["g"], left_at="at", right_at="since", take=["k"], key="k", stretch=s) for s in (None, 20))
    assert sorted(map(repr, cut.collect())) == sorted(map(repr, plain.collect()))


def test_holders_are_looked_up_by_stretches(spark):
    df = spark.createDataFrame([(1, "h", 5, 3, "u", 0, 10)], ROWS)
    plan = ancestry.holder_at_start(df, df, NAMES, slack_us=1)._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(host#" in plan and "_s#" in plan
