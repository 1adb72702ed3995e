"""Growing files, waiting joins, ancestors in valid time, key index, saved and closing hours, newest rows, local days, nested far ends; tables as in ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import ancestry, series, workspace
from ..operators import events as ev
from ..sources import feeds, key_index, readback, saved_hours
from ..streaming import hour_close, live_bins, tail, waiting
from .queries import AS_OF, E_SQL, H, S, dsum, events, query, read
from .scratch import made, scratch, written

# --- files that grow

TAIL_DAYS = 240 * H  # a file holds ten days of a host


def _append(batches):
    """Rows (root, file, bytes) in order, appended to their files."""
    import pyarrow as pa
    import pyarrow.fs

    n = 0
    for batch in batches:
        roots, files, texts = (batch.column(i).to_pylist() for i in range(3))
        at = 0
        while at < len(files):
            end = at
            while end < len(files) and files[end] == files[at]:
                end += 1
            store, root = pa.fs.FileSystem.from_uri(roots[at])
            with store.open_append_stream(f"{root}/{files[at]}") as out:
                out.write("".join(texts[at:end]).encode())
            n += end - at
            at = end
    yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})


def grown(fragments, root: str, step: int) -> None:
    """Append a step's fragments, file by file in order."""
    own = fragments.filter(F.col("step") == step).repartition("file").sortWithinPartitions("file", "place")
    own.select(F.lit(root).alias("root"), "file", "text").mapInArrow(_append, "n bigint").agg(F.sum("n")).collect()


@query(f"""WITH {E_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY host, us // {TAIL_DAYS} ORDER BY us, event_id) AS i, count(*) OVER (PARTITION BY host, us // {TAIL_DAYS}) AS n FROM e)
SELECT host, cls, us // {H} AS hour, count(*) AS n, {dsum("value")} AS cost FROM l WHERE i < n GROUP BY ALL""")
def stream_growing_files(spark, d):
    """A file for each host and ten days grows in three steps that end within a line; the last line of each stays torn."""
    e = events(spark, d).select("event_id", "us", "cls", "value", "host", F.concat("host", F.lit("-"), F.floor(F.col("us") / TAIL_DAYS), F.lit(".jsonl")).alias("file"))
    by_file = Window.partitionBy("file")
    placed = e.withColumns({"i": F.row_number().over(by_file.orderBy("us", "event_id")), "of": F.count(F.lit(1)).over(by_file)})
    placed = placed.withColumn("step", F.floor(3 * (F.col("i") - 1) / F.col("of")).cast("int")).withColumn("torn", F.max("i").over(Window.partitionBy("file", "step")) == F.col("i"))
    line = F.to_json(F.struct("event_id", "us", "cls", "value", "host"))

    def piece(step, place, text):
        return F.struct(step.alias("step"), place.cast("double").alias("place"), text.alias("text"))

    here, at = F.col("step"), F.col("i")
    head, rest = piece(here, at, F.left(line, F.lit(20))), piece(here + 1, at + 0.5, F.concat(F.substring(line, 21, 1 << 30), F.lit("\n")))
    half = F.when(F.col("i") == F.col("of"), F.array(head)).otherwise(F.array(head, rest))
    whole = F.array(piece(here, at, F.concat(line, F.lit("\n"))))
    fragments = written(placed.select("file", F.explode(F.when(F.col("torn"), half).otherwise(whole)).alias("f")).select("file", "f.*"), "fragments")

    root, out, state = made(spark, scratch(spark, "growing")), scratch(spark, "lines"), scratch(spark, "offsets")
    spark.dataSource.register(tail.TailSource)
    for step in range(3):
        grown(fragments, root, step)
        stream = spark.readStream.format("heddle_tail").option("glob", "*.jsonl").option("split_bytes", 1 << 16).load(root)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    lines = spark.read.schema(tail.SCHEMA).parquet(out)
    good = lines.select(F.from_json("line", "event_id bigint, us bigint, cls string, value double, host bigint").alias("r")).select("r.*")
    return good.groupBy("host", "cls", F.floor(F.col("us") / H).alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("cost"))


# --- children that wait

WAITED_SQL = f"""WITH {E_SQL}, r AS (SELECT event_id AS id, host, k % 20 AS pid, us // 1000 AS ms, cls = 'purchase' AS is_parent FROM e),
p AS (SELECT host, pid, ms, min(id) AS id FROM r WHERE is_parent GROUP BY ALL),
f AS (SELECT c.id AS child, p.id AS parent, p.ms - c.ms AS waited_ms FROM (SELECT * FROM r WHERE NOT is_parent) c ASOF LEFT JOIN p ON c.host = p.host AND c.pid = p.pid AND c.ms <= p.ms)
SELECT child, CASE WHEN waited_ms <= {24 * waiting.HOUR_MS} THEN parent END AS parent, CASE WHEN waited_ms <= {24 * waiting.HOUR_MS} THEN waited_ms END AS waited_ms FROM f"""


def _family(spark, d):
    return events(spark, d).select(F.col("event_id").alias("id"), "host", (F.col("k") % 20).alias("pid"), F.timestamp_micros("us").alias("at"), (F.col("cls") == "purchase").alias("is_parent"))


@query(WAITED_SQL)
def children_waited(spark, d):
    return waiting.waited(_family(spark, d), key=["host", "pid"], is_parent="is_parent", row_id="id", at="at")


@query(WAITED_SQL)
def stream_children_waited(spark, d):
    """The same as a stream of slices of time; a row far ahead of all moves the watermark past the last of them."""
    rows = _family(spark, d)
    folder, out, state = scratch(spark, "slices"), scratch(spark, "waited"), scratch(spark, "waiting")
    cuts = [0, *(AS_OF - n * 24 * H for n in (20, 10, 5)), 1 << 60]
    slices = [rows.filter((F.unix_micros("at") >= a) & (F.unix_micros("at") < b)) for a, b in zip(cuts, cuts[1:])]
    ends = [spark.range(1).select(F.lit(-1).cast("bigint").alias("id"), F.lit(-1).cast("bigint").alias("host"), F.lit(-1).cast("bigint").alias("pid"), F.timestamp_micros(F.lit(AS_OF + n * 24 * H)).alias("at"), F.lit(True).alias("is_parent")) for n in (40, 80)]
    for part in [*slices, *ends]:
        part.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        joined = waiting.waiting_join(stream, key=["host", "pid"], is_parent="is_parent", row_id="id", at="at")
        joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(waiting.OUT).parquet(out)


# --- ancestors

PROCESS_SQL = f"""{E_SQL}, p AS (SELECT event_id AS key, host, k + 2 AS pid, (k * 7 + 13) % 102 AS parent_pid, CASE event_id % 11 WHEN 0 THEN 'root' WHEN 1 THEN NULL ELSE 'u' || (event_id % 11 // 6) END AS "user", us AS start,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE us + (1 + event_id % 6) * {36 * H} END AS "end", event_id % 4 = 0 AS node, event_id % 37 = 0 AS daemon, cls,
  CASE WHEN event_id % 5 < 4 THEN 'pend' WHEN event_id % 2 = 0 THEN 'call' ELSE 'hk' END AS fate FROM e)"""
#: The process of ``held`` that had the parent's pid of each of ``asked`` when it started
HOLDER_SQL = """SELECT c.key, CASE WHEN h.key IS NOT NULL AND coalesce(h."end" + 1000000 >= c.start, true) THEN h.key END AS up,
  CASE WHEN h.key IS NULL THEN CASE WHEN EXISTS (SELECT 1 FROM {held} x WHERE x.host = c.host AND x.pid = c.parent_pid) THEN 'earlier' ELSE 'none' END WHEN h."end" + 1000000 < c.start THEN 'later' ELSE 'child' END AS kin
  FROM (SELECT * FROM {asked} WHERE parent_pid > 1) c ASOF LEFT JOIN (SELECT host, pid, start, max(key) AS key, arg_max("end", key) AS "end" FROM {held} GROUP BY ALL) h ON c.host = h.host AND c.parent_pid = h.pid AND c.start + 1000000 >= h.start"""
CONFLICT_SQL = "coalesce({a} <> {b} AND {a} <> 'root' AND {b} <> 'root', false)"


def _processes(spark, d):
    user = F.when(F.col("event_id") % 11 == 0, "root").when(F.col("event_id") % 11 > 1, F.concat(F.lit("u"), F.floor(F.col("event_id") % 11 / 6).cast("string")))
    return events(spark, d).select(
        F.col("event_id").alias("key"), "host", (F.col("k") + 2).alias("pid"), ((F.col("k") * 7 + 13) % 102).alias("parent_pid"), user.alias("user"), F.col("us").alias("start"),
        F.when(F.col("event_id") % 13 != 0, F.col("us") + (1 + F.col("event_id") % 6) * 36 * H).alias("end"), "cls",
        F.when(F.col("event_id") % 5 < 4, "pend").when(F.col("event_id") % 2 == 0, "call").otherwise("hk").alias("fate"),
    )


@query(f"""WITH RECURSIVE {PROCESS_SQL}, u AS ({HOLDER_SQL.format(asked="p", held="p")}),
w AS (SELECT p.key AS n, p."user" AS nu, p.start AS ns, u.up AS cur, 1 AS i FROM p JOIN u USING (key) WHERE node AND NOT daemon AND up IS NOT NULL
  UNION ALL SELECT w.n, nu, ns, u.up, i + 1 FROM w JOIN p c ON c.key = w.cur AND NOT c.node AND NOT {CONFLICT_SQL.format(a="nu", b='c."user"')} JOIN u ON u.key = c.key WHERE u.up IS NOT NULL AND i < 64),
f AS (SELECT w.n, c.key AS ancestor, i FROM w JOIN p c ON c.key = w.cur AND c.node AND c.key <> w.n AND NOT {CONFLICT_SQL.format(a="nu", b='c."user"')} AND c.start - 1000000 <= ns AND coalesce(ns <= c."end" + 1000000, true))
SELECT key, f.ancestor, CAST(f.i AS BIGINT) AS n FROM p LEFT JOIN f ON f.n = p.key WHERE node""")
def ancestors_in_time(spark, d):
    return ancestry.nearest_nodes(_processes(spark, d), ancestry.Process(), is_node=F.col("key") % 4 == 0, is_daemon=F.col("key") % 37 == 0)


@query(f"""WITH RECURSIVE {PROCESS_SQL}, c AS (SELECT * FROM p WHERE cls = 'error'), o AS (SELECT * FROM p WHERE cls <> 'error'), j AS (SELECT * FROM o WHERE fate = 'pend'),
first AS ({HOLDER_SQL.format(asked="c", held="o")}), further AS ({HOLDER_SQL.format(asked="j", held="o")}),
w AS (SELECT c.key AS n, c."user" AS nu, f.up AS cur, 0 AS i, {CONFLICT_SQL.format(a='c."user"', b='o."user"')} AS strange FROM c JOIN first f USING (key) JOIN o ON o.key = f.up
  UNION ALL SELECT n, nu, g.up, i + 1, strange OR {CONFLICT_SQL.format(a="nu", b='o."user"')} FROM w JOIN further g ON g.key = w.cur AND g.kin = 'child' JOIN o ON o.key = g.up WHERE i < 9),
e2 AS (SELECT n, arg_max({{'cur': cur, 'i': i, 'strange': strange}}, i) AS x FROM w GROUP BY n)
SELECT c.key, CASE WHEN f.kin = 'earlier' THEN 'unplaced' WHEN coalesce(f.kin, 'none') <> 'child' THEN 'running' WHEN x.i > 8 THEN 'hops_out' WHEN x.strange THEN 'unplaced' WHEN o.fate <> 'pend' THEN 'routed' WHEN g.kin = 'earlier' THEN 'unplaced' ELSE 'running' END AS status,
  CASE WHEN status = 'routed' THEN o.fate END AS fate, CASE WHEN status = 'routed' THEN o.key END AS what, CASE WHEN status = 'routed' THEN CAST(x.i AS BIGINT) END AS n
FROM c LEFT JOIN first f USING (key) LEFT JOIN e2 ON e2.n = c.key LEFT JOIN o ON o.key = x.cur LEFT JOIN further g ON g.key = x.cur""")
def late_children(spark, d):
    p = _processes(spark, d).withColumn("what", F.col("key"))
    return ancestry.late_children(p.filter("cls = 'error'"), p.filter("cls <> 'error'"), ancestry.Process(), fate="fate", what="what")


@query("""WITH RECURSIVE l AS (SELECT event_id AS key, (event_id * event_id + 1) % 9973 AS parent FROM events),
w AS (SELECT key AS s, parent AS c, 1 AS i FROM l UNION ALL SELECT s, l.parent, i + 1 FROM w JOIN l ON l.key = w.c WHERE c <> s AND i < 600),
y AS (SELECT s, min(c) AS least FROM w WHERE s IN (SELECT s FROM w WHERE c = s) GROUP BY s)
SELECT l.key, CASE WHEN y.least = l.key THEN NULL ELSE l.parent END AS parent, coalesce(y.least = l.key, false) AS cut FROM l LEFT JOIN y ON y.s = l.key""")
def cycles_cut(spark, d):
    links = read(spark, d, "events").select(F.col("event_id").alias("key"), ((F.col("event_id") * F.col("event_id") + 1) % 9973).alias("parent"))
    return ancestry.cut_cycles(links)


# --- the key index


@query("SELECT event_id, user_id, event_type AS cls FROM events WHERE event_id IN (3, 77, 500, 501, 999)")
def keys_found_by_index(spark, d):
    """Written in two parts, each indexed when it comes."""
    history, index = scratch(spark, "history"), scratch(spark, "index")
    rows = read(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    for part in (rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1")):
        part.repartitionByRange("day", "ts").write.partitionBy("day").mode("append").parquet(history)
        key_index.extend_key_index(spark, history, index, key="event_id")
    found = key_index.search_keys(spark, history, index, key="event_id", keys=[3, 77, 500, 501, 999])
    return found.select("event_id", "user_id", F.col("event_type").alias("cls"))


# --- saved hours


def hour_parts(rows):
    return rows.groupBy("hour", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("cost"))


@query(f"""WITH {E_SQL}, x AS (SELECT * FROM e UNION ALL SELECT * FROM e WHERE CAST(ts AS DATE) = DATE '2024-01-10' AND event_id % 5 = 0)
SELECT us // {24 * H} AS day, cls, count(*) AS n, {dsum("value")} AS cost FROM x GROUP BY ALL""")
def saved_hours_refreshed(spark, d):
    """All hours are saved, six to a folder, then rows come late to one day: its folders alone are made again."""
    source, saved = scratch(spark, "source"), scratch(spark, "saved")
    rows = events(spark, d).select("event_id", "cls", "value", "ts", (F.floor(F.col("us") / (6 * H)) * 6).alias("hour"))
    rows.repartition("hour").write.partitionBy("hour").parquet(source)
    saved_hours.refresh(spark, source, saved, hour_parts)
    late = rows.filter((F.col("ts").cast("date") == "2024-01-10") & (F.col("event_id") % 5 == 0))
    late.repartition("hour").write.partitionBy("hour").mode("append").parquet(source)
    saved_hours.refresh(spark, source, saved, hour_parts)
    parts = saved_hours.parts(spark, saved)
    return parts.groupBy(F.floor(F.col("hour") / 24).alias("day"), "cls").agg(F.sum("n").alias("n"), F.sum("cost").cast("double").alias("cost"))


# --- hours that close

GRACE, HORIZON = 6 * H, 8 * 24 * H
CUTS = [0, *(AS_OF - n * 24 * H for n in (24, 18, 12, 6)), 1 << 60]
#: A row comes with the slice of its time, or one or three slices later.
DELAY_SQL = "CASE WHEN event_id % 29 = 0 THEN 3 WHEN event_id % 17 = 0 THEN 1 ELSE 0 END"
SLICE_SQL = " + ".join(f"(us >= {c})::INT" for c in CUTS[1:-1])


@query(f"""WITH {E_SQL}, s AS (SELECT *, us // {H} AS hour, {SLICE_SQL} + {DELAY_SQL} AS slice FROM e), g AS (SELECT slice, max(us) AS top FROM s GROUP BY slice),
m AS (SELECT s.*, (SELECT max(top) FROM g WHERE g.slice < s.slice) AS mark FROM s),
k AS (SELECT *, CASE WHEN mark IS NULL OR (hour + 1) * {H} > mark - {GRACE} THEN 'on_time' WHEN (hour + 1) * {H} > mark - {HORIZON} THEN 'patch' ELSE 'dropped' END AS kind FROM m)
SELECT hour, cls, count(*) FILTER (kind <> 'dropped') AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) FILTER (kind <> 'dropped') AS DOUBLE) AS cost, count(*) FILTER (kind = 'patch') AS patched, count(*) FILTER (kind = 'dropped') AS dropped
FROM k WHERE (hour + 1) * {H} <= (SELECT max(us) FROM e) - {GRACE} GROUP BY hour, cls""")
def stream_hours_closed(spark, d):
    """Slices of time with rows that come one or three slices late: some patch a closed hour, some are dropped."""
    delay = F.when(F.col("event_id") % 29 == 0, 3).when(F.col("event_id") % 17 == 0, 1).otherwise(0)
    rows = events(spark, d).select("event_id", "us", "cls", "value").withColumn("slice", sum(((F.col("us") >= c).cast("int") for c in CUTS[1:-1]), delay))
    folder, path, state = scratch(spark, "slices"), scratch(spark, "closed"), scratch(spark, "closing")
    write = hour_close.closing(path, us="us", cls="cls", cost="value", grace_us=GRACE, horizon_us=HORIZON)
    for i in range(len(CUTS) + 2):
        part = rows.filter(F.col("slice") == i).drop("slice")
        part.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(part.schema).parquet(folder)
        stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return hour_close.closed_hours(spark, path, grace_us=GRACE)


@query(f"""WITH {E_SQL} SELECT us // {H} AS hour, cls, count(*) AS n, {dsum("value")} AS cost FROM e GROUP BY ALL""")
def stream_bins_closed(spark, d):
    """Windows that the watermark closes, in append mode; two rows far ahead move it past the last."""
    rows = events(spark, d).select("us", "cls", "value")
    folder, out, state = scratch(spark, "slices"), scratch(spark, "windows"), scratch(spark, "window-state")
    slices = [rows.filter((F.col("us") >= a) & (F.col("us") < b)) for a, b in zip(CUTS, CUTS[1:])]
    ends = [spark.range(1).select(F.lit(AS_OF + n * 24 * H).alias("us"), F.lit("end").alias("cls"), F.lit(0.0).alias("value")) for n in (40, 80)]
    for part in [*slices, *ends]:
        part.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        bins = live_bins.minute_bins(stream, us="us", cls="cls", cost="value", width="1 hour", grace="5 minutes")
        flat = bins.select(F.floor(F.unix_micros("w.start") / H).alias("hour"), "cls", "n", "cost")
        flat.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("hour bigint, cls string, n bigint, cost double").parquet(out).filter("cls <> 'end'")


# --- the newest rows


@query(f"WITH {E_SQL}, r AS (SELECT event_id, us, cls, row_number() OVER (ORDER BY us DESC, event_id DESC) AS r FROM e WHERE cls = 'error') SELECT CAST((r - 1) // 15 AS INTEGER) AS page, event_id, us FROM r WHERE r <= 30")
def newest_error_pages(spark, d):
    """Two pages of the newest errors, each from the newest days alone."""
    history = scratch(spark, "history")
    feeds.write_history(read(spark, d, "events"), history, ts="ts")
    page = lambda before: readback.newest_rows(spark, history, 15, at="ts", key="event_id", where=F.col("event_type") == "error", before=before)
    first = page(None)
    last = first.agg(F.min(F.struct("ts", "event_id")).alias("m")).first()["m"]
    pages = [first, page((last["ts"], last["event_id"]))]
    own = [p.select(F.lit(i).alias("page"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")) for i, p in enumerate(pages)]
    return own[0].unionByName(own[1])


# --- local days

ZONE = "America/New_York"


@query(f"""WITH o AS (SELECT epoch_us(o_orderdate) + o_orderkey % 24 * {H} AS us, o_totalprice FROM orders), l AS (SELECT CAST(timezone('{ZONE}', make_timestamptz(us)) AS DATE) AS day, o_totalprice FROM o),
b AS (SELECT min(day) AS a, max(day) AS z FROM l), s AS (SELECT CAST(unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM b),
g AS (SELECT day, count(*) AS n, {dsum("o_totalprice")} AS cost FROM l GROUP BY day)
SELECT day, (epoch_us(timezone('{ZONE}', (day + 1)::TIMESTAMP)) - epoch_us(timezone('{ZONE}', day::TIMESTAMP))) / {H}.0::DOUBLE AS hours, coalesce(n, 0) AS n, cost FROM s LEFT JOIN g USING (day)""")
def orders_by_local_day(spark, d):
    """Days of New York, two of each year with 23 or 25 hours."""
    orders = read(spark, d, "orders").withColumn("us", F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 24 * H)
    return series.by_local_day(orders, us="us", zone=ZONE, cost="o_totalprice")


# --- far ends in nested lists


def _linked(spark, d):
    """Events as lines of JSON with nested lists, read again."""
    end = lambda i: F.struct(
        F.concat(F.lit("10.0.0."), ((F.col("event_id") + i) % 7).cast("string")).alias("addr"), F.when(i < 3, 80 + i).alias("port"), F.when((F.col("k") + i) % 4 > 0, "tcp").alias("proto"), ((F.col("event_id") + i) % 5 == 0).alias("inbound"),
        ((F.col("k") + i) % 11 == 0).alias("external"), F.when((F.col("k") + i) % 3 == 0, F.concat(F.lit("p"), F.col("host"))).alias("provider"), (i + 1).alias("calls"), (F.col("k") + i).alias("tx_bytes"), (2 * i).alias("rx_bytes"),
    )
    lost = F.when(F.col("k") % 6 == 0, F.struct((F.col("k") % 3).alias("calls"), (F.col("k") % 5).alias("tx_bytes"), F.lit(1).alias("rx_bytes")))
    lists = F.when(F.col("k") % 9 > 0, F.transform(F.when(F.col("k") % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("k") % 4)), end))
    rows = events(spark, d).select("event_id", "cls", lists.alias("endpoints"), lost.alias("lost"), F.when(F.col("k") % 2 == 0, F.col("k")).alias("sent"), F.lit(0).alias("received"))
    path = scratch(spark, "linked")
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    schema = spark.createDataFrame([], f"event_id bigint, cls string, endpoints array<struct<{ev.ENDPOINT}>>, lost struct<{ev.LOST}>, sent bigint, received bigint").schema
    return feeds.read_jsonl(spark, path, schema)[0]


FAR_SQL = f"""{E_SQL}, x AS (SELECT event_id, cls, k, host, unnest(CASE WHEN k % 4 = 0 THEN [] ELSE range(0, k % 4 + 1) END) AS i FROM e WHERE k % 9 > 0),
f AS (SELECT event_id AS key, cls, i, '10.0.0.' || ((event_id + i) % 7) AS addr, (event_id + i) % 5 = 0 AS inbound, CASE WHEN (k + i) % 4 > 0 THEN 'tcp' ELSE '?' END || '/' || CASE WHEN i < 3 THEN CAST(80 + i AS VARCHAR) ELSE '?' END AS port,
  (k + i) % 11 = 0 AS external, CASE WHEN (k + i) % 3 = 0 THEN 'p' || host END AS provider, i + 1 AS calls, k + i AS tx, 2 * i AS rx FROM x)"""


@query(f"""WITH {FAR_SQL}, s AS (SELECT addr, inbound, cls, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(tx) AS BIGINT) AS tx, CAST(sum(rx) AS BIGINT) AS rx, count(DISTINCT key) AS records FROM f GROUP BY ALL),
q AS (SELECT addr, inbound, port, sum(calls) AS n FROM f GROUP BY ALL), p AS (SELECT addr, inbound, first(port ORDER BY n DESC, port) AS port, count(*) AS ports FROM q GROUP BY ALL),
t AS (SELECT addr, inbound, bool_or(external) AS external, first(provider ORDER BY key, i) FILTER (provider IS NOT NULL) AS provider FROM f GROUP BY ALL)
SELECT * FROM s JOIN p USING (addr, inbound) JOIN t USING (addr, inbound)""")
def far_ends(spark, d):
    return ev.nested_endpoints(_linked(spark, d), key="event_id", cls="cls", endpoints="endpoints")


@query(f"""WITH {FAR_SQL}, l AS (SELECT cls, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(tx) AS BIGINT) AS tx, CAST(sum(rx) AS BIGINT) AS rx FROM f GROUP BY cls),
o AS (SELECT cls, count(*) FILTER (k % 9 > 0) AS records, CAST(coalesce(sum(k % 3) FILTER (k % 9 > 0 AND k % 6 = 0), 0) AS BIGINT) AS lost_calls, CAST(coalesce(sum(k % 5) FILTER (k % 9 > 0 AND k % 6 = 0), 0) AS BIGINT) AS lost_tx,
  count(*) FILTER (k % 9 > 0 AND k % 6 = 0) AS lost_rx, count(*) FILTER (k % 9 = 0 AND k % 2 = 0 AND k > 0) AS missing, CAST(coalesce(sum(k) FILTER (k % 9 = 0 AND k % 2 = 0), 0) AS BIGINT) AS missing_bytes FROM e GROUP BY cls)
SELECT o.*, coalesce(calls, 0) AS calls, coalesce(tx, 0) AS tx, coalesce(rx, 0) AS rx FROM o LEFT JOIN l USING (cls)""")
def far_end_coverage(spark, d):
    return ev.endpoint_coverage(_linked(spark, d), key="event_id", cls="cls", endpoints="endpoints", lost="lost", sent="sent", received="received")


# --- where agents worked

#: Deep paths of many and of few siblings, below the users' homes
DIR_SQL = """'/home/u' || (user_id % 5) || '/p' || (k % 20) || CASE WHEN k % 7 = 0 THEN '' ELSE '/run' || (event_id % 23) || CASE WHEN k % 3 = 0 THEN '' ELSE '/d' || (event_id % 4) || '/e' || (k % 9) || '/f' || (k % 2) END END"""


def _level_sql(level: int) -> str:
    most, keep = workspace.TOP if level == 1 else workspace.BELOW
    return f"""a{level} AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS parent FROM o{level} WHERE level = {level}),
b{level} AS (SELECT *, count(*) OVER w > {most} AND row_number() OVER (w ORDER BY procs + 3 * names DESC, path) > {keep} AS folds FROM a{level} WINDOW w AS (PARTITION BY agent, anchor, parent)),
o{level - 1} AS (SELECT agent, anchor, path, level, sum(raw) AS raw, sum(procs) AS procs, sum(names) AS names FROM (SELECT agent, anchor, path, level, raw, procs, names FROM o{level} WHERE level < {level}
  UNION ALL SELECT agent, anchor, parent, {level - 1}, raw, procs, names FROM b{level} WHERE folds) GROUP BY ALL)"""


@query(f"""WITH {E_SQL}, d AS (SELECT user_id % 10 AS agent, '/home/u' || (user_id % 5) AS anchor, {DIR_SQL} AS full_path, count(*) AS procs, count(DISTINCT k % 6) AS names FROM e GROUP BY ALL),
s AS (SELECT *, list_filter(string_split(substr(full_path, length(anchor) + 1), '/'), lambda x: x <> '')[:4] AS steps FROM d),
o4 AS (SELECT agent, anchor, anchor || CASE WHEN len(steps) > 0 THEN '/' || array_to_string(steps, '/') ELSE '' END AS path, len(steps) AS level, count(*) AS raw, sum(procs) AS procs, sum(names) AS names FROM s GROUP BY ALL),
{", ".join(_level_sql(level) for level in (4, 3, 2, 1))},
z AS (SELECT agent, anchor, path, level, raw, procs, names FROM o0 {" ".join(f"UNION ALL SELECT agent, anchor, path, level, raw, procs, names FROM b{level} WHERE NOT folds" for level in (1, 2, 3, 4))})
SELECT agent, anchor, path, CAST(level AS INTEGER) AS level, CAST(raw AS BIGINT) AS raw, CAST(procs AS BIGINT) AS procs, CAST(names AS BIGINT) AS names FROM z""")
def workspace_rolled_up(spark, d):
    full = F.expr(DIR_SQL)
    dirs = events(spark, d).groupBy((F.col("user_id") % 10).alias("agent"), F.concat(F.lit("/home/u"), F.col("user_id") % 5).alias("anchor"), full.alias("path")).agg(F.count(F.lit(1)).alias("procs"), F.countDistinct(F.col("k") % 6).alias("names"))
    return workspace.rolled_up(dirs, by="agent", path="path", anchor="anchor", measures=["procs", "names"], activity=F.col("procs") + 3 * F.col("names"))


@query()
def tasks_merged(spark, d):
    """Pieces are a user's events of half an hour and class; at most two tasks a day stay."""
    piece = F.floor(F.col("us") / (H // 2))
    pieces = events(spark, d).groupBy("user_id", piece.alias("piece")).agg(F.min("us").alias("at"), F.sort_array(F.collect_set(F.col("k") % 12)).alias("names"))
    pieces = pieces.withColumns({"day": F.floor(F.col("at") / (24 * H)), "stretch": F.floor(F.col("at") / (72 * H))})
    return workspace.merged_tasks(pieces, by="user_id", at="at", day="day", stretch="stretch", names="names", cap=2)
