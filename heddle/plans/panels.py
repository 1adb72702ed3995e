"""Panels and process trees as queries, with the SQL that checks them; tables as in ``queries``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import measures as M
from ..operators import panels, sequences, trees
from .queries import AS_OF, E_SQL, WEIGHED, H, S, dpct, dsum, events, query, read, weighed

RUN_SQL = f"r AS (SELECT *, {WEIGHED} AS w, k * 1.0::DOUBLE AS life, CASE WHEN k % 7 = 3 THEN NULL ELSE (k * (1 + (event_id % 5) * 0.02))::DOUBLE END AS run FROM e)"


def _runs(spark, d):
    run = F.when(F.col("k") % 7 == 3, None).otherwise(F.col("k") * (F.lit(1) + (F.col("event_id") % 5) * F.lit(0.02)))
    return events(spark, d).withColumns({"w": weighed(), "life": F.col("k").cast("double"), "run": run.cast("double")})


ODD = "run > life * 1.05::DOUBLE + 0.001::DOUBLE"


@query(f"""WITH {E_SQL}, {RUN_SQL}, x AS (SELECT *, coalesce({ODD}, false) AS odd FROM r), s AS (
SELECT cls, count(*) AS n, count(*) FILTER (odd) AS excluded, {dsum("CASE WHEN NOT odd THEN run END")} AS run, {dsum("CASE WHEN NOT odd AND run IS NOT NULL THEN life END")} AS life, {dsum("w")} AS w_sum, count(w) AS wn FROM x GROUP BY cls)
SELECT cls, n, excluded, run, {dpct("run", "life")} AS on_cpu_pct, w_sum, {dpct("wn", "n")} AS w_coverage_pct FROM s""")
def resources_by_class(spark, d):
    return panels.resources_by_class(_runs(spark, d), cls="cls", run="run", duration="life", waits=["w"])


@query(f"""WITH {E_SQL}, {RUN_SQL} SELECT user_id AS tool, count(w) AS n, {dsum("w")} AS total, max(w) AS most FROM r GROUP BY 1 HAVING count(w) > 0 ORDER BY total DESC, tool LIMIT 20""")
def stalls_by_tool(spark, d):
    return panels.stalls_by_tool(_runs(spark, d), tool="user_id", wait="w")


@query("""WITH p AS (SELECT event_id AS key, 'value' AS measure, CAST(value AS DOUBLE) AS value FROM events UNION ALL SELECT event_id, 'k', CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY value DESC, key) AS rank FROM p WHERE value IS NOT NULL) SELECT key, measure, value, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 12""")
def worst_records(spark, d):
    return panels.worst(events(spark, d), measures=["value", "k"], key="event_id")


@query(f"""WITH {E_SQL}, x AS (SELECT *, {WEIGHED} AS w, row_number() OVER (PARTITION BY host ORDER BY us DESC, event_id DESC) AS r FROM e)
SELECT host, max(us) AS last_at, max(CASE WHEN r = 1 THEN event_id END) AS last_key, max(CASE WHEN r = 1 THEN cls END) AS last_cls, count(*) AS ticks, count(DISTINCT cls) AS classes, {dsum("w")} AS w FROM x GROUP BY host""")
def host_table(spark, d):
    return panels.host_table(events(spark, d).withColumn("w", weighed()), host="host", at="us", key="event_id", cls="cls", measures=["w"])


LINE = "cls || ' --k=' || (k % 25)"


def _line() -> Column:
    return F.concat("cls", F.lit(" --k="), (F.col("k") % 25).cast("string"))


@query(f"""WITH {E_SQL} SELECT {LINE} AS line, count(*) AS n, count(DISTINCT user_id) AS users, min(us) AS first_at, max(us) AS last_at, {dsum("value")} AS value FROM e GROUP BY 1 ORDER BY n DESC, line LIMIT 30 OFFSET 5""")
def command_lines(spark, d):
    return panels.command_lines(events(spark, d), line=_line(), user="user_id", at="us", measures=["value"], order=[F.desc("n"), F.asc("line")], limit=30, offset=5)


@query(f"""WITH {E_SQL}, f AS (SELECT user_id AS tree, {LINE} AS line, min({{'at': us, 'key': event_id, 'cwd': host}}) AS f, count(*) AS n FROM e GROUP BY 1, 2),
r AS (SELECT tree, line, f.cwd AS cwd, f."at" AS "at", n, row_number() OVER (PARTITION BY tree ORDER BY f."at", f.key) AS place FROM f) SELECT tree, CAST(place AS INTEGER) AS place, line, cwd, "at", n FROM r WHERE place <= 40""")
def tool_calls_of_tree(spark, d):
    return panels.tool_calls(events(spark, d).withColumn("line", _line()), tree="user_id", line="line", at="us", key="event_id", cwd="host", cap=40)


@query("""SELECT o_orderpriority AS grp, CAST(sum(CAST(CASE WHEN o_custkey % 9 <> 0 AND o_orderkey % 5 > 0 THEN (o_custkey % 9) * ((o_orderkey % 5) * 3600 / 2.0) / 3600 END AS DECIMAL(18,4))) AS DOUBLE) AS hours,
count(*) FILTER (o_custkey % 9 <> 0 AND o_orderkey % 5 > 0) AS known, count(*) FILTER (NOT (o_custkey % 9 <> 0 AND o_orderkey % 5 > 0)) AS unknown
FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY 1""")
def requested_hours(spark, d):
    units = F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey") % 9)
    limit_s = F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_orderkey") % 5) * F.lit(1800.0))
    at = F.col("o_orderdate").cast("date")
    return panels.requested_hours(read(spark, d, "orders"), by="o_orderpriority", units=units, limit_s=limit_s, at=at, since=F.lit("1995-01-01").cast("date"), until=F.lit("1997-01-01").cast("date"))


@query(f"WITH {E_SQL} SELECT host, us // {60 * S} AS minute, count(*) AS n FROM (SELECT DISTINCT host, us, event_id FROM e) GROUP BY ALL")
def snapshots_once(spark, d):
    e = events(spark, d).select("host", "us", "event_id")
    again = e.unionByName(e.filter("event_id % 3 = 0"))  # a folder that is read again after rows were added
    once = panels.snapshots_once(again, by=["host", "us", "event_id"])
    return once.groupBy("host", F.floor(F.col("us") / (60 * S)).alias("minute")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {E_SQL}, x AS (SELECT us, CASE WHEN us >= ({AS_OF} - {5 * 24 * H}) // {H} * {H} THEN {600 * S} ELSE {H} END AS size FROM e)
SELECT us - us % size AS bin, CAST(size AS BIGINT) AS size, count(*) AS n FROM x GROUP BY ALL""")
def two_tier_counts(spark, d):
    return panels.two_tiers(events(spark, d).withColumn("one", F.lit(1)), at="us", n="one", now=AS_OF, fine=600 * S, coarse=H, keep=5 * 24 * H).withColumn("size", F.col("size").cast("bigint"))


@query(f"""WITH {E_SQL}, x AS (SELECT *, CASE WHEN cls = lag(cls) OVER w THEN 0 ELSE 1 END AS f FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
y AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM x)
SELECT user_id AS grp, CAST(run AS BIGINT) AS run, any_value(cls) AS token, count(*) AS length, min(us) AS start_us, max(us) AS end_us FROM y GROUP BY 1, 2""")
def runs_joined_at_seam(spark, d):
    e = events(spark, d)
    seam = AS_OF - 15 * 24 * H
    parts = [sequences.run_lengths(e.filter(c), by="user_id", token="cls", order=["us", "event_id"], us="us", cap=1 << 30) for c in (F.col("us") < seam, F.col("us") >= seam)]
    return panels.joined_runs(*parts, by="grp")


@query(f"""WITH {E_SQL}, t AS (SELECT user_id AS grp, string_agg(CASE cls WHEN 'click' THEN 'e' WHEN 'view' THEN CAST(k % 2 AS VARCHAR) WHEN 'signup' THEN '' WHEN 'error' THEN '' ELSE 'x' END, '' ORDER BY us, event_id) AS s FROM e GROUP BY 1),
l AS (SELECT grp, regexp_extract_all(s, '0(?:e+0){{2,}}|1(?:e+1){{2,}}') AS loops FROM t), u AS (SELECT grp, unnest(loops) AS loop, generate_subscripts(loops, 1) AS nth FROM l)
SELECT grp, CAST(nth AS INTEGER) AS nth, CAST(loop[1] AS BIGINT) AS command, CAST(length(replace(loop, 'e', '')) - 1 AS BIGINT) AS rounds FROM u""")
def rework_loops(spark, d):
    """Edits are clicks, runs are views of one of two commands, signups and errors stand for reading; purchases end a loop."""
    from pyspark.sql.window import Window

    cls = F.col("cls")
    loops = panels.rework_loops(events(spark, d), by="user_id", order=["us", "event_id"], edit=cls == "click", run=F.when(cls == "view", F.col("k") % 2), reading=cls.isin("signup", "error"))
    return loops.select("grp", F.row_number().over(Window.partitionBy("grp").orderBy("first")).alias("nth"), "command", "rounds")


@query(f"""WITH {E_SQL}, s AS (SELECT user_id AS grp, cls AS category, sum(CAST(value AS DECIMAL(18,4))) AS s FROM e GROUP BY ALL), t AS (SELECT grp, sum(s) AS total FROM s GROUP BY grp),
h AS (SELECT s.grp, category, CAST(total AS DOUBLE) AS spent, CASE WHEN total > 0 THEN round(CAST(s AS DOUBLE) / CAST(total AS DOUBLE), 4) ELSE 0.0 END AS share FROM s JOIN t USING (grp)),
c AS (SELECT grp, any_value(spent) AS spent, CASE WHEN any_value(spent) > 0 AND max(share) >= 0.5 THEN first(category ORDER BY share DESC, category) ELSE 'mixed' END AS chief FROM h GROUP BY grp)
SELECT c.grp, chief, coalesce(string_agg(category, ', ' ORDER BY share DESC, category) FILTER (share >= 0.1 AND category <> chief), '') AS also, c.spent FROM c JOIN h USING (grp) GROUP BY ALL""")
def session_use(spark, d):
    return panels.session_use(events(spark, d), by="user_id", category="cls", spent=F.col("value"))


PHASE_SQL = f"""{E_SQL}, p0 AS (SELECT user_id, us, event_id AS phase, us + k * {10 * 60 * S} AS end_us FROM e WHERE cls = 'signup'),
p AS (SELECT user_id, us AS start_us, phase, least(end_us, coalesce(lead(us) OVER (PARTITION BY user_id ORDER BY us, phase) - 1, end_us)) AS end_us FROM p0),
c AS (SELECT e.event_id, e.user_id, e.us, p.phase, p.end_us FROM (SELECT * FROM e WHERE cls <> 'signup') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.us >= p.start_us),
placed AS (SELECT event_id, user_id, CASE WHEN us <= end_us THEN phase END AS phase FROM c)"""


@query(f"""WITH {PHASE_SQL}, n AS (SELECT phase, count(*) AS n FROM placed WHERE phase IS NOT NULL GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS m FROM n)
SELECT max(m) AS phases, (SELECT count(*) FROM placed WHERE phase IS NULL) AS outside, max(CASE WHEN i = greatest(0, CAST(ceil(0.5 * m) AS BIGINT) - 1) THEN n END) AS median_calls, max(CASE WHEN i = greatest(0, CAST(ceil(0.9 * m) AS BIGINT) - 1) THEN n END) AS p90_calls, max(n) AS most_calls FROM r""")
def phase_report(spark, d):
    from pyspark.sql.window import Window

    e = events(spark, d)
    marks = e.filter("cls = 'signup'").select("user_id", F.col("us").alias("start_us"), F.col("event_id").alias("phase"), (F.col("us") + F.col("k") * 600 * S).alias("end_us"))
    following = F.lead("start_us").over(Window.partitionBy("user_id").orderBy("start_us", "phase")) - 1
    marks = marks.withColumn("end_us", F.least("end_us", F.coalesce(following, "end_us")))
    placed = panels.placed_in_phases(e.filter("cls <> 'signup'").select("event_id", "user_id", "us"), marks, by="user_id", at="us")
    # Counts of counts: the sorted list is one of distinct counts, not of phases.
    sums = placed.filter("phase IS NOT NULL").groupBy("phase").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    pairs = F.sort_array(F.collect_list(F.struct("n", "m")))
    outside = placed.agg(F.count_if(F.col("phase").isNull()).alias("outside"))
    folded = sums.agg(F.sum("m").alias("phases"), pairs.alias("x"), F.max("n").alias("most_calls"))

    def rank(q: float) -> Column:
        at = M.rank_index(q, F.col("phases"), "ceil")
        upto = F.transform("x", lambda p, i: F.struct(p["n"].alias("n"), F.aggregate(F.slice("x", 1, i + 1), F.lit(0).cast("bigint"), lambda a, b: a + b["m"]).alias("cum")))
        return F.filter(upto, lambda p: p["cum"] > at)[0]["n"]

    return folded.join(outside).select("phases", "outside", rank(0.5).alias("median_calls"), rank(0.9).alias("p90_calls"), "most_calls")


@query(f"""WITH {E_SQL}, s AS (SELECT *, user_id AS root, arg_max(k // 25, {{'a': us, 'b': k // 25}}) OVER (PARTITION BY host, user_id) AS now FROM e)
SELECT host, root, CAST(now AS BIGINT) AS session, max(value) AS rss_peak, round({dsum("value")} / count(value), 4) AS rss_mean, count(value) AS n, min(us) AS first_at, max(us) AS last_at FROM s WHERE k // 25 = now GROUP BY ALL""")
def residency(spark, d):
    e = events(spark, d).withColumn("session", F.floor(F.col("k") / 25).cast("bigint"))
    return panels.residency(e, host="host", root="user_id", session="session", at="us", rss="value")


@query(f"""WITH {E_SQL}, x AS (SELECT host, user_id AS pid, max({{'us': us, 'id': event_id, 'gone': cls = 'purchase'}}) AS x, min({{'us': us, 'id': event_id, 'p': parent}}) FILTER (parent % 2 = 0) AS p FROM e GROUP BY ALL)
SELECT host, pid, x.us AS last_at, p.p AS parent FROM x WHERE NOT x.gone""")
def live_roots(spark, d):
    e = events(spark, d).withColumn("parent", F.when(F.col("parent") % 2 == 0, F.col("parent")))
    return panels.live_roots(e, host="host", pid="user_id", at="us", key="event_id", exited=F.col("cls") == "purchase", parent="parent")


@query(f"""WITH RECURSIVE {E_SQL}, known AS (SELECT event_id AS pid, CASE WHEN parent <> event_id THEN parent END AS parent, cls, (cls = 'signup' AND k >= 50) AS tagged FROM e),
w AS (SELECT pid, parent, cls, tagged, 0 AS n FROM known WHERE tagged UNION SELECT k.pid, k.parent, k.cls, k.tagged, n + 1 FROM w JOIN known k ON k.pid = w.parent AND NOT k.tagged WHERE n < 8)
SELECT DISTINCT 0 AS host, pid, parent, cls, tagged FROM w""")
def process_index(spark, d):
    e = events(spark, d).withColumns({"host": F.lit(0), "parent": F.when(F.col("parent") != F.col("event_id"), F.col("parent"))})
    return trees.process_index(e, host="host", pid="event_id", parent="parent", at="us", key="event_id", take=["cls"], wanted=(F.col("cls") == "signup") & (F.col("k") >= 50))


OUTCOME_SQL = f"""{E_SQL}, o AS (SELECT event_id AS key, user_id, CASE WHEN parent <> event_id THEN parent END AS parent, cls IN ('click', 'view') AS w, k % 40 = 3 AS i, k % 20 = 6 AS u, CASE WHEN k % 10 = 9 THEN NULL ELSE k % 4 END AS code, CASE WHEN k % 20 = 7 THEN 9 ELSE 0 END AS sig FROM e),
b AS (SELECT key AS root, key, 0 AS depth FROM o UNION ALL SELECT b.root, o.key, depth + 1 FROM b JOIN o ON o.parent = b.key WHERE depth < 4),
f AS (SELECT root, count(*) FILTER (i) AS iso, count(*) FILTER (b.key <> root AND NOT w) AS ran, count(*) FILTER (b.key <> root AND NOT w AND u) AS unk FROM b JOIN o USING (key) GROUP BY root),
outcomes AS (SELECT o.key, user_id, CASE WHEN iso > 0 THEN 'isolated' WHEN ran > 0 AND unk > 0 THEN 'unknown' WHEN ran > 0 THEN 'not_isolated' WHEN sig <> 0 OR code <> 0 THEN 'failed' WHEN code = 0 THEN 'no_payload' ELSE 'unknown' END AS outcome FROM o JOIN f ON root = o.key WHERE w)"""


def _outcomes(spark, d):
    k = F.col("k")
    return trees.wrapper_outcomes(
        events(spark, d), key="event_id", parent="parent", wrapper=F.col("cls").isin("click", "view"), isolated=k % 40 == 3, unknown=k % 20 == 6, code=F.when(k % 10 != 9, k % 4), signal=F.when(k % 20 == 7, 9).otherwise(0)
    )


@query(f"WITH RECURSIVE {OUTCOME_SQL} SELECT key, outcome FROM outcomes")
def sandbox_outcomes(spark, d):
    return _outcomes(spark, d)


@query(f"""WITH RECURSIVE {OUTCOME_SQL}, s AS (SELECT key // 7 AS session, count(*) FILTER (outcome = 'isolated') AS isolated, count(*) FILTER (outcome = 'not_isolated') AS open, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'unknown') AS unknown FROM outcomes GROUP BY 1)
SELECT *, CASE WHEN isolated + open + failed > 0 AND isolated = isolated + open + failed THEN 'sandboxed' WHEN isolated > 0 THEN 'partial' WHEN failed > 0 THEN 'failed'
WHEN open > 0 THEN 'unsandboxed' WHEN unknown > 0 THEN 'unknown' ELSE 'no_calls' END AS verdict FROM s""")
def sandbox_verdicts(spark, d):
    """Sessions of a few calls, so that every verdict occurs."""
    return trees.session_verdicts(_outcomes(spark, d).withColumn("session", F.floor(F.col("key") / 7)), by="session")


@query(f"""WITH {E_SQL}, n AS (SELECT event_id FROM e WHERE cls <> 'error'), x AS (
SELECT c.event_id, p.event_id AS parent, 'ancestor' AS via, 0 AS r FROM e c JOIN e p ON p.event_id = c.parent AND p.us <= c.us AND p.user_id = c.user_id UNION ALL
SELECT c.event_id, d.event_id, 'same_user_daemon', 1 FROM e c JOIN (SELECT user_id, min(event_id) AS event_id FROM e WHERE cls = 'signup' GROUP BY 1 HAVING count(*) = 1) d USING (user_id) UNION ALL
SELECT event_id, k, 'tree_root', 2 FROM e WHERE k % 5 = 0),
b AS (SELECT event_id, min({{'r': r, 'p': parent, 'via': via}}) AS b FROM x WHERE parent IS NOT NULL AND parent <> event_id GROUP BY 1),
f AS (SELECT n.event_id, b.p AS parent, b.via AS via FROM n LEFT JOIN b USING (event_id)),
c AS (SELECT f.*, coalesce(o.parent = f.event_id AND f.event_id < f.parent, false) AS cyc FROM f LEFT JOIN f o ON f.parent = o.event_id)
SELECT event_id, CASE WHEN NOT cyc THEN parent END AS parent, CASE WHEN cyc THEN 'cycle' ELSE coalesce(via, 'root') END AS via FROM c""")
def parents_by_evidence(spark, d):
    e = events(spark, d)
    up = e.select(F.col("event_id").alias("parent"), F.col("us").alias("p_us"), F.col("user_id").alias("p_user"))
    near = e.join(up, "parent").filter("p_us <= us AND p_user = user_id").select("event_id", "parent", F.lit("ancestor").alias("via"))
    daemons = e.filter("cls = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("parent"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    daemon = e.drop("parent").join(daemons, "user_id").select("event_id", "parent", F.lit("same_user_daemon").alias("via"))
    root = e.filter("k % 5 = 0").select("event_id", F.col("k").alias("parent"), F.lit("tree_root").alias("via"))
    return trees.parents_by_evidence(e.filter("cls <> 'error'"), [near, daemon, root], key="event_id")


@query(f"""WITH {E_SQL}, r AS (SELECT user_id AS tree, event_id, k % 6 AS depth, us, row_number() OVER (PARTITION BY user_id ORDER BY k % 6, us, event_id) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM e)
SELECT tree, event_id, depth, CAST(place AS INTEGER) AS place, CAST(greatest(0, n - 10) AS BIGINT) AS more FROM r WHERE place <= 10""")
def tree_budget(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("tree"), "event_id", (F.col("k") % 6).alias("depth"), "us")
    return trees.budget_cut(e, tree="tree", key="event_id", depth="depth", at="us", budget=10).drop("us")
