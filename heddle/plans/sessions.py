"""Views, accounting distributions, submissions and calls as queries; tables as in ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import taxonomy, text
from ..operators import lineage, views
from .queries import AS_OF, E_SQL, H, S, dpct, dsum, events, query, read
from .records import SUBMITS, _pick, _pick_sql

ASKED = [("user", "1,2"), ("user", "3"), ("cls", "click,view"), ("least", "5"), ("since", "2024-01-05"), ("until", "1705708800")]


@query(f"""WITH {E_SQL} SELECT event_id, user_id, cls, us, CASE WHEN length(a) > 20 THEN left(a, 19) || '…' ELSE a END AS args FROM (SELECT *, cls || repeat('-x', k % 20) AS a FROM e)
WHERE user_id IN (1, 2, 3) AND cls IN ('click', 'view') AND coalesce(value, 0) >= 5 AND us >= 1704412800000000 AND us < 1705708800000000""")
def view_of_page(spark, d):
    wanted = views.view_filter(views.parse_filters(ASKED, sets=("user", "cls"), minima=("least",)), us="us", sets={"user": "user_id", "cls": "cls"}, minima={"least": "value"})
    args = F.concat("cls", F.expr("repeat('-x', cast(k % 20 as int))"))
    return views.who(events(spark, d).filter(wanted), columns=["event_id", "user_id", "cls", "us"], args=args, most=20)


@query(f"WITH {E_SQL} SELECT cls, count(*) AS n, '7 d' AS label FROM e WHERE us >= {AS_OF} - {7 * 24 * H} AND us < {AS_OF} GROUP BY cls")
def window_clamped(spark, d):
    start, end, label = views.resolve_window(20_000, now_us=AS_OF)
    return events(spark, d).filter((F.col("us") >= start) & (F.col("us") < end)).groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.lit(label).alias("label"))


@query(f"""WITH x AS (SELECT l_returnflag AS grp, round(least(1.5, l_quantity / 40.0), 4) AS a, CASE WHEN date_diff('day', CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)) BETWEEN -60 AND -1 THEN CAST(-date_diff('day', CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)) AS DOUBLE) END AS b
FROM lineitem JOIN orders ON l_orderkey = o_orderkey), p AS (SELECT grp, 'efficiency' AS measure, a AS v FROM x UNION ALL SELECT grp, 'wait', b FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, measure ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY grp, measure) AS n FROM p WHERE v IS NOT NULL)
SELECT grp, measure, any_value(n) AS n, {dsum("v")} / any_value(n) AS mean, max(CASE WHEN i = CAST(round_even(0.5::DOUBLE * (n - 1), 0) AS BIGINT) THEN v END) AS p50, max(CASE WHEN i = CAST(round_even(0.9::DOUBLE * (n - 1), 0) AS BIGINT) THEN v END) AS p90 FROM r GROUP BY ALL""")
def job_distributions(spark, d):
    steps = read(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity", "l_shipdate")
    joined = steps.join(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    wait = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    measures = {"efficiency": F.least(F.lit(1.5), F.col("l_quantity") / F.lit(40.0)), "wait": F.when(wait.between(1, 60), wait.cast("double"))}
    return views.distributions(joined, by="l_returnflag", measures=measures)


@query(f"""WITH {E_SQL}, x AS (SELECT cls, {_pick_sql(SUBMITS, "k")} AS args, CASE WHEN k % 4 = 1 THEN event_id END AS job, k % 3 AS code, k % 10 = 0 AS refused, k % 11 < 3 AS q, k, event_id FROM e),
y AS (SELECT *, CASE WHEN args LIKE '%--test-only%' THEN 'dry_run' WHEN job IS NOT NULL THEN 'job' WHEN args LIKE '% --jobid%' OR args LIKE '% --overlap%' THEN 'step' WHEN code <> 0 AND (args LIKE 'sbatch%' OR refused) THEN 'rejected' ELSE 'no_id' END AS o FROM x),
s AS (SELECT cls, count(*) FILTER (q) AS queries, count(*) FILTER (o = 'job') AS jobs, count(*) FILTER (o = 'rejected') AS rejected, count(*) FILTER (o = 'dry_run') AS dry_runs, count(*) FILTER (o = 'step') AS steps,
count(*) FILTER (o IN ('job', 'rejected', 'no_id')) AS asked, count(DISTINCT regexp_replace(args || ' ' || (k % 3), '[0-9]+', '#', 'g')) AS shapes, {dsum("CASE WHEN o = 'job' THEN (k % 5) * 2.5 END")} AS hours FROM y GROUP BY cls)
SELECT *, {dpct("rejected", "asked")} AS rejected_pct, queries + 10 * (jobs + rejected) + steps AS weight FROM s""")
def submissions_by_class(spark, d):
    args, code = _pick(SUBMITS, "k"), F.col("k") % 3
    outcome = taxonomy.submit_outcome(args, F.when(F.col("k") % 4 == 1, F.col("event_id")), code, F.split(args, " ")[0], F.col("k") % 10 == 0)
    shape = F.regexp_replace(F.concat(args, F.lit(" "), (F.col("k") % 3).cast("string")), "[0-9]+", "#")
    return views.submissions_by_class(events(spark, d), cls="cls", outcome=outcome, query=F.col("k") % 11 < 3, shape=shape, job_hours=(F.col("k") % 5) * F.lit(2.5))


@query(f"""WITH RECURSIVE {E_SQL}, f AS (SELECT c.event_id, CASE WHEN c.parent <> c.event_id THEN c.parent END AS parent, c.parent <> c.event_id AND p.cls = 'signup' AS direct FROM e c JOIN e p ON p.event_id = c.parent),
w AS (SELECT event_id AS key, event_id AS pos, 0 AS n FROM f UNION ALL SELECT w.key, f.parent, n + 1 FROM w JOIN f ON f.event_id = w.pos WHERE NOT f.direct AND f.parent IS NOT NULL AND n < 64),
o AS (SELECT w.key, f.event_id AS call FROM w JOIN f ON f.event_id = w.pos WHERE f.direct)
SELECT coalesce(call, -1) AS call, count(*) AS processes, {dsum("value")} AS cost FROM e LEFT JOIN o ON o.key = event_id GROUP BY 1""")
def calls_of_processes(spark, d):
    e = events(spark, d)
    up = e.select(F.col("event_id").alias("parent"), F.col("cls").alias("p_cls"))
    own = e.join(up, "parent").withColumn("direct", (F.col("parent") != F.col("event_id")) & (F.col("p_cls") == "signup"))
    own = own.withColumn("parent", F.when(F.col("parent") != F.col("event_id"), F.col("parent")))
    calls = lineage.owners(own, key="event_id", parent="parent", is_owner=F.col("direct"))
    both = e.join(calls.select(F.col("key").alias("event_id"), F.col("owner").alias("call")), "event_id", "left")
    return both.groupBy(F.coalesce("call", F.lit(-1)).alias("call")).agg(F.count(F.lit(1)).alias("processes"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("cost"))


@query(f"""WITH {E_SQL}, x AS (SELECT user_id AS session, us, k, CASE WHEN cls IN ('click', 'view') THEN 'submit' WHEN cls = 'signup' THEN 'query' WHEN k % 2 = 0 THEN 'cancel' WHEN cls = 'error' THEN 'run' END AS kind,
  CASE k % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'dry_run' WHEN 2 THEN 'step' WHEN 3 THEN 'no_id' ELSE 'job' END AS o0, event_id FROM e),
y AS (SELECT *, CASE WHEN event_id % 3 > 0 THEN 'job' ELSE o0 END AS o, CASE k % 4 WHEN 0 THEN 'gpu,test' WHEN 1 THEN 'gpu' WHEN 2 THEN ' shared , gpu' ELSE NULL END AS part, CASE WHEN k % 3 > 0 THEN k % 3 END AS g,
  CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE k % 6 END AS tasks, CASE WHEN k % 7 > 0 THEN (k % 7) * 1800 END AS lim FROM x WHERE kind IS NOT NULL),
s AS (SELECT session, min(us) AS first_us, max(us) AS last_us, {", ".join(f"count(*) FILTER (kind = 'submit' AND o = '{o}') AS {o}" for o in ("job", "rejected", "no_id", "step", "dry_run"))},
  count(*) FILTER (kind = 'query') AS queries, count(*) FILTER (kind = 'cancel') AS cancels, count(*) FILTER (kind = 'run') AS runs, count(*) FILTER (kind = 'run' AND k % 4 = 1) AS runs_failed,
  count(*) FILTER (kind = 'submit' AND o = 'job' AND g > 0) AS gpu_jobs, CAST(coalesce(sum(g * CASE WHEN coalesce(tasks, 1) > 0 THEN coalesce(tasks, 1) ELSE 1 END) FILTER (kind = 'submit' AND o = 'job' AND g > 0), 0) AS BIGINT) AS gpus,
  CAST(sum(CAST(g * coalesce(tasks, 1) * lim / 3600.0::DOUBLE AS DECIMAL(18,4))) FILTER (kind = 'submit' AND o = 'job' AND g > 0 AND lim > 0 AND coalesce(tasks, 1) > 0) AS DOUBLE) AS gpu_hours,
  count(*) FILTER (kind = 'submit' AND o = 'job' AND g > 0 AND lim > 0 AND coalesce(tasks, 1) > 0) AS gpu_hours_known FROM y GROUP BY session),
m AS (SELECT session, max(n) AS peak_minute FROM (SELECT session, us // 60000000, count(*) AS n FROM y WHERE kind = 'submit' AND o = 'job' GROUP BY ALL) GROUP BY session),
q AS (SELECT session, trim(p) AS p, count(*) AS n FROM (SELECT session, unnest(string_split(part, ',')) AS p FROM y WHERE kind = 'submit' AND o = 'job') GROUP BY ALL),
r AS (SELECT session, count(*) AS partitions, first(p ORDER BY n DESC, p) AS chief_partition FROM q GROUP BY session)
SELECT s.*, coalesce(peak_minute, 0) AS peak_minute, coalesce(partitions, 0) AS partitions, chief_partition, CASE WHEN job > 0 THEN round(queries / job, 4) END AS queries_a_job FROM s LEFT JOIN m USING (session) LEFT JOIN r USING (session)""")
def batch_use_by_session(spark, d):
    k, cls = F.col("k"), F.col("cls")
    kind = F.when(cls.isin("click", "view"), "submit").when(cls == "signup", "query").when(k % 2 == 0, "cancel").when(cls == "error", "run")
    outcome = F.when(F.col("event_id") % 3 > 0, "job").otherwise(F.element_at(F.array(*map(F.lit, ("rejected", "dry_run", "step", "no_id", "job"))), (k % 5 + 1).cast("int")))
    partition = F.when(k % 4 == 0, "gpu,test").when(k % 4 == 1, "gpu").when(k % 4 == 2, " shared , gpu")
    tasks = F.when(k % 6 == 1, 0).when(k % 6 > 1, k % 6)
    return views.batch_use_by_session(
        events(spark, d), session="user_id", us="us", kind=kind, outcome=outcome, partition=partition, gpus=F.when(k % 3 > 0, k % 3), tasks=tasks, limit_s=F.when(k % 7 > 0, (k % 7) * 1800), failed=k % 4 == 1
    )


@query(f"""WITH {E_SQL}, x AS (SELECT cls, CASE WHEN k % 20 = 7 THEN 13 WHEN k % 20 = 8 THEN 9 + k // 20 ELSE 0 END AS sig, CASE WHEN k % 10 = 9 THEN NULL ELSE k % 13 END AS code FROM e),
y AS (SELECT cls, CASE WHEN sig <> 0 THEN 'signal' ELSE 'code' END AS kind, CAST(CASE WHEN sig <> 0 THEN sig ELSE code END AS BIGINT) AS value FROM x WHERE sig <> 0 OR (code > 0 AND NOT (code = 1 AND cls = 'view'))),
c AS (SELECT cls, kind, value, count(*) AS n FROM y GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY cls, kind ORDER BY n DESC, value) AS INTEGER) AS rank FROM c) SELECT * FROM r WHERE rank <= 8""")
def top_exits(spark, d):
    k = F.col("k")
    signal, code = F.when(k % 20 == 7, 13).when(k % 20 == 8, 9 + F.floor(k / 20)).otherwise(0), F.when(k % 10 != 9, k % 13)
    verdict = text.verdict(code, signal, F.when(F.col("cls") == "view", "grep").otherwise("make"))
    return views.top_exits(events(spark, d), cls="cls", verdict=verdict, code=code, signal=signal)
