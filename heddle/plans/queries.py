"""Every operator as a query on the driver's tables, with the SQL that checks it.

``events`` stands for the record stream (user_id: user, event_type: class or
tool, value: cost, props.k: a counter, user_id % 4: host, event_id: process id
whose parent is event_id div 3); orders and lineitem for jobs and their steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import shell, text
from ..operators import events as ev
from ..operators import jobs, lineage, live, sequences, series, stats
from ..sources import feeds
from ..streaming import live_bins
from .scratch import scratch, written

S = 1_000_000
H = 3600 * S
AS_OF = 1_706_659_200 * S  # 2024-01-31, the clock of all windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(
        "event_id", "ts", M.micros(F.col("ts")).alias("us"), "user_id", F.col("event_type").alias("cls"), "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"), (F.col("user_id") % 4).alias("host"),
        F.floor(F.col("event_id") / 3).cast("bigint").alias("parent"),
    )


E_SQL = """e AS (SELECT event_id, ts, epoch_us(ts) AS us, user_id, event_type AS cls, value,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id % 4 AS host, event_id // 3 AS parent FROM events)"""
D = "CAST(sum(CAST({} AS DECIMAL(18,4))) AS DOUBLE)"


def dsum(x: str, scale: int = 4) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,{scale}))) AS DOUBLE)"


def dpct(a: str, b: str) -> str:
    return f"CASE WHEN coalesce({b}, 0) = 0 THEN 0.0 ELSE round(100.0::DOUBLE * {a} / {b}, 2) END"


WEIGHED = "CASE WHEN value > 100 THEN NULL ELSE value END"


def weighed() -> Column:
    return F.when(F.col("value") > 100, None).otherwise(F.col("value"))


BINS_SQL = f"""
{E_SQL}, h AS (SELECT us // 3600000000 AS bin, cls, count(*) AS n, {dsum("w")} AS cost FROM (SELECT *, {WEIGHED} AS w FROM e) GROUP BY 1, 2),
g AS (SELECT bin, cls FROM (SELECT unnest(generate_series(min(bin), max(bin))) AS bin FROM h), (SELECT DISTINCT cls FROM h)),
l AS (SELECT DISTINCT bin FROM h),
bins AS (
  SELECT g.bin, g.cls, CASE WHEN l.bin IS NOT NULL THEN coalesce(h.n, 0) END AS n,
         CASE WHEN l.bin IS NOT NULL AND h.n IS NULL THEN 0.0 ELSE h.cost END AS cost
  FROM g LEFT JOIN l ON g.bin = l.bin LEFT JOIN h ON g.bin = h.bin AND g.cls = h.cls)
"""


@query(f"WITH {BINS_SQL} SELECT CAST(bin AS BIGINT) AS bin, cls, CAST(n AS BIGINT) AS n, cost FROM bins")
def bins_by_class(spark, d):
    return series.bins_by_class(events(spark, d).withColumn("w", weighed()), us="us", cls="cls", cost="w")


@query(f"WITH {BINS_SQL} SELECT cls, CAST(sum(n) AS BIGINT) AS n, {dsum('cost')} AS cost, count(n) AS bins_held, count(*) AS bins FROM bins WHERE bin BETWEEN 473400 AND 473500 GROUP BY cls")
def bins_slice_totals(spark, d):
    return series.slice_totals(bins_by_class(spark, d), F.lit(473400), F.lit(473500))


@query(f"""WITH {E_SQL}, h AS (SELECT us // 3600000000 AS bin, host, {dsum("value")} / count(*) AS mean, count(*) AS ticks FROM e GROUP BY 1, 2)
SELECT CAST(bin AS BIGINT) AS bin, {dsum("mean", 6)} AS resident, count(*) AS hosts, CAST(sum(ticks) AS BIGINT) AS ticks FROM h GROUP BY bin""")
def resource_series(spark, d):
    return series.resident_series(events(spark, d), us="us", host="host", value="value")


@query(f"""WITH {E_SQL} SELECT cls, {dsum("w")} AS cost_total, count(w) AS cost_n, count(*) AS cost_seen, {dpct("count(w)", "count(*)")} AS cost_coverage_pct,
{dsum("w")} / nullif(count(w), 0) AS cost_mean FROM (SELECT *, {WEIGHED} AS w FROM e) GROUP BY cls""")
def acc_coverage(spark, d):
    return events(spark, d).withColumn("w", weighed()).groupBy("cls").agg(*M.coverage("cost", F.col("w")))


def _sketch_sql(table: str, cls: str, value: str) -> str:
    picks = ", ".join(f"min(CASE WHEN cum > CAST(floor({q}::DOUBLE * (n - 1)) AS BIGINT) THEN {{'cum': cum, 'v': v}} END).v AS p{round(q * 100)}" for q in stats.SKETCH_RANKS)
    return f"""
WITH b AS (
  SELECT {cls} AS cls, CASE WHEN abs({value}) <= 1e-9 THEN 0 ELSE CAST(sign({value}) AS INT) END AS s,
         CASE WHEN abs({value}) <= 1e-9 THEN 0 ELSE CAST(ceil(ln(abs({value})) / ln({stats.GAMMA!r}::DOUBLE)) AS BIGINT) END AS idx, {value} AS x
  FROM {table} WHERE {value} IS NOT NULL),
g AS (SELECT cls, s, idx, count(*) AS k, min(x) AS lo, max(x) AS hi FROM b GROUP BY ALL),
c AS (SELECT *, sum(k) OVER (PARTITION BY cls ORDER BY s, s * idx) AS cum, sum(k) OVER (PARTITION BY cls) AS n, min(lo) OVER (PARTITION BY cls) AS mn, max(hi) OVER (PARTITION BY cls) AS mx FROM g),
v AS (SELECT *, round(least(greatest(s * 2 * pow({stats.GAMMA!r}::DOUBLE, idx) / ({stats.GAMMA!r}::DOUBLE + 1), mn), mx), 4) AS v FROM c)
SELECT cls, CAST(sum(k) AS BIGINT) AS n, min(mn) AS min, max(mx) AS max, {picks} FROM v GROUP BY cls"""


@query(_sketch_sql("events", "event_type", "value"))
def sketch_quantiles(spark, d):
    return stats.sketch_quantiles(events(spark, d), by="cls", value="value")


@query(_sketch_sql("lineitem", "l_returnflag", "l_extendedprice"))
def sketch_quantiles_prices(spark, d):
    return stats.sketch_quantiles(read(spark, d, "lineitem"), by="l_returnflag", value="l_extendedprice")


def _ranks_sql() -> str:
    at = {"floor": "CAST(floor({q}::DOUBLE * (n - 1)) AS BIGINT)", "half_even": "CAST(round_even({q}::DOUBLE * (n - 1), 0) AS BIGINT)", "ceil": "greatest(0, CAST(ceil({q}::DOUBLE * n) AS BIGINT) - 1)"}
    picks = ", ".join(f"max(CASE WHEN r = {at[rule].format(q=q)} THEN v END) AS {rule}_p{round(q * 100)}" for rule in at for q in (0.1, 0.5, 0.9))
    return f"""WITH x AS (SELECT o_orderstatus AS grp, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1 AS r,
count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT grp, any_value(n) AS n, {picks} FROM x GROUP BY grp"""


@query(_ranks_sql())
def nearest_rank_quantiles(spark, d):
    return stats.nearest_ranks(read(spark, d, "orders"), by="o_orderstatus", value="o_totalprice", qs=(0.1, 0.5, 0.9))


@query(f"""WITH {E_SQL}, p AS (SELECT CAST(host AS VARCHAR) AS population, cls, value FROM e UNION ALL SELECT 'agent:' || (k % 3), cls, value FROM e WHERE k % 3 > 0),
s AS (SELECT population, cls AS bucket, count(*) AS calls, {dsum("value")} AS cost FROM p GROUP BY ALL),
t AS (SELECT population, sum(calls) AS c, {dsum("cost")} AS w FROM s GROUP BY 1)
SELECT population, bucket, calls, cost, {dpct("calls", "c")} AS calls_pct, {dpct("cost", "w")} AS cost_pct FROM s JOIN t USING (population)""")
def tool_mix_shares(spark, d):
    tagged = events(spark, d).withColumns({"h": F.col("host").cast("string"), "tag": F.when(F.col("k") % 3 > 0, (F.col("k") % 3).cast("string"))})
    return stats.shares(tagged, cls="h", tag="tag", bucket="cls", cost="value")


PART_SQL = f"SELECT l_partkey, count(*) AS n, {dsum('l_quantity')} AS quantity, {dsum('l_extendedprice')} AS price FROM lineitem GROUP BY l_partkey"


def _part_sums(spark, d):
    return read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), M.exact_sum("l_quantity").alias("quantity"), M.exact_sum("l_extendedprice").alias("price"))


@query(f"""WITH s AS ({PART_SQL}), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, l_partkey) AS a, row_number() OVER (ORDER BY quantity DESC, l_partkey) AS b,
row_number() OVER (ORDER BY price DESC, l_partkey) AS c FROM s) SELECT l_partkey, n, quantity, price FROM r WHERE least(a, b, c) <= 20""")
def top_union(spark, d):
    return stats.top_union(_part_sums(spark, d), key="l_partkey", measures=["n", "quantity", "price"], n=20)


@query(f"""WITH s AS (SELECT l_returnflag AS f, l_suppkey, count(*) AS n, {dsum("l_extendedprice")} AS price FROM lineitem GROUP BY ALL),
sub(name, a, r, n_) AS (VALUES ('A',1,0,0),('N',0,0,1),('R',0,1,0),('A+N',1,0,1),('A+R',1,1,0),('N+R',0,1,1),('A+N+R',1,1,1)),
t AS (SELECT name, l_suppkey, sum(n) AS n, {dsum("price")} AS price FROM s JOIN sub ON (f = 'A' AND a = 1) OR (f = 'R' AND r = 1) OR (f = 'N' AND n_ = 1) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, l_suppkey) AS x, row_number() OVER (PARTITION BY name ORDER BY price DESC, l_suppkey) AS y FROM t)
SELECT DISTINCT l_suppkey FROM k WHERE least(x, y) <= 5""")
def subset_topn(spark, d):
    sums = read(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).alias("price"))
    return stats.subset_top(sums, cls="l_returnflag", key="l_suppkey", measures=["n", "price"], classes=["A", "N", "R"], n=5)


CODE_SQL = "CASE WHEN k % 10 = 9 THEN NULL ELSE k % 4 END"


@query(f"""WITH {E_SQL}, v AS (SELECT cls, CASE WHEN sig = 13 THEN 'pipe' WHEN sig <> 0 THEN 'signal' WHEN code IS NULL THEN 'none' WHEN code = 0 THEN 'ok'
WHEN code = 1 AND tool IN ('grep','diff') THEN 'answer' ELSE 'nonzero' END AS v FROM (SELECT cls, CASE WHEN k % 20 = 7 THEN 13 WHEN k % 20 = 8 THEN 9 ELSE 0 END AS sig, {CODE_SQL} AS code,
CASE cls WHEN 'view' THEN 'grep' WHEN 'click' THEN 'diff' ELSE cls END AS tool FROM e))
SELECT cls, {", ".join(f"count(*) FILTER (v = '{x}') AS {x}" for x in ("pipe", "signal", "none", "ok", "answer", "nonzero"))} FROM v GROUP BY cls""")
def exit_verdicts(spark, d):
    k = F.col("k") % 20
    signal = F.when(k == 7, 13).when(k == 8, 9).otherwise(0)
    code = F.when(F.col("k") % 10 == 9, None).otherwise(F.col("k") % 4)
    tool = F.when(F.col("cls") == "view", "grep").when(F.col("cls") == "click", "diff").otherwise(F.col("cls"))
    v = events(spark, d).withColumn("v", F.coalesce(text.verdict(code, signal, tool), F.lit("ok")))
    return v.groupBy("cls").agg(*(F.count_if(F.col("v") == x).alias(x) for x in ("pipe", "signal", "none", "ok", "answer", "nonzero")))


@query(f"""WITH {E_SQL}, x AS (SELECT cls, 'user_id' AS facet, CAST(user_id AS VARCHAR) AS value FROM e UNION ALL SELECT cls, 'host', CAST(host AS VARCHAR) FROM e),
p AS (SELECT facet, value, cls, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT facet, value, CAST(sum(n) AS BIGINT) AS total FROM p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY total DESC, value) AS r FROM t) SELECT facet, value, cls, n, total FROM p JOIN r USING (facet, value) WHERE r <= 50""")
def facets(spark, d):
    return ev.facets(events(spark, d), names=["user_id", "host"], cls="cls")


@query(f"WITH {E_SQL} SELECT event_id, us, user_id, cls, value FROM e WHERE cls IN ('error','click') AND us >= 1704412800000000 AND us < 1705017600000000 AND coalesce(value, 0) >= 10 ORDER BY us DESC, event_id LIMIT 50 OFFSET 10")
def event_scan_page(spark, d):
    rows = events(spark, d).select("event_id", "us", "user_id", "cls", "value")
    condition = ev.predicate(sets={"cls": ["error", "click"]}, least={"value": 10}, since=("us", 1704412800 * S), until=("us", 1705017600 * S))
    return ev.page(rows, condition, order=[F.desc("us"), F.asc("event_id")], limit=50, offset=10)


@query("SELECT c_custkey, c_name FROM customer WHERE (c_mktsegment IN ('BUILDING','MACHINERY') AND c_name LIKE 'Customer#00000001%') OR CAST(c_nationkey AS VARCHAR) IN ('3')")
def where_algebra(spark, d):
    condition = ev.where([{"c_mktsegment": ["BUILDING", "MACHINERY"], "c_name": ev.Prefix("Customer#00000001")}, {"c_nationkey": [3]}])
    return read(spark, d, "customer").filter(condition).select("c_custkey", "c_name")


@query("SELECT page_id FROM pages WHERE substr(url, strpos(url, ':') + 1) LIKE '//m.%' OR url LIKE 'https://blog.%'")
def where_urls(spark, d):
    pages = read(spark, d, "pages").select("page_id", "url")
    rest = pages.withColumn("rest", text.after_first(F.col("url")))
    return rest.filter(ev.where([{"rest": ev.Prefix("//m.")}, {"url": ev.Prefix("https://blog.")}])).select("page_id")


@query("""WITH c AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,4))) FILTER (l_quantity > 10) AS held, count(*) FILTER (l_quantity > 10) AS children, count(*) FILTER (NOT l_quantity > 10) AS rejected FROM lineitem GROUP BY 1)
SELECT o_orderkey, CAST(greatest(0, CAST(o_totalprice AS DECIMAL(18,4)) - coalesce(held, 0)) AS DOUBLE) AS own, CAST(coalesce(held, 0) AS DOUBLE) AS held, coalesce(children, 0) AS children, coalesce(rejected, 0) AS rejected,
CAST(o_totalprice AS DECIMAL(18,4)) - coalesce(held, 0) < 0 AS clamped FROM orders LEFT JOIN c ON o_orderkey = l_orderkey""")
def own_cost(spark, d):
    steps = read(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity")
    return lineage.own_cost(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), steps, key="o_orderkey", parent="l_orderkey", cost="o_totalprice", child_cost="l_extendedprice", accept=F.col("c_l_quantity") > 10)


TREE_OK = "c.event_id <> p.event_id AND c.us >= p.us - 60000000 AND (c.user_id = p.user_id OR c.user_id = 0 OR p.user_id = 0 OR c.k % 2 = 0)"


@query(f"""WITH {E_SQL}, h AS (SELECT p.event_id, sum(CAST(c.value AS DECIMAL(18,4))) FILTER ({TREE_OK}) AS held, count(*) FILTER ({TREE_OK}) AS children, count(*) FILTER (NOT ({TREE_OK})) AS rejected FROM e p JOIN e c ON c.parent = p.event_id GROUP BY 1)
SELECT e.event_id, CAST(greatest(0, CAST(value AS DECIMAL(18,4)) - coalesce(held, 0)) AS DOUBLE) AS own, CAST(coalesce(held, 0) AS DOUBLE) AS held, coalesce(children, 0) AS children, coalesce(rejected, 0) AS rejected, CAST(value AS DECIMAL(18,4)) - coalesce(held, 0) < 0 AS clamped FROM e LEFT JOIN h USING (event_id)""")
def own_cost_tree(spark, d):
    e = events(spark, d).select("event_id", "parent", "us", "user_id", "k", "value")
    users = (F.col("c_user_id") == F.col("user_id")) | (F.col("c_user_id") == 0) | (F.col("user_id") == 0) | (F.col("c_k") % 2 == 0)
    accept = (F.col("c_event_id") != F.col("event_id")) & (F.col("c_us") >= F.col("us") - 60 * S) & users
    return lineage.own_cost(e, e, key="event_id", parent="parent", cost="value", child_cost="value", accept=accept)


@query(f"WITH {E_SQL} SELECT event_id, cls FROM e a WHERE NOT (k % 2 = 0 AND EXISTS (SELECT 1 FROM e b WHERE b.parent = a.event_id AND b.host = a.host AND b.cls = a.cls))")
def dedup_anti(spark, d):
    e = events(spark, d).select("event_id", "parent", "host", "cls", "k")
    return lineage.without_wrappers(e, key="event_id", parent="parent", session="host", token="cls", wrapper=F.col("k") % 2 == 0).select("event_id", "cls")


OWNER_SQL = f"""{E_SQL}, w AS (
  SELECT event_id AS key, event_id AS at, 0 AS n FROM e UNION ALL
  SELECT w.key, x.parent, n + 1 FROM w JOIN e x ON x.event_id = w.at WHERE NOT (x.cls = 'signup' AND x.k >= 50) AND x.parent <> x.event_id AND n < 64),
o AS (SELECT w.key, w.at AS owner, n FROM w JOIN e x ON x.event_id = w.at WHERE x.cls = 'signup' AND x.k >= 50),
owners AS (SELECT e.event_id AS key, o.owner, CAST(o.n AS BIGINT) AS hops, CASE WHEN o.n IS NULL THEN 'unknown' WHEN o.n = 0 THEN 'self' WHEN o.n = 1 THEN 'parent' ELSE 'ancestor' END AS provenance FROM e LEFT JOIN o ON o.key = e.event_id)"""


def _owners(spark, d):
    e = events(spark, d).select("event_id", F.when(F.col("parent") != F.col("event_id"), F.col("parent")).alias("parent"), "cls", "k")
    return lineage.owners(e, key="event_id", parent="parent", is_owner=(F.col("cls") == "signup") & (F.col("k") >= 50))


@query(f"WITH RECURSIVE {OWNER_SQL} SELECT * FROM owners")
def owner_recursive(spark, d):
    return _owners(spark, d)


@query(f"WITH RECURSIVE {OWNER_SQL} SELECT coalesce(owner, event_id) AS session, count(*) AS n, {dsum('value')} AS cost, count(DISTINCT cls) AS tools FROM e JOIN owners ON key = event_id GROUP BY 1")
def fold_sessions(spark, d):
    measures = [F.count(F.lit(1)).alias("n"), M.exact_sum("value").alias("cost"), F.countDistinct("cls").alias("tools")]
    return lineage.fold(events(spark, d), _owners(spark, d), key="event_id", measures=measures)


@query(f"""WITH RECURSIVE {E_SQL}, c AS (SELECT event_id AS root, event_id AS key, 0 AS depth FROM e UNION ALL SELECT c.root, x.event_id, depth + 1 FROM c JOIN e x ON x.parent = c.key AND x.event_id <> x.parent WHERE depth < 3)
SELECT root, count(*) AS nodes, CAST(max(depth) AS INTEGER) AS depth, {dsum("value")} AS cost FROM c JOIN e ON e.event_id = c.key GROUP BY root""")
def subtree_rollup(spark, d):
    e = events(spark, d)
    down = lineage.closure(e.filter("event_id <> parent").select("event_id", "parent").unionByName(e.filter("event_id = parent").select("event_id", F.lit(None).cast("bigint").alias("parent"))), key="event_id", parent="parent", depth=3)
    return down.join(e.select(F.col("event_id").alias("key"), "value"), "key").groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"), M.exact_sum("value").alias("cost"))


@query(f"""WITH {E_SQL}, l AS (SELECT event_id, user_id, us FROM e WHERE cls <> 'signup'), r AS (SELECT user_id, us AS at, event_id AS held_event, k FROM e WHERE cls = 'signup')
SELECT l.event_id, l.user_id, l.us, r.at AS held_at, r.k AS held_k FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.us >= r.at""")
def asof_holder(spark, d):
    e = events(spark, d)
    calls, holders = e.filter("cls <> 'signup'").select("event_id", "user_id", "us"), e.filter("cls = 'signup'").select("event_id", "user_id", "us", "k")
    return lineage.as_of(calls, holders, by=["user_id"], left_at="us", right_at="us", take=["k"], key="event_id")


@query(f"""WITH c AS (SELECT c_nationkey AS k, count(*) AS customers, {dsum("c_acctbal")} AS balance FROM customer WHERE c_nationkey < 20 GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_nationkey > 4 GROUP BY 1)
SELECT coalesce(c.k, s.k) AS nationkey, customers, balance, suppliers FROM c FULL JOIN s ON c.k = s.k""")
def full_outer_sources(spark, d):
    c = read(spark, d, "customer").filter("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("customers"), M.exact_sum("c_acctbal").alias("balance"))
    s = read(spark, d, "supplier").filter("s_nationkey > 4").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    return c.join(s, "nationkey", "full")


@query(f"""WITH {E_SQL}, x AS (SELECT event_id, user_id, k, lag(k) OVER (PARTITION BY user_id ORDER BY us, event_id) AS was FROM e)
SELECT event_id, user_id, k, CASE WHEN k >= was THEN k - was END AS delta, coalesce(k < was, false) AS counter_reset FROM x""")
def counter_delta_reset(spark, d):
    return sequences.counter_deltas(events(spark, d).select("event_id", "user_id", "us", "k"), by=["user_id"], order=["us", "event_id"], counter="k").drop("us")


@query(f"""WITH {E_SQL}, x AS (SELECT *, CASE WHEN cls = lag(cls) OVER w THEN 0 ELSE 1 END AS f FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
y AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM x),
z AS (SELECT user_id AS grp, CAST(run AS BIGINT) AS run, any_value(cls) AS token, count(*) AS length, min(us) AS start_us, max(us) AS end_us FROM y GROUP BY 1, 2)
SELECT *, total > 40 AS truncated FROM (SELECT *, max(run) OVER (PARTITION BY grp) AS total FROM z) WHERE run <= 40""".replace("SELECT *, total > 40", "SELECT grp, run, token, length, start_us, end_us, total > 40"))
def rle_chain(spark, d):
    return sequences.run_lengths(events(spark, d), by="user_id", token="cls", order=["us", "event_id"], us="us", cap=40)


@query(f"""WITH {E_SQL}, a AS (SELECT user_id AS grp, us, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > {H} THEN 1 ELSE 0 END AS f, event_id FROM e),
b AS (SELECT grp, us, sum(f) OVER (PARTITION BY grp ORDER BY us, event_id) AS poll FROM a), p AS (SELECT grp, poll, min(us) AS us FROM b GROUP BY 1, 2),
g AS (SELECT *, us - lag(us) OVER (PARTITION BY grp ORDER BY us) AS gap FROM p), l AS (SELECT *, sum(CASE WHEN gap > {12 * H} THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY us) AS loop FROM g),
s AS (SELECT grp, loop, count(*) AS n, max(us) - min(us) AS span, list_sort(list(gap) FILTER (gap <= {12 * H})) AS gaps FROM l GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY span DESC, loop) AS r, sum(n) OVER (PARTITION BY grp) AS polls, count(*) OVER (PARTITION BY grp) AS loops FROM s)
SELECT grp, CAST(polls AS BIGINT) AS polls, loops, n AS loop_polls, span AS loop_us, gaps[len(gaps) // 2 + 1] AS median_gap_us, span >= {24 * H} AS polling FROM r WHERE r = 1""")
def polls_loops(spark, d):
    return sequences.polls_and_loops(events(spark, d), by="user_id", us="us", order=["us", "event_id"], join_us=H, loop_us=12 * H, least_us=24 * H)


@query(f"""WITH RECURSIVE {E_SQL}, s AS (SELECT user_id AS grp, us, row_number() OVER (PARTITION BY user_id ORDER BY us) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM e),
w AS (SELECT grp, r, us AS anchor, n, 1 AS steps FROM s WHERE r = 1 UNION ALL
SELECT w.grp, s.r, CASE WHEN s.us - w.anchor <= {6 * H} THEN w.anchor ELSE s.us END, w.n, w.steps + CASE WHEN s.us - w.anchor <= {6 * H} THEN 0 ELSE 1 END FROM w JOIN s ON s.grp = w.grp AND s.r = w.r + 1)
SELECT grp, n AS calls, CAST(steps AS BIGINT) AS steps FROM w WHERE r = n""")
def steps_anchor(spark, d):
    return sequences.steps(events(spark, d), by="user_id", us="us", reach_us=6 * H)


SPAN = "us AS s, us + k * 60000000 AS t"


@query(f"""WITH {E_SQL}, x AS (SELECT user_id AS grp, {SPAN} FROM e), y AS (SELECT *, max(t) OVER (PARTITION BY grp ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS from_us FROM x)
SELECT grp, from_us, s AS to_us FROM y WHERE s - from_us >= {24 * H}""")
def idle_gaps(spark, d):
    return sequences.idle_gaps(events(spark, d), by="user_id", start=F.col("us"), end=F.col("us") + F.col("k") * 60 * S, least_us=24 * H)


@query(f"""WITH {E_SQL}, x AS (SELECT user_id AS grp, us AS t, 1 AS d FROM e UNION ALL SELECT user_id, us + k * 3600000000, -1 FROM e), n AS (SELECT grp, t, d, sum(d) AS net FROM x GROUP BY ALL)
SELECT grp, CAST(max(o) AS BIGINT) AS peak FROM (SELECT grp, sum(net) OVER (PARTITION BY grp ORDER BY t, d DESC) AS o FROM n) GROUP BY grp""")
def peak_open(spark, d):
    return sequences.peak_open(events(spark, d), by="user_id", start=F.col("us"), end=F.col("us") + F.col("k") * H)


@query(f"""WITH {E_SQL}, g AS (SELECT user_id, cls, CAST(us - lag(us) OVER (PARTITION BY user_id, cls ORDER BY us) AS DOUBLE) / 1000000 AS g FROM e)
SELECT user_id, cls, count(*) AS starts, round(stddev_pop(g) / avg(g), 6) AS cv, round(stddev_pop(g) / avg(g), 6) <= 0.9 AS polling FROM g GROUP BY ALL HAVING count(*) >= 5""")
def cv_polling(spark, d):
    return sequences.regular_starts(events(spark, d), by=["user_id", "cls"], us="us", most_cv=0.9)


@query(f"""WITH {E_SQL}, r AS (SELECT user_id AS grp, cls, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM e),
s AS (SELECT grp, cls, any_value(n) AS n, count(*) FILTER (r <= n // 3) / any_value(n // 3) AS p, count(*) FILTER (r > n - n // 3) / any_value(n // 3) AS q FROM r WHERE n >= 30 AND (r <= n // 3 OR r > n - n // 3) GROUP BY ALL)
SELECT grp, any_value(n) AS n, round((sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2, 6) AS jsd FROM s GROUP BY grp""")
def drift_jsd(spark, d):
    return stats.drift(events(spark, d), by="user_id", token="cls", order=["us", "event_id"])


@query("""WITH p AS (SELECT o_custkey, count(*) AS x FROM orders GROUP BY 1), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM p)
SELECT any_value(n) AS keys, CAST(sum(x) AS BIGINT) AS rows, round(2 * CAST(sum(i * x) AS DOUBLE) / (any_value(n) * CAST(sum(x) AS DOUBLE)) - (any_value(n) + 1) / any_value(n), 3) AS gini,
round(100.0::DOUBLE * (sum(x) FILTER (i > n - ceil(0.1::DOUBLE * n)))::BIGINT / sum(x)::BIGINT, 2) AS top_pct FROM r""")
def gini_concentration(spark, d):
    return stats.gini(read(spark, d, "orders"), of="o_custkey")


@query("SELECT CAST(isodow(ts) AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour, count(DISTINCT epoch_us(ts) // 60000000) AS minutes FROM events GROUP BY 1, 2")
def hour_grid(spark, d):
    return series.hour_grid(events(spark, d), ts="ts", us="us")


@query(f"""WITH {E_SQL}, f AS (SELECT * FROM e), h AS (SELECT us // 86400000000 AS day, cls, count(*) AS n, {dsum("value")} AS cost, count(DISTINCT user_id) AS users FROM f GROUP BY 1, 2),
m AS (SELECT us // 86400000000 AS day, count(DISTINCT us // 60000000) AS held_minutes FROM f GROUP BY 1), g AS (SELECT * FROM (SELECT unnest(generate_series(min(day), max(day))) AS day FROM h), (SELECT DISTINCT cls FROM h))
SELECT CAST(g.day AS BIGINT) AS day, g.cls, CASE WHEN m.day IS NOT NULL THEN coalesce(n, 0) END AS n, CASE WHEN m.day IS NOT NULL THEN coalesce(cost, 0.0) END AS cost, CASE WHEN m.day IS NOT NULL THEN coalesce(users, 0) END AS users, held_minutes
FROM g LEFT JOIN m ON g.day = m.day LEFT JOIN h ON h.day = g.day AND h.cls = g.cls""")
def daily_trend(spark, d):
    return series.daily_trend(events(spark, d), ts="ts", us="us", cls="cls", cost="value", user="user_id")


@query(f"""WITH {E_SQL}, s AS (SELECT user_id, us // 86400000000 AS day, count(*) AS n, {dsum("value")} AS cost, max(us) AS recent, count(DISTINCT cls) AS tools FROM e GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, user_id, day) AS a, row_number() OVER (ORDER BY cost DESC, user_id, day) AS b, row_number() OVER (ORDER BY recent DESC, user_id, day) AS c FROM s),
x AS (SELECT 'n' AS ranking, a AS rank, user_id, day, n AS v FROM r WHERE a <= 15 UNION ALL SELECT 'cost', b, user_id, day, cost FROM r WHERE b <= 15 UNION ALL SELECT 'recent', c, user_id, day, 1 FROM r WHERE c <= 15)
SELECT ranking, CAST(rank AS INTEGER) AS rank, user_id, CAST(day AS BIGINT) AS day, round(100.0::DOUBLE * u / t, 2) AS user_share_pct FROM (SELECT *, {dsum("v").replace("sum(", "sum(", 1)} OVER (PARTITION BY ranking, user_id) AS u FROM x) JOIN (SELECT ranking, {dsum("v")} AS t FROM x GROUP BY 1) USING (ranking)""".replace("CAST(sum(CAST(v AS DECIMAL(18,4))) AS DOUBLE) OVER (PARTITION BY ranking, user_id)", "CAST(sum(CAST(v AS DECIMAL(18,4))) OVER (PARTITION BY ranking, user_id) AS DOUBLE)"))
def rankings_dominance(spark, d):
    from functools import reduce

    from pyspark.sql.window import Window

    s = events(spark, d).groupBy("user_id", F.floor(F.col("us") / (24 * H)).cast("bigint").alias("day")).agg(F.count(F.lit(1)).alias("n"), M.exact_sum("value").alias("cost"), F.max("us").alias("recent"))
    parts = []
    for name, weight in (("n", F.col("n")), ("cost", F.col("cost")), ("recent", F.lit(1))):
        top = s.orderBy(F.desc(name), "user_id", "day").limit(15)
        w = Window.orderBy(F.desc(name), "user_id", "day")  # over 15 rows
        parts.append(top.select(F.lit(name).alias("ranking"), F.row_number().over(w).alias("rank"), "user_id", "day", weight.cast("decimal(18,4)").alias("v")))
    x = reduce(DataFrame.unionByName, parts)
    share = F.round(F.lit(100.0) * F.sum("v").over(Window.partitionBy("ranking", "user_id")).cast("double") / F.sum("v").over(Window.partitionBy("ranking")).cast("double"), 2)
    return x.select("ranking", "rank", "user_id", "day", share.alias("user_share_pct"))


@query(f"""WITH {E_SQL}, x AS (SELECT user_id, us, cls, value, sum(CASE WHEN us - p > {12 * H} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS s FROM (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS p FROM e)),
s AS (SELECT user_id, user_id % 4 AS host, s, count(*) AS calls, max(us) - min(us) AS wall FROM x GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY calls) - 1 AS a, row_number() OVER (PARTITION BY host ORDER BY wall) - 1 AS b, count(*) OVER (PARTITION BY host) AS n FROM s),
u AS (SELECT host, max(c) AS top FROM (SELECT host, user_id, sum(calls) AS c FROM s GROUP BY ALL) GROUP BY host)
SELECT host, any_value(n) AS sessions, count(DISTINCT user_id) AS users, {dpct("CAST(any_value(top) AS BIGINT)", "CAST(sum(calls) AS BIGINT)")} AS top_user_share, max(calls) FILTER (a = CAST(floor(0.5::DOUBLE * (n - 1)) AS BIGINT)) AS calls_p50,
max(calls) FILTER (a = CAST(floor(0.9::DOUBLE * (n - 1)) AS BIGINT)) AS calls_p90, max(calls) AS calls_max, max(wall) FILTER (b = CAST(floor(0.5::DOUBLE * (n - 1)) AS BIGINT)) AS wall_p50_us, max(wall) AS longest_us FROM r JOIN u USING (host) GROUP BY host""")
def session_summary(spark, d):
    from pyspark.sql.window import Window

    cut = sequences.sessions_by_gap(events(spark, d), by=["user_id"], us="us", order=["us", "event_id"], gap_us=12 * H)
    s = cut.groupBy("host", "user_id", "session").agg(F.count(F.lit(1)).alias("calls"), (F.max("us") - F.min("us")).alias("wall"))
    w = Window.partitionBy("host")
    s = s.withColumns({"a": F.row_number().over(w.orderBy("calls")) - 1, "b": F.row_number().over(w.orderBy("wall")) - 1, "n": F.count(F.lit(1)).over(w)})
    top = s.groupBy("host", "user_id").agg(F.sum("calls").alias("c")).groupBy("host").agg(F.max("c").alias("top"))
    at = lambda r, q, v: F.max(F.when(F.col(r) == M.rank_index(q, F.col("n"), "floor"), F.col(v)))
    return s.join(top, "host").groupBy("host").agg(
        F.first("n").alias("sessions"), F.countDistinct("user_id").alias("users"), M.pct(F.first("top"), F.sum("calls")).alias("top_user_share"),
        at("a", 0.5, "calls").alias("calls_p50"), at("a", 0.9, "calls").alias("calls_p90"), F.max("calls").alias("calls_max"), at("b", 0.5, "wall").alias("wall_p50_us"), F.max("wall").alias("longest_us"),
    )


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS x, max(l_suppkey) AS node, sum(CAST(l_quantity AS DECIMAL(18,4))) AS q FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY x DESC, l_linenumber) AS r FROM s)
SELECT l_orderkey AS job, max(x) AS peak, max(node) FILTER (r = 1) AS peak_node, coalesce(max(x) FILTER (l_linenumber = 1), max(x)) AS main_peak, {dsum("q")} AS consumed, count(*) AS steps FROM r GROUP BY 1""")
def job_fold_steps(spark, d):
    li = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("x"), F.max("l_suppkey").alias("node"), F.sum(F.col("l_quantity").cast("decimal(18,4)")).alias("q"))
    return jobs.fold_steps(li, job="l_orderkey", step="l_linenumber", peak="x", consumed="q", node="node", main=1)


@query(f"""WITH r AS (SELECT o_custkey AS job, o_orderdate AS start, o_orderkey % 97 AS elapsed, o_totalprice AS used, o_orderstatus AS st, o_orderkey AS k FROM orders),
o AS (SELECT *, row_number() OVER (PARTITION BY job, start ORDER BY elapsed DESC, k DESC) AS n FROM r), g AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY start DESC) AS last FROM o WHERE n = 1)
SELECT job, count(*) AS generations, min(start) AS first_start, {dsum("used")} AS consumed, max(elapsed) AS peak, max(st) FILTER (last = 1) AS state FROM g GROUP BY job""")
def job_generation_merge(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderdate").alias("start"), (F.col("o_orderkey") % 97).alias("elapsed"), F.col("o_totalprice").alias("used"), F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("top"), F.col("o_orderstatus").alias("st"))
    once = rows.select("job", "start", "elapsed", "used", F.col("elapsed").alias("peak"), "st", "k")
    return jobs.merge_generations(once, job="job", start="start", elapsed="elapsed", consumed="used", peak="peak", state="st", key="k")


@query(f"""WITH j AS (SELECT c_mktsegment AS cls, o_custkey, o_orderstatus AS st, o_totalprice AS used, c_acctbal * 30 AS asked FROM orders JOIN customer ON o_custkey = c_custkey),
e AS (SELECT *, round(CASE WHEN asked > 0 THEN least(1.5, used / asked) END, 6) AS eff FROM j)
SELECT cls, count(*) AS jobs, count(DISTINCT o_custkey) AS users, {dpct("count(*) FILTER (st = 'F')", "count(*)")} AS done_pct, {dsum("used")} AS used, round({dsum("eff", 6)} / count(eff), 6) AS efficiency FROM e GROUP BY cls""")
def job_rollup(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") * 30).alias("asked"))
    j = read(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return jobs.rollup(j, cls="c_mktsegment", user="o_custkey", state="o_orderstatus", done="F", used="o_totalprice", asked="asked")


@query(f"SELECT o_custkey, o_orderpriority, count(*) AS times, {dsum('o_totalprice')} AS cost FROM orders GROUP BY ALL HAVING count(*) > 1 ORDER BY times DESC, o_custkey, o_orderpriority LIMIT 12")
def repeat_submissions(spark, d):
    return jobs.repeated(read(spark, d, "orders"), by=["o_custkey", "o_orderpriority"], cost="o_totalprice")


# Each with a text that must be there, so that most documents are not searched by pattern.
RULES = {"address": (".", r"[0-9](\.[0-9]{1,3}){3}"), "mail": ("@", r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[a-z]"), "licence": ("icen", r"[Ll]icen[sc]e"), "shouting": ("!!", r"[A-Z]{4}!!")}
SECRETS = {"token": ("token", r"token *= *\"?[0-9a-f]{16}"), "password": ("password", r"password *= *[^ ]{6}"), "aws_key": ("AKIA", r"AKIA[A-Z0-9]{16}"), "hex32": ("", r"[0-9a-f]{32}"), "basic_auth": ("://", r"://[^/ :@]+:[^/ @]+@")}


def _rules_sql(rules: dict[str, tuple[str, str]], extra: str) -> str:
    each = " UNION ALL ".join(f"SELECT '{k}' AS rule, source, n_chars FROM documents WHERE regexp_matches(text, '{v}')" for k, (_, v) in rules.items())
    return f"SELECT rule, count(*) AS n, count(DISTINCT source) AS users, {extra} FROM ({each}) GROUP BY rule"


def _held(rules: dict[str, tuple[str, str]]) -> dict[str, Column]:
    return {k: F.col("text").contains(gate) & F.col("text").rlike(v) for k, (gate, v) in rules.items()}


@query(_rules_sql(RULES, "CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (n_chars > 1000) AS long_texts"))
def rules_risk(spark, d):
    extra = [F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") > 1000).alias("long_texts")]
    docs = read(spark, d, "documents").select("text", "source", "n_chars")
    return ev.rule_hits(docs, _held(RULES), user="source", extra=extra)


@query(_rules_sql(SECRETS, "min(n_chars) AS shortest"))
def secrets_scan(spark, d):
    docs = read(spark, d, "documents").select("text", "source", "n_chars")
    return ev.rule_hits(docs, _held(SECRETS), user="source", extra=[F.min("n_chars").alias("shortest")])


def masked_sql(column: str) -> str:
    """The same forms; the SQL engine looks neither ahead nor behind, so there the neighbours are put back."""
    out = column
    for pattern in text.PLACES:
        put_back = "@" if pattern.endswith("(?=@)") else ""
        pattern = pattern.replace("(?=@)", "@").replace("'", "''")
        out = f"regexp_replace({out}, '{pattern}', '\\1{text.MARK}{put_back}', 'g')"
    shapes, _, signed = text.TOKEN_SHAPE.replace("'", "''").partition(r"|(?<![\w-])")
    out = f"regexp_replace({out}, '{shapes})', '{text.MARK}', 'g')"
    return f"regexp_replace({out}, '(^|[^\\w-]){signed.removesuffix(')')}', '\\1{text.MARK}', 'g')"


@query(f"SELECT doc_id, md5({masked_sql('text')}) AS masked_md5 FROM documents")
def masked_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(text.mask(F.col("text"))).alias("masked_md5"))


@query("SELECT c_custkey, 'user-' || left(sha256('salt|' || c_name), 8) AS alias FROM customer")
def alias_users(spark, d):
    return read(spark, d, "customer").select("c_custkey", text.alias(F.col("c_name"), "salt").alias("alias"))


HOST_SQL = "lower(regexp_extract(url, '://([^/?#]*)', 1))"


@query(f"""WITH p AS (SELECT {HOST_SQL} AS host, page_id % 3 AS cls, length(html) AS sent FROM pages), n AS (SELECT DISTINCT host, regexp_extract(host, '[^.]+\\.[^.]+$') AS name FROM p WHERE host LIKE '%.com')
SELECT coalesce(n.name, p.host) AS endpoint, cls, count(*) AS calls, {dsum("sent")} AS sent, count(DISTINCT p.host) AS addresses FROM p LEFT JOIN n USING (host) GROUP BY 1, 2""")
def endpoints_fold(spark, d):
    p = read(spark, d, "pages").select(text.host_of(F.col("url")).alias("host"), (F.col("page_id") % 3).alias("cls"), F.length("html").alias("sent"))
    names = p.filter(F.col("host").endswith(".com")).select("host", F.regexp_extract("host", r"[^.]+\.[^.]+$", 0).alias("name")).distinct()
    return ev.endpoints(p, names, address="host", cls="cls", sent="sent", known="host", name="name")


@query(f"""WITH {E_SQL}, g AS (SELECT host, us, us - lag(us) OVER (PARTITION BY host ORDER BY us) AS gap FROM e), l AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY us DESC) AS r FROM g WHERE gap IS NOT NULL),
i AS (SELECT host, median(gap) AS m FROM l WHERE r <= 64 GROUP BY host)
SELECT host, CAST(floor(us / greatest({H}.0, 2 * m)) AS BIGINT) AS bin, max(value) AS most, {dsum("value")} / count(value) AS mean, count(*) AS n FROM e JOIN i USING (host) GROUP BY 1, 2""")
def node_series(spark, d):
    return series.node_series(events(spark, d), host="host", us="us", field="value")


@query(f"WITH {E_SQL} SELECT CAST(us // 86400000000 AS BIGINT) AS day, cls, count(*) AS n, {dsum('value')} AS cost FROM e GROUP BY 1, 2")
def hour_partials_merge(spark, d):
    hours = live_bins.partial_bins(events(spark, d), us="us", cls="cls", cost="value", width_us=H)
    days = live_bins.merged_bins(hours.withColumn("bin", F.floor(F.col("bin") / 24).cast("bigint")))
    return days.withColumnRenamed("bin", "day")


@query(f"""WITH {E_SQL}, h AS (SELECT user_id, max(us) AS last_us, count(*) AS n, count(*) FILTER (k = 0) AS lost, arg_max(cls, (us, event_id)) = 'error' AS stopped FROM e GROUP BY 1)
SELECT user_id, last_us, n, lost, stopped, CASE WHEN stopped THEN 'stopped' WHEN last_us < {AS_OF} - {36 * H} THEN 'silent' WHEN lost * 100.0 > n * 2.0 THEN 'degraded' ELSE 'ok' END AS verdict FROM h""")
def health_verdict(spark, d):
    e = events(spark, d)
    hosts = e.groupBy("user_id").agg(F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") == 0).alias("lost"), (F.max_by("cls", F.struct("us", "event_id")) == "error").alias("stopped"))
    return live.health(hosts, as_of_us=AS_OF, heartbeat_us=36 * H, lost_pct=2.0)


@query(f"""WITH {E_SQL}, p AS (SELECT user_id, cls, count(*) AS k, {dsum("value")} AS c FROM e GROUP BY ALL)
SELECT user_id AS user, CAST(sum(k) AS BIGINT) AS n, {dsum("c")} AS cost, string_agg(cls || ':' || k, ',' ORDER BY cls || ':' || k) AS by_class FROM p GROUP BY 1""")
def roster_order(spark, d):
    return live.roster(events(spark, d), user="user_id", cls="cls", cost="value")


@query("""WITH w AS (SELECT conv_id, unnest(string_split(lower(text), ' ')) AS word FROM conversations), t AS (SELECT conv_id, word, count(*) AS steps FROM w WHERE length(word) >= 4 GROUP BY ALL),
f AS (SELECT word, count(*) AS df, min(conv_id) AS first FROM t GROUP BY word), n AS (SELECT count(DISTINCT conv_id) AS n FROM t),
s AS (SELECT conv_id, word, steps, round(steps * ln(1 + n / CAST(df AS DOUBLE)) * CASE WHEN first = conv_id THEN 1.5 ELSE 1.0 END, 6) AS score FROM t JOIN f USING (word), n),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, word) AS r FROM s) SELECT conv_id, CAST(r AS INTEGER) AS rank, word, steps, score FROM r WHERE r <= 3""")
def score_names(spark, d):
    w = read(spark, d, "conversations").select("conv_id", F.explode(F.split(F.lower("text"), " ")).alias("word")).filter(F.length("word") >= 4)
    t = w.groupBy("conv_id", "word").agg(F.count(F.lit(1)).alias("steps"))
    f = t.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.min("conv_id").alias("first"))
    n = t.agg(F.countDistinct("conv_id").alias("n"))
    fresh = F.when(F.col("first") == F.col("conv_id"), 1.5).otherwise(1.0)
    s = t.join(f, "word").crossJoin(F.broadcast(n)).withColumn("score", F.round(F.col("steps") * F.log(1 + F.col("n") / F.col("df").cast("double")) * fresh, 6))
    return live.newest(s, by=["conv_id"], order=[F.desc("score"), F.asc("word")], n=3).select("conv_id", "rank", "word", "steps", "score")


@query("""WITH t AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS w FROM conversations), x AS (SELECT conv_id, turn, w, lead(w) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM t)
SELECT conv_id, turn, CAST(len(list_intersect(w, v)) AS BIGINT) AS common, round(CAST(len(list_intersect(w, v)) AS DOUBLE) / (len(w) + len(v) - len(list_intersect(w, v))), 6) AS jaccard FROM x WHERE v IS NOT NULL""")
def jaccard_neighbours(spark, d):
    from pyspark.sql.window import Window

    t = read(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    x = t.withColumn("v", F.lead("w").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("v IS NOT NULL")
    common = F.size(F.array_intersect("w", "v")).cast("bigint")
    return x.select("conv_id", "turn", common.alias("common"), F.round(common.cast("double") / (F.size("w") + F.size("v") - common), 6).alias("jaccard"))


@query(f"WITH {E_SQL} SELECT CAST(us // 60000000 AS BIGINT) AS bin, cls, count(*) AS n, {dsum('value')} AS cost FROM e GROUP BY 1, 2")
def stream_minute_bins(spark, d):
    stream = live_bins.file_stream(spark, f"{d}/events.parquet").select(M.micros(F.col("ts")).alias("us"), F.col("event_type").alias("cls"), "value")
    out, state = scratch(spark, "bins"), scratch(spark, "bins-state")

    def each(batch: DataFrame, number: int) -> None:
        live_bins.upsert_bins(out, ["bin", "cls"])(live_bins.partial_bins(batch, us="us", cls="cls", cost="value", width_us=60 * S), number)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return live_bins.merged_bins(spark.read.parquet(out).drop("batch"))


@query(f"WITH {E_SQL} SELECT user_id AS key, count(*) AS n, {dsum('value')} AS cost, max(us) AS last_us FROM e GROUP BY 1")
def stream_running_state(spark, d):
    stream = live_bins.file_stream(spark, f"{d}/events.parquet").select("user_id", M.micros(F.col("ts")).alias("us"), "value")
    out, state = scratch(spark, "running"), scratch(spark, "running-state")
    rows = live_bins.running_state(stream, key="user_id", us="us", cost="value")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    newest = live.latest(spark.read.parquet(out), by=["key"], order=["batch"], columns=["n", "cost", "last_us"])
    return newest.withColumn("cost", F.round("cost", 4))


@query(f"""WITH {E_SQL}, t AS (SELECT user_id AS grp, us // 604800000000 AS tick, cls AS name, count(*) AS n FROM e GROUP BY ALL), k AS (SELECT grp, count(DISTINCT tick) AS ticks FROM t GROUP BY 1)
SELECT grp, name, min(n) AS n FROM t JOIN k USING (grp) GROUP BY grp, name, ticks HAVING count(DISTINCT tick) = ticks""")
def census_baseline(spark, d):
    return live.least_census(_ticks(spark, d, 7), by="user_id", tick="tick", name="cls", count="n")


def _ticks(spark, d, days=1):
    return events(spark, d).groupBy("user_id", F.floor(F.col("us") / (days * 24 * H)).alias("tick"), "cls").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {E_SQL}, t AS (SELECT user_id AS grp, us // 86400000000 AS tick, cls AS name, count(*) AS n FROM e GROUP BY ALL), k AS (SELECT grp, count(DISTINCT tick) AS ticks, max(tick) AS last FROM t GROUP BY 1),
b AS (SELECT grp, name, min(n) AS n FROM t JOIN k USING (grp) GROUP BY grp, name, ticks HAVING count(DISTINCT tick) = ticks),
o AS (SELECT t.grp, t.name, t.n - coalesce(b.n, 0) AS n FROM t JOIN k ON k.grp = t.grp AND k.last = t.tick LEFT JOIN b ON b.grp = t.grp AND b.name = t.name)
SELECT grp, name, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, name) AS r FROM o WHERE n > 0) WHERE r <= 5""")
def running_now(spark, d):
    ticks = _ticks(spark, d)
    last = ticks.groupBy("user_id").agg(F.max("tick").alias("tick"))
    now = ticks.join(last, ["user_id", "tick"]).select(F.col("user_id").alias("grp"), F.col("cls").alias("name"), "n")
    return live.census_above(now, live.least_census(ticks, by="user_id", tick="tick", name="cls", count="n"))


@query(f"WITH {E_SQL} SELECT user_id, event_id, cls, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS r FROM e) WHERE r <= 5")
def user_tail(spark, d):
    return live.newest(events(spark, d), by=["user_id"], order=[F.desc("us"), F.desc("event_id")], n=5).select("user_id", "event_id", "cls", "rank")


@query(f"WITH {E_SQL} SELECT host, event_id, us, cls FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY us DESC, event_id DESC) AS r FROM e) WHERE r = 1")
def latest_state(spark, d):
    return live.latest(events(spark, d), by=["host"], order=["us", "event_id"], columns=["event_id", "us", "cls"])


@query(f"WITH {E_SQL} SELECT CASE WHEN count(*) > 0 THEN count(DISTINCT (user_id, cls)) END AS alive FROM e WHERE us > {AS_OF} - {12 * H} AND us <= {AS_OF}")
def sessions_alive(spark, d):
    return live.alive(events(spark, d), by=["user_id", "cls"], us="us", as_of_us=AS_OF, within_us=12 * H)


@query(f"WITH {E_SQL} SELECT cls AS grp, event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY value DESC, event_id) AS r FROM e) WHERE r = 1")
def largest_by_class(spark, d):
    return stats.largest_rows(events(spark, d), by="cls", value="value", key="event_id", columns=["event_id", "user_id", "value"])


@query(f"WITH {E_SQL} SELECT cls, list_sort(list(value))[count(*) // 2 + 1] AS upper_median FROM e GROUP BY cls")
def upper_median(spark, d):
    return stats.upper_medians(events(spark, d), by="cls", value="value").withColumnRenamed("grp", "cls")


@query(f"WITH {E_SQL} SELECT cls, host, CAST(grouping(cls) * 2 + grouping(host) AS BIGINT) AS level, count(*) AS n, {dsum('value')} AS cost, count(*) FILTER (k < 5) AS stalled FROM e GROUP BY GROUPING SETS ((cls, host), (cls), (host), ())")
def confinement_matrix(spark, d):
    e = events(spark, d)
    return e.cube("cls", "host").agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("n"), M.exact_sum("value").alias("cost"), F.count_if(F.col("k") < 5).alias("stalled"))


@query(f"""WITH {E_SQL}, s AS (SELECT user_id, cls, count(*) AS n, {dsum("value")} AS cost, count(DISTINCT host) AS hosts FROM e WHERE cls IN ('click', 'purchase') GROUP BY ALL), t AS (SELECT {dsum("cost")} AS whole FROM s)
SELECT user_id, cls, n, cost, hosts, {dpct("cost", "whole")} AS cost_pct FROM s, t ORDER BY cost DESC, user_id, cls LIMIT 24""")
def login_compute(spark, d):
    s = events(spark, d).filter(F.col("cls").isin("click", "purchase")).groupBy("user_id", "cls").agg(F.count(F.lit(1)).alias("n"), M.exact_sum("value").alias("cost"), F.countDistinct("host").alias("hosts"))
    whole = s.agg(M.exact_sum("cost").alias("whole"))
    return s.crossJoin(F.broadcast(whole)).select("user_id", "cls", "n", "cost", "hosts", M.pct(F.col("cost"), F.col("whole")).alias("cost_pct")).orderBy(F.desc("cost"), "user_id", "cls").limit(24)


@query(f"WITH {E_SQL} SELECT CAST(1800 AS INTEGER) AS width, CAST(us // 1800000000 AS BIGINT) AS bin, cls AS kind, count(*) AS starts, min(event_id) AS first_key FROM e GROUP BY 2, 3")
def navigator_density(spark, d):
    return series.density(events(spark, d), us="us", kind="cls", key="event_id")


@query("""WITH s(p_size, spec) AS (SELECT DISTINCT p_size, CASE p_size % 4 WHEN 0 THEN '0-' || p_size || '%4' WHEN 1 THEN '1-' || p_size || ':3' WHEN 2 THEN p_size || ',' || (p_size + 2) || '-' || (p_size + 9) ELSE 'x' || p_size END FROM part)
SELECT CAST(p_size AS INTEGER) AS p_size, spec, CAST(CASE p_size % 4 WHEN 0 THEN p_size + 1 WHEN 1 THEN (p_size - 1) // 3 + 1 WHEN 2 THEN 9 END AS BIGINT) AS tasks FROM s""")
def array_specs(spark, d):
    n = F.col("p_size").cast("string")
    spec = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("0-"), n, F.lit("%4"))).when(F.col("p_size") % 4 == 1, F.concat(F.lit("1-"), n, F.lit(":3")))
    spec = spec.when(F.col("p_size") % 4 == 2, F.concat(n, F.lit(","), (F.col("p_size") + 2).cast("string"), F.lit("-"), (F.col("p_size") + 9).cast("string"))).otherwise(F.concat(F.lit("x"), n))
    return read(spark, d, "part").select("p_size").distinct().withColumn("spec", spec).withColumn("tasks", text.array_tasks(F.col("spec")))


@query("SELECT DISTINCT p_size, CAST(p_size * 1048576 AS DOUBLE) AS bytes, CAST(p_size * 3600 + 61 AS BIGINT) AS secs FROM part")
def sizes_and_durations(spark, d):
    n = F.col("p_size")
    made = read(spark, d, "part").select("p_size").distinct().withColumns({"a": F.concat(n.cast("string"), F.lit("M")), "b": F.concat(F.floor(n / 24).cast("string"), F.lit("-"), F.lpad((n % 24).cast("string"), 2, "0"), F.lit(":01:01"))})
    return made.select("p_size", text.size_bytes(F.col("a")).alias("bytes"), text.seconds(F.col("b")).alias("secs"))


@query("""WITH a AS (SELECT s_suppkey, (10 + s_suppkey % 3) * 16777216 + (s_suppkey % 7) * 65536 + s_suppkey AS ip FROM supplier), n(base, bits, provider) AS (VALUES (167772160, 8, 'ten'), (167837696, 16, 'ten-one'), (184549376, 8, 'eleven')),
m AS (SELECT s_suppkey, provider, bits FROM a LEFT JOIN n ON ip // CAST(pow(2, 32 - bits) AS BIGINT) = base // CAST(pow(2, 32 - bits) AS BIGINT)) SELECT s_suppkey, arg_max(provider, bits) AS provider FROM m GROUP BY 1""")
def provider_networks(spark, d):
    ip = F.concat_ws(".", (10 + F.col("s_suppkey") % 3).cast("string"), (F.col("s_suppkey") % 7).cast("string"), F.floor(F.col("s_suppkey") / 256).cast("string"), (F.col("s_suppkey") % 256).cast("string"))
    a = read(spark, d, "supplier").select("s_suppkey", text.ip_number(ip).alias("ip"))
    n = spark.createDataFrame([(167772160, 8, "ten"), (167837696, 16, "ten-one"), (184549376, 8, "eleven")], "base bigint, bits int, provider string")
    return ev.longest_prefix(a, n, number="ip", key="s_suppkey")


@query("SELECT 'missing' AS side, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'extra', 0")
def history_round_trip(spark, d):
    e = read(spark, d, "events")
    path = scratch(spark, "history")
    feeds.write_history(e, path, ts="ts", kind="event_type")
    return feeds.differences(e, feeds.read_history(spark, path).drop("day"))


@query(f"WITH {E_SQL} SELECT event_id, us, cls FROM e WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-06'")
def history_window(spark, d):
    path = scratch(spark, "history")
    feeds.write_history(read(spark, d, "events"), path, ts="ts")
    own = feeds.read_history(spark, path, first_day="2024-01-05", last_day="2024-01-06")
    return own.select("event_id", M.micros(F.col("ts")).alias("us"), F.col("event_type").alias("cls"))


@query(f"WITH {E_SQL} SELECT cls, count(*) AS n, {dsum('value')} AS cost, CAST(0 AS BIGINT) AS bad FROM e GROUP BY cls")
def jsonl_scan(spark, d):
    e = events(spark, d).select("event_id", "us", "cls", "value")
    path = scratch(spark, "feed")
    e.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    good, bad = feeds.read_jsonl(spark, path, e.schema)
    return good.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), M.exact_sum("value").alias("cost")).crossJoin(F.broadcast(bad.agg(F.count(F.lit(1)).alias("bad"))))


@query(f"WITH {E_SQL} SELECT host, us, event_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY us DESC, event_id DESC) AS r FROM e) WHERE r <= 2")
def newest_snapshots(spark, d):
    return feeds.newest_snapshots(events(spark, d), host="host", ts="us", key="event_id").select("host", "us", "event_id", "rank")


@query(f"""WITH {E_SQL}, f AS (SELECT cls, max(us) AS newest_us, CAST(1 AS INTEGER) AS files, count(*) FILTER (k = 0) AS bad FROM e GROUP BY cls)
SELECT cls, newest_us, files, bad, CASE WHEN newest_us < {AS_OF} - {1 * H} THEN 'stale' WHEN bad > 20 THEN 'degraded' WHEN bad > 0 THEN 'degraded' ELSE 'ok' END AS status, {AS_OF} - newest_us AS lag_us FROM f""")
def feed_status(spark, d):
    f = events(spark, d).groupBy("cls").agg(F.max("us").alias("newest_us"), F.lit(1).alias("files"), F.count_if(F.col("k") == 0).alias("bad"))
    return feeds.feed_status(f, as_of_us=AS_OF, stale_us=H)


@query(f"WITH {E_SQL} SELECT event_id + c * 1000000 AS event_id, cls FROM e, range(3) AS r(c) WHERE event_id % 100 = 0".replace(" WHERE event_id % 100 = 0", ""))
def amplified_feed(spark, d):
    return feeds.amplified(events(spark, d).select("event_id", "cls"), key="event_id", times=3, step=1_000_000)


@query(f"WITH {E_SQL} SELECT event_id, least(us, 1706054400000000) AS us FROM e WHERE us <= 1706054400000000 + 120000000")
def clock_guard(spark, d):
    return live_bins.guard_clock(events(spark, d).select("event_id", "us"), us="us", now_us=1706054400 * S)


@query()
def shell_category(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(shell.category(F.col("line")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query()
def task_spans(spark, d):
    return sequences.task_spans(events(spark, d), by="user_id", us="us", objects="cls", gap_us=12 * H, least_us=2 * H)


@query()
def phase_runs(spark, d):
    return sequences.absorbed_runs(events(spark, d), by="user_id", token="cls", us="us", key="event_id", most_us=12 * H)


_MOTIFS = ", ".join(f"CASE WHEN coalesce(lead(cls, {p}) OVER w = cls, false) THEN NULL ELSE r END AS x{p}" for p in (1, 2, 3, 4))
_ENDS = ", ".join(f"(min(x{p}) OVER (PARTITION BY grp ORDER BY r DESC) - r) // {p} + 1 AS t{p}" for p in (1, 2, 3, 4))
_BEST = "greatest(" + ", ".join(f"CASE WHEN t{p} >= 3 THEN {{'cover': t{p} * {p}, 'minus': -{p}, 'n': t{p}}} ELSE {{'cover': CAST(1 AS BIGINT), 'minus': -1, 'n': CAST(1 AS BIGINT)}} END" for p in (1, 2, 3, 4)) + ")"


@query(f"""WITH RECURSIVE {E_SQL}, a AS (SELECT user_id AS grp, cls, us, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS r FROM e),
b AS (SELECT grp, r, {_MOTIFS} FROM a WINDOW w AS (PARTITION BY grp ORDER BY us, event_id)), c AS (SELECT grp, r, {_ENDS} FROM b), f AS (SELECT grp, r, {_BEST} AS g FROM c),
k AS (SELECT grp, r, g FROM f WHERE r = 0 UNION ALL SELECT f.grp, f.r, f.g FROM k JOIN f ON f.grp = k.grp AND f.r = k.r + k.g.cover)
SELECT grp, r AS "at", CAST(-g.minus AS BIGINT) AS period, g.n AS repeats FROM k""")
def periodic_motifs(spark, d):
    return sequences.periodic_runs(events(spark, d), by="user_id", token="cls", order=["us", "event_id"])


@query(f"""WITH c AS (SELECT c_custkey % 7 AS grp, c_custkey AS key, c_custkey * {S} AS us, c_name FROM customer),
p AS (SELECT *, lead(c_name) OVER w AS b, lead(key) OVER w AS next_key, lead(us) OVER w - us AS gap FROM c WINDOW w AS (PARTITION BY grp ORDER BY us, key))
SELECT grp, key, next_key, damerau_levenshtein(c_name, b) AS distance FROM p WHERE key % 3 = 0 AND gap BETWEEN {S // 2} AND {120 * S} AND damerau_levenshtein(c_name, b) BETWEEN 1 AND greatest(3, length(c_name) // 5)""")
def typo_pairs(spark, d):
    c = read(spark, d, "customer").select((F.col("c_custkey") % 7).alias("host"), F.col("c_custkey").alias("key"), (F.col("c_custkey") * S).alias("us"), "c_name")
    return sequences.retyped(c, by="host", us="us", key="key", text="c_name", failed=F.col("key") % 3 == 0)
