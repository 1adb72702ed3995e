"""What agents are and how their users work with them: roles, surfaces, portraits, rosters, hosts and costs by class; tables as in ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import roles, taxonomy, text
from ..operators import jobs, live, panels, portraits, sequences, series, stats, views
from ..operators import normalize as nz
from .mechanisms import ZONE
from .queries import AS_OF, E_SQL, H, S, _sketch_sql, dpct, dsum, events, query, read
from .records import _pick, _pick_sql

#: Processes tagged as agents: type, command, line, terminal; then role, subcommand, surface, its detail and version, told by hand.
PROCESSES = (
    ("codex", "codex-linux-san", "codex-linux-sandbox --x -- ls", "", "sandbox", None, None, None, None), ("bwrap", "bwrap", "bwrap --ro-bind / / sh", "", "sandbox", None, None, None, None),
    ("codex", "codex", "codex sandbox -C d -P agent -- ls", "", "sandbox", "sandbox", None, None, None), ("vscode", "code-1a2b3c4", "/h/.vscode-server/code-1a2b3c4 x", "", "ide", None, None, None, None),
    ("vscode", "node", "node out/server-main.js", "", "ide", None, None, None, None), ("vscode", "sh", "sh /h/.vscode-server/check.sh", "", "helper", None, None, None, None),
    ("cursor", "node", "/h/.cursor-server/node bootstrap-fork", "", "ide", None, None, None, None), ("cursor", "cursor-agent", "cursor-agent fix it", "pts/1", "agent", "fix", None, None, None),
    ("codex", "codex-code-mode", "codex-code-mode-host", "", "infra", None, None, None, None), ("claude_code", "srv", "/h/.claude/remote/srv/a/srv serve", "", "infra", None, "desktop", "Claude desktop app", None),
    ("claude_code", "srv", "/h/.claude/remote/srv/a/srv --version", "", "probe", None, None, None, None), ("claude_code", "claude", "/bin/bash /t/stub/claude -p", "", "helper", None, None, None, None),
    ("claude_code", "claude", "/usr/bin/env node /o/bin/claude -p hi", "", "agent", None, "script", "claude -p", None), ("codex", "codex", "/usr/bin/env -S A=1 node /o/bin/codex exec go", "", "agent", "exec", "script", "codex exec", None),
    ("codex", "node", "node --max-old-space-size=9 /o/@openai/codex/bin/codex.js exec --experimental-json", "", "agent", "exec", "script", "Codex SDK", None), ("codex", "node", "node /o/other.js codex", "", "helper", None, None, None, None),
    ("claude_code", "zsh", "zsh -c source /h/.claude/shell-snapshots/s.sh", "", "tool-shell", None, None, None, None), ("claude_code", "mkdir", "mkdir /h/.codex/x", "", "helper", None, None, None, None),
    ("claude_code", "2.1.291", "rg -n word", "", "embedded-tool", "word", None, None, "2.1.291"), ("codex", "codex", "codex --codex-run-as-fs-helper", "", "helper", None, None, None, None),
    ("claude_code", "claude", "claude --claude-in-chrome-mcp", "", "helper", None, None, None, None), ("claude_code", "claude", "claude --model m --version", "", "probe", None, None, None, None),
    ("claude_code", "claude", "claude --model doctor", "pts/2", "agent", None, "terminal", "interactive", None), ("claude_code", "claude", "claude auth status", "", "probe", "auth", None, None, None),
    ("codex", "codex", "codex migrate-nfs-db", "", "probe", "migrate-nfs-db", None, None, None), ("codex", "codex", "codex -c a=b app-server proxy", "", "client", "app-server", None, None, None),
    ("codex", "codex", "codex app-server daemon", "", "infra", "app-server", "unknown", "shared app server", None), ("codex", "codex", "codex app-server", "", "agent", "app-server", "unknown", "app server", None),
    ("codex", "codex", "codex app-server --listen unix:///s", "", "agent", "app-server", "unknown", "shared app server", None),
    ("codex", "codex", "codex -c features.code_mode_host=true app-server --listen unix:///s", "", "agent", "app-server", "desktop", "Codex app", None), ("codex", "codex", "codex app-server --remote-control", "", "agent", "app-server", "web", "Codex Remote Control", None),
    ("codex", "codex", "/h/.vscode-server/extensions/openai.chatgpt-1/codex app-server", "", "agent", "app-server", "extension", "VS Code", None), ("codex", "codex", "/h/.trae-server/extensions/openai.chatgpt-1/codex", "", "agent", None, "extension", "trae", None),
    ("codex", "codex", "/h/.trae-server/extensions/openai.chatgpt-1/codex", "pts/3", "agent", None, "terminal", "interactive", None), ("claude_code", "claude", "claude mcp serve", "", "agent", "mcp", "script", "MCP server", None),
    ("claude_code", "claude", "claude mcp list", "", "probe", "mcp", None, None, None), ("claude_code", "claude", "claude attach 7", "", "client", "attach", None, None, None), ("claude_code", "claude", "claude rc", "", "infra", "rc", "web", "Claude Remote Control", None),
    ("codex", "codex", "codex remote-control", "", "infra", "remote-control", "web", "Codex Remote Control", None), ("claude_code", "claude", "claude daemon run", "", "infra", "daemon", "terminal", "background session", None),
    ("claude_code", "claude", "claude --output-format stream-json -p x", "", "agent", None, "script", "Agent SDK", None), ("claude_code", "claude", "/h/.cursor-server/extensions/anthropic.claude-code-2/claude --input-format=stream-json", "", "agent", None, "extension", "Cursor", None),
    ("claude_code", "2.1.286", "/h/.claude/remote/ccd-cli/2.1.286 --input-format stream-json", "", "agent", None, "desktop", "Claude desktop app", "2.1.286"), ("claude_code", "claude", "claude --print --sdk-url ws://x", "", "agent", None, "web", "Claude Remote Control", None),
    ("claude_code", "claude", "claude bg-spare", "", "agent", "bg-spare", "terminal", "background session", None), ("copilot", "copilot", "copilot -p fix", "", "agent", None, "script", "-p", None), ("codex", "codex", "/o/releases/0.162.1-x86/bin/codex mcp-server", "", "agent", "mcp-server", "script", "MCP server", "0.162.1"),
    ("claude_code", "claude", "claude -c -m x", "pts/4", "agent", "x", "terminal", "interactive", None), (None, "python3", "", "", "helper", None, None, None, None), ("claude_code", "claude", None, "", "agent", None, "terminal", "interactive", None),
)


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _processes(spark, d):
    """An event is the process at the place of its k; every seventh is a person's, every eleventh is not tagged."""
    column = lambda at: F.element_at(F.array(*(F.lit(p[at]) for p in PROCESSES)), (F.col("k") % len(PROCESSES) + 1).cast("int"))
    return events(spark, d).select(
        "event_id", "user_id", F.lit(8).alias("schema_version"), F.when(F.col("event_id") % 13 == 0, "start").otherwise("exit").alias("event"), F.when(F.col("event_id") % 7 == 0, "human").otherwise("agent").alias("actor3"),
        (F.col("event_id") % 11 > 0).alias("is_agent"), column(0).alias("agent_type"), column(1).alias("command"), column(2).alias("args"), column(3).alias("tty"),
    )


PROCESSES_SQL = f"""{E_SQL}, told(i, kind, command, args, tty, role, sub, surface, detail, version) AS (VALUES {", ".join(f"({i}, {', '.join(map(_text, p))})" for i, p in enumerate(PROCESSES))}),
r AS (SELECT event_id, user_id, event_id % 7 = 0 AS person, CASE WHEN event_id % 11 > 0 AND event_id % 13 > 0 THEN role END AS role, CASE WHEN event_id % 11 > 0 AND event_id % 13 > 0 THEN sub END AS sub,
  CASE WHEN event_id % 11 > 0 AND event_id % 13 > 0 AND event_id % 7 > 0 THEN surface END AS surface, CASE WHEN event_id % 11 > 0 AND event_id % 13 > 0 AND event_id % 7 > 0 THEN detail END AS detail, version FROM e JOIN told ON k % {len(PROCESSES)} = i)"""


@query(f"WITH {PROCESSES_SQL} SELECT role, sub AS subcommand, surface, detail, version, count(*) AS n, count(DISTINCT user_id) AS users FROM r GROUP BY ALL")
def role_census(spark, d):
    """How many processes of which role, asked for what, driven from where."""
    n = nz.normalize(_processes(spark, d))
    by = [F.col("_role").alias("role"), F.col("_subcommand").alias("subcommand"), F.col("_surface").alias("surface"), F.col("_surface_detail").alias("detail"), roles.version(F.col("command"), F.col("args")).alias("version")]
    return n.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


# --- portraits

#: A user's sessions are stretches of 4 days, a day or 6 hours, up to four at once; a state that is the user's own prevails.
SURFACES, APPROVALS, BOXES = ("terminal", "script", "desktop", "extension", "web", "unknown"), ("bypassed", "auto", "supervised", "unobservable", "unknown"), ("sandboxed", "partial", "failed", "unsandboxed", "unknown", "no_calls")
CATS = ("test", "slurm", "run", "build", "edit", "git", "wait", "explore", "unknown")


def _state(values: tuple[str, ...], often: str) -> str:
    """SQL that both sides read: the user's own value often, else one by session, or null."""
    listed = ", ".join(f"'{v}'" for v in values)
    return f"CASE WHEN {often} THEN element_at(array({listed}), CAST(user_id % {len(values)} + 1 AS INT)) ELSE element_at(array({listed}, NULL), CAST(s % {len(values) + 1} + 1 AS INT)) END"


def _state_sql(values: tuple[str, ...], often: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"CASE WHEN {often} THEN [{listed}][user_id % {len(values)} + 1] ELSE [{listed}, NULL][s % {len(values) + 1} + 1] END"


WORK_SQL = f"""{E_SQL}, x AS (SELECT *, us // (CASE user_id % 3 WHEN 0 THEN 96 WHEN 1 THEN 24 ELSE 6 END * {H}) * 8 + k % (user_id % 4 + 1) AS s, CASE WHEN user_id % 50 < 49 THEN 'u' || user_id END AS "user" FROM e),
y AS (SELECT *, CASE user_id % 3 WHEN 0 THEN 'claude_code' WHEN 1 THEN CASE s % 3 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude_code' ELSE '' END ELSE CASE WHEN user_id % 2 = 0 THEN 'copilot' ELSE 'codex' END END AS kind FROM x),
ss AS (SELECT "user", s, kind, any_value({_state_sql(SURFACES, "s % 5 < user_id % 4 + 1")}) AS surface, any_value({_state_sql(APPROVALS, "s % 5 < user_id % 5")}) AS approval, any_value({_state_sql(BOXES, "s % 5 < user_id % 3 + 1")}) AS sandbox,
  min(us) AS first_us, max(us) AS last_us, s % 9 = 0 AS running, any_value(CASE WHEN s % 6 > 0 THEN 'p' || (s * 7 % (user_id % 7 + 1)) END) AS project, count(*) AS processes, {dsum("value")} AS cost FROM y WHERE "user" IS NOT NULL GROUP BY ALL),
cc AS (SELECT "user", CASE WHEN user_id % 6 = 0 THEN us - us % {24 * H} + {5 * H} + us % {4 * H} ELSE us END AS us, CASE WHEN k < 70 AND user_id % 4 < 3 THEN [{", ".join(f"'{c}'" for c in CATS)}][user_id % 9 + 1] ELSE [{", ".join(f"'{c}'" for c in CATS)}, NULL][k % 10 + 1] END AS category,
  CASE WHEN user_id % 3 = 0 THEN CASE k % 10 WHEN 0 THEN 'commit' WHEN 1 THEN 'pr' END END AS said, k % 4 AS words FROM y WHERE "user" IS NOT NULL AND kind IN ('claude_code', 'codex')),
bb AS (SELECT "user", count(*) FILTER (cls = 'purchase' AND k < 50) AS jobs, max(user_id % 2) AS polling_sessions FROM y WHERE user_id % 5 = 0 GROUP BY 1)"""


def _work(spark, d):
    width = F.when(F.col("user_id") % 3 == 0, 96).when(F.col("user_id") % 3 == 1, 24).otherwise(6) * F.lit(H)
    x = events(spark, d).withColumns({"s": F.floor(F.col("us") / width) * 8 + F.col("k") % (F.col("user_id") % 4 + 1), "user": F.when(F.col("user_id") % 50 < 49, F.concat(F.lit("u"), F.col("user_id")))})
    u, s = F.col("user_id"), F.col("s")
    kind = F.when(u % 3 == 0, "claude_code").when(u % 3 == 1, F.when(s % 3 == 0, "codex").when(s % 3 == 1, "claude_code").otherwise("")).otherwise(F.when(u % 2 == 0, "copilot").otherwise("codex"))
    y = x.withColumn("kind", kind)
    sessions = y.groupBy("user", "user_id", "s", "kind").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("processes"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("cost"))
    sessions = sessions.withColumns({
        "surface": F.expr(_state(SURFACES, "s % 5 < user_id % 4 + 1")), "approval": F.expr(_state(APPROVALS, "s % 5 < user_id % 5")), "sandbox": F.expr(_state(BOXES, "s % 5 < user_id % 3 + 1")),
        "running": s % 9 == 0, "project": F.when(s % 6 > 0, F.concat(F.lit("p"), s * 7 % (u % 7 + 1))),
    })
    day = 24 * H
    at = F.when(u % 6 == 0, F.col("us") - F.col("us") % day + 5 * H + F.col("us") % (4 * H)).otherwise(F.col("us"))
    category = F.when((F.col("k") < 70) & (u % 4 < 3), _pick(CATS, "user_id")).otherwise(F.get(F.array(*map(F.lit, CATS)), (F.col("k") % 10).cast("int")))
    said = F.when(u % 3 == 0, F.when(F.col("k") % 10 == 0, "commit").when(F.col("k") % 10 == 1, "pr"))
    calls = y.select("user", "kind", at.alias("us"), category.alias("category"), said.alias("said"), (F.col("k") % 4).alias("words"))
    batch = y.filter(u % 5 == 0).filter("user IS NOT NULL").groupBy("user").agg(F.count_if((F.col("cls") == "purchase") & (F.col("k") < 50)).alias("jobs"), F.max(u % 2).alias("polling_sessions"), F.lit(0.0).alias("polling_s"))
    return portraits.with_traits(portraits.user_rows(sessions, calls, batch, zone=ZONE))


def _share_sql(part: str, whole: str, least: float) -> str:
    return f"coalesce({whole} > 0 AND {part} >= {least}::DOUBLE * {whole}, false)"


_CALLS = " + ".join(f"c_{c}" for c in CATS)
_KNOWN, _STARTED, _JUDGED = "(sessions - s_unknown)", "(a_bypassed + a_auto + a_supervised)", "(b_sandboxed + b_partial + b_failed + b_unsandboxed)"
_ACTIONS = "(c_explore + c_edit + c_test + c_build + c_run + c_slurm + c_git)"
_TRAITS_SQL = {
    "interactive": _share_sql("s_terminal", _KNOWN, 0.6), "scripted": _share_sql("s_script", _KNOWN, 0.5), "app": _share_sql("(s_desktop + s_extension + s_web)", _KNOWN, 0.5), "bypass": _share_sql("a_bypassed", _STARTED, 0.5), "auto": _share_sql("a_auto", _STARTED, 0.5),
    "sandboxed": _share_sql("(b_sandboxed + b_partial)", _JUDGED, 0.5), "multi_agent": "agent_types >= 2", "parallel": "peak_open >= 3", "long": "wall_p50_us >= 7200000000", "short": "sessions >= 10 AND wall_p50_us <= 600000000",
    **{t: f"logged >= 20 AND {_share_sql(f'c_{c}', 'logged', least)}" for t, c, least in (("explorer", "explore", 0.6), ("tester", "test", 0.15), ("builder", "build", 0.15))},
    "slurm": f"coalesce(jobs, 0) > 0 OR (logged >= 20 AND {_share_sql('c_slurm', 'logged', 0.1)})", "poller": f"coalesce(polling_sessions, 0) > 0 OR (logged >= 20 AND {_share_sql('c_wait', 'logged', 0.25)})",
    "committer": "said_commit + said_pr > 0", "overnight": f"active_min >= 60 AND {_share_sql('night', 'active_min', 0.25)}",
}
PORTRAIT_SQL = f"""{WORK_SQL}, g AS (SELECT "user", count(*) AS sessions, count(*) FILTER (running) AS running, {", ".join(f"count(*) FILTER (coalesce(surface, 'unknown') = '{v}') AS s_{v}" for v in SURFACES)},
  {", ".join(f"count(*) FILTER (coalesce(approval, 'unknown') = '{v}') AS a_{v}" for v in APPROVALS)}, {", ".join(f"count(*) FILTER (coalesce(sandbox, 'no_calls') = '{v}') AS b_{v}" for v in BOXES)},
  count(DISTINCT nullif(kind, '')) AS agent_types, count(*) FILTER (kind IN ('claude_code', 'codex')) AS read_sessions, {dsum("cost")} AS cost, CAST(sum(last_us - first_us) AS BIGINT) AS wall_us, list_sort(list(last_us - first_us))[(count(*) - 1) // 2 + 1] AS wall_p50_us FROM ss GROUP BY 1),
o AS (SELECT "user", max(n) AS peak_open FROM (SELECT "user", (SELECT count(*) FROM ss b WHERE b."user" = a."user" AND b.first_us <= a.first_us AND b.last_us >= a.first_us) AS n FROM ss a) GROUP BY 1),
pp AS (SELECT "user", count(*) AS projects_total, string_agg(project || ':' || n, ',' ORDER BY r) FILTER (r <= 5) AS projects, max(project) FILTER (r = 1) AS project, max(n) FILTER (r = 1) AS project_n FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY n DESC, project) AS r FROM (SELECT "user", project, count(*) AS n FROM ss WHERE project IS NOT NULL GROUP BY ALL)) GROUP BY 1),
ct AS (SELECT "user", {", ".join(f"count(*) FILTER (coalesce(category, 'unknown') = '{c}') AS c_{c}" for c in CATS)} FROM cc GROUP BY 1),
mm AS (SELECT "user", CAST(hour(timezone('{ZONE}', make_timestamptz(m * 60000000))) AS INTEGER) AS h, count(*) AS n FROM (SELECT DISTINCT "user", us // 60000000 AS m FROM cc) GROUP BY ALL),
am AS (SELECT "user", CAST(sum(n) AS BIGINT) AS active_min, CAST(sum(n) FILTER (h < 6) AS BIGINT) AS night, arg_max(h, n * 100 - h) AS busiest_hour, {", ".join(f"coalesce(sum(n) FILTER (h = {h}), 0)::BIGINT AS h{h}" for h in range(24))} FROM mm GROUP BY 1),
wd AS (SELECT "user", count(DISTINCT words) FILTER (said = 'commit') AS said_commit, count(DISTINCT words) FILTER (said = 'pr') AS said_pr FROM cc GROUP BY 1),
j AS (SELECT * REPLACE (coalesce(active_min, 0) AS active_min, coalesce(night, 0) AS night, coalesce(said_commit, 0) AS said_commit, coalesce(said_pr, 0) AS said_pr, {", ".join(f"coalesce(c_{c}, 0) AS c_{c}" for c in CATS)}, {", ".join(f"coalesce(h{h}, 0) AS h{h}" for h in range(24))}),
  {" + ".join(f"coalesce(c_{c}, 0)" for c in CATS)} AS logged FROM g LEFT JOIN o USING ("user") LEFT JOIN pp USING ("user") LEFT JOIN ct USING ("user") LEFT JOIN am USING ("user") LEFT JOIN wd USING ("user") LEFT JOIN bb USING ("user")),
us_ AS (SELECT "user", string_agg(u || ':' || n, ',' ORDER BY n DESC, i) AS uses, max(n) AS n1, coalesce(list_sort(list(n), 'DESC')[2], 0) AS n2, count(*) AS n_uses FROM (SELECT "user", unnest([0, 1, 2, 3, 4, 5]) AS i, unnest(['explore', 'develop', 'build', 'run', 'hpc', 'git']) AS u, unnest([c_explore, c_edit + c_test, c_build, c_run, c_slurm, c_git]) AS n FROM j) WHERE n > 0 GROUP BY 1),
t AS (SELECT "user", concat_ws(',', {", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _TRAITS_SQL.items())}) AS traits FROM j)"""


@query(f"""WITH {PORTRAIT_SQL} SELECT j."user", sessions, running, {", ".join(f"s_{v} AS surface_{v}" for v in SURFACES)}, {", ".join(f"a_{v} AS approval_{v}" for v in APPROVALS)}, agent_types, cost, wall_us, wall_p50_us, peak_open, coalesce(projects_total, 0) AS projects_total, coalesce(projects, '') AS projects,
CASE WHEN read_sessions > 0 THEN logged END AS calls, active_min, concat_ws(',', {", ".join(f"h{h}" for h in range(24))}) AS hours, said_commit, said_pr, traits,
CASE WHEN {_KNOWN} = 0 THEN 'unknown' WHEN greatest(s_terminal, s_script, s_extension, s_desktop + s_web) < 0.5::DOUBLE * {_KNOWN} THEN 'mixed' WHEN s_terminal = greatest(s_terminal, s_script, s_extension, s_desktop + s_web) THEN 'terminal'
  WHEN s_script = greatest(s_script, s_extension, s_desktop + s_web) THEN 'script' WHEN s_extension >= s_desktop + s_web THEN 'extension' ELSE 'app' END AS mode,
CASE WHEN {_STARTED} > 0 THEN CASE WHEN a_bypassed >= 0.5::DOUBLE * {_STARTED} THEN 'bypass' WHEN a_auto >= 0.5::DOUBLE * {_STARTED} THEN 'auto' ELSE 'no_flag' END END AS autonomy, CASE WHEN peak_open >= 3 THEN peak_open END AS parallel,
CASE WHEN read_sessions > 0 AND {_ACTIONS} >= 20 THEN uses ELSE '' END AS uses, {_ACTIONS} AS actions, CAST(CASE WHEN read_sessions = 0 OR {_ACTIONS} < 20 THEN 0 WHEN n1 >= 0.5::DOUBLE * {_ACTIONS} THEN 1 WHEN n_uses > 1 AND n1 + n2 >= 0.5::DOUBLE * {_ACTIONS} THEN 2 ELSE 0 END AS INTEGER) AS mostly,
CASE WHEN logged >= 20 AND c_wait >= 0.25::DOUBLE * logged THEN c_wait END AS waiting, project, project_n >= 0.5::DOUBLE * sessions AS project_mostly, CASE WHEN active_min > 0 THEN busiest_hour END AS busiest_hour, CASE WHEN active_min >= 60 THEN round(100.0::DOUBLE * night / active_min, 1) END AS night_pct
FROM j JOIN t USING ("user") LEFT JOIN us_ USING ("user")""")
def user_portraits(spark, d):
    rows = portraits.with_leverage(_work(spark, d))
    pair = lambda name: lambda x: F.concat_ws(":", x[name], x["n"])
    own = ["user", "sessions", "running", *(f"surface_{v}" for v in SURFACES), *(f"approval_{v}" for v in APPROVALS), "agent_types", "cost", "wall_us", "wall_p50_us", "peak_open", "projects_total", "calls", "active_min", "said_commit", "said_pr"]
    lists = [F.array_join(F.transform("projects", pair("project")), ",").alias("projects"), F.array_join("hours", ",").alias("hours"), F.array_join("traits", ",").alias("traits"), F.array_join(F.transform("uses", pair("id")), ",").alias("uses")]
    return rows.select(*own, *lists, "mode", "autonomy", "parallel", "actions", "mostly", "waiting", "project", "project_mostly", "busiest_hour", "night_pct")


@query(f"""WITH {PORTRAIT_SQL}, f AS (SELECT 'users' AS part, '' AS name, count(*) AS n FROM j UNION ALL SELECT 'sessions', '', sum(sessions) FROM j UNION ALL SELECT 'running', '', sum(running) FROM j
{" ".join(f"UNION ALL SELECT '{part}', '{v}', sum({p}_{v}) FROM j" for part, p, names in (("surface", "s", SURFACES), ("approval", "a", APPROVALS), ("sandbox", "b", BOXES), ("cat", "c", CATS)) for v in names)}
UNION ALL SELECT 'trait', name, count(*) FROM (SELECT unnest(string_split(traits, ',')) AS name FROM t WHERE traits <> '') GROUP BY 2) SELECT part, name, CAST(n AS BIGINT) AS n FROM f WHERE n > 0""")
def fleet_portrait(spark, d):
    return portraits.fleet(_work(spark, d))


# --- costs by class: sketches of several measures, stalls, series

COST_SQL = f"""{E_SQL}, m AS (SELECT *, CASE WHEN k % 9 > 0 THEN value / 10 END AS run, CASE WHEN k % 10 > 0 THEN k * 2.0::DOUBLE END AS life, CASE WHEN k % 4 > 0 THEN (k % 3) * value END AS wait, CASE WHEN k % 4 > 0 THEN k % 3 END AS episodes,
  CASE WHEN k % 4 > 0 THEN (k % 3) * value / 2 END AS longest, CASE WHEN k % 4 > 0 THEN CASE WHEN k % 8 < 4 THEN 'trace' ELSE 'poll' END END AS source, CASE WHEN cls = 'view' THEN NULL ELSE (k % 2) * value END AS written FROM e)"""
COSTS = {"run": "run", "life": "life", "wait": "wait", "written": "written", "on_cpu": "CASE WHEN life > 0 AND run <= life * 1.05::DOUBLE + 0.001::DOUBLE THEN least(1.0, run / life) END", "never": "CASE WHEN cls = 'error' THEN 0.0 END"}


def _costs(spark, d):
    k, v = F.col("k"), F.col("value")
    told = k % 4 > 0
    return events(spark, d).withColumns({
        "run": F.when(k % 9 > 0, v / 10), "life": F.when(k % 10 > 0, k * F.lit(2.0)), "wait": F.when(told, (k % 3) * v), "episodes": F.when(told, k % 3), "longest": F.when(told, (k % 3) * v / 2),
        "source": F.when(told, F.when(k % 8 < 4, "trace").otherwise("poll")), "written": F.when(F.col("cls") != "view", (k % 2) * v),
    })


_PAIRS_SQL = " UNION ALL ".join(f"SELECT cls, '{name}' AS measure, CAST({sql} AS DOUBLE) AS v FROM m" for name, sql in COSTS.items())


@query(f"""WITH {COST_SQL}, p AS ({_PAIRS_SQL}), c AS (SELECT cls || '/' || measure AS cm, any_value(cls) AS cls, any_value(measure) AS measure, count(*) AS seen, count(v) AS n, {dpct("count(v)", "count(*)")} AS coverage_pct, {dpct("count(*) FILTER (abs(v) <= 1e-9)", "count(v)")} AS zero_pct,
count(v) > 0 AND count(*) FILTER (abs(v) <= 1e-9) = count(v) AS all_zero, round({dsum("v")} / nullif(count(v), 0), 4) AS mean FROM p GROUP BY 1),
q AS ({_sketch_sql("(SELECT cls || '/' || measure AS cm, v FROM p)", "cm", "v")}) SELECT c.* EXCLUDE (cm), q.* EXCLUDE (cls, n) FROM c LEFT JOIN q ON q.cls = c.cm""")
def cost_sketches(spark, d):
    """Five measures and one that never worked, by class, in one pass."""
    c = F.col
    measures = {"run": c("run"), "life": c("life"), "wait": c("wait"), "written": c("written"), "on_cpu": panels.on_cpu(c("run"), c("life")), "never": F.when(c("cls") == "error", 0.0)}
    return stats.sketches(_costs(spark, d), by="cls", measures=measures)


@query(f"""WITH {COST_SQL}, s AS (SELECT cls, string_agg(source || ':' || n, ',' ORDER BY source) AS sources FROM (SELECT cls, source, count(*) AS n FROM m WHERE source IS NOT NULL GROUP BY ALL) GROUP BY 1)
SELECT m.cls, count(*) AS seen, count(wait) AS n, {dpct("count(wait)", "count(*)")} AS coverage_pct, count(*) FILTER (wait > 0) AS stalled, {dsum("wait")} AS wait, CAST(sum(episodes) AS BIGINT) AS episodes, coalesce(max(longest), 0.0) AS longest, coalesce(any_value(sources), '') AS sources FROM m LEFT JOIN s USING (cls) GROUP BY m.cls""")
def stalls_by_class(spark, d):
    return panels.stalls_by_class(_costs(spark, d), cls="cls", wait="wait", episodes="episodes", longest="longest", source="source")


@query(f"""WITH {COST_SQL}, h AS (SELECT us // {H // 2} AS bin, cls, count(*) AS n, {dsum("wait")} AS wait, {dsum("written")} AS written FROM m WHERE us // {H} % 5 > 1 GROUP BY ALL), b AS (SELECT greatest(min(bin), max(bin) - 959) AS lo, max(bin) AS hi FROM h),
g AS (SELECT unnest(range(lo, hi + 1)) AS bin FROM b), c AS (SELECT DISTINCT cls FROM h, b WHERE bin >= lo) SELECT bin, cls, n, wait, written FROM g CROSS JOIN c LEFT JOIN h USING (bin, cls)""")
def measured_series(spark, d):
    """Half hours of the newest twenty days; whole hours hold nothing."""
    rows = _costs(spark, d).filter(F.floor(F.col("us") / H) % 5 > 1)
    return series.measured_series(rows, us="us", cls="cls", fields=["wait", "written"], width_s=1800)


@query(f"""WITH {COST_SQL}, h AS (SELECT us // {6 * H} AS bin, 't' || (k % 13) AS tool, count(wait) AS told, {dsum("wait")} AS wait FROM m WHERE us // {H} % 30 > 7 GROUP BY ALL), g AS (SELECT unnest(range(min(bin), max(bin) + 1)) AS bin FROM h),
t AS (SELECT tool FROM h GROUP BY 1 HAVING sum(wait) > 0 ORDER BY {dsum("wait")} DESC, tool LIMIT 4), l AS (SELECT tool FROM t UNION ALL SELECT NULL),
s AS (SELECT bin, CASE WHEN tool IN (FROM t) THEN tool END AS tool, {dsum("wait")} AS wait FROM h WHERE told > 0 GROUP BY ALL), d AS (SELECT DISTINCT bin, true AS measured FROM h WHERE told > 0)
SELECT g.bin, l.tool, CASE WHEN measured THEN coalesce(s.wait, 0.0) END AS wait FROM g CROSS JOIN l LEFT JOIN d USING (bin) LEFT JOIN s ON s.bin = g.bin AND s.tool IS NOT DISTINCT FROM l.tool""")
def stall_series(spark, d):
    rows = _costs(spark, d).filter(F.floor(F.col("us") / H) % 30 > 7).withColumn("tool", F.concat(F.lit("t"), F.col("k") % 13))
    return series.stall_series(rows, us="us", tool="tool", wait="wait", width_s=21600, tools=4)


# --- hosts and accounts now

CENSUS_SQL = f"""{E_SQL}, l AS (SELECT event_id, us, user_id % 20 AS host, k, unnest(CASE WHEN k % 17 = 3 THEN [NULL] WHEN k % 3 = 0 THEN ['agent'] WHEN k % 3 = 1 THEN ['agent', 'human'] ELSE ['agent', 'human', 'ide'] END) AS cls FROM e),
n AS (SELECT user_id % 20 AS host, max((us, event_id)) AS newest FROM e GROUP BY 1),
c AS (SELECT host, us AS last_at, cls, CASE WHEN cls IS NOT NULL AND k % 7 > 0 THEN k + length(cls) END AS n_procs, CASE WHEN cls IS NOT NULL THEN 2 * k END AS threads, CASE WHEN cls IS NOT NULL AND k % 5 > 0 THEN k * 10.0::DOUBLE END AS rss_mb, CASE WHEN cls IS NOT NULL THEN k % 2 END AS d_state, CASE WHEN cls IS NOT NULL THEN 1 END AS users
  FROM l JOIN n USING (host) WHERE (us, event_id) = newest)"""


def _census(spark, d):
    """An event is a tick of one of twenty hosts; some hosts have no process, some classes do not tell all."""
    k = F.col("k")
    block = lambda cls: F.struct(F.when(k % 7 > 0, k + len(cls)).alias("n_procs"), (2 * k).alias("threads"), F.when(k % 5 > 0, k * F.lit(10.0)).alias("rss_mb"), (k % 2).alias("d_state"), F.lit(1).cast("bigint").alias("users"))
    entries = lambda *names: F.array(*(F.struct(F.lit(c).alias("key"), block(c).alias("value")) for c in names))
    told = F.when(k % 17 == 3, F.slice(entries("agent"), 1, 0)).when(k % 3 == 0, entries("agent")).when(k % 3 == 1, entries("agent", "human")).otherwise(entries("agent", "human", "ide"))
    ticks = events(spark, d).select("event_id", "us", (F.col("user_id") % 20).alias("host"), F.map_from_entries(told).alias("census"))
    return live.newest_census(ticks, host="host", at="us", key="event_id", census="census")


@query(f"""WITH {CENSUS_SQL} SELECT host, max(last_at) AS last_at, coalesce(string_agg(cls || ':' || coalesce(n_procs, 0), ',' ORDER BY cls), '') AS by_class, CAST(coalesce(sum(n_procs), 0) AS BIGINT) AS procs, CAST(coalesce(sum(threads), 0) AS BIGINT) AS threads,
CAST(coalesce(sum(d_state), 0) AS BIGINT) AS d_state, CAST(coalesce(sum(users), 0) AS BIGINT) AS users, round(nullif(sum(rss_mb) / 1024, 0.0), 2) AS rss_gb FROM c GROUP BY host""")
def hosts_by_class(spark, d):
    return live.hosts_by_class(_census(spark, d))


@query(f"""WITH {CENSUS_SQL} SELECT cls, count(DISTINCT host) AS hosts, CAST(sum(n_procs) AS BIGINT) AS procs, CAST(sum(threads) AS BIGINT) AS threads, round(nullif(sum(rss_mb) / 1024, 0.0), 2) AS rss_gb, CAST(sum(d_state) AS BIGINT) AS d_state, CAST(sum(users) AS BIGINT) AS users FROM c WHERE cls IS NOT NULL GROUP BY cls""")
def class_plates(spark, d):
    return live.plates(_census(spark, d))


NOW, WINDOW, WITHIN = AS_OF - 5 * 24 * H - 7 * H - 123 * S, 3 * 24 * H + 77 * S, 6 * H
ROSTER_SQL = f"""{E_SQL}, a AS (SELECT event_id, us, host, k, value, 'u' || user_id AS "user", CASE WHEN cls IN ('click', 'purchase') THEN 'agent' WHEN cls = 'signup' THEN 'ide' ELSE 'human' END AS c, CASE WHEN cls = 'click' THEN 'claude' WHEN cls = 'purchase' THEN 'codex' ELSE '' END AS type FROM e),
z AS (SELECT *, CASE WHEN us >= {NOW - live.FINE_SPAN_US} THEN {live.FINE_US} ELSE {live.COARSE_US} END AS size FROM (SELECT * REPLACE (least(us, {NOW}) AS us) FROM a WHERE us <= {NOW + live.SKEW_US} AND us >= {NOW - live.RETENTION_US})),
u AS (SELECT "user", c, type, count(*) AS n, {dsum("value")} AS cpu, max(us) AS last_us FROM z WHERE us - us % size + size > {NOW - WINDOW} GROUP BY ALL),
rr AS (SELECT "user", c, type, count(*) AS live, CAST(sum(procs) AS BIGINT) AS procs FROM (SELECT host, k % 40 AS root, arg_max("user", (us, k, event_id)) AS "user", arg_max(c, (us, k, event_id)) AS c, arg_max(type, (us, k, event_id)) AS type, max(us) AS us, arg_max(k, (us, k, event_id)) AS procs FROM a WHERE us <= {NOW} GROUP BY ALL) WHERE us >= {NOW - WITHIN} GROUP BY ALL),
f AS (SELECT coalesce(u."user", rr."user") AS "user", coalesce(u.c, rr.c) AS c, coalesce(u.type, rr.type) AS type, n, cpu, last_us, live FROM u FULL JOIN rr ON u."user" = rr."user" AND u.c = rr.c AND u.type = rr.type)"""


def _roster(spark, d):
    cls = F.when(F.col("cls").isin("click", "purchase"), "agent").when(F.col("cls") == "signup", "ide").otherwise("human")
    kind = F.when(F.col("cls") == "click", "claude").when(F.col("cls") == "purchase", "codex")
    a = events(spark, d).select("us", "host", "k", F.col("value").alias("cpu"), F.concat(F.lit("u"), "user_id").alias("user"), cls.alias("cls"), kind.alias("type"))
    used = live.usage(a, now_us=NOW, window_us=WINDOW, measures=["cpu"])
    return used, live.running_sessions(_ticks(a), now_us=NOW, within_us=WITHIN)


def _ticks(a):
    return a.select("host", (F.col("k") % 40).alias("root"), "user", "cls", "type", "us", F.col("k").alias("procs"), F.when(F.col("k") % 3 > 0, F.col("k") * F.lit(2.0)).alias("rss"))


@query(f"""WITH {ROSTER_SQL}, g AS (SELECT "user", CAST(coalesce(sum(live) FILTER (c = 'agent'), 0) AS BIGINT) AS running_agents, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, coalesce({dsum("cpu")}, 0.0) AS cpu,
string_agg(c || CASE WHEN type = '' THEN '' ELSE '/' || type END || ':' || coalesce(n, 0), ',' ORDER BY c || CASE WHEN type = '' THEN '' ELSE '/' || type END || ':' || coalesce(n, 0)) AS by_class,
coalesce(string_agg(c || CASE WHEN type = '' THEN '' ELSE '/' || type END || ':' || live, ',' ORDER BY c || CASE WHEN type = '' THEN '' ELSE '/' || type END || ':' || live) FILTER (live > 0), '') AS running, max(last_us) AS last_us FROM f GROUP BY 1)
SELECT *, CAST(row_number() OVER (ORDER BY running_agents DESC, n DESC, "user") AS INTEGER) AS rank FROM g QUALIFY rank <= 100""")
def ranked_roster(spark, d):
    return live.ranked_roster(*_roster(spark, d), measures=["cpu"], limit=100)


@query(f"""WITH {ROSTER_SQL}, p AS (SELECT 'all' AS part, '' AS name, "user" FROM f UNION ALL SELECT 'class', c, "user" FROM f UNION ALL SELECT 'running', c || '/' || type, "user" FROM f WHERE live > 0 UNION ALL SELECT 'live_agent', '', "user" FROM f WHERE live > 0 AND c = 'agent')
SELECT part, name, count(DISTINCT "user") AS users FROM p GROUP BY ALL""")
def roster_counts(spark, d):
    return live.roster_counts(*_roster(spark, d))


@query(f"""WITH {ROSTER_SQL}, o AS (SELECT host, k % 40 AS root, arg_max(c, (us, k, event_id)) AS cls, arg_max(type, (us, k, event_id)) AS type, arg_max(k, (us, k, event_id)) AS procs, min(us) AS first_us, max(us) AS us,
max(k * 2.0::DOUBLE) FILTER (k % 3 > 0) AS rss_peak, round(CAST(sum(CAST(k * 2.0 AS DECIMAL(18,4))) FILTER (k % 3 > 0) AS DOUBLE) / nullif(count(*) FILTER (k % 3 > 0), 0), 1) AS rss_mean, count(*) FILTER (k % 3 > 0) AS rss_ticks FROM a WHERE "user" = 'u7' AND us <= {NOW} GROUP BY ALL)
SELECT host, root, cls, nullif(type, '') AS type, procs, {NOW} - first_us AS age_us, rss_peak, rss_mean, rss_ticks, CAST(row_number() OVER (ORDER BY cls <> 'agent', procs DESC, host, root) AS INTEGER) AS rank FROM o WHERE us >= {NOW} - {8 * 24 * H}""")
def sessions_of_account(spark, d):
    a = events(spark, d).filter("user_id = 7")
    cls = F.when(F.col("cls").isin("click", "purchase"), "agent").when(F.col("cls") == "signup", "ide").otherwise("human")
    kind = F.when(F.col("cls") == "click", "claude").when(F.col("cls") == "purchase", "codex")
    a = a.select("us", "host", "k", F.concat(F.lit("u"), "user_id").alias("user"), cls.alias("cls"), kind.alias("type"))
    return live.sessions_of(_ticks(a), user="u7", now_us=NOW, within_us=8 * 24 * H)


# --- accounting in full

JOBS_SQL = f"""j AS (SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'agent' ELSE 'other' END AS cls, o_orderkey AS job, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 8 END AS arr, CASE WHEN o_custkey % 40 > 0 THEN 'u' || (o_custkey % 200) END AS "user", CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'd' || (o_custkey % 30) END AS work_dir,
  [{", ".join(f"'{s}'" for s in jobs.STATES)}, NULL][o_orderkey % 9 + 1] AS state, epoch_us(o_orderdate) + o_orderkey % 24 * {H} AS submit_us, CASE WHEN o_orderkey % 11 > 0 THEN submit_us + (o_orderkey % 50 - 3) * {17 * H} END AS start_us, o_orderkey * 7 % 5000 AS elapsed_s, CASE WHEN o_orderkey % 23 > 0 THEN o_orderkey % 5 END AS cpus,
  o_orderkey % 7 * 37 AS limit_min, CASE WHEN o_orderkey % 6 > 0 THEN o_totalprice / 10 END AS cpu_s, o_totalprice AS rss, o_orderkey % 6 * 50000.0::DOUBLE AS mem, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 3 END AS gpus, o_orderkey % 2 AS gpus_asked, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 50 END AS gpu_util, 1 + (o_orderkey % 17 = 0)::INT AS generations FROM orders)"""


def _jobs(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    submit = F.unix_micros(F.col("o_orderdate").cast("timestamp")) + k % 24 * H
    return read(spark, d, "orders").select(
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "agent").otherwise("other").alias("cls"), k.alias("job"), F.when(k % 3 == 0, F.floor(k / 8)).alias("array"), F.when(c % 40 > 0, F.concat(F.lit("u"), c % 200)).alias("user"), F.when(c % 5 == 0, "").otherwise(F.concat(F.lit("d"), c % 30)).alias("work_dir"),
        F.get(F.array(*map(F.lit, jobs.STATES)), (k % 9).cast("int")).alias("state"), submit.alias("submit_us"), F.when(k % 11 > 0, submit + (k % 50 - 3) * (17 * H)).alias("start_us"), (k * 7 % 5000).alias("elapsed_s"), F.when(k % 23 > 0, k % 5).alias("cpus"),
        (k % 7 * 37).alias("limit_min"), F.when(k % 6 > 0, F.col("o_totalprice") / 10).alias("cpu_s"), F.col("o_totalprice").alias("rss"), (k % 6 * F.lit(50000.0)).alias("mem"), F.when(k % 4 == 0, k % 3).alias("gpus"), (k % 2).alias("gpus_asked"),
        F.when(k % 5 == 1, 0).when(k % 5 > 1, 50).alias("gpu_util"), (1 + (k % 17 == 0).cast("int")).alias("generations"),
    )


@query(f"""WITH {JOBS_SQL} SELECT cls, count(*) AS jobs, count(DISTINCT coalesce(arr, job)) AS submissions, count(DISTINCT coalesce("user", '?')) AS users, count(DISTINCT nullif(work_dir, '')) AS work_dirs, {dsum("coalesce(cpus, 0) * elapsed_s / 3600.0::DOUBLE")} AS core_hours, {dsum("coalesce(gpus, 0) * elapsed_s / 3600.0::DOUBLE")} AS gpu_hours,
count(*) FILTER (gpus > 0) AS gpu_jobs, {dpct("count(arr)", "count(*)")} AS array_pct, count(*) FILTER (generations > 1) AS requeued, {dpct("count(*) FILTER (generations > 1)", "count(*)")} AS requeued_pct, {dpct("count(*) FILTER (cpus = 1)", "count(*)")} AS single_core_pct, round(count(*)::DOUBLE / count(DISTINCT coalesce(arr, job)), 2) AS array_collapse,
{", ".join(f"count(*) FILTER (state = '{s}') AS state_{s.lower()}" for s in jobs.STATES)}, count(*) FILTER (gpus > 0 AND gpu_util > 0) AS gpu_used, count(*) FILTER (gpus > 0 AND gpu_util = 0) AS gpu_idle, count(*) FILTER (gpus > 0 AND gpu_util IS NULL) AS gpu_util_unknown,
count(*) FILTER (coalesce(gpus, 0) = 0 AND gpus_asked > 0) AS gpu_requested_unmet, concat_ws(',', {", ".join(f"count(*) FILTER (submit_us // {H} % 24 = {h})" for h in range(24))}) AS hours FROM j GROUP BY cls""")
def account_by_class(spark, d):
    return jobs.account(_jobs(spark, d)).withColumn("hours", F.array_join("hours", ","))


QS = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)
_MEASURES_SQL = {
    "walltime_used": "CASE WHEN limit_min > 0 AND elapsed_s > 0 THEN least(1.5::DOUBLE, elapsed_s / (limit_min * 60.0::DOUBLE)) END", "cpu_eff": "CASE WHEN cpu_s > 0 AND elapsed_s > 60 AND cpus > 0 THEN least(1.5::DOUBLE, cpu_s / (elapsed_s * cpus)) END", "mem_eff": "CASE WHEN rss > 0 AND mem > 0 THEN least(1.5::DOUBLE, rss / mem) END",
    "queue_wait_s": "CASE WHEN start_us >= submit_us AND start_us - submit_us < 2592000000000 THEN (start_us - submit_us) / 1000000.0::DOUBLE END", "elapsed_s": "CASE WHEN elapsed_s > 0 THEN elapsed_s::DOUBLE END", "timelimit_s": "CASE WHEN limit_min > 0 THEN limit_min * 60.0::DOUBLE END",
}


@query(f"""WITH {JOBS_SQL}, p AS ({" UNION ALL ".join(f"SELECT cls AS grp, '{m}' AS measure, round({x}, 4) AS v FROM j" for m, x in _MEASURES_SQL.items())} UNION ALL SELECT cls, 'jobs_per_user', count(*)::DOUBLE FROM j GROUP BY cls, coalesce("user", '?') UNION ALL SELECT cls, 'jobs_per_work_dir', count(*)::DOUBLE FROM j WHERE work_dir <> '' GROUP BY cls, work_dir),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, measure ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY grp, measure) AS n FROM p WHERE v IS NOT NULL)
SELECT grp, measure, any_value(n) AS n, {dsum("v")} / any_value(n) AS mean, {", ".join(f"max(v) FILTER (i = round_even({q}::DOUBLE * (n - 1), 0)) AS p{round(q * 100)}" for q in QS)} FROM r GROUP BY ALL""")
def account_distributions(spark, d):
    """Six of jobs, and jobs by user and by folder, each user and folder as one."""
    own = _jobs(spark, d)
    each = views.distributions(own, by="cls", measures=jobs.account_measures(), qs=QS)
    heads = views.distributions(jobs.per_capita(own), by="cls", measures={"jobs_per_user": F.col("jobs_per_user"), "jobs_per_work_dir": F.col("jobs_per_work_dir")}, qs=QS)
    return each.unionByName(heads)


@query(f"""WITH {JOBS_SQL}, l AS (SELECT 'u' || u AS "user", 'field' || (u % 12) AS domain FROM (SELECT unnest(range(200)) AS u) WHERE u % 7 > 0), c AS (SELECT cls, coalesce(domain, 'unknown') AS domain, count(*) AS jobs FROM j LEFT JOIN l USING ("user") GROUP BY ALL)
SELECT cls, CAST(row_number() OVER (PARTITION BY cls ORDER BY jobs DESC, domain) AS INTEGER) AS rank, domain, jobs FROM c QUALIFY rank <= 8""")
def account_domains(spark, d):
    own = _jobs(spark, d)
    number = F.substring("user", 2, 9).cast("bigint")
    lookup = own.select("user").distinct().filter(number % 7 > 0).select("user", F.concat(F.lit("field"), number % 12).alias("domain"))
    return jobs.domains(own, lookup)


@query(f"""WITH {JOBS_SQL}, c AS (SELECT coalesce("user", '?') AS "user", count(*) AS jobs, CASE WHEN min(cls) = max(cls) THEN min(cls) ELSE 'mixed' END AS cls FROM j GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY jobs DESC, "user") AS INTEGER) AS rank, * FROM c QUALIFY rank <= 60""")
def account_rank_size(spark, d):
    return jobs.rank_size(_jobs(spark, d))


# --- pauses, rankings, states and reasons

STEP_KINDS = ("test", "explore", "run", "git", "edit", "explore", "test", "build", "explore", "run")
PAUSE_SQL = f"""{E_SQL}, st AS (SELECT user_id AS grp, event_id, us AS s, us + k * {H // 20} AS e, {_pick_sql(STEP_KINDS, "k")} AS kind, 'c' || (k % 2) AS c FROM e)"""


@query(f"""WITH {PAUSE_SQL}, x AS (SELECT *, lag(e) OVER w AS f, lag(kind) OVER w AS was, last_value(CASE WHEN kind IN ('test', 'run', 'edit') THEN kind END IGNORE NULLS) OVER b AS mark, last_value(CASE WHEN kind NOT IN ('explore', 'git') THEN kind || '/' || c END IGNORE NULLS) OVER b AS act FROM st
WINDOW w AS (PARTITION BY grp ORDER BY s, event_id), b AS (PARTITION BY grp ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, CASE WHEN kind IN ('test', 'run') AND s - f >= {H} AND s - f < {6 * H} AND mark IS DISTINCT FROM 'edit' THEN CASE WHEN act IN ('test/' || c, 'run/' || c) THEN 'between_runs' WHEN was = 'explore' THEN 'after_reading' END END AS why FROM x)
SELECT grp, CASE WHEN s - f >= {6 * H} THEN 'idle' ELSE 'edit_guess' END AS what, f AS from_us, s AS to_us, why FROM y WHERE s - f >= {6 * H} OR why IS NOT NULL""")
def pauses(spark, d):
    """Hours stand for minutes here, as users' events are hours apart."""
    steps = events(spark, d).select("user_id", "event_id", "us", (F.col("us") + F.col("k") * (H // 20)).alias("e"), _pick(STEP_KINDS, "k").alias("kind"), F.concat(F.lit("c"), F.col("k") % 2).alias("c"))
    return sequences.pauses(steps, by="user_id", order=["us", "event_id"], start="us", end="e", kind="kind", command="c", idle_us=6 * H, guess_us=H)


RANKED = ("recent", "events", "cpu_s", "peak_rss_mb", "io_mb", "net_mb", "distinct_tools")


@query(f"""WITH {E_SQL}, s AS (SELECT user_id * 1000 + us // {24 * H} % 1000 AS key, user_id % 30 AS "user", count(*) AS events, {dsum("value")} AS cpu_s, max(CASE WHEN k % 5 > 0 THEN k END) AS peak_rss_mb, {dsum("CASE WHEN k % 3 > 0 THEN value / 4 END")} AS io_mb, {dsum("k * 2.5::DOUBLE")} AS net_mb, count(DISTINCT k % 8) AS distinct_tools, max(us) AS recent, bool_or(cls = 'click') AS rooted FROM e GROUP BY 1, 2),
v AS (SELECT key, "user", unnest([{", ".join(f"'{r}'" for r in RANKED)}]) AS ranking, coalesce(unnest([recent::DOUBLE, events::DOUBLE, cpu_s, peak_rss_mb::DOUBLE, io_mb, net_mb, distinct_tools::DOUBLE]), 0.0) AS value, rooted FROM s),
r AS (SELECT *, CASE WHEN ranking = 'recent' THEN 1.0 ELSE value END AS w, CAST(row_number() OVER (PARTITION BY ranking ORDER BY value DESC, key) AS INTEGER) AS rank FROM v WHERE ranking <> 'recent' OR rooted QUALIFY rank <= 15),
o AS (SELECT ranking, "user", CAST(sum(CAST(w AS DECIMAL(28,4))) AS DOUBLE) AS own FROM r GROUP BY ALL), a AS (SELECT ranking, CAST(sum(CAST(w AS DECIMAL(28,4))) AS DOUBLE) AS total FROM r GROUP BY 1), p AS (SELECT ranking, "user", {dpct("own", "total")} AS user_share_pct FROM o JOIN a USING (ranking))
SELECT ranking, rank, key, "user", value, user_share_pct, max(user_share_pct) OVER (PARTITION BY ranking) AS dominant_pct FROM r JOIN p USING (ranking, "user")""")
def session_rankings(spark, d):
    """All seven lists of sessions (a user's days); the newest lists rooted sessions alone, and shares there are of sessions."""
    key, value = F.col("user_id") * 1000 + F.floor(F.col("us") / (24 * H)) % 1000, F.col("value")
    money = lambda c: F.sum(c.cast("decimal(18,4)")).cast("double")
    s = events(spark, d).groupBy(key.alias("key"), (F.col("user_id") % 30).alias("user")).agg(
        F.count(F.lit(1)).alias("events"), money(value).alias("cpu_s"), F.max(F.when(F.col("k") % 5 > 0, F.col("k"))).alias("peak_rss_mb"), money(F.when(F.col("k") % 3 > 0, value / 4)).alias("io_mb"),
        money(F.col("k") * 2.5).alias("net_mb"), F.count_distinct(F.col("k") % 8).alias("distinct_tools"), F.max("us").alias("recent"), F.bool_or(F.col("cls") == "click").alias("rooted"),
    )
    return stats.rankings(s, key="key", user="user", measures={r: F.col(r) for r in RANKED}, weights={"recent": F.lit(1)}, only={"recent": F.col("rooted")})


@query(f"""WITH {E_SQL}, t AS (SELECT user_id AS grp, us // {24 * H} AS tick, cls AS name, count(*) AS n FROM e GROUP BY ALL), k AS (SELECT grp, count(DISTINCT tick) AS ticks, max(tick) AS last FROM t GROUP BY 1),
b AS (SELECT grp, name, min(n) AS n FROM t JOIN k USING (grp) GROUP BY grp, name, ticks HAVING count(DISTINCT tick) = ticks), o AS (SELECT t.grp, t.name, t.n - coalesce(b.n, 0) AS n FROM t JOIN k ON k.grp = t.grp AND k.last = t.tick AND t.grp % 3 > 0 LEFT JOIN b ON b.grp = t.grp AND b.name = t.name),
l AS (SELECT grp, string_agg(name || ':' || n, ',' ORDER BY n DESC, name) AS commands FROM o WHERE n > 0 GROUP BY 1), s AS (SELECT grp, CASE WHEN grp % 7 > 0 THEN last * {24 * H} END AS at_us, grp % 11 > 0 AS told, CASE WHEN grp % 5 > 0 THEN grp % 4 * 60000000 END AS age FROM k)
SELECT grp, CASE WHEN NOT coalesce(at_us >= {AS_OF - 3 * 24 * H} AND told, false) THEN 'unknown' WHEN commands IS NOT NULL THEN 'running' WHEN age <= 150000000 THEN 'idle' ELSE 'unknown' END AS state, CASE WHEN state = 'running' THEN commands END AS commands FROM s LEFT JOIN l USING (grp)""")
def running_states(spark, d):
    ticks = events(spark, d).groupBy("user_id", F.floor(F.col("us") / (24 * H)).alias("tick"), "cls").agg(F.count(F.lit(1)).alias("n"))
    last = ticks.groupBy("user_id").agg(F.max("tick").alias("tick"))
    now = ticks.join(last, ["user_id", "tick"]).filter("user_id % 3 > 0").select(F.col("user_id").alias("grp"), F.col("cls").alias("name"), "n")
    above = live.census_above(now, live.least_census(ticks, by="user_id", tick="tick", name="cls", count="n"))
    g = F.col("grp")
    sessions = last.withColumnRenamed("user_id", "grp").select("grp", F.when(g % 7 > 0, F.col("tick") * (24 * H)).alias("at_us"), (g % 11 > 0).alias("told"), F.when(g % 5 > 0, g % 4 * 60_000_000).alias("base_age_us"))
    return live.running_state(sessions, above, fresh_us=AS_OF - 3 * 24 * H)


#: What a submission printed; then the reason and whether it is a refusal, told by hand.
PRINTED = (
    ("sbatch: error: Batch job submission failed: Invalid account 42\nexample: sbatch -A x", "sbatch: error: Batch job submission failed: Invalid account N", True), ("Submitted 1\n  \x1b[31msrun: error: Unable to allocate resources: QOS 7\x1b[0m \n", "srun: error: Unable to allocate resources: QOS N", True),
    ("srun: error: holy7c24101: task 0: Exited with exit code 1", "srun: error: holyNcN: task N: Exited with exit code N", False), ("Unable to allocate 2.00 GiB for an array", "Unable to allocate N.N GiB for an array", False),
    (None, None, False), (" \r\n\t", None, False), ("SALLOC: ERROR: Job submit/allocate failed: 9", "SALLOC: ERROR: Job submit/allocate failed: N", True), ("x" * 200, "x" * 160, False),
)


@query(f"""WITH {E_SQL}, t(i, reason, refused) AS (VALUES {", ".join(f"({i}, {_text(r)}, {x})" for i, (_, r, x) in enumerate(PRINTED))}), x AS (SELECT coalesce(reason, 'exit ' || coalesce(CAST(CASE WHEN event_id % 3 > 0 THEN event_id % 3 END AS VARCHAR), 'None') || CASE WHEN event_id % 5 = 0 THEN ', signal 9' ELSE '' END || ', nothing printed') AS reason, refused, user_id FROM e JOIN t ON k % {len(PRINTED)} = i)
SELECT reason, refused, count(*) AS n, count(DISTINCT user_id) AS users FROM x GROUP BY ALL""")
def refusal_reasons(spark, d):
    e = events(spark, d).withColumn("tail", F.element_at(F.array(*(F.lit(p) for p, _, _ in PRINTED)), (F.col("k") % len(PRINTED) + 1).cast("int")))
    why = taxonomy.reason(F.col("tail"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3), F.when(F.col("event_id") % 5 == 0, 9))
    return e.groupBy(why.alias("reason"), taxonomy.refused(F.col("tail")).alias("refused")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query(f"""WITH {E_SQL}, n AS (SELECT user_id % 6 AS host, us, CASE WHEN k % 4 > 0 THEN k END AS load, value AS wait FROM e), d AS (SELECT DISTINCT host, us FROM n), g AS (SELECT *, us - lag(us) OVER (PARTITION BY host ORDER BY us) AS gap, row_number() OVER (PARTITION BY host ORDER BY us DESC) AS r FROM d),
w AS (SELECT (SELECT min(x) FROM (SELECT unnest({list(series.WIDTHS)}) AS x) WHERE x >= greatest(3600, 2 * round(median(gap) / 1000000, 1)))::BIGINT AS bin_s FROM g WHERE r <= 64 AND gap IS NOT NULL), b AS (SELECT bin_s, ({AS_OF} - {6 * 24 * H}) // (bin_s * 1000000) AS lo, {AS_OF} // (bin_s * 1000000) AS hi FROM w),
s AS (SELECT host, us // (bin_s * 1000000) AS bin, count(*) AS snapshots, max(load) AS load, {dsum("wait")} / count(wait) AS wait FROM n, b WHERE us // (bin_s * 1000000) BETWEEN lo AND hi GROUP BY ALL), p AS (SELECT bin_s, unnest(range(lo, hi + 1)) AS bin FROM b)
SELECT host, bin, CAST(bin_s AS BIGINT) AS bin_s, snapshots, load, wait FROM p CROSS JOIN (SELECT DISTINCT host FROM s) LEFT JOIN s USING (host, bin)""")
def node_history(spark, d):
    snapshots = events(spark, d).select((F.col("user_id") % 6).alias("host"), "us", F.when(F.col("k") % 4 > 0, F.col("k")).alias("load"), F.col("value").alias("wait"))
    return series.node_history(snapshots, host="host", us="us", fields={"load": "max", "wait": "mean"}, now_us=AS_OF, window_us=6 * 24 * H)


_PADS = [bytes(b ^ pad for b in b"salt".ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]


@query(f"""SELECT c_custkey, 'user-' || left(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode('user:' || c_name)))), 8) AS alias, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 9 AS VARCHAR) END AS gpus,
CASE WHEN c_custkey >= 864 THEN (c_custkey * 100 // 86400) || '-' ELSE '' END || strftime(make_timestamp(c_custkey * 100 % 86400 * 1000000), '%H:%M:%S') AS lasted FROM customer""")
def keyed_aliases(spark, d):
    """Aliases under a key, one resource of a list, and seconds written as durations."""
    c, key = read(spark, d, "customer"), F.col("c_custkey")
    listed = F.concat(F.lit("cpu=4,xgres/gpu=7"), F.when(key % 3 > 0, F.concat(F.lit(",gres/gpu="), key % 9)).otherwise(""))
    return c.select("c_custkey", text.keyed_alias("user", F.col("c_name"), "salt").alias("alias"), text.resource(listed, "gres/gpu").alias("gpus"), text.as_duration(key * 100).alias("lasted"))
