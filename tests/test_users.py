"""Roles, surfaces and portraits on small tables, and their empty cases."""

import pytest
from pyspark.sql import functions as F

from heddle.functions import roles
from heddle.operators import normalize as nz
from heddle.operators import portraits
from heddle.plans.users import PROCESSES

SESSIONS = "user string, kind string, surface string, approval string, sandbox string, first_us bigint, last_us bigint, running boolean, project string, processes bigint, cost double"
CALLS = "user string, kind string, us bigint, category string, said string, words string"
BATCH = "user string, jobs bigint, polling_sessions bigint, polling_s double"
MINUTE, HOUR = 60_000_000, 3_600_000_000


@pytest.fixture(scope="module")
def told(spark):
    rows = [(i, p[0], p[1], p[2]) for i, p in enumerate(PROCESSES)]
    df = spark.createDataFrame(rows, "i int, kind string, c string, a string")
    df = roles.with_argv(df, command=F.col("c"), args=F.col("a"))
    out = df.withColumns({"role": roles.role(F.col("kind")), "sub": roles.subcommand(), "js": roles.js_launcher()})
    return {r.i: r for r in out.withColumn("direct", roles.spawned_by_agent(F.col("role"), F.col("c"), F.col("a"))).collect()}


@pytest.mark.parametrize("i", range(len(PROCESSES)))
def test_role_and_subcommand(told, i):
    assert (told[i].role, told[i].sub) == PROCESSES[i][4:6]


def test_who_starts_whom(told):
    direct = {PROCESSES[i][2] for i, r in told.items() if r.direct}
    assert direct == {"codex-linux-sandbox --x -- ls", "zsh -c source /h/.claude/shell-snapshots/s.sh"}
    launchers = {PROCESSES[i][2] for i, r in told.items() if r.js}
    assert launchers == {"/usr/bin/env node /o/bin/claude -p hi", "/usr/bin/env -S A=1 node /o/bin/codex exec go", "node --max-old-space-size=9 /o/@openai/codex/bin/codex.js exec --experimental-json"}


def test_tagged_before_the_flag(spark):
    """Without ``is_agent`` a record is tagged if its agent is the process itself; others have no role."""
    df = spark.createDataFrame([(5, 5, "claude", "claude"), (5, 6, "claude", "claude"), (None, 7, "claude", "claude"), (8, 8, None, None)], "agent_pid bigint, pid bigint, command string, args string")
    got = nz.normalize(df.withColumns({"agent_type": F.lit("claude_code"), "actor3": F.lit("agent"), "ts": F.lit("2024-01-01 00:00:00"), "host": F.lit("h")})).collect()
    assert {r.pid: (r._role, r._surface) for r in got} == {5: ("agent", "terminal"), 6: (None, None), 7: (None, None), 8: ("helper", None)}


def user_row(spark, sessions, calls=(), batch=()):
    rows = portraits.user_rows(spark.createDataFrame(list(sessions), SESSIONS), spark.createDataFrame(list(calls), CALLS), spark.createDataFrame(list(batch), BATCH))
    return {r.user: r for r in portraits.with_leverage(portraits.with_traits(rows)).collect()}


def test_empty_and_nobody(spark):
    assert user_row(spark, []) == {}
    nobody = [(None, "codex", "terminal", "auto", None, 0, 1, True, "p", 1, 1.0)]
    assert user_row(spark, nobody, [(None, "codex", 0, "test", "pr", "x")], [("a", 1, 1, 1.0)]) == {}


def test_all_unknown(spark):
    """Null states, times and projects: nothing holds and nothing is told."""
    r = user_row(spark, [("a", None, None, None, None, None, None, None, None, None, None)])["a"]
    assert r.traits == [] and (r.mode, r.autonomy, r.parallel, r.waiting, r.project, r.busiest_hour, r.night_pct) == ("unknown", None, None, None, None, None, None)
    assert (r.sessions, r.running, r.agent_types, r.calls, r.actions, r.mostly, r.peak_open, r.wall_p50_us, r.cost) == (1, 0, 0, None, 0, 0, 0, None, None) and r.hours == [0] * 24 and r.projects == []


def test_calls_of_unrecognised_agents_do_not_count(spark):
    r = user_row(spark, [("a", "copilot", "script", "auto", "sandboxed", 0, HOUR, False, "p", 1, 1.0)], [("a", "copilot", 0, "test", "commit", "x")] * 30)["a"]
    assert r.calls is None and r.cat_test == 0 and r.said_commit == 0 and r.active_min == 0 and r.traits == ["scripted", "auto", "sandboxed"]


def test_traits_at_their_bounds(spark):
    """Each share is met at its bound, not below; a commit said twice is one."""
    at = lambda n, of, a, b: [a] * n + [b] * (of - n)
    surfaces, approvals = at(3, 5, "terminal", "web"), at(3, 5, "supervised", "bypassed")
    sessions = [("a", "codex", s, p, "partial", i, 2 * HOUR + i, False, "p", 1, 0.5) for i, (s, p) in enumerate(zip(surfaces, approvals))]
    calls = [("a", "codex", i * MINUTE, c, None, None) for i, c in enumerate(at(3, 20, "test", "edit"))] + [("a", "codex", i * MINUTE, "git", "commit", "x") for i in range(2)]
    r = user_row(spark, sessions, calls)["a"]
    assert r.traits == ["interactive", "sandboxed", "parallel", "long", "committer"] and (r.mode, r.autonomy, r.parallel) == ("terminal", "no_flag", 5) and (r.said_commit, r.active_min, r.calls) == (1, 20, 22)
    assert [(u.id, u.n) for u in r.uses] == [("develop", 20), ("git", 2)] and r.mostly == 1 and (r.project, r.project_mostly) == ("p", True) and r.night_pct is None
    r = user_row(spark, sessions, calls[:20], [("a", 0, 0, 0.0)])["a"]
    assert "tester" in r.traits and r.cat_test * 100 == 15 * r.calls
    assert "tester" not in user_row(spark, sessions, calls[:19])["a"].traits, "19 calls are too few to share"


def test_ties_go_to_the_earlier(spark):
    sessions = [("a", "codex", s, "auto", None, 0, 0, False, p, 1, 0.0) for s, p in (("script", "q"), ("terminal", "p"))]
    calls = [("a", "codex", HOUR * h, c, None, None) for h in (3, 9) for c in ["run"] * 6 + ["build"] * 6]
    r = user_row(spark, sessions, calls)["a"]
    assert (r.mode, r.project, r.busiest_hour, r.mostly) == ("terminal", "p", 3, 1) and [u.id for u in r.uses] == ["build", "run"]


def test_fleet_sums_rows(spark):
    sessions = [(u, "codex", "terminal", "auto", None, 0, 3 * HOUR, i == 0, None, 1, 0.0) for u in ("a", "b") for i in range(2)]
    rows = portraits.with_traits(portraits.user_rows(spark.createDataFrame(sessions, SESSIONS), spark.createDataFrame([], CALLS), spark.createDataFrame([], BATCH)))
    got = {(r.part, r.name): r.n for r in portraits.fleet(rows).collect()}
    assert got == {("users", ""): 2, ("sessions", ""): 4, ("running", ""): 2, ("surface", "terminal"): 4, ("approval", "auto"): 4, ("sandbox", "no_calls"): 4, ("trait", "interactive"): 2, ("trait", "auto"): 2, ("trait", "long"): 2}
    assert portraits.fleet(rows.limit(0)).collect() == []
