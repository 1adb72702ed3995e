"""Users by how they work with agents: a row a user from sessions and calls, the traits that hold, how agents are used, and the fleet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measures import exact_sum
from ..plans.scratch import written
from . import sequences, stats

# States that are counted, and what a trait or a summary needs.
SURFACES = ("terminal", "script", "desktop", "extension", "web", "unknown")
APPROVALS = ("bypassed", "auto", "supervised", "unobservable", "unknown")
SANDBOXES = ("sandboxed", "partial", "failed", "unsandboxed", "unknown", "no_calls")
CATEGORIES = ("test", "slurm", "run", "build", "edit", "git", "wait", "explore", "unknown")
USES = {"explore": ("explore",), "develop": ("edit", "test"), "build": ("build",), "run": ("run",), "hpc": ("slurm",), "git": ("git",)}
MODES = {"terminal": ("terminal",), "script": ("script",), "extension": ("extension",), "app": ("desktop", "web")}
LEAST = {
    "interactive": 0.6, "scripted": 0.5, "app": 0.5, "bypass": 0.5, "auto": 0.5, "sandboxed": 0.5, "parallel": 3, "long_s": 7200, "short_n": 10, "short_s": 600, "explore": 0.6, "test": 0.15, "build": 0.15,
    "slurm": 0.10, "wait": 0.25, "night": 0.25, "night_min": 60, "min_calls": 20, "mode": 0.5, "mostly": 0.5, "project": 0.5,
}
NIGHT = range(6)
READ_TYPES = ("claude_code", "codex")  # agents whose calls are recognised

PROJECTS = 5
MINUTE = 60_000_000


def _n(kind: str, *states: str) -> Column:
    """How many of a user's sessions, or calls, are in any of the states."""
    return reduce(Column.__add__, (F.coalesce(F.col(f"{kind}_{s}"), F.lit(0)) for s in states))


def user_rows(sessions: DataFrame, calls: DataFrame, batch: DataFrame, *, zone: str = "UTC") -> DataFrame:
    """One row a user: sessions by state, calls by category, active minutes by local hour, most sessions open at once, medians and projects.

    ``sessions``: user, kind, surface, approval, sandbox, first_us, last_us, running, project, processes, cost.
    ``calls``: user, kind, us, category, said (``commit`` or ``pr``) and words. ``batch``: user, jobs,
    polling_sessions, polling_s; a user may lack there. Null states are unknown; sessions without a
    user are no one's. Calls of agents that are not recognised are no calls, which is not none:
    ``calls`` is null for a user with no session of a recognised agent.
    """
    own = sessions.filter("user IS NOT NULL").withColumns({"surface": F.coalesce("surface", F.lit("unknown")), "approval": F.coalesce("approval", F.lit("unknown")), "sandbox": F.coalesce("sandbox", F.lit("no_calls")), "wall_us": F.col("last_us") - F.col("first_us")})
    own = written(own, "sessions")  # read four times
    states = [F.count_if(F.col(c) == s).alias(f"{c}_{s}") for c, names in (("surface", SURFACES), ("approval", APPROVALS), ("sandbox", SANDBOXES)) for s in names]
    rows = own.groupBy("user").agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if("running").alias("running"), *states, F.count_distinct(F.nullif("kind", F.lit(""))).alias("agent_types"), F.count_if(F.col("kind").isin(*READ_TYPES)).alias("read_sessions"),
        F.sum("processes").alias("processes"), exact_sum("cost").alias("cost"), F.sum("wall_us").alias("wall_us"), F.max("wall_us").alias("wall_max_us"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
    )
    middle = stats.nearest_ranks(own, by="user", value="wall_us", qs=(0.5,), rules=("floor",)).select(F.col("grp").alias("user"), F.col("floor_p50").alias("wall_p50_us"))
    open_ = sequences.peak_open(own.filter("first_us IS NOT NULL AND last_us IS NOT NULL"), by="user", start=F.col("first_us"), end=F.col("last_us")).select(F.col("grp").alias("user"), F.col("peak").alias("peak_open"))
    said = own.filter("project IS NOT NULL AND project <> ''").groupBy("user", "project").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user").orderBy(F.desc("n"), "project")
    named = said.withColumn("place", F.row_number().over(w)).groupBy("user").agg(F.count(F.lit(1)).alias("projects_total"), F.sort_array(F.collect_list(F.when(F.col("place") <= PROJECTS, F.struct("place", "project", "n")))).alias("projects"))

    told = written(calls.filter(F.col("user").isNotNull() & F.col("kind").isin(*READ_TYPES)).select("user", "us", "category", "said", "words"), "calls")
    cats = told.groupBy("user").agg(*(F.count_if(F.coalesce("category", F.lit("unknown")) == c).alias(f"cat_{c}") for c in CATEGORIES))
    # A minute counts once, whatever the calls in it: by local hour.
    minutes = told.select("user", F.floor(F.col("us") / MINUTE).alias("minute")).distinct()
    hour = F.hour(F.from_utc_timestamp(F.timestamp_micros(F.col("minute") * MINUTE), zone))
    active = minutes.withColumn("hour", hour).groupBy("user").agg(F.count(F.lit(1)).alias("active_min"), F.array(*(F.count_if(F.col("hour") == h) for h in range(24))).alias("hours"))
    words = told.filter("said IS NOT NULL").select("user", "said", "words").distinct().groupBy("user").agg(*(F.count_if(F.col("said") == s).alias(f"said_{s}") for s in ("commit", "pr")))
    for part in (middle, open_, named, cats, active, words, batch.select("user", "jobs", "polling_sessions", "polling_s")):
        rows = rows.join(part, "user", "left")
    counts = [f"cat_{c}" for c in CATEGORIES] + ["active_min", "peak_open", "projects_total", "said_commit", "said_pr"]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    all_calls = reduce(Column.__add__, (F.col(f"cat_{c}") for c in CATEGORIES))
    return rows.withColumns({"calls": F.when(F.col("read_sessions") > 0, all_calls), "hours": F.coalesce("hours", F.array_repeat(F.lit(0).cast("bigint"), 24)), "projects": F.coalesce("projects", F.array().cast(named.schema["projects"].dataType))})


def _night() -> Column:
    return reduce(Column.__add__, (F.col("hours")[h] for h in NIGHT))


def trait_rules() -> dict[str, Column]:
    """What each trait needs of a row of ``user_rows``, in the order a portrait lists them; a share over nothing known meets none."""
    known_surface = F.col("sessions") - _n("surface", "unknown")
    known_approval, known_sandbox = _n("approval", "bypassed", "auto", "supervised"), _n("sandbox", "sandboxed", "partial", "failed", "unsandboxed")
    logged = reduce(Column.__add__, (F.col(f"cat_{c}") for c in CATEGORIES))
    share = lambda part, whole, least: (whole > 0) & (part >= F.lit(LEAST[least]) * whole)
    of_calls = lambda c, least: (logged >= LEAST["min_calls"]) & share(F.col(f"cat_{c}"), logged, least)
    return {
        "interactive": share(_n("surface", "terminal"), known_surface, "interactive"),
        "scripted": share(_n("surface", "script"), known_surface, "scripted"),
        "app": share(_n("surface", "desktop", "extension", "web"), known_surface, "app"),
        "bypass": share(_n("approval", "bypassed"), known_approval, "bypass"),
        "auto": share(_n("approval", "auto"), known_approval, "auto"),
        "sandboxed": share(_n("sandbox", "sandboxed", "partial"), known_sandbox, "sandboxed"),
        "multi_agent": F.col("agent_types") >= 2,
        "parallel": F.col("peak_open") >= LEAST["parallel"],
        "long": F.col("wall_p50_us") >= LEAST["long_s"] * 1_000_000,
        "short": (F.col("sessions") >= LEAST["short_n"]) & (F.col("wall_p50_us") <= LEAST["short_s"] * 1_000_000),
        "explorer": of_calls("explore", "explore"),
        "tester": of_calls("test", "test"),
        "builder": of_calls("build", "build"),
        "slurm": (F.coalesce("jobs", F.lit(0)) > 0) | of_calls("slurm", "slurm"),
        "poller": (F.coalesce("polling_sessions", F.lit(0)) > 0) | of_calls("wait", "wait"),
        "committer": F.col("said_commit") + F.col("said_pr") > 0,
        "overnight": (F.col("active_min") >= LEAST["night_min"]) & (_night() >= F.lit(LEAST["night"]) * F.col("active_min")),
    }


def with_traits(rows: DataFrame) -> DataFrame:
    """The rows with ``traits``, the names of the rules that hold, in order."""
    return rows.withColumn("traits", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in trait_rules().items()))))


def with_leverage(rows: DataFrame) -> DataFrame:
    """The rows with how most sessions are driven, the freedom they start with, what actions are for, waiting, the project and the hours.

    Ties go to the earlier mode, use or hour. ``mostly`` is how many uses from the top hold half of
    the actions: 1, 2, or 0 for a mix. What the numbers do not tell is null.
    """
    known = F.col("sessions") - _n("surface", "unknown")
    of_mode = F.array(*(F.struct(_n("surface", *states).alias("n"), F.lit(-i).alias("i"), F.lit(m).alias("id")) for i, (m, states) in enumerate(MODES.items())))
    started = _n("approval", "bypassed", "auto", "supervised")
    of_use = F.array(*(F.struct((-_n("cat", *cats)).alias("r"), F.lit(i).alias("i"), F.lit(u).alias("id"), _n("cat", *cats).alias("n")) for i, (u, cats) in enumerate(USES.items())))
    actions = reduce(Column.__add__, (_n("cat", *cats) for cats in USES.values()))
    logged = reduce(Column.__add__, (F.col(f"cat_{c}") for c in CATEGORIES))
    busiest = F.array_max(F.transform("hours", lambda n, h: F.struct(n.alias("n"), (-h).alias("h"))))
    out = rows.withColumns({"_mode": F.array_max(of_mode), "_uses": F.sort_array(F.filter(of_use, lambda u: u["n"] > 0)), "actions": actions, "_known": known, "_started": started, "_busiest": busiest})
    enough = F.col("calls").isNotNull() & (F.col("actions") >= LEAST["min_calls"])
    top = lambda i: F.coalesce(F.get("_uses", F.lit(i))["n"], F.lit(0))
    half = F.lit(LEAST["mostly"]) * F.col("actions")
    first = F.get("projects", F.lit(0))
    return out.withColumns({
        "mode": F.when(known == 0, "unknown").when(F.col("_mode.n") >= F.lit(LEAST["mode"]) * known, F.col("_mode.id")).otherwise("mixed"),
        "autonomy": F.when(started > 0, F.when(_n("approval", "bypassed") >= F.lit(LEAST["bypass"]) * started, "bypass").when(_n("approval", "auto") >= F.lit(LEAST["auto"]) * started, "auto").otherwise("no_flag")),
        "parallel": F.when(F.col("peak_open") >= LEAST["parallel"], F.col("peak_open")),
        "uses": F.when(enough, F.transform("_uses", lambda u: F.struct(u["id"].alias("id"), u["n"].alias("n"), F.round(F.lit(100.0) * u["n"] / F.col("actions"), 1).alias("pct")))).otherwise(F.array().cast("array<struct<id:string,n:bigint,pct:double>>")),
        "mostly": F.when(~enough, 0).when(top(0) >= half, 1).when((F.size("_uses") > 1) & (top(0) + top(1) >= half), 2).otherwise(0),
        "waiting": F.when((logged >= LEAST["min_calls"]) & (F.col("cat_wait") >= F.lit(LEAST["wait"]) * logged), F.col("cat_wait")),
        "project": first["project"],
        "project_mostly": first["n"] >= F.lit(LEAST["project"]) * F.col("sessions"),
        "busiest_hour": F.when(F.col("active_min") > 0, -F.col("_busiest.h")),
        "night_pct": F.when(F.col("active_min") >= LEAST["night_min"], F.round(F.lit(100.0) * _night() / F.col("active_min"), 1)),
    }).drop("_mode", "_uses", "_known", "_started", "_busiest")


def fleet(rows: DataFrame) -> DataFrame:
    """(part, name, n): users, sessions and running ones, sessions by state, calls by category, and how many users hold each trait; from rows with traits."""
    pairs = [("users", "", F.lit(1)), ("sessions", "", F.col("sessions")), ("running", "", F.col("running"))]
    pairs += [(c, s, F.col(f"{c}_{s}")) for c, names in (("surface", SURFACES), ("approval", APPROVALS), ("sandbox", SANDBOXES), ("cat", CATEGORIES)) for s in names]
    held = F.transform("traits", lambda t: F.struct(F.lit("trait").alias("part"), t.alias("name"), F.lit(1).cast("bigint").alias("n")))
    counted = F.array(*(F.struct(F.lit(p).alias("part"), F.lit(s).alias("name"), n.cast("bigint").alias("n")) for p, s, n in pairs))
    each = rows.select(F.explode(F.concat(counted, held)).alias("x")).select("x.*")
    return each.groupBy("part", "name").agg(F.sum("n").alias("n")).filter("n > 0")
