"""Ancestors in valid time: pids are used again, users differ, chains may close.

A process is a row with a key, a host and pid, its parent's pid, its user and its
lifetime.  Its parent is the process that held that pid when it started.  Chains are
followed by pointer jumping: each round doubles the reach and is written, so a chain of 64
takes seven joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written
from .lineage import as_of

STRETCH_US = 6 * 3_600_000_000  # a host's pid has many processes: they are looked up by stretches of time
NO_PARENT = (0, 1)  # besides null: the kernel's and init's


@dataclass(frozen=True)
class Process:
    """The names of a process table's columns; times in microseconds."""

    key: str = "key"
    host: str = "host"
    pid: str = "pid"
    parent_pid: str = "parent_pid"
    user: str = "user"
    start: str = "start"
    end: str = "end"


def conflict(a: Column, b: Column) -> Column:
    """Two known, different users, none of them root: one cannot have started the other."""
    return F.coalesce((a != b) & (a != "root") & (b != "root"), F.lit(False))


def holder_at_start(children: DataFrame, holders: DataFrame, names: Process, *, slack_us: int) -> DataFrame:
    """(key, up, kin): of each child the process that held its parent's pid when it started.

    Of several the latest to start.  ``kin`` is ``child``; ``later`` where that one had ended, so a
    process without a row holds the pid; ``earlier`` where all rows of the pid began after the
    child; ``none`` where the pid has no row.
    """
    n = names
    asked = children.select(F.col(n.key).alias("key"), F.col(n.host).alias("host"), F.col(n.parent_pid).alias("pid"), F.col(n.start).alias("start"), (F.col(n.start) + slack_us).alias("_by"))
    asked = asked.filter(F.col("pid").isNotNull() & ~F.col("pid").isin(*NO_PARENT) & F.col("start").isNotNull())
    held = holders.select(F.col(n.key).alias("up"), F.col(n.host).alias("host"), F.col(n.pid).alias("pid"), F.col(n.start).alias("since"), F.col(n.end).alias("until")).filter("since IS NOT NULL")
    found = as_of(asked, held, by=["host", "pid"], left_at="_by", right_at="since", take=["up", "until"], key="up", stretch=STRETCH_US)
    any_row = held.groupBy("host", "pid").agg(F.lit(True).alias("_any"))
    found = found.join(any_row, ["host", "pid"], "left")
    ended = F.coalesce(F.col("held_until") + slack_us < F.col("start"), F.lit(False))
    kin = F.when(F.col("held_up").isNull(), F.when(F.col("_any"), "earlier").otherwise("none")).when(ended, "later").otherwise("child")
    return found.select("key", F.when(kin == "child", F.col("held_up")).alias("up"), kin.alias("kin"))


def jumped(state: DataFrame, hops: int, name: str) -> DataFrame:
    """Follow (key, stop, n, next, reach, low, high) until each chain stops or is ``hops`` long.

    ``stop`` is where a chain ends, ``n`` the steps to it; ``next`` lies ``reach`` steps on; ``low`` and
    ``high`` are the least and greatest user on the way.
    """
    done = 1
    while done <= hops:
        on = state.select(*(F.col(c).alias(f"_{c}") for c in state.columns))
        both = state.join(on, state["next"] == on["_key"], "left")
        open_chain = F.col("stop").isNull()
        state = both.select(
            "key",
            F.coalesce("stop", "_stop").alias("stop"),
            F.when(open_chain & F.col("_stop").isNotNull(), F.col("reach") + F.col("_n")).otherwise(F.col("n")).alias("n"),
            F.when(open_chain & F.col("_stop").isNull(), F.col("_next")).alias("next"),
            (F.col("reach") + F.coalesce("_reach", F.lit(0))).alias("reach"),
            F.least("low", "_low").alias("low"),
            F.greatest("high", "_high").alias("high"),
        )
        state = written(state, name)
        done *= 2
        if state.filter("next IS NOT NULL").isEmpty():
            break
    return state


def nearest_nodes(processes: DataFrame, names: Process, *, is_node: Column, is_daemon: Column, hops: int = 64, slack_us: int = 1_000_000) -> DataFrame:
    """(key, ancestor, n) of every node: the nearest node up its chain of parents.

    A chain breaks where a parent's user conflicts with the node's own; the ancestor must also
    have run when the node started.  A daemon has no ancestor.  A chain that closes, or is longer
    than ``hops``, has none.
    """
    n = names
    up = holder_at_start(processes, processes, n, slack_us=slack_us)
    facts = processes.select(F.col(n.key).alias("key"), is_node.alias("node"), is_daemon.alias("daemon"), F.col(n.user).alias("user"), F.col(n.start).alias("start"), F.col(n.end).alias("end"))
    facts = written(facts.join(up.select("key", "up"), "key", "left"), "facts")
    known_user = F.when(~F.col("node") & (F.col("user") != "root"), F.col("user"))
    state = facts.select(
        "key", F.when(F.col("node"), F.col("key")).alias("stop"), F.lit(0).alias("n"), F.when(~F.col("node"), F.col("up")).alias("next"), F.lit(1).alias("reach"), known_user.alias("low"), known_user.alias("high")
    )
    state = jumped(state, hops, "ancestors").select(F.col("key").alias("_at"), "stop", "n", "low", "high")
    above = facts.select(F.col("key").alias("_stop"), F.col("user").alias("_user"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    nodes = facts.filter("node").join(state, F.col("up") == F.col("_at"), "left").join(above, F.col("stop") == F.col("_stop"), "left")
    ran = F.coalesce(F.col("_start") - slack_us <= F.col("start"), F.lit(True)) & F.coalesce(F.col("start") <= F.col("_end") + slack_us, F.lit(True))
    ok = ~F.col("daemon") & (F.col("n") < hops) & (F.col("stop") != F.col("key")) & ran
    for other in ("low", "high", "_user"):
        ok = ok & ~conflict(F.col("user"), F.col(other))
    ok = F.coalesce(ok, F.lit(False))
    return nodes.select("key", F.when(ok, F.col("stop")).alias("ancestor"), F.when(ok, F.col("n").cast("bigint") + 1).alias("n"))


def cut_cycles(links: DataFrame, *, key: str = "key", parent: str = "parent") -> DataFrame:
    """(key, parent, cut): of each closed chain, of any length, the node with the least key loses its parent.

    Chains that end drop out round by round.  When a round leaves as many nodes as the one
    before, none of them ends: a chain that ends has nodes at every depth.  Then what lies far
    enough ahead of any of them is the set of nodes on cycles.
    """
    own = links.select(F.col(key).alias("key"), F.when(F.col(parent) != F.col(key), F.col(parent)).alias("parent"), F.coalesce(F.col(parent) == F.col(key), F.lit(False)).alias("self"))
    own = written(own, "links")
    state = own.filter("parent IS NOT NULL").select("key", F.col("parent").alias("next"), F.least("key", "parent").alias("least"))
    left, reach, before = state.count(), 1, -1
    while left and (left != before or reach < left):
        on = state.select(F.col("key").alias("_key"), F.col("next").alias("_next"), F.col("least").alias("_least"))
        state = written(state.join(on, F.col("next") == F.col("_key")).select("key", F.col("_next").alias("next"), F.least("least", "_least").alias("least")), "cycles")
        before, left, reach = left, state.count(), 2 * reach
    if not left:
        return own.select("key", "parent", F.col("self").alias("cut"))
    on_cycle = state.select(F.col("next").alias("key")).distinct()
    first = state.join(on_cycle, "key").filter(F.col("key") == F.col("least")).select("key", F.lit(True).alias("_first"))
    out = own.join(first, "key", "left")
    return out.select("key", F.when(F.col("_first").isNull(), F.col("parent")).alias("parent"), (F.col("self") | F.col("_first").isNotNull()).alias("cut"))


def late_children(children: DataFrame, notes: DataFrame, names: Process, *, fate: str, what: str, hops: int = 8, slack_us: int = 1_000_000) -> DataFrame:
    """(key, status, fate, what, n): where children go whose parents have ended before them.

    ``notes`` are processes that ended, with their fate; ``pend`` means that one joined its own parent, so the
    walk goes on to that one's note.  status: ``routed`` to the fate found; ``running`` where a parent on
    the way has no note of its time; ``unplaced`` where the note of its time is gone or another
    user's; ``hops_out`` beyond ``hops``.
    """
    n = names
    joined = notes.filter(F.col(fate) == "pend")
    first, further = (holder_at_start(x, notes, n, slack_us=slack_us) for x in (children, joined))
    facts = notes.select(F.col(n.key).alias("key"), F.col(fate).alias("fate"), F.col(what).alias("what"), F.col(n.user).alias("user")).join(further, "key", "left")
    facts = written(facts, "notes")
    # A chain stops at a fate of its own, or where no note of its time leads on.
    goes_on = (F.col("fate") == "pend") & (F.col("kin") == "child")
    known_user = F.when(F.col("user") != "root", F.col("user"))
    state = facts.select("key", F.when(~F.coalesce(goes_on, F.lit(False)), F.col("key")).alias("stop"), F.lit(0).alias("n"), F.when(goes_on, F.col("up")).alias("next"), F.lit(1).alias("reach"), known_user.alias("low"), known_user.alias("high"))
    state = jumped(state, hops, "late").select(F.col("key").alias("_at"), "stop", "n", "low", "high")
    end = facts.select(F.col("key").alias("_stop"), "fate", "what", F.col("kin").alias("_kin"))
    own = children.select(F.col(n.key).alias("key"), F.col(n.user).alias("user")).join(first, "key", "left")
    met = own.join(state, F.col("up") == F.col("_at"), "left").join(end, F.col("stop") == F.col("_stop"), "left")
    strange = conflict(F.col("user"), F.col("low")) | conflict(F.col("user"), F.col("high"))
    kin = F.coalesce("kin", F.lit("none"))
    status = (
        F.when(kin == "earlier", "unplaced").when(kin != "child", "running")
        .when(F.col("stop").isNull() | (F.col("n") > hops), "hops_out").when(strange, "unplaced")
        .when(F.col("fate") != "pend", "routed").when(F.col("_kin") == "earlier", "unplaced").otherwise("running")
    )
    routed = status == "routed"
    return met.select("key", status.alias("status"), F.when(routed, F.col("fate")).alias("fate"), F.when(routed, F.col("what")).alias("what"), F.when(routed, F.col("n").cast("bigint")).alias("n"))
