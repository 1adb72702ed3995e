"""What a page asks for: filters from its parameters, its window, and the rows as it shows them."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import all_of, exact_sum, pct, rank_index

PRESETS_MIN = (60, 360, 720, 1440, 4320, 10080)  # fixed values
RETENTION_MIN, LEAST_MIN, MOST_VALUES = 10080, 5, 64
FORMATS = ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d")


def bound(value: str) -> float:
    """An instant as seconds since 1970, or written in one of three forms (UTC)."""
    try:
        return float(value)
    except ValueError:
        pass
    for form in FORMATS:
        try:
            return datetime.strptime(value, form).replace(tzinfo=timezone.utc).timestamp()
        except ValueError:
            continue
    raise ValueError(f"not an instant: {value}")


def parse_filters(parameters: list[tuple[str, str]], *, sets: tuple[str, ...], minima: tuple[str, ...] = ()) -> dict[str, Any]:
    """Parameters that repeat or hold comma lists as sets of at most 64 values, minima as numbers, since and until as instants."""
    out: dict[str, Any] = {}
    for name, value in parameters:
        if name in sets:
            own = out.setdefault(name, [])
            own += [v for v in value.split(",") if v and v not in own]
            if len(own) > MOST_VALUES:
                raise ValueError(f"more than {MOST_VALUES} values: {name}")
        elif name in minima:
            out[name] = float(value)
        elif name in ("since", "until"):
            out[name] = bound(value)
        else:
            raise ValueError(f"no such filter: {name}")
    return out


def view_filter(filters: dict[str, Any], *, us: str, sets: dict[str, str], minima: dict[str, str] | None = None) -> Column:
    """The filter before all panels of a page; names map to columns."""
    parts = [F.col(c).cast("string").isin(*filters[name]) for name, c in sets.items() if filters.get(name)]
    parts += [F.coalesce(F.col(c), F.lit(0)) >= filters[name] for name, c in (minima or {}).items() if name in filters]
    if "since" in filters:
        parts.append(F.col(us) >= int(filters["since"] * 1_000_000))
    if "until" in filters:
        parts.append(F.col(us) < int(filters["until"] * 1_000_000))
    return all_of(parts)


def resolve_window(minutes: int | None, *, now_us: int, default: int = 1440, retention: int = RETENTION_MIN) -> tuple[int, int, str]:
    """(from, to, label) of a window that ends now: at least five minutes, at most what is kept."""
    m = max(LEAST_MIN, min(retention, minutes or default))
    label = f"{m // 1440} d" if m % 1440 == 0 else f"{m // 60} h" if m % 60 == 0 else f"{m} min"
    return now_us - m * 60_000_000, now_us, label


def who(records: DataFrame, *, columns: list[str], args: Column | None = None, most: int = 220) -> DataFrame:
    """Rows as panels show them: the named fields, and the command line cut to ``most`` characters."""
    shown = [F.col(c) for c in columns]
    if args is not None:
        shown.append(F.when(F.length(args) > most, F.concat(F.substring(args, 1, most - 1), F.lit("…"))).otherwise(args).alias("args"))
    return records.select(*shown)


def distributions(records: DataFrame, *, by: str, measures: dict[str, Column], qs: tuple[float, ...] = (0.5, 0.9), bucket: int = 4) -> DataFrame:
    """(grp, measure, n, mean, p..): nearest ranks, half to even, of several measures; values are rounded to ``bucket`` places and counted first."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), F.round(c, bucket).alias("v")) for k, c in measures.items())))
    counts = records.select(F.col(by).alias("grp"), pairs.alias("p")).select("grp", "p.*").filter("v IS NOT NULL").groupBy("grp", "measure", "v").agg(F.count(F.lit(1)).alias("k"))
    from pyspark.sql.window import Window

    w = Window.partitionBy("grp", "measure")
    placed = counts.withColumns({"upto": F.sum("k").over(w.orderBy("v")), "n": F.sum("k").over(w)})
    picks = [F.min(F.when(F.col("upto") > rank_index(q, F.col("n"), "half_even"), F.col("v"))).alias(f"p{round(q * 100)}") for q in qs]
    return placed.groupBy("grp", "measure").agg(F.max("n").alias("n"), (exact_sum(F.col("v") * F.col("k")) / F.max("n")).alias("mean"), *picks)


def submissions_by_class(records: DataFrame, *, cls: str, outcome: Column, query: Column, shape: Column, job_hours: Column) -> DataFrame:
    """Of each class: queries, submissions by outcome, how many shapes of command line, hours asked for, and the rate of refusal."""
    own = records.withColumns({"_o": outcome, "_q": query, "_s": shape, "_h": job_hours})
    n = lambda name: F.count_if(F.col("_o") == name)
    asked = n("job") + n("rejected") + n("no_id")
    return own.groupBy(F.col(cls).alias("cls")).agg(
        F.count_if("_q").alias("queries"), n("job").alias("jobs"), n("rejected").alias("rejected"), n("dry_run").alias("dry_runs"), n("step").alias("steps"), asked.alias("asked"),
        F.count_distinct("_s").alias("shapes"), exact_sum(F.when(F.col("_o") == "job", F.col("_h"))).alias("hours"), pct(n("rejected"), asked).alias("rejected_pct"),
        (F.count_if("_q") + 10 * (n("job") + n("rejected")) + n("step")).alias("weight"),
    )


def batch_use_by_session(records: DataFrame, *, session: str, us: str, kind: Column, outcome: Column, partition: Column, gpus: Column, tasks: Column, limit_s: Column, failed: Column) -> DataFrame:
    """What each session asked of the batch system.

    ``kind`` is submit, query, cancel or run, else the record is of no account. Submissions come by outcome;
    jobs' partitions (a list, comma-separated) are counted each, and the chief one has most jobs, then comes
    first by name; GPU hours are known where a job's limit is; ``peak_minute`` is the most jobs in one minute.
    An array whose size cannot be read counts as one task, and its hours as unknown: ``tasks`` is then 0.
    """
    own = records.select(
        F.col(session).alias("session"), F.col(us).alias("us"), kind.alias("kind"), outcome.alias("outcome"), partition.alias("partition"), gpus.alias("gpus"), tasks.alias("tasks"), limit_s.alias("limit_s"), failed.alias("failed")
    ).filter("kind IN ('submit', 'query', 'cancel', 'run')")
    is_job = (F.col("kind") == "submit") & (F.col("outcome") == "job")
    on_gpus = is_job & (F.col("gpus") > 0)
    size = F.when(F.coalesce("tasks", F.lit(1)) > 0, F.coalesce("tasks", F.lit(1))).otherwise(1)
    known = on_gpus & (F.col("limit_s") > 0) & (F.coalesce("tasks", F.lit(1)) > 0)
    out = lambda name: F.count_if((F.col("kind") == "submit") & (F.col("outcome") == name)).alias(name)
    n = lambda name: F.count_if(F.col("kind") == name)
    sums = own.groupBy("session").agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), *map(out, ("job", "rejected", "no_id", "step", "dry_run")), n("query").alias("queries"), n("cancel").alias("cancels"), n("run").alias("runs"),
        F.count_if((F.col("kind") == "run") & F.coalesce("failed", F.lit(False))).alias("runs_failed"), F.count_if(on_gpus).alias("gpu_jobs"), F.coalesce(F.sum(F.when(on_gpus, F.col("gpus") * size)), F.lit(0)).alias("gpus"),
        exact_sum(F.when(known, F.col("gpus") * size * F.col("limit_s") / F.lit(3600.0))).alias("gpu_hours"), F.count_if(known).alias("gpu_hours_known"),
    )
    jobs = own.filter(is_job)
    peak = jobs.groupBy("session", F.floor(F.col("us") / 60_000_000).alias("minute")).agg(F.count(F.lit(1)).alias("k")).groupBy("session").agg(F.max("k").alias("peak_minute"))
    each = jobs.select("session", F.explode(F.split("partition", ",")).alias("p")).withColumn("p", F.trim("p")).filter("p <> ''")
    used = each.groupBy("session", "p").agg(F.count(F.lit(1)).alias("k")).groupBy("session").agg(F.count(F.lit(1)).alias("partitions"), F.min(F.struct((-F.col("k")).alias("k"), "p"))["p"].alias("chief_partition"))
    both = sums.join(peak, "session", "left").join(used, "session", "left").na.fill(0, ["peak_minute", "partitions"])
    return both.withColumn("queries_a_job", F.when(F.col("job") > 0, F.round(F.col("queries") / F.col("job"), 4)))


def top_exits(records: DataFrame, *, cls: str, verdict: Column, code: Column, signal: Column, most: int = 8) -> DataFrame:
    """(cls, kind, value, n, rank): each class's commonest codes of failures and signals; of equal counts the smaller value."""
    kind = F.when(verdict.isin("signal", "pipe"), F.struct(F.lit("signal").alias("kind"), signal.cast("bigint").alias("value"))).when(verdict == "nonzero", F.struct(F.lit("code").alias("kind"), code.cast("bigint").alias("value")))
    counts = records.select(F.col(cls).alias("cls"), kind.alias("x")).filter("x IS NOT NULL").groupBy("cls", "x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql.window import Window

    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("cls", "kind").orderBy(F.desc("n"), "value"))).filter(F.col("rank") <= most)
