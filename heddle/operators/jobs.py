"""Job accounting: folding steps, merging generations, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measures import exact_sum, pct


def fold_steps(steps: DataFrame, *, job: str, step: str, peak: str, consumed: str, node: str, main: int) -> DataFrame:
    """A row a job: the peak with its node, the main step's value or else the largest, the sum consumed, step count."""
    return steps.groupBy(F.col(job).alias("job")).agg(
        F.max(peak).alias("peak"),
        F.max_by(node, F.struct(F.col(peak), -F.col(step))).alias("peak_node"),
        F.coalesce(F.max(F.when(F.col(step) == main, F.col(peak))), F.max(peak)).alias("main_peak"),
        exact_sum(consumed).alias("consumed"),
        F.count(F.lit(1)).alias("steps"),
    )


def merge_generations(rows: DataFrame, *, job: str, start: str, elapsed: str, consumed: str, peak: str, state: str, key: str) -> DataFrame:
    """Requeued jobs as one: copies of one start count once (the longest), consumption adds, peaks and last state hold."""
    best = F.max_by(F.struct(elapsed, consumed, peak, state, key), F.struct(F.col(elapsed), F.col(key)))
    once = rows.groupBy(F.col(job).alias("job"), F.col(start).alias("start")).agg(best.alias("b")).select("job", "start", "b.*")
    return once.groupBy("job").agg(
        F.count(F.lit(1)).alias("generations"), F.min("start").alias("first_start"), exact_sum(consumed).alias("consumed"),
        F.max(peak).alias("peak"), F.max_by(state, "start").alias("state"),
    )


def rollup(jobs: DataFrame, *, cls: str, user: str, state: str, done: str, used: str, asked: str, cap: float = 1.5) -> DataFrame:
    """Of each class: jobs, users, share done, consumption, and mean efficiency with each ratio capped."""
    ratio = F.when(F.col(asked) > 0, F.least(F.lit(cap), F.col(used) / F.col(asked)))
    return jobs.withColumn("_e", F.round(ratio, 6)).groupBy(F.col(cls).alias("cls")).agg(
        F.count(F.lit(1)).alias("jobs"), F.countDistinct(user).alias("users"),
        pct(F.count_if(F.col(state) == done), F.count(F.lit(1))).alias("done_pct"),
        exact_sum(used).alias("used"), F.round(exact_sum("_e", 6) / F.count("_e"), 6).alias("efficiency"),
    )


def repeated(rows: DataFrame, *, by: list[str], cost: str, top: int = 12) -> DataFrame:
    """Keys that occur more than once, the most frequent first."""
    per = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("times"), exact_sum(cost).alias("cost")).filter("times > 1")
    return per.orderBy(F.desc("times"), *by).limit(top)


#: A share of what was asked for counts up to this, and waits in the queue up to 30 days (fixed values).
MOST_USED, MOST_WAIT_S, LEAST_ELAPSED_S = 1.5, 30 * 86400, 60
STATES = ("COMPLETED", "FAILED", "TIMEOUT", "OUT_OF_MEMORY", "CANCELLED", "PREEMPTED", "NODE_FAIL", "REQUEUED")


def account(jobs: DataFrame, *, states: tuple[str, ...] = STATES) -> DataFrame:
    """One row a class: jobs, submissions, users and folders, hours, shares, states, use of GPUs, and submissions by hour of day.

    ``jobs``: cls, job, array (null outside arrays), user, work_dir, state, submit_us, elapsed_s, cpus,
    gpus, gpus_asked, gpu_util, generations. A null user counts as ``?``; a job of no array is its own
    submission; a folder that is not told is none. Shares of no jobs are 0.
    """
    n, gpus = F.count(F.lit(1)), F.coalesce("gpus", F.lit(0))
    elapsed, cpus = F.coalesce("elapsed_s", F.lit(0)), F.coalesce("cpus", F.lit(0))
    hour = F.pmod(F.floor(F.col("submit_us") / 3_600_000_000), F.lit(24))
    counted = {
        "gpu_used": (gpus > 0) & (F.col("gpu_util") > 0), "gpu_idle": (gpus > 0) & (F.col("gpu_util") <= 0),
        "gpu_util_unknown": (gpus > 0) & F.col("gpu_util").isNull(), "gpu_requested_unmet": (gpus <= 0) & (F.col("gpus_asked") > 0),
    }
    share = lambda c: pct(F.count_if(c), n)
    subs, held = F.count_distinct(F.coalesce("array", "job")), F.greatest(F.lit(1), F.count_distinct(F.coalesce("array", "job")))
    return jobs.groupBy("cls").agg(
        n.alias("jobs"), subs.alias("submissions"), F.count_distinct(F.coalesce("user", F.lit("?"))).alias("users"), F.count_distinct(F.nullif("work_dir", F.lit(""))).alias("work_dirs"),
        exact_sum(cpus * elapsed / F.lit(3600.0)).alias("core_hours"), exact_sum(gpus * elapsed / F.lit(3600.0)).alias("gpu_hours"), F.count_if(gpus > 0).alias("gpu_jobs"),
        share(F.col("array").isNotNull()).alias("array_pct"), F.count_if(F.col("generations") > 1).alias("requeued"), share(F.col("generations") > 1).alias("requeued_pct"), share(F.col("cpus") == 1).alias("single_core_pct"),
        F.round(n / held, 2).alias("array_collapse"), *(F.count_if(F.col("state") == s).alias(f"state_{s.lower()}") for s in states), *(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counted.items()),
        F.array(*(F.count_if(hour == h) for h in range(24))).alias("hours"),
    )


def account_measures() -> dict[str, Column]:
    """What is distributed of a job: shares of time, processors and memory that were asked for, waits, lives and limits; null where not told."""
    elapsed, limit = F.col("elapsed_s"), F.col("limit_min")
    over = lambda used, asked: F.least(F.lit(MOST_USED), used / asked)
    wait = (F.col("start_us") - F.col("submit_us")) / F.lit(1_000_000.0)
    return {
        "walltime_used": F.when((limit > 0) & (elapsed > 0), over(elapsed, limit * 60.0)),
        "cpu_eff": F.when((F.col("cpu_s") > 0) & (elapsed > LEAST_ELAPSED_S) & (F.col("cpus") > 0), over(F.col("cpu_s"), elapsed * F.col("cpus"))),
        "mem_eff": F.when((F.col("rss") > 0) & (F.col("mem") > 0), over(F.col("rss"), F.col("mem"))),
        "queue_wait_s": F.when((wait >= 0) & (wait < MOST_WAIT_S), wait),
        "elapsed_s": F.when(elapsed > 0, elapsed.cast("double")),
        "timelimit_s": F.when(limit > 0, limit * 60.0),
    }


def per_capita(jobs: DataFrame) -> DataFrame:
    """(cls, jobs_per_user, jobs_per_work_dir): each user and each folder of a class is one row, so that one busy user is one unit."""
    users = jobs.groupBy("cls", F.coalesce("user", F.lit("?")).alias("u")).agg(F.count(F.lit(1)).alias("n"))
    dirs = jobs.filter("work_dir <> ''").groupBy("cls", "work_dir").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("double")
    return users.select("cls", F.col("n").cast("double").alias("jobs_per_user"), none.alias("jobs_per_work_dir")).unionByName(dirs.select("cls", none.alias("jobs_per_user"), F.col("n").cast("double").alias("jobs_per_work_dir")))


def domains(jobs: DataFrame, of_user: DataFrame, *, top: int = 8) -> DataFrame:
    """(cls, rank, domain, jobs): the fields of work of most jobs of each class; users that the lookup (user, domain) lacks are ``unknown``."""
    counts = jobs.filter("user IS NOT NULL").groupBy("cls", "user").agg(F.count(F.lit(1)).alias("n")).join(of_user, "user", "left").select("cls", F.coalesce("domain", F.lit("unknown")).alias("domain"), "n")
    nobody = jobs.filter("user IS NULL").groupBy("cls").agg(F.count(F.lit(1)).alias("n")).select("cls", F.lit("unknown").alias("domain"), "n")
    sums = counts.unionByName(nobody).groupBy("cls", "domain").agg(F.sum("n").alias("jobs"))
    w = Window.partitionBy("cls").orderBy(F.desc("jobs"), "domain")
    return sums.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("cls", "rank", "domain", "jobs")


def rank_size(jobs: DataFrame, *, top: int = 60) -> DataFrame:
    """(rank, user, jobs, cls): the users of most jobs; the class of one who has jobs of several is ``mixed``."""
    users = jobs.groupBy(F.coalesce("user", F.lit("?")).alias("user")).agg(F.count(F.lit(1)).alias("jobs"), F.min("cls").alias("a"), F.max("cls").alias("b"))
    first = users.orderBy(F.desc("jobs"), "user").limit(top)
    return first.select(F.row_number().over(Window.orderBy(F.desc("jobs"), "user")).alias("rank"), "user", "jobs", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("mixed").alias("cls"))
