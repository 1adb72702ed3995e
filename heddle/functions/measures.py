"""Null-aware measures: null is not zero, and zero is not missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(x: Column | str, scale: int = 4) -> Column:
    """A sum that does not depend on the order of rows, as double."""
    x = F.col(x) if isinstance(x, str) else x
    return F.sum(x.cast(f"decimal(18,{scale})")).cast("double")


def pct(part: Column, whole: Column) -> Column:
    """100 * part / whole to two places; 0 where the whole is 0 or null."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(F.lit(100.0) * part / whole, 2))


def coverage(name: str, x: Column) -> list[Column]:
    """Sum, present and seen counts, coverage and mean of a nullable measure."""
    total, n, seen = exact_sum(x), F.count(x), F.count(F.lit(1))
    return [total.alias(f"{name}_total"), n.alias(f"{name}_n"), seen.alias(f"{name}_seen"), pct(n, seen).alias(f"{name}_coverage_pct"), (total / F.when(n > 0, n)).alias(f"{name}_mean")]


def rank_index(q: float, n: Column, rule: str) -> Column:
    """0-based index of a nearest-rank quantile; ``floor``, ``half_even`` or ``ceil`` rank rule."""
    if rule == "floor":
        return F.floor(F.lit(q) * (n - 1)).cast("bigint")
    if rule == "half_even":
        return F.bround(F.lit(q) * (n - 1), 0).cast("bigint")
    return F.greatest(F.lit(0), F.ceil(F.lit(q) * n) - 1).cast("bigint")


def none_token(x: Column) -> Column:
    """An untagged value as ``none``."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("none"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    seconds = F.unix_date(ts.cast("date")).cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.expr("1000000").cast("bigint") * F.extract(F.lit("SECOND"), ts)).cast("bigint")
