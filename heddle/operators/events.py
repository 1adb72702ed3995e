"""Filtered scans over events: predicates, pages, facets, rules and folds of nested values."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import all_of, any_of, exact_sum
from ..functions.text import after_first


class Prefix(str):
    """Matches values that start with it."""


class AfterColon(str):
    """Matches values whose part after the first colon equals it."""


def where(clauses: list[dict[str, Any]]) -> Column:
    """An OR of ANDs over columns: sets of values compared as text, prefixes, and parts after a colon."""

    def one(name: str, want: Any) -> Column:
        if isinstance(want, Prefix):
            return F.col(name).cast("string").startswith(str(want))
        if isinstance(want, AfterColon):
            return after_first(F.col(name)) == str(want)
        return F.col(name).cast("string").isin(*map(str, want))

    return any_of([all_of([F.coalesce(one(k, v), F.lit(False)) for k, v in c.items()]) for c in clauses])


def predicate(*, sets: dict[str, list] | None = None, least: dict[str, float] | None = None, since: tuple[str, Any] | None = None, until: tuple[str, Any] | None = None, contains: tuple[Column, str] | None = None, strict: tuple[str, ...] = ()) -> Column:
    """A conjunctive filter; a null number counts as 0 for minima, except in ``strict`` columns."""
    parts = [F.col(k).cast("string").isin(*map(str, v)) for k, v in (sets or {}).items()]
    parts += [(F.col(k) if k in strict else F.coalesce(F.col(k), F.lit(0))) >= v for k, v in (least or {}).items()]
    if since:
        parts.append(F.col(since[0]) >= since[1])
    if until:
        parts.append(F.col(until[0]) < until[1])
    if contains:
        parts.append(F.lower(contains[0]).contains(contains[1].lower()))
    return all_of(parts)


def page(records: DataFrame, condition: Column, *, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return records.filter(condition).orderBy(*order).offset(offset).limit(limit)


def facets(records: DataFrame, *, names: list[str], cls: str, top: int = 50) -> DataFrame:
    """facet, value, class, n of the most frequent values of each facet."""
    each = records.select(F.col(cls).alias("cls"), F.explode(F.array(*(F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value")) for n in names))).alias("x")).select("cls", "x.*")
    from pyspark.sql.window import Window

    per = each.filter("value IS NOT NULL AND value <> ''").groupBy("facet", "value", "cls").agg(F.count(F.lit(1)).alias("n"))
    totals = per.groupBy("facet", "value").agg(F.sum("n").alias("total"))
    totals = totals.withColumn("r", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("total"), "value"))).filter(F.col("r") <= top)
    return per.join(totals.drop("r"), ["facet", "value"])


def rule_hits(records: DataFrame, rules: dict[str, Column], *, user: str, extra: list[Column]) -> DataFrame:
    """Of each rule: hits, users, and extra measures; a record can hit several."""
    hits = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items())))
    each = records.withColumn("rule", F.explode(hits))
    return each.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(user).alias("users"), *extra)


def endpoints(records: DataFrame, names: DataFrame, *, address: str, cls: str, sent: str, known: str, name: str) -> DataFrame:
    """Traffic by named endpoint and class; addresses without a name stand for themselves."""
    named = records.join(F.broadcast(names.select(F.col(known).alias("_a"), F.col(name).alias("_n"))), F.col(address) == F.col("_a"), "left")
    return named.groupBy(F.coalesce("_n", address).alias("endpoint"), F.col(cls).alias("cls")).agg(F.count(F.lit(1)).alias("calls"), exact_sum(sent).alias("sent"), F.countDistinct(address).alias("addresses"))


def longest_prefix(addresses: DataFrame, networks: DataFrame, *, number: str, key: str) -> DataFrame:
    """(key, provider) by the longest network (base, bits, provider) that holds an address; networks are few and broadcast."""
    low = F.floor(F.col(number) / F.pow(F.lit(2), 32 - F.col("bits"))).cast("bigint")
    base = F.floor(F.col("base") / F.pow(F.lit(2), 32 - F.col("bits"))).cast("bigint")
    held = addresses.join(F.broadcast(networks), low == base, "left")
    return held.groupBy(key).agg(F.max_by("provider", "bits").alias("provider"))


#: What a record says of one far end, and of what it lost count of.
ENDPOINT = "addr string, port bigint, proto string, inbound boolean, external boolean, provider string, calls bigint, tx_bytes bigint, rx_bytes bigint"
LOST = "calls bigint, tx_bytes bigint, rx_bytes bigint"


def _each_endpoint(records: DataFrame, *, key: str, cls: str, endpoints: str) -> DataFrame:
    each = records.select(F.col(key).alias("key"), F.col(cls).alias("cls"), F.posexplode(endpoints).alias("nth", "e")).filter("e IS NOT NULL AND coalesce(e.addr, '') <> ''")
    count = lambda name: F.coalesce(F.greatest(F.col(f"e.{name}"), F.lit(0)), F.lit(0)).alias(name.removesuffix("_bytes"))
    port = F.concat(F.coalesce("e.proto", F.lit("?")), F.lit("/"), F.coalesce(F.col("e.port").cast("string"), F.lit("?")))
    return each.select("key", "cls", "nth", "e.addr", F.coalesce("e.inbound", F.lit(False)).alias("inbound"), port.alias("port"), "e.external", "e.provider", *map(count, ("calls", "tx_bytes", "rx_bytes")))


def nested_endpoints(records: DataFrame, *, key: str, cls: str, endpoints: str) -> DataFrame:
    """Of each far end, direction and class: calls, bytes and records, with the end's chief port and provider.

    A record counts once for an end, however often it lists it. The chief port has most calls, then
    comes first by name; the provider is the first that a record, by key and place, tells.
    """
    each = _each_endpoint(records, key=key, cls=cls, endpoints=endpoints)
    # Once by record, so that a record counts once; both levels combine before they shuffle.
    by_record = each.groupBy("addr", "inbound", "cls", "key").agg(*(F.sum(c).alias(c) for c in ("calls", "tx", "rx")))
    sums = by_record.groupBy("addr", "inbound", "cls").agg(*(F.sum(c).alias(c) for c in ("calls", "tx", "rx")), F.count(F.lit(1)).alias("records"))
    ports = each.groupBy("addr", "inbound", "port").agg(F.sum("calls").alias("n")).groupBy("addr", "inbound").agg(F.min(F.struct((-F.col("n")).alias("n"), "port"))["port"].alias("port"), F.count(F.lit(1)).alias("ports"))
    told = F.when(F.coalesce("provider", F.lit("")) != "", F.struct("key", "nth", "provider"))
    facts = each.groupBy("addr", "inbound").agg(F.coalesce(F.bool_or("external"), F.lit(False)).alias("external"), F.min(told)["provider"].alias("provider"))
    return sums.join(ports, ["addr", "inbound"]).join(facts, ["addr", "inbound"])


def endpoint_coverage(records: DataFrame, *, key: str, cls: str, endpoints: str, lost: str, sent: str, received: str) -> DataFrame:
    """Of each class: records that list far ends and what these add up to, what was lost count of, and traffic of records that list none."""
    each = _each_endpoint(records, key=key, cls=cls, endpoints=endpoints)
    listed = each.groupBy("cls").agg(F.sum("calls").alias("calls"), F.sum("tx").alias("tx"), F.sum("rx").alias("rx"))
    has, traffic = F.col(endpoints).isNotNull(), F.coalesce(sent, F.lit(0)) + F.coalesce(received, F.lit(0))
    silent = ~has & (traffic > 0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    own = records.groupBy(F.col(cls).alias("cls")).agg(
        F.count_if(has).alias("records"), *(total(F.when(has, F.col(f"{lost}.{c}"))).alias(f"lost_{c.removesuffix('_bytes')}") for c in ("calls", "tx_bytes", "rx_bytes")),
        F.count_if(silent).alias("missing"), total(F.when(silent, traffic)).alias("missing_bytes"),
    )
    return own.join(listed, "cls", "left").na.fill(0, ["calls", "tx", "rx"])
