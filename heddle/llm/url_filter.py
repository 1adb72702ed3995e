"""URL rules by Bloom filter cascades: exact membership without joins.

A rule is a host and a path prefix (``example.org/es/``).  It fits the host and
its subdomains when the url's path starts with the rule's path.  For each url
the possible rule keys are few: host suffixes with as many labels as some rule
has, times path prefixes as long as some rule's.  The distinct keys of the whole
corpus, with the listed keys, are the complete universe.  Level 0 of a cascade
is a Bloom filter of the listed keys, level 1 one of the unlisted keys that pass
level 0, level 2 one of the listed keys that pass level 1, and so on until no
key is wrong.  A key is listed when the first level that it fails is odd.

Everything is DataFrame expressions.  A filter's bitmap is built by ``bit_or``
per byte in the cluster and is bounded by ``max_bits``; with more keys than that
allows for, the filters get denser and the cascade deeper, and the answer stays
exact.  Null urls, and urls without ``://``, have empty host and path and fit no
rule.  Repeated rows are judged one by one; an empty table gives no rows; other
columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, settle

HASHES = 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, rules: Iterable[str]) -> Column:
    """The rule keys that could fit: suffixes of the host times prefixes of the path."""
    shapes = sorted({(len(h.split(".")), len(p)) for h, p in map(split_rule, rules)})
    labels = F.size(F.split(host, r"\."))
    keys = [
        F.when((labels >= n) & (F.length(path) >= m), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m)))
        for n, m in shapes
    ]
    return F.array_distinct(F.array_compact(F.array(*keys))) if keys else F.array().cast("array<string>")


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


class Cascade:
    """Alternating Bloom filters; ``member(key)`` is exact for every key of the universe."""

    def __init__(self, levels: list[tuple[int, int, bytes]]):
        self.levels = levels

    @staticmethod
    def _places(key: Column, level: int, bits: int) -> list[Column]:
        # Two hashes make all of a level's places (double hashing).
        a = F.xxhash64(key, F.lit(2 * level))
        b = F.xxhash64(key, F.lit(2 * level + 1)).bitwiseOR(F.lit(1))
        mix = [a] + [F.xxhash64(a, b, F.lit(i)) for i in range(1, HASHES)]
        return [F.pmod(x, F.lit(bits)) for x in mix]

    @staticmethod
    def _passes(key: Column, level: int, bits: int, bitmap: bytes) -> Column:
        data = F.lit(bitmap)
        hits = []
        for place in Cascade._places(key, level, bits):
            byte = F.conv(F.hex(F.substr(data, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            hits.append(F.getbit(byte, (place % 8).cast("int")) == 1)
        return reduce(lambda x, y: x & y, hits)

    @classmethod
    def build(cls, universe: DataFrame, *, bits_per_key: int = 10, max_bits: int = 1 << 26) -> Cascade:
        """universe: distinct ``key`` with boolean ``listed``."""
        levels: list[tuple[int, int, bytes]] = []
        sizes: list[int] = []
        while True:
            level = len(levels)
            inside = universe.filter(F.col("listed") if level % 2 == 0 else ~F.col("listed"))
            for done in levels:
                inside = inside.filter(cls._passes(F.col("key"), *done))
            n = inside.count()
            if n == 0:
                return cls(levels)
            if level > 1 and levels[-2][1] == max_bits and n > 0.5 * sizes[-2]:
                max_bits *= 2  # full bitmaps pass every key: the levels would not end
            sizes.append(n)
            bits = min(max_bits, max(64, -(-n * bits_per_key // 8) * 8))
            rows = (
                inside.select(F.explode(F.array(*cls._places(F.col("key"), level, bits))).alias("place"))
                .groupBy(F.floor(F.col("place") / 8).alias("byte"))
                .agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("place") % 8).cast("int"))).alias("mask"))
                .toLocalIterator()
            )
            bitmap = bytearray(bits // 8)  # bounded by max_bits
            for row in rows:
                bitmap[row["byte"]] = row["mask"]
            levels.append((level, bits, bytes(bitmap)))

    def member(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(self._passes(key, *level), answer).otherwise(F.lit(level[0] % 2 == 1))
        return answer


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    *,
    url: str = "url",
    keep: tuple[str, ...] = ("page_id",),
    default: str = "allow",
    bits_per_key: int = 10,
) -> DataFrame:
    """``keep`` columns, host, path, rule and verdict of every row.

    rules: (``allow`` or ``block``, host and path).  The longest rule that fits
    wins; between two of one length, the one later in text order.  Urls that fit
    no rule are on neither list and get ``default``.
    """
    texts = [r for _, r in rules]
    host, path = host_and_path(F.col(url))
    parts = pages.select(*keep, host.alias("_host"), path.alias("_path"))
    parts = parts.withColumn("_keys", candidate_keys(F.col("_host"), F.col("_path"), texts))
    spark = pages.sparkSession
    seen = parts.select(F.explode("_keys").alias("key")).distinct()
    fits: dict[str, Column] = {}
    for action in ("allow", "block"):
        listed = spark.createDataFrame([(r,) for a, r in rules if a == action], "key string")
        both = seen.withColumn("listed", F.lit(False)).unionByName(listed.withColumn("listed", F.lit(True)))
        universe = settle(both.groupBy("key").agg(F.max("listed").alias("listed")), "url-keys")
        cascade = Cascade.build(universe, bits_per_key=bits_per_key)
        fits[action] = F.filter("_keys", cascade.member)

    def ranked(action: str) -> Column:
        return F.transform(fits[action], lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"), F.lit(action).alias("action")))

    best = F.array_max(F.concat(ranked("allow"), ranked("block")))
    return parts.withColumn("_best", best).select(
        *keep,
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.action", F.lit(default)).alias("verdict"),
    )
