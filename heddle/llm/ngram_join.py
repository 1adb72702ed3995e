"""Near-duplicate texts by an n-gram Jaccard join with several global token orders.

A text's tokens are its distinct shingles of ``k`` words.  Two sets of nx and ny tokens
whose Jaccard similarity is at least t have t / (1 + t) * (nx + ny) tokens in common or more.
Under any global order of the tokens, all of these but the last few lie in a prefix of
either set: at most as many lie outside as the longer of the two rests holds.

1. Texts with equal sets form a class, told by a digest of the set; what follows is
   about classes, so ids may be repeated or absent.
2. Order A puts tokens that are frequent last (frequencies counted over the
   whole corpus, within blocks; the ``heavy`` most frequent are sent to the
   tasks, a fixed bound; any table gives a valid order).  Prefix tokens under A
   are dealt out by token; tokens of one class only drop out.  Prefixes are longer than
   the least by ``extra`` percent of n, so similar sets share many tokens of them.
3. What is left of a set's prefix is put in order again, rarest first.  A shared token
   with f tokens from it on admits partners of those sizes alone for which f common
   tokens are enough.  Token lists are cut by bands of both sizes, and a set enters
   those bands that it admits; lists without two sides drop out.
4. In each of some turns, a set meets one head: the one of its lists' heads that most
   of them name.  First the heads are the sets with most shared tokens (what the
   others were copied from), then sets by a hash, of other components.  Last, the
   pairs of different components that are left are made, where both sides admit the other.
5. Orders B and C (ascending and descending by another hash): candidates must share as
   many tokens of their prefixes under each as similar sets do.  Whole sets meet,
   and common tokens are counted, only for those that pass.

Shingles are compared by 64-bit hashes.  Null and empty texts, and texts without
words, have no tokens and stay alone.  Rows that repeat an id each belong to their own
text's class; a null id takes its class's component (null where no id is in it).  An
empty table gives no rows; further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bound_batches, broadcastable, mapped, settle
from .components import connected_components
from .words import mix, shingles, signed, text_blocks, word_hashes

COUNTED = 3_000_000  # tokens that are counted together before the cluster adds counts up


def token_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sorted distinct shingle hashes of runs of texts."""
    for at, data, offsets in text_blocks(texts):
        words, first = word_hashes(data, offsets)
        yield at, [np.unique(shingles(words[a:b], k)) for a, b in zip(first[:-1], first[1:])]


def digests(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone."""
    a, b = (mix(tokens ^ np.uint64(s)).sum(dtype=np.uint64) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
    return tuple(signed(np.array([a, b], np.uint64)).tolist())


def needed(n: Column | int, percent: int):
    """The least overlap of a set of n with any that is similar to it."""
    return -((-n * percent) // 100) if isinstance(n, int) else F.ceil(n * percent / 100)


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    """kind 0: (doc, n, d1, d2) of each text; kind 1: n texts of a block hold the token d1."""

    names = ["kind", "doc", "n", "d1", "d2"]

    def frequent(own: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(own) if own else np.empty(0, np.uint64), return_counts=True)
        token, count = token[count > 1], count[count > 1]
        own.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(token), "int32")), pa.nulls(len(token), kind), pa.array(count), pa.array(signed(token)), pa.array(np.zeros(len(token), np.int64))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        held, kind = 0, None
        for batch in batches:
            n, d1, d2, kind = [], [], [], batch.column(0).type
            for _, sets in token_sets(batch.column(1), k):
                for s in sets:
                    d = digests(s) if len(s) else (0, 0)
                    n.append(len(s))
                    d1.append(d[0])
                    d2.append(d[1])
                    if d not in seen:
                        seen.add(d)
                        own.append(s)
                        held += len(s)
                if held > COUNTED:
                    yield frequent(own, kind)
                    held = 0
                    seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), "int32")), batch.column(0), *(pa.array(x, pa.int64()) for x in (n, d1, d2))], names=names)
        if own:
            yield frequent(own, kind)

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.select("doc", "text").transform(mapped, run, f"kind int, doc {kind}, n long, d1 long, d2 long")


def _postings(docs: DataFrame, k: int, percent: int, extra: int, heavy: np.ndarray, weight: np.ndarray) -> DataFrame:
    """(token, d1) of the prefixes under order A; heavy is sorted, weight its frequencies."""
    sent = docs.sparkSession.sparkContext.broadcast((heavy, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, weight = sent.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, sets in token_sets(batch.column(0), k):
                tokens, keys = [], []
                for s in sets:
                    if not len(s) or (d := digests(s)) in seen:
                        continue
                    seen.add(d)
                    p = len(s) - outside(len(s), percent, extra)
                    if len(heavy):
                        place = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                        rank = np.where(heavy[place] == s, weight[place], 0)
                        if rank.any():
                            s = s[np.argsort(rank, kind="stable")]
                    tokens.append(s[:p])
                    keys.append(np.full(p, d[0]))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(tokens))), pa.array(np.concatenate(keys))], names=["token", "d1"])

    return docs.select("text").transform(mapped, run, "token long, d1 long")


def _sets(docs: DataFrame, wanted: DataFrame, k: int, percent: int, extra: int) -> DataFrame:
    """(key, n, rising, falling, tokens) of the wanted classes (key, rep, d1, d2): whole sets, and prefixes under orders B and C."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in token_sets(batch.column(0), k):
                d = [digests(s) if len(s) else (0, 0) for s in sets]
                sets = [np.sort(signed(mix(s ^ np.uint64(0xD1342543DE82EF95)))) for s in sets]
                p = [len(s) - outside(len(s), percent, extra) if len(s) else 0 for s in sets]
                columns = [pa.array([x[i] for x in d], pa.int64()) for i in (0, 1)]
                for part in ([s[:n] for s, n in zip(sets, p)], [s[len(s) - n :] for s, n in zip(sets, p)], sets):
                    offsets = np.cumsum([0, *map(len, part)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(part) if part else np.empty(0, np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=["d1", "d2", "rising", "falling", "tokens"])

    reps = settle(wanted.select(F.col("rep").alias("_rep")).distinct(), "representatives")
    some = docs.join(broadcastable(reps), docs["doc"].eqNullSafe(reps["_rep"]), "left_semi")
    found = some.select("text").transform(mapped, run, "d1 long, d2 long, rising array<long>, falling array<long>, tokens array<long>")
    found = found.join(broadcastable(wanted.select("key", "n", "d1", "d2")), ["d1", "d2"])
    # Of rows with equal sets one serves; a representative's id seldom stands on several.
    return found.drop("d1", "d2").dropDuplicates(["key"])


def outside(n: Column | int, percent: int, extra: int):
    """How many of a set's n tokens lie outside its prefix."""
    return needed(n, percent) - 1 - (n * extra // 100 if isinstance(n, int) else F.floor(n * extra / 100))


def required(nx: Column, ny: Column, percent: int, extra: int) -> Column:
    """The least number of common tokens in the prefixes, under one order, of similar sets of nx and ny."""
    common = F.ceil((nx + ny) * percent / (100 + percent))
    return common - F.greatest(outside(nx, percent, extra), outside(ny, percent, extra))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int, extra: int) -> DataFrame:
    """Those (a, b) of pairs that are similar."""

    def side(name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("key").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    parts = ("n", "rising", "falling")
    both = pairs.select("a", "b").join(side("a", *parts), "a").join(side("b", *parts), "b")
    least = F.greatest(F.lit(1), required(F.col("n_a"), F.col("n_b"), percent, extra))
    passing = both.filter((F.size(F.array_intersect("rising_a", "rising_b")) >= least) & (F.size(F.array_intersect("falling_a", "falling_b")) >= least))
    passing = settle(passing.select("a", "b", "n_a", "n_b"), "passing")
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    whole = passing.join(side("a", "tokens"), "a").join(side("b", "tokens"), "b")
    return whole.filter(common * 100 >= percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def _fit(na: Column, nb: Column, percent: int) -> Column:
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def _banded(lists: DataFrame, percent: int, extra: int, step: float = 1.05) -> DataFrame:
    """Lists (token, n, f ...) dealt to pairs of size bands (small, large) that f admits; ``band`` is the own one."""
    band = lambda n: F.floor(F.log(n) / float(np.log(step))).cast("int")
    n = F.col("n")
    near = F.sequence(band(F.ceil(n * percent / 100)) - 1, band(F.floor(n * 100 / percent)) + 1)
    dealt = lists.withColumn("band", band(n)).withColumn("other", F.explode(near))
    # The least required number over a band is at one of its ends; one more on either side for rounding.
    ends = [F.greatest(F.lit(1), F.floor(F.pow(F.lit(step), F.col("other"))) - 1), F.ceil(F.pow(F.lit(step), F.col("other") + 1)) + 1]
    least = F.least(*(required(n, e, percent, extra) for e in ends)) - 1
    dealt = dealt.filter(F.col("f") >= least)
    return dealt.withColumns({"small": F.least("band", "other"), "large": F.greatest("band", "other")}).drop("other")


def _alive(lists: DataFrame, comp: str) -> DataFrame:
    """Rows of the lists that hold several components, and both bands."""
    by = Window.partitionBy("token", "small", "large")
    ends = {"lo": F.min(comp).over(by), "hi": F.max(comp).over(by), "_b0": F.min("band").over(by), "_b1": F.max("band").over(by)}
    return lists.withColumns(ends).filter("lo < hi AND _b0 = small AND _b1 = large").drop("lo", "hi", "_b0", "_b1")


def _classes(docs: DataFrame, *, k: int, percent: int, extra: int, heavy: int, turns: int) -> tuple[DataFrame, DataFrame]:
    """(doc, n, d1, d2) of every row, and (d1, d2, component_id) of every set."""
    signatures = settle(_signatures(docs, k), "signatures")
    own = signatures.filter("kind = 0").drop("kind")
    frequent = signatures.filter("kind = 1").groupBy("d1").agg(F.sum("n").alias("n")).filter("n >= 8").orderBy(F.desc("n"), "d1").limit(heavy)
    table = frequent.select("d1", "n").toArrow()  # at most ``heavy`` rows
    token, weight = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
    order = np.argsort(token)
    classes = own.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc").alias("rep"), F.first("n").alias("n"))
    # 64 bits stand for a set; where they are those of another set too, other 64 bits do.
    first = F.row_number().over(Window.partitionBy("d1").orderBy("d2")) == 1
    classes = settle(classes.withColumn("key", F.when(first, F.col("d1")).otherwise(F.xxhash64("d1", "d2"))), "classes")

    by_token, by_key = Window.partitionBy("token"), Window.partitionBy("key")
    spread = lambda c: {"lo": F.min(c).over(by_token), "hi": F.max(c).over(by_token)}
    shared = _postings(docs, k, percent, extra, token[order], weight[order])
    shared = settle(shared.withColumns(spread("d1")).filter("lo < hi").select("token", "d1"), "shared-tokens")
    lists = shared.distinct().join(classes.select("d1", "key", "n"), "d1").select("token", "key", "n")
    lists = lists.withColumn("size", F.count(F.lit(1)).over(by_token))
    lists = lists.withColumns({"shared": F.count(F.lit(1)).over(by_key), "at": F.row_number().over(by_key.orderBy("size", "token"))})
    lists = lists.withColumn("f", F.col("shared") - F.col("at") + 1).filter(F.col("f") > F.floor(F.col("n") * extra / 100))
    lists = settle(_alive(_banded(lists, percent, extra), "key").select("token", "small", "large", "band", "key", "n", "shared", "f"), "lists")
    wanted = settle(classes.join(lists.select("key").distinct(), "key", "left_semi"), "wanted")
    sets = settle(_sets(docs, wanted, k, percent, extra), "sets")

    comps, links = None, None
    by_list = Window.partitionBy("token", "small", "large")

    def comp_of(df: DataFrame) -> DataFrame:
        if comps is None:
            return df.withColumn("comp", F.col("key"))
        known = comps.select(F.col("node").alias("key"), F.col("comp").alias("_c"))
        return df.join(known, "key", "left").withColumn("comp", F.coalesce("_c", "key")).drop("_c")

    def learn(pairs: DataFrame) -> bool:
        nonlocal comps, links
        more = settle(_verify(pairs, sets, percent, extra), "links")
        if more.isEmpty():
            return False
        links = settle(links.unionByName(more), "links") if links is not None else more
        comps = connected_components(links)
        return True

    def admits(x: str, y: str) -> Column:
        least = required(F.col(f"{x}n"), F.col(f"{y}n"), percent, extra)
        return (F.col(f"{x}f") >= least) & (F.col(f"{y}f") >= least) & _fit(F.col(f"{x}n"), F.col(f"{y}n"), percent)

    for turn in range(turns):
        # Heads stand for their component in each list; a set meets the one that most of its lists name.
        rank = (-F.col("shared") / F.col("n")) if turn == 0 else F.xxhash64("key", F.lit(turn)).cast("double")
        head = F.min(F.struct(rank.alias("h"), "key", "comp", "n", "f")).over(by_list)
        lists = settle(_alive(comp_of(lists.drop("comp")), "comp"), "live-lists")
        flat = {f"h_{c}": F.col(f"head.{c}") for c in ("key", "comp", "n", "f")}
        far = lists.withColumn("head", head).withColumns(flat).withColumns({"x_n": F.col("n"), "x_f": F.col("f")}).filter((F.col("comp") != F.col("h_comp")) & admits("x_", "h_"))
        votes = far.groupBy(F.col("h_key").alias("a"), F.col("key").alias("b")).agg(F.count(F.lit(1)).alias("votes"))
        if not learn(votes.groupBy("b").agg(F.max_by("a", F.struct("votes", "a")).alias("a"))) and turn:
            break
    lists = settle(_alive(comp_of(lists.drop("comp")), "comp"), "mixed-lists")
    x, y = (lists.select("token", "small", "large", F.col("key").alias(r), *(F.col(c).alias(f"{r}_{c}") for c in ("n", "f", "comp", "band"))) for r in "ab")
    met = x.join(y, ["token", "small", "large"]).filter((F.col("a_comp") < F.col("b_comp")) & (F.col("small") + F.col("large") == F.col("a_band") + F.col("b_band")) & admits("a_", "b_"))
    learn(met.select("a", "b").distinct())

    placed = comp_of(classes.select("key", "d1", "d2", "rep"))
    least = placed.groupBy("comp").agg(F.min("rep").alias("component_id"))
    return own, settle(placed.join(least, "comp").select("d1", "d2", "comp", "component_id"), "placed")


def near_duplicates(documents: DataFrame, *, k: int = 5, percent: int = 75, extra: int = 10, heavy: int = 200_000, turns: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    docs = documents.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    own, placed = _classes(docs, k=k, percent=percent, extra=extra, heavy=heavy, turns=turns)
    linked = own.filter("n > 0").join(placed, ["d1", "d2"]).select("doc", "n", "component_id")
    alone = own.filter("n = 0").select("doc", "n", F.col("doc").alias("component_id"))
    return linked.unionByName(alone).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def with_digests(documents: DataFrame, k: int, text: str, names: tuple[str, str]) -> DataFrame:
    """The rows with the digest of each one's set, 0 and 0 for none."""
    at = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = [digests(s) if len(s) else (0, 0) for _, sets in token_sets(batch.column(at), k) for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[i] for x in d], pa.int64()) for i in (0, 1))], names=[*batch.schema.names, *names])

    return documents.transform(mapped, run, T.StructType([*documents.schema, *(T.StructField(c, T.LongType()) for c in names)]))


def one_of_each(documents: DataFrame, *, k: int = 5, percent: int = 75, extra: int = 10, heavy: int = 200_000, turns: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that of the smallest id, or of any where none has an id.

    Texts without words are in no component and stay.  Of rows with the same id and
    equal sets one stays.
    """
    bound_batches(documents.sparkSession)
    docs = documents.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    own, placed = _classes(docs, k=k, percent=percent, extra=extra, heavy=heavy, turns=turns)
    # The rows of each set and id, and which of them come first in their component.
    each = own.filter("n > 0").groupBy("d1", "d2", "doc").agg(F.count(F.lit(1)).alias("rows")).join(placed.drop("component_id"), ["d1", "d2"])
    each = settle(each.withColumn("place", F.struct(F.col("doc").isNull().alias("none"), "doc", "d1", "d2")), "members")
    each = each.join(each.groupBy("comp").agg(F.min("place").alias("first")), "comp").withColumn("stays", F.col("place").eqNullSafe(F.col("first")))
    each = settle(each.select("doc", "d1", "d2", "rows", "stays"), "decided")
    if own.groupBy("doc").count().filter("doc IS NULL OR count > 1").isEmpty():  # ids tell rows apart
        gone = settle(each.filter("NOT stays").select(F.col("doc").alias("_gone")), "gone")
        return documents.join(broadcastable(gone), documents[doc_id] == gone["_gone"], "left_anti")
    names = ("_heddle_d1", "_heddle_d2")
    marked = with_digests(documents, k, text, names)

    def matched(rows: DataFrame, of: DataFrame, how: str) -> DataFrame:
        of = settle(of.select(F.col("doc").alias("_doc"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2")), "matched")
        same = (rows[names[0]] == of["_d1"]) & (rows[names[1]] == of["_d2"]) & rows[doc_id].eqNullSafe(of["_doc"])
        return rows.join(broadcastable(of), same, how)

    kept = matched(marked, each.filter("NOT stays"), "left_anti")
    several = each.filter("stays AND rows > 1")
    once = matched(kept, several, "left_semi").dropDuplicates([doc_id, *names])
    return matched(kept, several, "left_anti").unionByName(once).drop(*names)
