"""Exact top-k inner products with coarse-to-fine segment bounds.

A vector is cut into segments; each keeps its length, mean and deviation (the
root of its summed squared differences from the mean).  Of two vectors, a
segment's inner product is at most length * mean * mean + deviation * deviation,
which is the same as the least distance that means and deviations allow.  Sums
over ever finer segments bound the whole product ever closer.  Pairs whose bound
is under the query's k-th best so far are dropped, coarse bounds first, and the
survivors get their exact integer product.  Bounds carry a margin for rounding,
so no pair is lost.

Queries come in blocks of at most ``block`` vectors (a bounded broadcast) and
are run against all rows in one scan for each block.  A scan's partial answers
are k rows for each query and partition.

Vectors that are null or hold null or non-finite components take no part, nor do
null ids; an empty vector has product 0 with other empty ones; vectors meet only
those of their own length.  Ties go to the smaller id, and rows that repeat an id
are candidates each.  Scores must fit 64 bits.  An empty table gives no rows, and
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mapped, settle

SEGMENTS = (1, 4, 16)
TILE = 512  # queries at a time against one batch of candidates


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite


def summary(x: np.ndarray, parts: int) -> np.ndarray:
    """Of each row its segments' means and deviations, scaled so that the product of two summaries is the bound."""
    n, d = x.shape
    edges = np.linspace(0, d, min(parts, max(1, d)) + 1).astype(int)
    columns = []
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            mean = x[:, a:b].mean(1)
            columns += [mean * np.sqrt(b - a), np.sqrt(np.square(x[:, a:b] - mean[:, None]).sum(1))]
    return np.stack(columns, 1) if columns else np.zeros((n, 1))


class Best:
    """The k best of each query so far: scores falling, ids rising within one."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), np.iinfo(np.int64).min), np.full((n, k), np.iinfo(np.int64).max)
        self.filled = np.zeros((n, k), bool)

    def floor(self) -> np.ndarray:
        return np.where(self.filled[:, -1], self.scores[:, -1].astype(float), -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        start = np.r_[0, np.flatnonzero(np.diff(query)) + 1] if len(query) else np.empty(0, int)
        for s, e in zip(start, np.r_[start[1:], len(query)]):
            q, e = query[s], min(e, s + self.k)
            have = self.filled[q]
            all_s, all_i = np.r_[self.scores[q][have], scores[s:e]], np.r_[self.ids[q][have], ids[s:e]]
            top = np.lexsort((all_i, -all_s))[: self.k]
            self.scores[q, : len(top)], self.ids[q, : len(top)] = all_s[top], all_i[top]
            self.filled[q, : len(top)] = True


class Search:
    """Queries of one length, held against batches of candidates one by one."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.best = ids, queries, Best(len(queries), k)
        self.levels = [summary(queries, p) for p in SEGMENTS]
        self.size = np.sqrt(np.square(queries).sum(1)).max(initial=0)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        own = [summary(x, p) for p in SEGMENTS]
        slack = 1e-9 * (1 + self.size * np.sqrt(np.square(x).sum(1)).max(initial=0))
        exact = self.size * np.sqrt(np.square(x).sum(1)).max(initial=0) < 2**52
        for a in range(0, len(self.queries), TILE):
            tile, floor = slice(a, a + TILE), self.best.floor()[a : a + TILE] - slack
            alive = self.ids[tile, None] != ids[None, :]
            q, c = np.nonzero(alive)
            for level, mine in zip(self.levels, own):
                if len(q) > 0.1 * alive.size:  # many left: bound them all at once
                    alive &= level[tile] @ mine.T >= floor[:, None]
                    q, c = np.nonzero(alive)
                elif len(q):
                    keep = np.einsum("ij,ij->i", level[a + q], mine[c]) >= floor[q]
                    q, c = q[keep], c[keep]
            if not len(q):
                continue
            if not exact:
                scores = (self.queries[a + q].astype(np.int64) * x[c].astype(np.int64)).sum(1)
            elif len(q) > 0.1 * alive.size:
                scores = (self.queries[tile] @ x.T)[q, c].astype(np.int64)
            else:
                scores = np.einsum("ij,ij->i", self.queries[a + q], x[c]).astype(np.int64)
            keep = scores >= floor[q]
            self.best.add(a + q[keep], ids[c[keep]], scores[keep])


def _grouped(batch: pa.RecordBatch | pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: ids and vectors."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(0).to_numpy(), batch.column(1)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    starts = np.cumsum(lengths) - lengths
    out = {}
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        out[int(d)] = ids[at], flat[starts[at][:, None] + np.arange(d)]
    return out


def top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 5,
    scale: int = 256,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    block: int = 16384,
) -> DataFrame:
    """query_id, rank, vec_id and score: the k largest products of each query with other rows."""
    x = F.transform(F.col(vector), lambda v: F.floor(v.cast("double") * scale).cast("long"))
    rows = vectors.filter(usable(F.col(vector)) & F.col(vec_id).isNotNull())
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"), is_query.alias("q"))
    queries = settle(rows.filter("q").select("vec_id", "x").distinct(), "queries")
    blocks = max(1, -(-queries.count() // block))
    partial = []
    for i in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i) if blocks > 1 else queries
        held = own.toArrow()  # about ``block`` vectors
        by_size = _grouped(held)
        sent = vectors.sparkSession.sparkContext.broadcast(by_size)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            searches: dict[int, Search] = {}
            for batch in batches:
                for d, (ids, x) in _grouped(batch).items():
                    if d in sent.value:
                        if d not in searches:
                            searches[d] = Search(*sent.value[d], k)
                        searches[d].meet(ids, x)
            for s in searches.values():
                q_ids, best = s.ids, s.best
                r, c = np.nonzero(best.filled)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[r]), pa.array(best.ids[r, c]), pa.array(best.scores[r, c])], names=["query_id", "vec_id", "score"])

        found = rows.select("vec_id", "x").transform(mapped, run, "query_id long, vec_id long, score long")
        partial.append(settle(found, "partial-top-k") if blocks > 1 else found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.unionByName, partial).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
