"""How far the sources of a language lie from each other, term by term.

Sort-based streaming.  Every block of documents sends one posting for each of its
terms: (lang, term, source, document, docs, count), where ``document`` is the
block's first row.  Postings are dealt by (lang, term) and sorted by the four keys; a
scan over the sorted rows folds each run, so a term's document frequency and its
counts by source are whole when the run ends, and no more than one run is held.  A
second scan of the same kind goes over what is kept, now with the shares p of every
source: each run gives partial sums for the pairs of sources that both have the
term, and the terms that stand out.

Sums over all terms need no row for a term that a source lacks.  With p0 for "no
occurrence", f(p, q) summed over all terms is the sum of

* f(p, p0) over the terms of one source and f(p0, p) over those of the other,
* f(p, q) - f(p, p0) - f(p0, q) + f(p0, p0) over the terms that both have,
* f(p0, p0) for each term, less one for each term of either source.

The first part depends on a source's counts alone, so it is summed over distinct
counts.

Null text, lang and source count as ''; repeated rows are documents of their own;
equal values rank by the item's UTF-8 bytes; a language without kept terms has
pairs of value 0; a language of one source has no pairs; an empty table gives no
rows; further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcastable, lanes, mapped, settle

#: A-Z in lower case, other ASCII than letters as space; bytes from 0x80 are parts of letters
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PIECE = 1 << 22  # bytes of a text whose terms are held at a time
ENTRIES = 200_000  # terms by source that a block holds before it is sent
PAIRS = 1 << 18  # pairs of postings worked on at a time
SCALE = 1_000_000_000

POSTINGS = "lang string, term string, source string, document long, docs long, count long"
KEPT = "lang string, term string, source string, count long, total long, first int"
FOUND = "lang string, source string, part string, item string, value long"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    folded, at = text.translate(FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def postings_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, source, text, place) to postings, counted over blocks of rows."""
    block: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    since, document = 0, None

    def send() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in block.items():
            terms = list(counts)
            for at in range(0, len(terms), 1 << 15):
                part = terms[at : at + (1 << 15)]
                n = len(part)
                columns = [pa.array([lang] * n, pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([source] * n, pa.string()), pa.array(np.full(n, document))]
                columns += [pa.array(list(map(of.__getitem__, part)), pa.int64()) for of in (docs, counts)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "source", "document", "docs", "count"])
        block.clear()

    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for lang, source, text, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, batch.column(3).to_pylist()):
            document = place if document is None else document
            counts, docs = block.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            for part in terms_of(text.as_py()):
                counts.update(part)
                own.update(part)
            docs.update(own)
            since += len(own)
            if since > ENTRIES // 4:  # so many entries are new at most
                since = 0
                if sum(len(c) for c, _ in block.values()) > ENTRIES:
                    yield from send()
                    document = None
    yield from send()


def begins(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a run of equal keys begins."""
    out = np.ones(len(rows), bool)
    if len(rows) > 1:
        same = None
        for k in keys:
            column = rows[k].combine_chunks() if isinstance(rows[k], pa.ChunkedArray) else rows[k]
            equal = pc.equal(column.slice(1), column.slice(0, len(column) - 1))
            same = equal if same is None else pc.and_(same, equal)
        out[1:] = ~same.to_numpy(zero_copy_only=False)
    return out


def numbers(rows: pa.Table, name: str) -> np.ndarray:
    return rows[name].to_numpy()


def folded(rows: pa.Table) -> pa.Table:
    """One row for each run of (lang, term, source)."""
    at = np.flatnonzero(begins(rows, ["lang", "term", "source"]))
    out = rows.take(pa.array(at))
    for name in ("docs", "count"):
        out = out.set_column(out.schema.get_field_index(name), name, pa.array(np.add.reduceat(numbers(rows, name), at)))
    return out


def whole_runs(batches: Iterator[pa.RecordBatch], fold: bool) -> Iterator[pa.Table]:
    """Tables that hold each run of (lang, term) whole; what is held over is one run."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
        rows = folded(rows) if fold else rows
        cut = int(np.flatnonzero(begins(rows, ["lang", "term"]))[-1])
        held = pa.concat_tables([rows.slice(cut)])
        if cut:
            yield rows.slice(0, cut)
    if held is not None:
        yield held


def kept_terms(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, fold=True):
            first = begins(rows, ["lang", "term"])
            at, which = np.flatnonzero(first), np.cumsum(first) - 1
            enough = (np.add.reduceat(numbers(rows, "docs"), at) >= min_docs)[which]
            total = np.add.reduceat(numbers(rows, "count"), at)[which]
            rows = rows.select(["lang", "term", "source", "count"]).append_column("total", pa.array(total)).append_column("first", pa.array(first.astype(np.int32)))
            yield from rows.filter(pa.array(enough)).to_batches()

    return run


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pairs_and_terms(top: int):
    """From kept postings with p, p0 and q to partial pairs and the terms that stand out in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, fold=False):
            n = len(rows)
            p, p0, q = (numbers(rows, k) for k in ("p", "p0", "q"))
            codes = [rows[k].combine_chunks().dictionary_encode() for k in ("lang", "source")]
            langs, sources = (c.indices.to_numpy().astype(np.int64) for c in codes)
            group = langs * len(codes[1].dictionary) + sources
            # The terms of each group that stand out, best first; rows come in the order of terms.
            out = np.flatnonzero(p > q)
            value = apart(p[out], q[out])
            order = np.lexsort((out, -value, group[out]))
            own = group[out][order]
            nth = np.arange(len(own)) - np.searchsorted(own, own)
            best = order[nth < top]
            yield found(rows, out[best], "term", rows["term"].take(pa.array(out[best])), value[best])
            # Each posting meets those of its run that come after it.
            first = begins(rows, ["lang", "term"])
            at = np.append(np.flatnonzero(first), n)
            partners = at[np.cumsum(first)] - np.arange(n) - 1
            upto = np.cumsum(partners)
            i = 0
            while i < n:
                j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS, side="right")))
                width = partners[i:j]
                a = np.repeat(np.arange(i, j), width)
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(width) - width, width)
                i = j
                if not len(a):
                    continue
                value = apart(p[a], p[b]) - apart(p[a], p0[b]) - apart(p0[a], p[b]) + apart(p0[a], p0[b])
                key = group[a] * len(codes[1].dictionary) + sources[b]
                order = np.argsort(key, kind="stable")
                key = key[order]
                start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                yield found(rows, a[order[start]], "pair", rows["source"].take(pa.array(b[order[start]])), np.add.reduceat(value[order], start))

    return run


def found(rows: pa.Table, at: np.ndarray, part: str, item: pa.ChunkedArray, value: np.ndarray) -> pa.RecordBatch:
    of = [rows[k].take(pa.array(at)).combine_chunks() for k in ("lang", "source")]
    return pa.RecordBatch.from_arrays([*of, pa.array([part] * len(at), pa.string()), item.combine_chunks(), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])


def share(count: str, n: str, v: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (n + 2 v)), without overflow."""
    return F.expr(f"1 + (cast({count} + 2 as decimal(20, 0)) * {SCALE}) div cast(greatest({n} + 2 * {v}, 1) as decimal(20, 0))")


def distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def audit_sources(
    documents: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_docs: int = 10,
    top: int = 10,
) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources and the terms of each."""
    spark = documents.sparkSession
    known = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))]
    rows = documents.select(*known, F.monotonically_increasing_id().alias("place"))
    postings = rows.transform(mapped, postings_of_blocks, POSTINGS).repartition(lanes(spark), "lang", "term")
    kept = settle(postings.sortWithinPartitions("lang", "term", "source", "document").transform(mapped, kept_terms(min_docs), KEPT), "terms")

    # n: occurrences of kept terms; has: kept terms that occur; all_n: those of the language; v: its kept terms
    by_source = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("has"))
    by_lang = by_source.groupBy("lang").agg(F.sum("n").alias("all_n")).join(kept.groupBy("lang").agg(F.sum("first").alias("v")), "lang")
    groups = documents.select(*known[:2]).distinct().join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0)
    groups = settle(groups.withColumn("p0", share("0", "n", "v")), "groups")
    of_group = broadcastable(groups)

    shares = kept.join(of_group, ["lang", "source"]).select("lang", "term", "source", share("count", "n", "v").alias("p"), "p0", share("total", "all_n", "v").alias("q"))
    scanned = shares.repartition(lanes(spark), "lang", "term").sortWithinPartitions("lang", "term", "source").transform(mapped, pairs_and_terms(top), FOUND)
    scanned = settle(scanned, "found")

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("p0_b"), F.col("has").alias("has_b"))
    other = broadcastable(other)
    counts = kept.groupBy("lang", "source", "count").agg(F.count("*").alias("times")).join(of_group, ["lang", "source"]).select("lang", "source", "times", share("count", "n", "v").alias("p"))
    alone = counts.join(other, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("times") * distance("p", "p0_b")).alias("value"))
    both = scanned.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    none = groups.join(other, "lang").filter("source <> item").select("lang", "source", "item", ((F.col("v") - F.col("has") - F.col("has_b")) * distance("p0", "p0_b")).alias("value"))
    one_way = alone.unionByName(both)
    either = one_way.unionByName(one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).unionByName(none)
    pairs = either.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    def ranked(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    terms = ranked(scanned.filter("part = 'term'")).filter(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked(pairs).select(columns).unionByName(terms.select(columns))
