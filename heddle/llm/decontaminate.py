"""Benchmark decontamination by a distributed positional inverted index.

Words are runs of characters outside ASCII punctuation, spaces and controls,
after A-Z become lower case.  A window is ``width`` consecutive words of a
benchmark item; a shorter item is one window.

1. Count, over the whole corpus, how often each word of the benchmark occurs.
2. For each window take its two rarest words as anchors.
3. Store the positional index: the postings (document, position) of every anchor word.
4. Shift the postings of a window's rarest word by its offset, and those of the
   second by its own; where both lists hold the same start the window may stand.  With
   ``slack`` the starts may differ by so much.
5. Compare the documents that hold such starts, once each, with their windows: all words
   at their places are an exact phrase match; all words within ``slack`` places
   around the window are a proximity match.
6. Count hit positions per document from overlapping intervals (no expansion).

Benchmark words, windows and the keys of matching documents are broadcast only up to
a number of bytes, which is counted; more words mean more passes over the corpus, more windows
or keys a shuffle.  Only DataFrame functions are used.

Null or empty texts have no words and no hits, nor has any text where there are
no items; an empty table gives no rows; repeated rows get equal answers.  Items
without id make hits, but are neither counted nor listed as items.  Further columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcastable, lower_ascii, settle

#: What parts words, after A-Z are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["_id", "_hash"]


def words(text: Column) -> Column:
    # Splitting takes a seventh of the time of matching the words themselves.
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), "")


def keyed(documents: DataFrame, doc_id: str, text: str) -> list[Column]:
    """Columns that tell rows apart, but for rows with equal ids and texts."""
    return [F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_hash")]


def windows_of(items: DataFrame, *, item_id: str, text: str, width: int) -> DataFrame:
    """Distinct (item, len, w) windows."""
    w = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))
    w = w.select("item", "w", F.explode(starts).alias("s"))
    cut = w.select("item", F.slice("w", F.col("s"), F.lit(width)).alias("w"))
    return cut.select("item", F.size("w").alias("len"), "w").distinct()


def anchored(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window with its two rarest words (term, off; term2, off2), the first on ties; one word has no second."""
    each = windows.select("item", "len", "w", F.posexplode("w").alias("off", "term")).join(counts, "term", "left")
    ranked = each.groupBy("item", "len", "w").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "term"))).alias("a"))
    # A word that the corpus lacks: the window cannot occur as it stands.
    ranked = ranked.filter(F.col("a")[0]["n"] > 0)
    second = F.get("a", F.lit(1))
    return ranked.select("item", "len", "w", F.col("a")[0]["term"].alias("term"), F.col("a")[0]["off"].alias("off"), second["term"].alias("term2"), second["off"].alias("off2"))


def _blocks(terms: DataFrame, limit: int) -> list[DataFrame]:
    """The terms in parts of some ``limit`` bytes."""
    size = terms.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0
    k = max(1, -(-size // limit))
    return [terms.filter(F.pmod(F.xxhash64("term"), F.lit(k)) == i) for i in range(k)] if k > 1 else [terms]


def corpus_counts(docs: DataFrame, vocabulary: DataFrame, limit: int) -> DataFrame:
    tokens = docs.select(F.explode(words(F.col("_text"))).alias("term"))
    parts = [tokens.join(F.broadcast(b), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n")) for b in _blocks(vocabulary, limit)]
    return reduce(DataFrame.unionByName, parts)


def build_index(docs: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """Postings (term, _id, _hash, pos) of the terms."""
    each = docs.select(*KEY, F.posexplode(words(F.col("_text"))).alias("pos", "term"))
    return reduce(DataFrame.unionByName, [each.join(F.broadcast(b), "term", "left_semi") for b in _blocks(terms, limit)])


def candidate_starts(index: DataFrame, windows: DataFrame, slack: int = 0) -> DataFrame:
    """(_id, _hash, item, len, w, start) where the lists of both anchors meet."""
    many = broadcastable(windows.withColumn("w_text", F.array_join("w", " ")).drop("w"))
    first = index.join(many, "term").select(*KEY, "item", "len", "w_text", (F.col("pos") - F.col("off")).alias("start"), "term2", "off2")
    alone = first.filter("term2 IS NULL")
    two = first.filter("term2 IS NOT NULL")
    place = F.col("start") + F.col("off2")
    two = two.withColumn("pos", F.explode(F.sequence(place - slack, place + slack)) if slack else place)
    listed = index.select(F.col("term").alias("term2"), *KEY, F.col("pos").cast("int").alias("pos")).distinct()
    two = two.withColumn("pos", F.col("pos").cast("int")).join(listed, ["term2", *KEY, "pos"], "left_semi")
    return alone.unionByName(two.drop("pos")).select(*KEY, "item", "len", "w_text", "start").distinct()


def _meet(docs: DataFrame, starts: DataFrame, holds) -> DataFrame:
    """(_id, _hash, item, start, len) of the starts for which ``holds(words, start)``; a document's words are cut once."""
    per_doc = starts.groupBy(*KEY).agg(F.collect_list(F.struct("item", "start", "len", "w_text")).alias("starts"))
    keys = settle(starts.select(*KEY).distinct(), "candidates")
    some = docs.join(broadcastable(keys), KEY, "left_semi").dropDuplicates(KEY).select(*KEY, words(F.col("_text")).alias("w"))
    found = some.join(per_doc, KEY).select(*KEY, F.explode(F.filter("starts", lambda c: holds(F.col("w"), c))).alias("c"))
    return found.select(*KEY, "c.item", "c.start", "c.len").distinct()


def phrase_matches(docs: DataFrame, index: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct (_id, _hash, item, start, len) where a window stands in a document word by word."""

    def same(w: Column, c: Column) -> Column:
        return (c["start"] >= 0) & (F.array_join(F.slice(w, F.greatest(c["start"], F.lit(0)) + 1, c["len"]), " ") == c["w_text"])

    return _meet(docs, settle(candidate_starts(index, windows), "starts"), same)


def proximity_matches(docs: DataFrame, index: DataFrame, windows: DataFrame, slack: int) -> DataFrame:
    """(_id, _hash, item, start, len) where all words of a window stand within ``slack`` places around it, in any order.

    Its second rarest word stands within ``slack`` of its place after the rarest.
    """

    def near(w: Column, c: Column) -> Column:
        low = F.greatest(c["start"] - slack, F.lit(0))
        around = F.slice(w, low + 1, F.greatest(c["start"] + c["len"] + slack - low, F.lit(0)))
        return F.size(F.array_except(F.split(c["w_text"], " "), around)) == 0

    return _meet(docs, settle(candidate_starts(index, windows, slack), "near-starts"), near)


def find_matches(documents: DataFrame, items: DataFrame, *, width: int, slack: int, doc_id: str, text: str, item_id: str, item_text: str, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Phrase matches, and with ``slack`` proximity matches, as (_id, _hash, item, start, len)."""
    docs = documents.select(*keyed(documents, doc_id, text), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    windows = settle(windows_of(items, item_id=item_id, text=item_text, width=width), "windows")
    vocabulary = settle(windows.select(F.explode("w").alias("term")).distinct(), "vocabulary")
    counts = settle(corpus_counts(docs, vocabulary, limit), "test-term-counts")
    windows = settle(anchored(windows, counts), "anchored-windows")
    terms = windows.select("term").unionByName(windows.select(F.col("term2").alias("term"))).filter("term IS NOT NULL")
    index = settle(build_index(docs, settle(terms.distinct(), "anchors"), limit), "postings")
    near = settle(proximity_matches(docs, index, windows, slack), "near") if slack else None
    return settle(phrase_matches(docs, index, windows), "phrases"), near


def _per_item(found: DataFrame, n: str, items: str) -> DataFrame:
    named = found.filter("item IS NOT NULL").select(*KEY, "item").distinct().groupBy(*KEY)
    return named.agg(F.count(F.lit(1)).alias(n), F.array_join(F.sort_array(F.collect_list("item")), ",").alias(items))


def decontaminate(
    documents: DataFrame,
    items: DataFrame,
    *,
    width: int = 10,
    slack: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    limit: int = 32 << 20,
) -> DataFrame:
    """Per row of ``documents``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; with ``slack`` also n_near, the items near."""
    found, near = find_matches(documents, items, width=width, slack=slack, doc_id=doc_id, text=text, item_id=item_id, item_text=item_text, limit=limit)
    per_start = found.groupBy(*KEY, "start").agg(F.max("len").alias("len"))
    by_start = Window.partitionBy(*KEY).orderBy("start")
    end = F.col("start") + F.col("len")
    reached = F.coalesce(F.max(end).over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), reached))
    hits = per_start.withColumn("_fresh", fresh).groupBy(*KEY).agg(F.sum("_fresh").alias("n_hit"))
    facts = hits.join(_per_item(found, "n_items", "items"), KEY, "left")
    extra = []
    if near is not None:
        facts = facts.join(_per_item(near, "n_near", "_near"), KEY, "full")
        extra = [F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")]
    facts = settle(facts, "facts")
    sized = documents.select(F.col(doc_id).alias("doc_id"), *keyed(documents, doc_id, text), F.size(words(F.col(text).cast("string"))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return sized.join(broadcastable(facts), KEY, "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        *extra,
    )


def keep_clean(documents: DataFrame, items: DataFrame, *, width: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = 32 << 20) -> DataFrame:
    """The rows, with all their columns, whose own text holds no window, whatever their id."""
    found, _ = find_matches(documents, items, width=width, slack=0, doc_id=doc_id, text=text, item_id=item_id, item_text=item_text, limit=limit)
    hit = settle(found.select(F.col("_id").alias("_hit_id"), F.col("_hash").alias("_hit_hash")).distinct(), "contaminated")
    own = keyed(documents, doc_id, text)
    return documents.join(broadcastable(hit), (own[0] == hit["_hit_id"]) & (own[1] == hit["_hit_hash"]), "left_anti")
