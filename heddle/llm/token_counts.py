"""Counts of tokens by a two-tier lookup, in one pass over the texts.

A byte-level vocabulary first splits a text into pre-tokens and merges bytes within
each alone, so a text's count is the sum over its pre-tokens.  The lengths of
frequent pre-tokens are broadcast as one small table; a worker encodes what the
table lacks and keeps it in a cache of bounded size.  No pre-token leaves the task
that reads it.  The table is filled from a bounded sample, which decides how fast a
count is found and never what it is.

Texts are cut where pre-tokens surely end.  A part that holds a special string, or
characters on whose class two Unicode tables might differ, is encoded by the
library itself.

Null texts are empty and have no tokens; repeated rows are counted each; an empty
table gives no rows; further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped

#: Characters on whose class no two Unicode tables differ: ASCII but separators 0x1C-0x1F and 0x7F, Latin letters and signs
_SURE = re.compile(r"[\x00-\x1b\x20-\x7e\xa0-ɏ‐-‧]*")
_LETTER, _DIGIT = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
#: The vocabulary's pattern over those characters, with their letters and digits spelt out
_PRE_TOKEN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^\s{_LETTER}{_DIGIT}]+|\s+(?!\S)|\s+")
_SOLID = r"[!-~\xa1-\xac\xae-ɏぁ-ゖァ-ヺ一-龥]"
#: A pre-token ends before a single space or line end between two such characters, and after a full stop before an ideograph.
_CUT = re.compile(rf"(?<={_SOLID})(?=[ \n]{_SOLID})|(?<=。)(?=[一-龥])")
PIECE = 1 << 15  # characters of a text at a time
CACHE_BYTES, LONGEST = 24 << 20, 64  # of a worker's cache, some 100 bytes an entry; longer pre-tokens aren't kept
BATCH = 20_000  # pre-tokens that are encoded together


@lru_cache(maxsize=1)
def tokenizer_of(path: str | None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())


def lengths(tokenizer, strings: list[str]) -> list[int]:
    return [len(e.ids) for e in tokenizer.encode_batch_fast(strings, add_special_tokens=False)]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


class Cache(dict):
    """Lengths of pre-tokens that the table lacks; emptied when it outgrows its bound."""

    size = 0

    def learn(self, new: list[str], found: list[int]) -> None:
        if self.size > CACHE_BYTES:
            self.clear()
            self.size = 0
        self.update(zip(new, found))
        self.size += 100 * len(new) + sum(map(len, new))


@lru_cache(maxsize=1)
def cache_of(path: str | None) -> Cache:
    """One for each worker, kept between its tasks."""
    return Cache()


def pre_tokens(text: str, special: tuple[str, ...]) -> Iterator[tuple[list[str] | None, str]]:
    """Each part with its pre-tokens; None where the library has to encode it."""
    for part in pieces(text):
        plain = _SURE.fullmatch(part) and not any(s in part for s in special)
        yield (_PRE_TOKEN.findall(part) if plain else None), part


def frequent(documents: DataFrame, *, text: str, vocabulary: str | None, table_size: int, sample_rows: int, seed: int = 7) -> dict[str, int]:
    """Lengths of at most ``table_size`` frequent pre-tokens of about ``sample_rows`` rows.

    The sample's rows are dealt to eight tasks; each sends its most frequent
    pre-tokens, so the driver merges eight short lists.
    """
    rows = documents.count()
    if not rows:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, special = tokenizer_of(vocabulary)
        counts: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                for found, _ in pre_tokens(value.as_py() or "", special):
                    counts.update(t for t in found or () if len(t) <= LONGEST)
                if len(counts) > 8 * table_size:
                    counts = Counter(dict(counts.most_common(4 * table_size)))
        best = counts.most_common(table_size)
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], names=["token", "n"])

    sample = documents.select(F.col(text).cast("string").alias("text")).sample(fraction=min(1.0, sample_rows / rows), seed=seed)
    merged: Counter = Counter()
    for token, n in zip(*(c.to_pylist() for c in sample.repartition(8).transform(mapped, run, "token string, n long").toArrow().columns)):
        merged[token] += n
    best = sorted(merged, key=lambda t: (-merged[t], t))[:table_size]
    return dict(zip(best, lengths(tokenizer_of(vocabulary)[0], best)))


def count_tokens(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    limit: int = 512,
    vocabulary: str | None = None,
    table_size: int = 1 << 15,
    sample_rows: int = 4_000,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    ``table_size`` entries of at most 64 characters bound what is broadcast (2 MB
    of ASCII, 8 MB at worst).
    """
    table = documents.sparkSession.sparkContext.broadcast(frequent(documents, text=text, vocabulary=vocabulary, table_size=table_size, sample_rows=sample_rows))
    id_type = documents.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (tokenizer, special), known, cache = tokenizer_of(vocabulary), table.value, cache_of(vocabulary)
        for batch in batches:
            n = [0] * batch.num_rows
            waiting: list[tuple[int, list[str]]] = []  # what the table lacks
            held = 0

            def settle_waiting() -> None:
                new = [t for t in {t for _, missing in waiting for t in missing} if t not in cache]
                own: dict[str, int] = {}
                for at in range(0, len(new), BATCH):
                    part = new[at : at + BATCH]
                    own.update(zip(part, lengths(tokenizer, part)))
                for i, missing in waiting:
                    n[i] += sum(own[t] if t in own else cache[t] for t in missing)
                short = [t for t in own if len(t) <= LONGEST]
                cache.learn(short, [own[t] for t in short])
                waiting.clear()

            for i, value in enumerate(batch.column(1)):
                for found, part in pre_tokens(value.as_py() or "", special):
                    if found is None:
                        n[i] += lengths(tokenizer, [part])[0]
                        continue
                    got = list(map(known.get, found))
                    if None in got:
                        missing = [t for t, k in zip(found, got) if k is None]
                        n[i] += sum(k for k in got if k is not None)
                        waiting.append((i, missing))
                        held += len(missing)
                        if held > 8 * BATCH:
                            settle_waiting()
                            held = 0
                    else:
                        n[i] += sum(got)
            settle_waiting()
            counts = pa.array(n, pa.int64())
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, counts, pc.greater(counts, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).transform(mapped, run, schema)
