"""Packing documents into fixed-size sequences by the sum-of-squares rule.

Texts become token ids with a closing id; only documents longer than a sequence
are cut, into full pieces and a rest.  Pieces are dealt evenly into shards of
bounded size, and each shard is packed in one task: every piece goes where the
squared counts of open sequences per residual gap become smallest.

Pieces of a shard are placed from the longest to the shortest, so the small ones
fill what is left.  Null texts count as empty (one piece holding the closing
id); repeated rows are packed each; an empty table gives no rows; further columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Collection, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, keep_between_tasks, mapped, settle
from .words import _powers, mix, text_blocks, word_spans

_UNSURE = re.compile(r"[\x1c-\x1f]")  # separators for str.split, symbols for the tokenizer
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-^`{-~]*)")  # no apostrophe or underscore
CACHED_WORDS, CACHED_PARTS, CACHED_LENGTH = 20_000, 20_000, 64  # of each of two ages; some 20 MB in a worker at most, until another operator's task comes
PLACE_BITS, WIDTH = 20, 8  # the tables of words and of parts: 2 ** 20 of at most 8 ids, some 25 MB each
BLOCK = 1 << 18  # bytes of text that are looked up at once
_U = np.uint64


class Recent:
    """What was learnt of late: when ``young`` holds ``most``, it becomes the older half, from which what is wanted again comes back."""

    def __init__(self, most: int):
        self.most, self.young, self.older = most, {}, {}

    def lacking(self, wanted: set[str]) -> set[str]:
        """What of ``wanted`` must be learnt; all else that is wanted stays in ``young`` until the next call."""
        if len(self.young) > self.most:
            self.young, self.older = {}, self.young
        new = wanted.difference(self.young)
        again = [w for w in new if w in self.older]  # a set's own methods would walk all that is older
        self.young.update((w, self.older[w]) for w in again)
        return new.difference(again)

    def forget(self) -> None:
        self.young, self.older = {}, {}


class Table:
    """Ids of short words, each at the place that its hash names; the last one learnt of a place stays."""

    def __init__(self, kind: type):
        self.kind, self.hashes = kind, np.empty(0, np.uint64)

    def forget(self) -> None:
        self.__init__(self.kind)

    def spell(self, data: np.ndarray, offsets: np.ndarray, of: Callable[[Collection[str]], dict[str, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts, and where each text's begin (with a closing total); ``of`` tells what is not held."""
        if not len(self.hashes):
            self.hashes, self.sizes, self.ids = np.zeros(1 << PLACE_BITS, np.uint64), np.zeros(1 << PLACE_BITS, np.uint8), np.zeros(WIDTH << PLACE_BITS, self.kind)
            self.hashes[0] = ~_U(0)  # no hash of an empty place leads to it
        value, starts, ends, first = word_spans(data, offsets, False)
        powers, inverse = _powers(max(2 * BLOCK, 1 << max(1, len(data)).bit_length()) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value * powers[: len(data)], out=total[1:])
        length = ends - starts
        hashes = mix((total.take(ends) - total.take(starts)) * inverse.take(starts) + length.astype(np.uint64))
        place = (hashes >> _U(64 - PLACE_BITS)).view(np.int64)
        missed = (self.hashes.take(place) != hashes) | (length > CACHED_LENGTH)
        size, which = self.sizes.take(place).astype(np.int64), np.flatnonzero(missed)
        raw = data.tobytes()
        words = [raw[a:b].decode() for a, b in zip(starts[which].tolist(), ends[which].tolist())]
        told = of(set(words))
        new = [told[w] for w in words]
        size[which] = np.fromiter(map(len, new), np.int64, len(new)) // 4
        stop = np.cumsum(size)
        begin = stop - size
        out = self.ids.take(np.arange(size.sum()) + np.repeat(place * WIDTH - begin, size), mode="clip").astype("<u4")
        out[np.repeat(missed, size)] = np.frombuffer(b"".join(new), "<u4")
        # Only now may what was held give way.
        keep = which[(size[which] <= WIDTH) & (length[which] <= CACHED_LENGTH)]
        at, some = np.unique(place[keep], return_index=True)
        keep = keep[some]
        self.hashes[at], self.sizes[at] = hashes[keep], size[keep]
        within = np.arange(size[keep].sum()) - np.repeat(np.cumsum(size[keep]) - size[keep], size[keep])
        self.ids[np.repeat(at * WIDTH, size[keep]) + within] = out[np.repeat(begin[keep], size[keep]) + within]
        return out, np.append(0, stop)[first]


def stretches(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts of some BLOCK bytes, cut at white space."""
    space = np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))
    cuts = space[np.searchsorted(space, np.arange(BLOCK, len(data), BLOCK)).clip(max=max(0, len(space) - 1))] if len(space) else space
    edges = np.unique(np.concatenate([[0], cuts, [len(data)]])).tolist()
    for a, b in zip(edges[:-1], edges[1:]):
        yield data[a:b]


@lru_cache(maxsize=2)
def id_bytes(path: str | None) -> Callable[[str], bytes]:
    """From a text to its ids as little-endian 32-bit words.

    The vocabulary drops white space and never joins across it, so a text's ids
    are its words' ids in a row; words are remembered, up to a bound.  ``each`` goes over
    an Arrow array of texts by blocks: there a word is told by the 64-bit hash of its bytes
    and ends at ASCII white space alone (of other kinds the tokenizer takes care).
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    known, parts = Recent(CACHED_WORDS), Recent(CACHED_PARTS)

    def encode(words: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    seam = tokenizer.encode("\x01", add_special_tokens=False).ids

    def of_parts(new: Collection[str]) -> dict[str, bytes]:
        # Many at a time, with a character between them that no part holds.
        out, wanted = [], list(new)
        for i in range(0, len(wanted), 5000):
            (ids,) = encode([" \x01 ".join(wanted[i : i + 5000])])
            cut = 4 * np.flatnonzero(np.frombuffer(ids, "<u4") == seam[0])
            out += [ids[a:b] for a, b in zip([0, *(cut + 4).tolist()], [*cut.tolist(), len(ids)])]
        return dict(zip(wanted, out))

    kind = np.uint16 if tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
    table, table_of_parts = Table(kind), Table(kind)

    def encode_parts(new: list[str]) -> dict[str, bytes]:
        raw = [p.encode() for p in new]
        ids, bounds = table_of_parts.spell(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), of_parts)
        whole, edges = ids.tobytes(), (4 * bounds).tolist()
        return {p: whole[a:b] for p, a, b in zip(new, edges[:-1], edges[1:])}

    def learn(words: Collection[str], parts_of: Callable[[list[str]], dict[str, bytes]]) -> dict[str, bytes]:
        # Letters with marks after them, the usual case, are two runs to the vocabulary.
        split, other = {}, []
        for w in words:
            if m := _PLAIN.fullmatch(w):
                split[w] = (m[1].lower(), m[2])
            else:
                other.append(w)
        held = parts_of(list({p for pair in split.values() for p in pair if p}))
        held[""] = b""
        out = {w: held[a] + held[b] for w, (a, b) in split.items()}
        out.update(zip(other, encode(other)))
        return out

    def remembered(cache: Recent, wanted: Collection[str], tell: Callable[[list[str]], dict[str, bytes]]) -> dict[str, bytes]:
        new = list(cache.lacking(set(wanted)))
        if new:
            cache.young.update(tell(new))
        out = {w: cache.young[w] for w in wanted}
        for w in new:
            if len(w) > CACHED_LENGTH:
                del cache.young[w]
        return out

    def ids(text: str) -> bytes:
        if _UNSURE.search(text):
            return encode([text])[0]
        words = text.split()
        own = remembered(known, set(words), lambda new: learn(new, lambda wanted: remembered(parts, wanted, of_parts)))
        return b"".join(map(own.__getitem__, words))

    def of(words: Collection[str]) -> dict[str, bytes]:
        return learn(words, encode_parts)

    def each(texts: pa.Array) -> Iterator[bytes]:
        for _, data, offsets in text_blocks(texts, BLOCK):
            if len(data) > 2 * BLOCK:  # one text
                yield b"".join(table.spell(part, np.array([0, len(part)]), of)[0].tobytes() for part in stretches(data))
                continue
            found, bounds = table.spell(data, offsets, of)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                yield found[a:b].tobytes()

    def forget() -> None:
        known.forget()
        parts.forget()
        table.forget()
        table_of_parts.forget()

    ids.each, ids.forget = each, forget
    return ids


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the given order.

    A new bin opens only where no open one has room: what stays open at the end
    is waste here, as there are no later pieces to fill it.
    """
    never = np.iinfo(np.int64).max
    counts = np.zeros(capacity + 1, np.int64)  # open bins by gap; full ones don't count
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n_bins = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        # Moving a bin from gap g to g - n changes the sum by 2 (counts[g - n] - counts[g] + 1).
        before, after = counts[n:], counts[: capacity + 1 - n]
        change = np.where(before > 0, 2 * (after - before + 1), never)
        if before[0]:
            change[0] = 1 - 2 * before[0]  # fills the bin, which is then not open
        gap = int(change.argmin()) + n
        if change[gap - n] < never:
            b = stacks[gap].pop()
            counts[gap] -= 1
        else:
            gap, b, n_bins = capacity, n_bins, n_bins + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > n:
            stacks[gap - n].append(b)
            counts[gap - n] += 1
    return bins, offsets


def cut_documents(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    vocabulary: str | None = None,
) -> DataFrame:
    """Pieces (doc_id, row, piece, start, length, ids_crc32); row tells repeated ids apart."""
    bound_batches(documents.sparkSession)
    id_type = documents.schema[doc_id].dataType
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = id_bytes(vocabulary)
        keep_between_tasks("cut_documents.<locals>.run", ids.forget)
        for batch in batches:
            source, piece, start, length, crc = [], [], [], [], []
            for i, own in enumerate(ids.each(batch.column(1))):
                data = own + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    source.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = [batch.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32"))])
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).transform(mapped, run, schema)


def pack(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None, shard_pieces: int = 100_000) -> DataFrame:
    """Every piece with its sequence_id and offset.

    Shards hold about ``shard_pieces`` pieces whatever the input's size and however often
    rows repeat, so a task's memory is bounded; each wastes at most a few sequences.
    """
    cut = settle(cut_documents(documents, doc_id=doc_id, text=text, capacity=capacity, end_id=end_id, vocabulary=vocabulary), "pieces")
    shards = max(1, -(-cut.count() // shard_pieces))
    key = F.xxhash64(F.monotonically_increasing_id())  # the pieces are written: rows have fixed places

    def place(shard: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((shard["ids_crc32"], shard["piece"], -shard["length"]))
        shard = shard.iloc[order]
        bins, offsets = sum_of_squares(shard["length"].to_numpy(), capacity)
        return shard.assign(sequence_id=(shard["_shard"].to_numpy() << 40) + bins, offset=offsets).drop(columns="_shard")

    schema = T.StructType([*cut.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    dealt = cut.withColumn("_shard", F.pmod(key, F.lit(shards)))
    return dealt.groupBy("_shard").applyInPandas(place, schema)
