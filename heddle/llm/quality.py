"""Quality scores from compression with dictionaries of good and of bad text.

Two zstandard dictionaries are built from blocks of labelled documents, one of
each class.  A text is compressed in blocks with either dictionary and with
none; the difference of the compressed sizes over the plain one, with the plain
compression rate, becomes a probability by a logistic fit on other labelled
documents.  Whole texts are compressed.

Training reads at most ``per_class`` labelled documents and ``blocks`` blocks of
``block_bytes`` bytes of each class.  With no labels, or of one class only, the
score is the smoothed share of good labels.  Null texts count as empty; an empty
text is one empty block.  Repeated rows are scored one by one, an empty table gives
no rows, and other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, mapped
from .labelled import fit_logistic, held_out, labelled_sample, predict_logistic

LEVEL = 3


def blocks_of(text: str, size: int) -> list[bytes]:
    data = text.encode()
    return [data[i : i + size] for i in range(0, max(1, len(data)), size)]


def make_dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their plain content serves
        return b"".join(samples)[-size:] or b"\0" * 8


class Compressors:
    """Compressed sizes of a text with the good, the bad and no dictionary."""

    def __init__(self, good: bytes, bad: bytes, block_bytes: int):
        self.size = block_bytes
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.each = []
        for data in (good, bad):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            self.each.append(zstandard.ZstdCompressor(dict_data=d, **plain))
        self.each.append(zstandard.ZstdCompressor(**plain))

    def features(self, text: str) -> tuple[float, float]:
        good = bad = none = n = 0
        for block in blocks_of(text, self.size):
            g, b, c = (len(z.compress(block)) for z in self.each)
            good, bad, none, n = good + g, bad + b, none + c, n + len(block) + 1
        return (bad - good) / none, float(np.log(none / n))


def _features(sample: DataFrame, good: bytes, bad: bytes, block_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = Compressors(good, bad, block_bytes)
        for batch in batches:
            f = [z.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64())], names=["label", "a", "b"])

    return sample.select("text", "label").transform(mapped, run, "label int, a double, b double")


def _sample_blocks(sample: DataFrame, label: int, blocks: int, block_bytes: int) -> list[bytes]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [b for t in batch.column(0) for b in blocks_of(t.as_py(), block_bytes) if b]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary())], names=["block"])

    cut = sample.filter((F.col("label") == label) & (F.col("half") == 0)).select("text").transform(mapped, run, "block binary")
    return [bytes(r[0]) for r in cut.orderBy(F.xxhash64("block"), "block").limit(blocks).collect()]


def train_quality(
    documents: DataFrame,
    labels: DataFrame,
    *,
    label: str = "quality",
    per_class: int = 6000,
    blocks: int = 2000,
    block_bytes: int = 2048,
    dictionary_bytes: int = 65536,
    doc_id: str = "doc_id",
    text: str = "text",
):
    """(good dictionary, bad dictionary, block size, logistic model), or a constant score."""
    sample = labelled_sample(documents, labels, label, per_class=per_class, doc_id=doc_id, text=text, name="quality")
    good, bad = (_sample_blocks(sample, c, blocks, block_bytes) for c in (1, 0))
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if not good or not bad:
        return (n.get(1, 0) + 1) / (n.get(0, 0) + n.get(1, 0) + 2)
    dictionaries = make_dictionary(good, dictionary_bytes), make_dictionary(bad, dictionary_bytes)
    rows = _features(sample.filter("half = 1"), *dictionaries, block_bytes).collect()  # at most 2 * per_class
    if len({r["label"] for r in rows}) < 2:
        rows = _features(sample, *dictionaries, block_bytes).collect()
    x, y = np.array([(r["a"], r["b"]) for r in rows]), np.array([r["label"] for r in rows], float)
    return (*dictionaries, block_bytes, fit_logistic(x, y))


def score_quality(documents: DataFrame, model, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = None if isinstance(model, float) else Compressors(*model[:3])
        for batch in batches:
            if z is None:
                p = np.full(batch.num_rows, model)
            else:
                f = np.array([z.features(t.as_py() or "") for t in batch.column(1)]).reshape(-1, 2)
                p = predict_logistic(model[3], f)
            columns = [batch.column(0), batch.column(2), pa.array(p, pa.float64()), pa.array((p >= threshold).astype("int32"))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    schema = T.StructType([T.StructField("doc_id", documents.schema[doc_id].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    own = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), held_out(doc_id).alias("held_out"))
    return own.transform(mapped, run, schema)


def keep_good(documents: DataFrame, model, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows, with all their columns, whose text scores at least the threshold."""
    bound_batches(documents.sparkSession)
    at = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = None if isinstance(model, float) else Compressors(*model[:3])
        for batch in batches:
            if z is None:
                good = np.full(batch.num_rows, model >= threshold)
            else:
                f = np.array([z.features(t.as_py() or "") for t in batch.column(at)]).reshape(-1, 2)
                good = predict_logistic(model[3], f) >= threshold
            yield batch.filter(pa.array(good))

    return documents.transform(mapped, run, documents.schema)
