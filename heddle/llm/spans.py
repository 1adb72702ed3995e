"""Spans in texts: a scanner over Arrow batches and the digests of its result."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped

#: kind, start, end (code points, end exclusive), score
Span = tuple[str, int, int, float]


def joined(spans: list[Span], order: dict[str, int]) -> str:
    """``kind:start:end`` by start, then kind in the listed order, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))


def scan_spans(
    documents: DataFrame,
    scanner: Callable[[], Callable[[str], list[Span]]],
    *,
    base: tuple[str, ...],
    added: tuple[str, ...],
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_<kind> of base kinds, base_sha256, spans, scores.

    ``scanner()`` is called once in each task and gives the function from a whole
    text to its spans.  Null texts count as empty.
    """
    order = {k: i for i, k in enumerate((*base, *added))}
    id_type = documents.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, empty = scanner(), hashlib.sha256(b"").hexdigest()
        for batch in batches:
            counts: list[list[int]] = [[] for _ in base]
            digests, all_spans, scores = [], [], []
            for value in batch.column(1):
                found = find(value.as_py() or "")
                if not found:
                    for c in counts:
                        c.append(0)
                    digests.append(empty)
                    all_spans.append("")
                    scores.append("")
                    continue
                own = [s for s in found if s[0] in base]
                for c, k in zip(counts, base):
                    c.append(sum(s[0] == k for s in own))
                digests.append(hashlib.sha256(joined(own, order).encode()).hexdigest())
                all_spans.append(joined(found, order))
                scores.append(",".join(f"{s[3]:.2f}" for s in sorted(found, key=lambda x: (x[1], order[x[0]], x[2]))))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(all_spans, pa.string()), pa.array(scores, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans", "scores"]
    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(f"n_{k}", T.LongType()) for k in base), *(T.StructField(n, T.StringType()) for n in names[-3:])])
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).transform(mapped, run, schema)
