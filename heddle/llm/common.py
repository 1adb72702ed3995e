"""What the operators of this subpackage share.

Tables between stages go to the folder that the cluster names in
``spark.checkpoint.dir``; every executor can read them again after another one
is lost.  Only where that setting is absent (tests) a local folder is used.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH = 4 << 20  # bytes of rows that go to a worker at once

_shipped: set[str] = set()
_kept: dict[str, Callable[[], None]] = {}  # in a worker: how to free what operators keep
_paths: dict[int, tuple[DataFrame, str]] = {}  # of tables settled of late


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(os.path.realpath(tempfile.mkdtemp()), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def bound_batches(spark: SparkSession) -> None:
    """Let rows go to the workers by BATCH bytes, unless the user has set a bound.

    A batch is held several times over, in the worker and in the executor beside it; Spark's own bounds are 64 MB and 10,000 rows.
    For operators that take texts one by one; the session keeps it.
    """
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, str(BATCH))


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow``, after this package is sent to the workers; for ``df.transform``.

    Workers are used again: at the end of a task, what it no longer needs goes back to the machine.
    """
    ship(df.sparkSession)

    owner = run.__qualname__

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def keep_between_tasks(owner: str, forget: Callable[[], None]) -> None:
    """What ``forget`` frees stays for further tasks of its owner, until another operator's task comes to the worker."""
    _kept[owner] = forget


def make_room(owner: str) -> None:
    if others := [k for k in _kept if k != owner]:
        for other in others:
            _kept.pop(other)()
        give_back()


def give_back() -> None:
    """Free memory that the worker holds without use."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own where it is unset and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else None
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="heddle-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The files go when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/heddle-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (out, path)
    while len(_paths) > 100:
        _paths.pop(next(iter(_paths)))
    return out


def discard(settled: DataFrame) -> None:
    """Delete the files of a table just settled, once what was made of them is settled too."""
    _, path = _paths.pop(id(settled))
    hadoop = settled.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(settled.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def broadcastable(df: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """``df`` with a broadcast hint where its values take at most ``limit`` bytes; counted, so ``df`` should be settled."""
    flat = all(isinstance(f.dataType, (T.StringType, T.BinaryType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType)) for f in df.schema)
    if not flat:
        return df
    size = F.lit(16 * len(df.columns))
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= limit else df


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def lanes(spark: SparkSession) -> int:
    """Shuffle partitions of the session, for explicit repartitioning."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
