"""A streaming source that follows files while they grow.

Offsets are (file, byte).  A file's new bytes count up to its last line end; a torn
last line waits until it is whole.  Spark's own file stream reads each file once, so
it can't follow one.

    spark.dataSource.register(TailSource)
    spark.readStream.format("heddle_tail").option("glob", "*.jsonl").load("file:///feeds")

gives (file, at, line): the path below the folder, the byte where the line begins, and
the line without its end.  ``split_bytes`` bounds what one task reads.  A file that
is shorter than what was read of it was written anew and is read from its start; one
that is gone is forgotten.  Files are opened through pyarrow, so the folder may be
local, mounted, or in a store that pyarrow knows.
"""

from __future__ import annotations

import fnmatch
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package

BLOCK = 1 << 20
SCHEMA = "file string, at bigint, line string"


@dataclass
class Stretch(InputPartition):
    """The lines of a file that begin in [begin, end); ``first``: a line begins at ``begin``; nothing is read from ``upto`` on."""

    file: str
    begin: int
    end: int
    upto: int
    first: bool


def last_line_end(store: pa.fs.FileSystem, path: str, size: int, after: int) -> int:
    """The byte behind the last line end before ``size``; ``after`` if there is none behind that."""
    with store.open_input_file(path) as f:
        at = size
        while at > after:
            begin = max(after, at - BLOCK)
            found = f.read_at(at - begin, begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return after


class Files:
    """What the batch and the streaming reader share."""

    def __init__(self, options: dict):
        self.store, self.root = pa.fs.FileSystem.from_uri(options["path"])
        self.glob, self.split = options.get("glob", "*"), int(options.get("split_bytes", 64 << 20))
        self.known: dict[str, int] = {}

    def whole(self) -> dict[str, int]:
        """Of each file the bytes of its whole lines."""
        out = {}
        for info in self.store.get_file_info(pa.fs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            name = info.path.removeprefix(self.root).lstrip("/")
            if not info.is_file or not fnmatch.fnmatch(info.base_name, self.glob):
                continue
            before = self.known.get(name, 0)
            out[name] = last_line_end(self.store, info.path, info.size, before if before <= info.size else 0)
        self.known = out
        return dict(out)

    def stretches(self, start: dict[str, int], end: dict[str, int]) -> list[Stretch]:
        out = []
        for name, upto in sorted(end.items()):
            begin = start.get(name, 0)
            begin = 0 if begin > upto else begin
            out += [Stretch(name, at, min(at + self.split, upto), upto, at == begin) for at in range(begin, upto, self.split)]
        return out

    def lines(self, s: Stretch) -> Iterator[pa.RecordBatch]:
        with self.store.open_input_file(f"{self.root}/{s.file}") as f:
            at = s.begin
            held = b""
            if not s.first:  # the line that runs into this stretch is the one before's
                at -= 1
                while True:
                    block = f.read_at(min(BLOCK, s.upto - at), at)
                    found = block.find(b"\n")
                    if found >= 0:
                        at += found + 1
                        break
                    at += len(block)
                    if not block:
                        return
            read = at
            while at < s.end:
                block = f.read_at(min(BLOCK, s.upto - read), read)
                read += len(block)
                *lines, held = (held + block).split(b"\n")
                begins, texts = [], []
                for line in lines:
                    if at >= s.end:
                        break
                    begins.append(at)
                    texts.append(line.decode("utf-8", "replace"))
                    at += len(line) + 1
                if begins:
                    yield pa.RecordBatch.from_arrays([pa.array([s.file] * len(begins)), pa.array(begins, pa.int64()), pa.array(texts, pa.string())], names=["file", "at", "line"])
                if not block:
                    return


class TailReader(DataSourceReader):
    """Every whole line there is now."""

    def __init__(self, options: dict):
        self.files = Files(options)

    def partitions(self):
        return self.files.stretches({}, self.files.whole())

    def read(self, partition):
        return self.files.lines(partition)


class TailStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.files = Files(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.files.whole()

    def partitions(self, start: dict, end: dict):
        return self.files.stretches(start, end)

    def read(self, partition):
        return self.files.lines(partition)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "heddle_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return TailReader(self.options)

    def streamReader(self, schema):
        return TailStream(self.options)
