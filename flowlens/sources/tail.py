"""A stream over growing line files: a tail that survives restarts, cuts and replacement.

The offset of a file is its identity (device and inode), the byte after its last
complete line, and a checksum of its first bytes. It is kept in the query's
checkpoint, so a restarted query goes on where it stopped. Between two offsets a
file

* that is the same and has grown gives the bytes between them;
* that has another identity, has become shorter, or begins with other bytes than
  before was replaced or cut and is read from its start;
* that is gone gives nothing, and is read from its start if it comes back.

A last line without a line end is left for later. The bytes of a file are dealt
out in ranges of ``maxPartitionBytes``; a range gives the lines that start in it,
as Arrow batches. Only sizes and the ends of files are looked at on the driver.

Files must be in a folder that driver and executors see under one path, and that
appends go to: an ordinary or a mounted file system. If a file is replaced while
a failed batch waits to run again, the bytes that batch had named are gone, and
it gives none for that file.
"""

from __future__ import annotations

import glob
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "flowlens_tail"
SCHEMA = "source string, start long, value string"
HEAD = 256  # first bytes that identify a file's content
BLOCK = 1 << 16
PARTITION_BYTES = 16 << 20
BATCH_LINES = 8192


def _complete(handle, size: int) -> int:
    """The byte after the last line end before ``size``."""
    high = size
    while high > 0:
        low = max(0, high - BLOCK)
        handle.seek(low)
        at = handle.read(high - low).rfind(b"\n")
        if at >= 0:
            return low + at + 1
        high = low
    return 0


def _head(handle, length: int) -> int:
    handle.seek(0)
    return zlib.crc32(handle.read(length))


def _identity(handle) -> str:
    stat = os.fstat(handle.fileno())
    return f"{stat.st_dev}:{stat.st_ino}"


def _state(path: str) -> dict | None:
    """Identity, end of the complete lines and checksum of the head; None if there is no such file."""
    try:
        with open(path, "rb") as handle:
            end = _complete(handle, os.fstat(handle.fileno()).st_size)
            return {"id": _identity(handle), "end": end, "head": _head(handle, min(HEAD, end))}
    except FileNotFoundError:
        return None


def _continues(path: str, before: dict | None, now: dict) -> bool:
    """Whether the bytes up to the earlier offset are still the ones that were read."""
    if before is None or before["id"] != now["id"] or before["end"] > now["end"]:
        return False
    try:
        with open(path, "rb") as handle:
            return _head(handle, min(HEAD, before["end"])) == before["head"]
    except FileNotFoundError:
        return False


@dataclass
class Range(InputPartition):
    """Bytes low .. high of a file; ``first`` is where the first of its ranges begins."""

    path: str
    identity: str
    first: int
    low: int
    high: int
    end: int


class TailReader(DataSourceStreamReader):
    def __init__(self, pattern: str, partition_bytes: int):
        self.pattern, self.partition_bytes = pattern, partition_bytes

    def _paths(self) -> list[str]:
        found = sorted(glob.glob(self.pattern))
        paths = []
        for path in found:
            if os.path.isdir(path):
                paths += [os.path.join(path, name) for name in sorted(os.listdir(path)) if not name.startswith((".", "_"))]
            else:
                paths.append(path)
        return [p for p in paths if os.path.isfile(p)]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: state for path in self._paths() if (state := _state(path))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, now in sorted(end.items()):
            before = start.get(path)
            if before == now:
                continue
            first = before["end"] if _continues(path, before, now) else 0
            for low in range(first, now["end"], self.partition_bytes):
                out.append(Range(path, now["id"], first, low, min(low + self.partition_bytes, now["end"]), now["end"]))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _lines(partition)


def _lines(part: Range) -> Iterator[pa.RecordBatch]:
    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([part.path] * len(starts)), pa.array(starts, pa.int64()), pa.array(values, pa.string())],
            names=["source", "start", "value"],
        )

    starts: list[int] = []
    values: list[str] = []
    try:
        handle = open(part.path, "rb")
    except FileNotFoundError:
        return
    with handle:
        if _identity(handle) != part.identity:
            return
        at = part.low
        if at > part.first:
            # The line that began before belongs to the range before.
            handle.seek(at - 1)
            at += len(handle.readline()) - 1
        handle.seek(at)
        while at < part.high:
            line = handle.readline(part.end - at)
            if not line.endswith(b"\n"):
                break  # cut since the offset was taken
            starts.append(at)
            values.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
            at += len(line)
            if len(starts) >= BATCH_LINES:
                yield batch()
                starts, values = [], []
    if starts:
        yield batch()


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        if "path" not in self.options:
            raise ValueError("a tail needs a path")
        return TailReader(self.options["path"], int(self.options.get("maxPartitionBytes", PARTITION_BYTES)))


def tail_lines(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Lines of growing files as a stream of (source, start, value); ``path`` is a file, a folder or a pattern."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format(NAME).option("maxPartitionBytes", partition_bytes).load(path)
