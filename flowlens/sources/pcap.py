"""Packet capture files to packet rows.

Only the record framing of a capture is parsed in Python, in Arrow batches;
decoding is column arithmetic (see ``operators.packets``). Files are read in byte
ranges, so one large capture is the work of many tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.packets import decode_frames

# File magic -> (byte order, fractions per second).
MAGICS = {
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000.0),
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000.0),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000.0),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000.0),
}
FILE_HEADER = 24
RECORD_HEADER = 16
LINK_ETHERNET = 1


def capture_format(head: bytes) -> tuple[str, float]:
    """Byte order and fractions per second of a file header; ValueError if it is none that can be read."""
    if len(head) < FILE_HEADER:
        raise ValueError("pcap file is missing a global header")
    order_and_scale = MAGICS.get(bytes(head[:4]))
    if order_and_scale is None:
        raise ValueError("unsupported pcap magic number")
    (link,) = struct.unpack_from(order_and_scale[0] + "I", head, 20)
    if link != LINK_ETHERNET:
        raise ValueError(f"unsupported data link type: {link}")
    return order_and_scale


def split_records(content: bytes):
    """Yield (ordinal, epoch seconds, frame); malformed captures raise ValueError."""
    order, scale = capture_format(content[:FILE_HEADER])
    position, ordinal = FILE_HEADER, 0
    while position < len(content):
        if position + RECORD_HEADER > len(content):
            raise ValueError("truncated pcap record header")
        seconds, fraction, kept, _ = struct.unpack_from(order + "IIII", content, position)
        start = position + RECORD_HEADER
        position = start + kept
        if position > len(content):
            raise ValueError("truncated pcap record payload")
        yield ordinal, seconds + fraction / scale, bytes(content[start:position])
        ordinal += 1


FRAME_SCHEMA = "packet_ordinal long, ts double, frame binary"
BATCH_FRAMES = 4096
RANGE_BYTES = 16 << 20
LARGEST_RECORD = 1 << 18  # no record of a sound capture is longer
CHAIN = 16  # record headers in a row that make a plausible start
NEAR_SECONDS = 366 * 86400


def _frame_batches(records) -> Iterator[pa.RecordBatch]:
    """Columns (ordinal, time, frame) of records, in batches of bounded size."""
    held, size = [], 0
    for record in records:
        held.append(record)
        size += len(record[2])
        if len(held) >= BATCH_FRAMES or size >= RANGE_BYTES:
            yield _frames(held)
            held, size = [], 0
    if held:
        yield _frames(held)


def _frames(records: list) -> pa.RecordBatch:
    ordinal, ts, frame = zip(*records)
    return pa.RecordBatch.from_arrays(
        [pa.array(ordinal, pa.int64()), pa.array(ts, pa.float64()), pa.array(frame, pa.binary())],
        names=["packet_ordinal", "ts", "frame"],
    )


def _beside(batch: pa.RecordBatch, row: int, kept: list[int], frames: pa.RecordBatch) -> pa.RecordBatch:
    """Frames with the other columns of the row they come from."""
    at = pa.array([row] * frames.num_rows, pa.int32())
    return pa.RecordBatch.from_arrays(
        [*(batch.column(i).take(at) for i in kept), *frames.columns],
        names=[*(batch.schema.names[i] for i in kept), *frames.schema.names],
    )


def split_captures(files: DataFrame) -> DataFrame:
    """(window_path, content) rows to one row per frame; for captures that fit a cell."""
    others = [f for f in files.schema.fields if f.name != "content"]
    schema = T.StructType(others + T._parse_datatype_string(FRAME_SCHEMA).fields)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = batch.column(batch.num_columns - 1)
            for row in range(batch.num_rows):
                for frames in _frame_batches(split_records(content[row].as_py() or b"")):
                    yield _beside(batch, row, list(range(batch.num_columns - 1)), frames)

    return files.select(*[F.col(f"`{f.name}`") for f in others], "content").mapInArrow(split, schema)


class Capture:
    """A capture file that is read at any place, with its header's byte order and time scale."""

    def __init__(self, path: str):
        store, place = (
            pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        )
        self.handle = store.open_input_file(place)
        self.size = self.handle.size()
        head = self.handle.read_at(min(self.size, FILE_HEADER + RECORD_HEADER), 0)
        self.order, self.scale = capture_format(head)
        self.near = struct.unpack_from(self.order + "I", head, FILE_HEADER)[0] if len(head) == FILE_HEADER + RECORD_HEADER else 0
        self.begin, self.block = 0, b""

    def at(self, position: int, length: int) -> bytes:
        """Bytes of the file, from a block that is read ahead."""
        low = position - self.begin
        if low < 0 or low + length > len(self.block):
            self.begin = position
            self.block = self.handle.read_at(max(0, min(max(length, 1 << 20), self.size - position)), position)
            low = 0
        return self.block[low:low + length]

    def plausible(self, position: int) -> bool:
        """Whether a chain of sound records starts here, up to the end of the file."""
        for _ in range(CHAIN):
            if position == self.size:
                return True
            head = self.at(position, RECORD_HEADER)
            if len(head) < RECORD_HEADER:
                return False
            seconds, fraction, kept, whole = struct.unpack(self.order + "IIII", head)
            if kept > LARGEST_RECORD or kept > whole or fraction >= self.scale or abs(seconds - self.near) > NEAR_SECONDS:
                return False
            position += RECORD_HEADER + kept
            if position > self.size:
                return False
        return True

    def resynchronised(self, low: int, high: int) -> int | None:
        """The first plausible record start in a range."""
        return next((p for p in range(low, min(high, self.size)) if self.plausible(p)), None)

    def records(self, start: int, high: int, ordinal: int = 0, frames: bool = True):
        """(ordinal, time, frame) of the records that start in start .. high; returns where the last one ends."""
        while start < high and start < self.size:
            head = self.at(start, RECORD_HEADER)
            if len(head) < RECORD_HEADER:
                raise ValueError("truncated pcap record header")
            seconds, fraction, kept, _ = struct.unpack(self.order + "IIII", head)
            end = start + RECORD_HEADER + kept
            if end > self.size:
                raise ValueError("truncated pcap record payload")
            yield ordinal, seconds + fraction / self.scale, self.at(start + RECORD_HEADER, kept) if frames else b""
            start, ordinal = end, ordinal + 1
        return start

    def span(self, start: int, high: int) -> tuple[int, int]:
        """Where the last record that starts before ``high`` ends, and how many there are."""
        records, count = self.records(start, high, frames=False), 0
        while True:
            try:
                next(records)
                count += 1
            except StopIteration as done:
                return done.value, count


def capture_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(window_path, start, high, first_ordinal): ranges of (window_path, length) files that begin at true record starts.

    Every range guesses its first record by a chain of plausible headers and tells
    where its last record ends. A guess holds if the range before ends just there;
    the first range starts after the file header, so all are checked in turn. A
    wrong guess (a payload may look like a capture) is read again from the right
    place.
    """
    pieces = files.select(
        "window_path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes))).alias("low")
    )

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                capture = Capture(path)
                high = low + range_bytes
                start = capture.resynchronised(low, high) if low else FILE_HEADER
                found = (None, None)
                if start is not None:
                    try:
                        found = capture.span(start, high)
                    except ValueError:
                        if not low:
                            raise
                rows.append((path, low, start if found[0] is not None else None, *found))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("window_path", "low", "start", "end", "n"), r)) for r in rows], schema=pa.schema([
                    ("window_path", pa.string()), *((c, pa.int64()) for c in ("low", "start", "end", "n"))]),
            )

    def chained(ranges: pd.DataFrame) -> pd.DataFrame:
        path, out, at, ordinal = ranges["window_path"].iloc[0], [], FILE_HEADER, 0
        capture = None
        for row in ranges.sort_values("low").itertuples():
            high = row.low + range_bytes
            if at >= high:
                continue  # inside a record of an earlier range
            end, n = row.end, row.n
            if row.start != at:
                capture = capture or Capture(path)
                end, n = capture.span(at, high)
            if n:
                out.append((path, at, high, ordinal))
            at, ordinal = int(end), ordinal + int(n)
        return pd.DataFrame(out, columns=["window_path", "start", "high", "first_ordinal"])

    guessed = pieces.repartition("window_path", "low").mapInArrow(guess, "window_path string, low long, start long, end long, n long")
    # One row per range of a file.
    return guessed.groupBy("window_path").applyInPandas(chained, "window_path string, start long, high long, first_ordinal long")


def read_frames(spark: SparkSession, path: str, pattern: str = "*.pcap", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Frames of every capture file below ``path``, in parallel over byte ranges; files have no size limit."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(path)
        .select(F.col("path").alias("window_path"), "length")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (path, start, high, first) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                for frames in _frame_batches(Capture(path).records(start, high, first)):
                    yield _beside(batch, row, [0], frames)

    ranges = capture_ranges(files, range_bytes).repartition("window_path", "start")
    return ranges.mapInArrow(read, f"window_path string, {FRAME_SCHEMA}")


def read_packets(spark: SparkSession, path: str, pattern: str = "*.pcap", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """TCP and UDP packets of every capture file below ``path``."""
    return decode_frames(read_frames(spark, path, pattern, range_bytes))
