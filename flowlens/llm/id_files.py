"""Token-id files in a word-aligned Simple-8b code (operator 9).

Ids are packed into 64-bit words: the top four bits of a word select how many
values it holds and how wide each is, the other 60 hold the values, first value
lowest.

| selector | 0 | 1 | 2 | 3 | 4 | 5 | 6 | 7 | 8 | 9 | 10 | 11 | 12 | 13 | 14 | 15 |
|---|---|---|---|---|---|---|---|---|---|---|---|---|---|---|---|---|
| values | 240 | 120 | 60 | 30 | 20 | 15 | 12 | 10 | 8 | 7 | 6 | 5 | 4 | 3 | 2 | 1 |
| bits | 0 | 0 | 1 | 2 | 3 | 4 | 5 | 6 | 7 | 8 | 10 | 12 | 15 | 20 | 30 | 60 |

Values of 2^60 and more are escapes: the word holds a zero, and the block lists
place and value. A file is a folder of Parquet parts, written and committed by
Spark, so any storage works and a lost executor leaves nothing half written.
One row is a block of whole documents with about ``BLOCK_IDS`` ids: shard,
number in the shard, ids before it in the shard, document ids, each document's
first word and first value in the block, the words, and the escapes. Every
document begins a new word, so one can be decoded alone, and a whole block is
decoded selector by selector, without a loop over words.

Shards are ranges of document ids in ascending order. Defined cases: null and
empty texts hold the end id only; null ids come first, repeated ids stay next
to each other; an empty table gives an empty file; extra columns are not stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.tokens import chunks, crc32, encoder

VALUES = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK_IDS = 65_536
_WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def _selectors(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place, the selector of the word that would begin there.

    The one with most values that all fit and do not pass the document's end.
    Runs are measured only where values fit, which are few for narrow widths.
    """
    size = len(values)
    room = ends - np.arange(size, dtype=ends.dtype)
    best = np.full(size, 15, np.uint8)
    for width in _WIDTHS[::-1]:
        fitting = np.flatnonzero(values < (1 << int(width)))
        selectors = np.flatnonzero(BITS == width)[::-1]
        if len(fitting) < VALUES[selectors].min():
            break  # nor can any narrower width
        if len(fitting) == size:
            for selector in selectors:
                best[room >= VALUES[selector]] = selector
            continue
        last = np.append(np.flatnonzero(np.diff(fitting) != 1), len(fitting) - 1)
        lengths = np.diff(last, prepend=-1)
        reach = np.minimum(np.repeat(fitting[last] + 1, lengths) - fitting, room[fitting])
        for selector in selectors:
            best[fitting[reach >= VALUES[selector]]] = selector
    return best


def pack(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of runs of values; first word of each run; places and values of escapes."""
    values = np.asarray(values, np.uint64)
    size = len(values)
    escaped = np.flatnonzero(values >> np.uint64(60))
    held = values
    if len(escaped):
        held = values.copy()
        held[escaped] = 0
    run_ends = np.cumsum(sizes)
    small = held.astype(np.int32) if size and int(held.max()) < 1 << 31 else held.astype(np.int64)
    best = _selectors(small, np.repeat(run_ends, sizes))
    step = VALUES[best].tolist()
    starts, at = [], 0
    while at < size:
        starts.append(at)
        at += step[at]
    begin = np.array(starts, np.int64)
    chosen = best[begin]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen):
        if BITS[selector]:
            rows = np.flatnonzero(chosen == selector)
            lanes = np.arange(VALUES[selector])
            shifts = (lanes * BITS[selector]).astype(np.uint64)
            words[rows] |= np.bitwise_or.reduce(held[begin[rows, None] + lanes] << shifts, axis=1)
    return words, np.searchsorted(begin, run_ends - sizes), escaped, values[escaped]


def unpack(words: np.ndarray, escape_at: np.ndarray, escape_values: np.ndarray) -> np.ndarray:
    """All values of the words, decoded one selector at a time."""
    words = np.asarray(words, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = VALUES[chosen]
    begin = np.cumsum(counts) - counts
    values = np.zeros(int(counts.sum()), np.uint64)
    for selector in np.unique(chosen):
        if BITS[selector]:
            rows = np.flatnonzero(chosen == selector)
            lanes = np.arange(VALUES[selector])
            shifts = (lanes * BITS[selector]).astype(np.uint64)
            mask = np.uint64((1 << int(BITS[selector])) - 1)
            values[begin[rows, None] + lanes] = (words[rows, None] >> shifts) & mask
    values[np.asarray(escape_at, np.int64)] = np.asarray(escape_values, np.uint64)
    return values


def _block_schema(doc_id: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()),
        T.StructField("ids_before", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(doc_id)), T.StructField("first_word", T.ArrayType(T.LongType())),
        T.StructField("first_value", T.ArrayType(T.LongType())), T.StructField("words", T.BinaryType()),
        T.StructField("escape_at", T.ArrayType(T.LongType())), T.StructField("escape_values", T.ArrayType(T.LongType())),
    ])


def write_ids(docs: DataFrame, path: str, vocabulary: str) -> None:
    """Tokenise ``docs`` (doc_id, text) and write id files in ascending doc_id order."""
    schema = _block_schema(docs.schema["doc_id"].dataType)
    arrow_id = pa.int64() if isinstance(docs.schema["doc_id"].dataType, T.LongType) else None

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, shard = encoder(vocabulary), TaskContext.get().partitionId()
        block, before = 0, 0
        held_ids: list[np.ndarray] = []
        held_sizes: list[np.ndarray] = []
        held_docs: list[pa.Array] = []
        held = 0

        def flush() -> pa.RecordBatch:
            sizes = np.concatenate(held_sizes)
            words, first_word, at, escaped = pack(np.concatenate(held_ids), sizes)
            docs_here = pa.concat_arrays(held_docs)
            of = lambda a: pa.array([np.asarray(a, np.int64)], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()),
                 pa.array([int(sizes.sum())], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(docs_here)], pa.int32()), docs_here),
                 of(first_word), of(np.cumsum(sizes) - sizes),
                 pa.array([words.astype("<u8").tobytes()], pa.binary()), of(at), of(escaped.view(np.int64))],
                names=schema.fieldNames(),
            )

        for batch in batches:
            for part, texts in chunks(batch, "text"):
                ids, sizes = worker.encode(texts)
                column = part.column(0) if arrow_id is None else part.column(0).cast(arrow_id)
                low = 0
                ends = np.cumsum(sizes)
                while low < len(texts):
                    # Documents up to the one that fills the block.
                    base = int(ends[low] - sizes[low])
                    high = int(np.searchsorted(ends, base + BLOCK_IDS - held)) + 1
                    high = min(max(high, low + 1), len(texts))
                    held_ids.append(ids[base:int(ends[high - 1])])
                    held_sizes.append(sizes[low:high])
                    held_docs.append(column.slice(low, high - low))
                    held += int(ends[high - 1]) - base
                    low = high
                    if held >= BLOCK_IDS:
                        yield flush()
                        before, block, held = before + held, block + 1, 0
                        held_ids, held_sizes, held_docs = [], [], []
        if held_sizes:
            yield flush()
        worker.rest()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, schema).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in an id file.

    ``start`` counts the ids of all documents before it: those of earlier shards
    (one small row per shard), of earlier blocks, and of the same block.
    """
    blocks = spark.read.parquet(path)
    inner = blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("doc_id", inner), T.StructField("at", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cell = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
                as_array = lambda name: cell[name].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                values = unpack(
                    np.frombuffer(cell["words"].as_buffer(), "<u8"), as_array("escape_at"),
                    as_array("escape_values").astype(np.int64).view(np.uint64),
                )
                first = as_array("first_value")
                sizes = np.diff(first, append=len(values))
                sums = [crc32(values[a:a + n]) for a, n in zip(first.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), cell["shard"].as_py()), pa.int32()), cell["doc_ids"].values,
                     pa.array(first + cell["ids_before"].as_py(), pa.int64()), pa.array(sizes, pa.int64()),
                     pa.array(sums, pa.int64())],
                    names=schema.fieldNames(),
                )

    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        F.col("shard").alias("of"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
    )
    decoded = blocks.drop("block", "n_ids", "first_word").mapInArrow(decode, schema)
    return decoded.join(bases, F.col("shard") == F.col("of")).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
