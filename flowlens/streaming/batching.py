"""Micro-batches by record count or age, whichever comes first.

Records of a key are held in state. ``max_records`` of them leave as one batch at
once; what is held for ``seconds`` leaves by a processing-time timer, so a slow
stream is never kept waiting and a burst is cut into batches of even size. State
holds fewer than ``max_records`` records a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MAX_RECORDS = 32
SECONDS = 1.0
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BY_COUNT, BY_AGE = "records", "interval"


class _Batcher(StatefulProcessor):
    def __init__(self, key: str, value: str, max_records: int, seconds: float):
        self.key, self.value = key, value
        self.max_records, self.millis = max_records, max(1, round(seconds * 1000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "value string")
        self.next = handle.getValueState("next", "batch long")

    def _batch(self, key, values: list, cause: str) -> pd.DataFrame:
        number = self.next.get()[0] if self.next.exists() else 0
        self.next.update((number + 1,))
        return pd.DataFrame({
            self.key: [key] * len(values), "batch": number, "cause": cause, "place": range(len(values)), self.value: values,
        })

    def _clear_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.held.get()]
        waited = bool(held)
        for part in rows:
            held += part[self.value].tolist()
            while len(held) >= self.max_records:
                yield self._batch(key[0], held[:self.max_records], BY_COUNT)
                held, waited = held[self.max_records:], False
        self.held.clear()
        if held:
            self.held.put([(v,) for v in held])
        if not waited:
            # The age of what is held counts from its first record.
            self._clear_timers()
            if held:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.millis)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.held.get()]
        self.held.clear()
        if held:
            yield self._batch(key[0], held, BY_AGE)

    def close(self) -> None:
        pass


def in_batches(
    stream: DataFrame, key: str, value: str = "value", max_records: int = MAX_RECORDS, seconds: float = SECONDS,
) -> DataFrame:
    """(key, batch, cause, place, value): records of a stream with the number and cause of the batch they leave in."""
    if max_records < 1:
        raise ValueError("a batch holds one record at least")
    schema = T.StructType([
        stream.schema[key], T.StructField("batch", T.LongType()), T.StructField("cause", T.StringType()),
        T.StructField("place", T.LongType()), T.StructField(value, T.StringType()),
    ])
    return stream.select(key, value).groupBy(key).transformWithStateInPandas(
        _Batcher(key, value, max_records, seconds), schema, "Append", "ProcessingTime"
    )


def use_rocksdb(spark: SparkSession) -> None:
    """Timers and lists of state need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
