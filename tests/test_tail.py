"""Tail of growing files: appends, partial lines, cuts, replacement, restarts."""

import json
import os

import pytest

from flowlens.sources import tail
from flowlens.streaming import runtime as rt


def _append(path, text):
    with open(path, "ab") as handle:
        handle.write(text.encode())


class _Follower:
    """Drains a tail into memory, each time with a new query on the same checkpoint."""

    def __init__(self, spark, path, checkpoint, **more):
        self.spark, self.path, self.checkpoint, self.more = spark, path, checkpoint, more

    def drain(self):
        seen = []
        query = (
            tail.tail_lines(self.spark, self.path, **self.more).writeStream
            .foreachBatch(lambda batch, _: seen.extend(batch.collect()))
            .option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
        assert query.exception() is None
        return [r["value"] for r in sorted(seen, key=lambda r: (r["source"], r["start"]))]


def test_growing_cut_and_replaced_file(spark, tmp_path):
    path = str(tmp_path / "alerts.jsonl")
    follow = _Follower(spark, path, str(tmp_path / "checkpoint"))
    assert follow.drain() == []
    _append(path, "a\nb\npart")
    assert follow.drain() == ["a", "b"]
    assert follow.drain() == []
    _append(path, "ial\r\n\nc")
    assert follow.drain() == ["partial", ""]
    _append(path, "\n")
    assert follow.drain() == ["c"]
    # Replaced by another file under the same name.
    other = str(tmp_path / "next")
    _append(other, "new 1\nnew 2\n")
    os.replace(other, path)
    assert follow.drain() == ["new 1", "new 2"]
    # Cut in place: shorter than what was read.
    with open(path, "wb") as handle:
        handle.write(b"x\n")
    assert follow.drain() == ["x"]
    # Cut in place and grown beyond the old end before anyone looked.
    with open(path, "wb") as handle:
        handle.write(b"longer than before\nand more\n")
    assert follow.drain() == ["longer than before", "and more"]
    os.remove(path)
    assert follow.drain() == []
    _append(path, "back\n")
    assert follow.drain() == ["back"]


@pytest.mark.parametrize("partition_bytes", [1, 3, 7, 64, 1 << 20])
def test_ranges_give_each_line_once(partition_bytes, tmp_path):
    path = str(tmp_path / "lines")
    lines = ["", "ä", "bb", "c" * 30, "", "d" * 64, "e"]
    _append(path, "".join(x + "\n" for x in lines) + "open")
    reader = tail.TailReader(str(tmp_path), partition_bytes)
    now = reader.latestOffset()
    for before in range(len(lines) + 1):
        byte = len("".join(x + "\n" for x in lines[:before]).encode())
        with open(path, "rb") as handle:
            start = {path: {**now[path], "end": byte, "head": tail._head(handle, min(tail.HEAD, byte))}}
        parts = reader.partitions(start, now) if byte < now[path]["end"] else []
        found = [v for p in parts for b in reader.read(p) for v in b.column(2).to_pylist()]
        assert found == lines[before:]
    assert reader.partitions(now, now) == []


def test_replay_after_replacement_reads_nothing(tmp_path):
    path = str(tmp_path / "f")
    _append(path, "a\nb\n")
    reader = tail.TailReader(path, 10)
    parts = reader.partitions({}, reader.latestOffset())
    os.remove(path)
    assert [b for p in parts for b in reader.read(p)] == []


def test_ingest_follows_a_growing_file(spark, tmp_path):
    path, store = str(tmp_path / "alerts.jsonl"), str(tmp_path / "store")

    def run():
        query = rt.ingest_stream(spark, path, "alert", store, str(tmp_path / "checkpoint"), drain=True, tail=True)
        query.awaitTermination(120)
        assert query.exception() is None
        return {r["source_event_id"]: r["severity"] for r in rt.stored_alerts(spark, store).collect()}

    event = lambda i, s: json.dumps({"source_event_id": i, "timestamp": "2024-01-01T00:00:00Z", "severity": s})
    _append(path, event("e1", "low") + "\n" + event("e2", "low")[:20])
    assert run() == {"e1": "low"}
    _append(path, event("e2", "low")[20:] + "\nnot json\n" + event("e1", "high") + "\n")
    assert run() == {"e1": "high", "e2": "low"}
    os.remove(path)
    _append(path, event("e3", "medium") + "\n")
    assert run() == {"e1": "high", "e2": "low", "e3": "medium"}
    assert spark.read.parquet(f"{store}/parse_errors").count() == 1
