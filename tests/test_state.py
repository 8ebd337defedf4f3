"""Stored state with compaction against a replay of everything."""

import glob
import json
import os

from pyspark.sql import functions as F

from flowlens.operators.alerts import alert_rows
from flowlens.streaming import runtime as rt
from flowlens.streaming import state


def test_compacted_state_is_the_replayed_state(spark, tmp_path):
    """Nine batches with a snapshot every two: few folders are left, and every read sees the same state."""
    plain, packed, path = str(tmp_path / "plain"), str(tmp_path / "packed"), str(tmp_path / "alerts.jsonl")
    for n in range(9):
        with open(path, "a") as handle:
            for i in (n % 3, n, 100):
                handle.write(json.dumps({"source_event_id": f"e{i}", "timestamp": f"t{n}", "severity": str(n)}) + "\n")
            handle.write(json.dumps({"timestamp": f"loose{n}"}) + "\n")
        for store, every in ((plain, 1000), (packed, 2)):
            query = rt.ingest_stream(
                spark, path, "alert", store, f"{store}/checkpoint", drain=True, tail=True, compact_every=every
            )
            query.awaitTermination(120)
            assert query.exception() is None
        if n in (0, 3, 8):
            shown = lambda s: sorted(map(tuple, rt.stored_alerts(spark, s).select(
                "source_event_id", "event_ts", "severity", "payload_json", "triage_status").collect()), key=repr)
            assert shown(plain) == shown(packed)
    assert len(glob.glob(f"{plain}/alert/batch_id=*")) == 9
    assert len(glob.glob(f"{packed}/alert/batch_id=*")) <= 4 and len(glob.glob(f"{packed}/alert__state/upto=*")) == 2
    # Ids do not change when a snapshot replaces the batches; compaction again changes nothing.
    ids = lambda: {r["source_event_id"]: r["id"] for r in rt.stored_alerts(spark, packed).collect() if r["source_event_id"]}
    before = ids()
    state.compact(spark, f"{packed}/alert", rt.MERGES["alert"], 7)
    state.compact(spark, f"{packed}/alert", rt.MERGES["alert"], 8)
    assert ids() == before and len(before) == 10


def test_broken_snapshot_is_not_read(spark, tmp_path):
    folder = str(tmp_path / "s")
    for n in range(3):
        spark.range(1).select(F.lit(n).alias("v")).write.parquet(f"{folder}/batch_id={n}")
    merge = lambda held, rows: rows.select("v") if held is None else held.unionByName(rows.select("v"))
    state.compact(spark, folder, merge, 1)
    os.makedirs(f"{folder}__state/upto=2")
    held, rows = state.parts(spark, folder)
    assert sorted(r["v"] for r in held.collect()) == [0, 1] and [r["v"] for r in rows.collect()] == [2]
    assert state.parts(spark, str(tmp_path / "none")) == (None, None)


def test_one_parse_of_the_payload(spark):
    """The plan of the extraction reads no field by a JSON path, and parses two maps a row."""
    payloads = spark.createDataFrame([('{"id": "a", "passthrough": {"src_ip": "1.2.3.4"}, "Src Port": "7"}',), (
        '{"passthrough": "{\\"src_ip\\": \\"9.9.9.9\\"}", "src_port": 8.0}',), ("[]",), (None,)], "payload_json string")
    rows = alert_rows(payloads, F.lit("now"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and plan.count("from_json") + plan.count("JsonToStructs") <= 4
    found = [(r["source_event_id"], r["src_ip"], r["src_port"], r["event_ts"]) for r in rows.collect()]
    assert found == [("a", "1.2.3.4", 7, "now"), (None, None, 8, "now"), (None, None, None, "now"), (None, None, None, "now")]
