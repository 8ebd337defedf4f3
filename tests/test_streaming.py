import json

import pytest
from pyspark.sql import functions as F

from flowlens.operators.contract import FeatureContract
from flowlens.operators.scoring import ScoringConfig, binary_columns
from flowlens.plans.runtime import bridge_windows
from flowlens.operators.adapter import AdapterProfile
from flowlens.sources import jsonl, training_logs
from flowlens.streaming import runtime as rt

CONTRACT = FeatureContract(("a", "b"), {"A": "a"})


def land(folder, name, lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(x) if not isinstance(x, str) else x for x in lines) + "\n")


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def scorer(rows):
    return rows.withColumns(binary_columns(F.col("features.a") / 10, ScoringConfig()))


def test_score_stream_resumes(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    run = lambda: finish(rt.score_stream(spark, str(source), CONTRACT, scorer, out, mark, drain=True))
    land(source, "1.jsonl", [{"A": 9, "b": 1, "x": "t"}, {"a": 1, "b": 2}, {"a": 1}, "{bad", "", [1]])
    run()
    reasons = lambda: sorted(json.loads(r.value)["reason"] for r in spark.read.text(f"{out}/quarantine").collect())
    assert reasons() == ["invalid_json", "invalid_record_type", "missing_required_features"]
    assert spark.read.parquet(f"{out}/predictions").count() == 2
    event = json.loads(rt.alert_events(spark, out).first().value)
    assert event["is_alert"] is True and event["passthrough"] == {"x": "t"} and event["attack_score"] == 0.9
    run()  # nothing new
    assert len(reasons()) == 3
    land(source, "2.jsonl", [{"a": 8, "b": 1}])
    run()
    assert spark.read.parquet(f"{out}/predictions").count() == 3


def test_scorer_failure_fails_the_batch(spark, tmp_path):
    land(tmp_path / "in", "1.jsonl", [{"a": 1, "b": 2}])

    def broken(rows):
        return scorer(rows.withColumn("boom", F.raise_error(F.lit("stage failed")))).withColumn("threshold", F.col("boom").cast("double"))

    query = rt.score_stream(spark, str(tmp_path / "in"), CONTRACT, broken, str(tmp_path / "out"), str(tmp_path / "c"), drain=True)
    with pytest.raises(Exception):
        query.awaitTermination()


def test_ingest_three_kinds(spark, tmp_path):
    store = str(tmp_path / "store")

    def ingest(kind):
        finish(rt.ingest_stream(spark, str(tmp_path / kind), kind, store, str(tmp_path / f"c-{kind}"), drain=True))

    land(tmp_path / "alert", "1", [{"source_event_id": "e1", "timestamp": "t1", "src_ip": "1.1.1.1"}])
    land(tmp_path / "anomaly", "1", [{"event_id": 5, "reason": "r"}])
    land(tmp_path / "summary", "1", [{"timestamp": "t1", "n": 1}])
    for kind in ("alert", "anomaly", "summary", "alert"):
        ingest(kind)
    assert rt.stored_alerts(spark, store).count() == 1 and rt.stored_summaries(spark, store).count() == 1
    land(tmp_path / "alert", "2", [{"source_event_id": "e1", "timestamp": "t2"}, {"src_ip": "x"}, "{broken"])
    land(tmp_path / "summary", "2", [{"timestamp": "t1", "n": 2}])
    ingest("alert")
    ingest("summary")
    alerts = {r.source_event_id: r for r in rt.stored_alerts(spark, store).collect()}
    assert set(alerts) == {"e1", None} and alerts["e1"].event_ts == "t2" and alerts["e1"].src_ip is None
    assert json.loads(rt.stored_summaries(spark, store).first().payload_json)["n"] == 2
    errors = spark.read.parquet(f"{store}/parse_errors").collect()
    assert [json.loads(r.payload_json)["raw_line"] for r in errors] == ["{broken"]
    with pytest.raises(ValueError):
        rt.ingest_stream(spark, "x", "odd", store, "c")


def test_line_numbers_and_limits(spark, tmp_path):
    land(tmp_path / "in", "a", ['{"k": 1}', "", "x" * 30, '{"k": 2}'])
    land(tmp_path / "in", "b", ['{"k": 3}'])
    parsed = jsonl.parse_lines(jsonl.read_lines(spark, str(tmp_path / "in")), max_length=20)
    got = sorted((r.source[-1], r.line_number, r.parse_reason, r.value) for r in parsed.collect())
    assert got == [("a", 1, None, '{"k": 1}'), ("a", 3, "jsonl_line_too_large", "x" * 30), ("a", 4, None, '{"k": 2}'), ("b", 1, None, '{"k": 3}')]


def test_bridge(spark, tmp_path):
    (tmp_path / "w_Flow.csv").write_text("A,b,id\n1,2,f1\n3,,f2\n")
    profile = AdapterProfile("p", {"A": "a", "b": "b"}, {"id": "source_flow_id"})
    contract = FeatureContract(("a", "b"), {})
    rows = bridge_windows(spark, str(tmp_path), "p", contract, {"p": profile}).orderBy("reason").collect()
    assert [r.reason for r in rows] == [None, "missing_required_features"] and rows[0].window_path.endswith("w_Flow.csv")
    error = bridge_windows(spark, str(tmp_path), "zz", contract, {"p": profile}).collect()
    assert [(r.stage, r.reason) for r in error] == [("adapter", "unknown_adapter_profile")]


def test_training_outputs(spark, tmp_path):
    for model, f1 in (("logreg", 0.9), ("mlp", 0.95)):
        (tmp_path / model).mkdir()
        (tmp_path / model / "summary.csv").write_text(
            "train_seconds,val_f1,test_f1,test_recall,test_precision,test_fpr,ood_recall,extra\n" + f"1,0.5,{f1},0.1,0.2,0.3,0.4,z\n"
        )
    board = training_logs.read_benchmark_summaries(spark, str(tmp_path), {"logreg": "LR", "mlp": "MLP"}).collect()
    assert [(r.model_key, r.model_label, r.test_f1) for r in board] == [("mlp", "MLP", 0.95), ("logreg", "LR", 0.9)]
    log = tmp_path / "run.log"
    log.write_text("\n".join(json.dumps({"time": 1.5, "data": d}) for d in ("0:\tlearn: 0.91 test: 0.90 best", "MLP epoch 3 done", "noise")))
    events = training_logs.read_log_events(spark, str(log))
    assert [tuple(r) for r in training_logs.progress_rows(events).collect()] == [(0, 0.91, 0.9, 1.5)]
    assert [r.event for r in training_logs.epoch_timeline(events, "MLP", "MLP epoch").collect()] == ["MLP epoch 3 done"]


def test_numbered_lines_stay_in_their_blocks(spark, tmp_path):
    """Lines of a file of many blocks are numbered where they are read."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("".join(f"line {i:05d}\n" for i in range(1, 2001)))
    (tmp_path / "in" / "b.txt").write_text("line 00001\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        numbered = jsonl.read_lines(spark, str(tmp_path / "in"))
        assert numbered.rdd.getNumPartitions() == spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 20
        rows = numbered.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(rows) == 2001 and all(r.value == f"line {r.line_number:05d}" for r in rows)
