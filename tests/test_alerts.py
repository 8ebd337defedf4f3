import json

import pytest
from pyspark.sql import functions as F

from flowlens.operators import alerts as al
from flowlens.operators import incidents as inc
from flowlens.operators import outbox as ob
from flowlens.operators import reporting as rp
from flowlens.schemas import ALERT_SCHEMA, OUTBOX_SCHEMA, RULE_SCHEMA

TS = "2026-04-05T23:00:1{}+00:00"


def alert(i, payload, ts=None, status="new", **columns):
    row = dict.fromkeys(ALERT_SCHEMA.names)
    row.update(id=i, sensor_id="sensor-local", source_event_id=None, event_ts=ts or TS.format(i), payload_json=json.dumps(payload),
               triage_status=status, created_at="c", updated_at="u", triage_updated_at="t")
    row.update(columns)
    return tuple(row[c] for c in ALERT_SCHEMA.names)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), ALERT_SCHEMA)


def rules(spark, *pairs):
    rows = [(i, "sensor-local", f"r{i}", f, v, "model_alert", True, f"t{i}", "t") for i, (f, v) in enumerate(pairs)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def burst(spark):
    ids = [(1, 80), (2, 443), (3, 830)]
    return table(spark, *[
        alert(i, {"score": 0.9999, "passthrough": {"transport_family": "tcp", "source_flow_id": f"192.168.117.132:56619-192.168.117.128:{p}-0000{i}"}})
        for i, p in ids
    ])


def test_burst_becomes_one_incident(spark):
    row = inc.group_incidents(al.hydrate(burst(spark)), with_ids=True).first()
    assert row.incident_alert_count == 3 and row.incident_dst_ports == [80, 443, 830] and row.severity == "critical"
    assert row.source_event_id == row.incident_label == "192.168.117.132 -> 192.168.117.128 (3 alerts)"
    assert row.incident_summary == "192.168.117.132:56619 -> 192.168.117.128 (80, 443, 830) (TCP)"
    assert row.source_event_ids == ["alert-3", "alert-2", "alert-1"] and row.latest_source_event_id == "alert-3"
    text = al.hydrate(burst(spark))
    message = inc.group_incidents(text).select(ob.notification_text().alias("t"), ob.dedupe_key().alias("k")).first()
    assert message.t.splitlines() == [
        "[IDS ALERT BURST]", "incident=alert-3", "severity=CRITICAL", "alerts=3",
        "flow=192.168.117.132:56619 -> 192.168.117.128 (80, 443, 830) (TCP)", "protocol=TCP", "score_max=0.9999",
        "dst_ports=80, 443, 830", "timestamp=2026-04-05T23:00:13+00:00",
    ]
    assert message.k == "incident:192.168.117.132:192.168.117.128:tcp:2026-04-05T23:00"


def test_missing_address_is_a_singleton(spark):
    df = al.hydrate(table(spark, alert(1, {}), alert(2, {})))
    assert inc.group_incidents(df).count() == 2
    assert {r.key_src for r in inc.incident_members(df).collect()} == {"singleton"}


def test_hydration_priorities(spark):
    row = al.hydrate(table(spark, alert(
        1, {"src_ip": "b", "Src Port": 7, "attack_score": 0, "score": 0.76, "Protocol": "UDP", "flow_id": "1.1.1.1:5-2.2.2.2:6-009"},
        src_ip=" ", src_port=0,
    ))).first()
    assert (row.src_ip, row.src_port, row.dst_ip, row.dst_port, row.protocol) == ("b", 7, "2.2.2.2", 6, "UDP")
    assert (row.attack_score, row.severity, row.flow_sequence, row.fingerprint) == (0.76, "medium", "009", "1.1.1.1:5-2.2.2.2:6-009")
    assert row.flow_summary == "b:7 -> 2.2.2.2:6 (UDP)"
    empty = al.hydrate(table(spark, alert(1, {"flow_id": "no shape"}))).first()
    assert empty.flow_summary == "? -> ?" and empty.severity == "unknown" and empty.source_flow_id is None


def test_a_zero_score_is_a_score(spark):
    rows = al.hydrate(table(spark, alert(1, {"attack_score": 0.0}), alert(2, {"attack_score": "0"}), alert(3, {"attack_score": ""}),
                            alert(4, {"attack_score": 0, "score": 0.5}), alert(5, {"score": 0.0}))).orderBy("id").collect()
    assert [r.attack_score for r in rows] == [0.0, 0.0, None, 0.5, 0.0]
    assert [r.severity for r in rows] == ["unknown", "unknown", "unknown", "low", "unknown"]


def test_family_states(spark):
    base = {"attack_family": "DoS", "attack_family_confidence": 0.93, "attack_family_margin": 0.44}
    df = al.hydrate(table(
        spark, alert(1, {**base, "family_status": " Known "}), alert(2, {"family_status": "unknown", "attack_family_confidence": 0.61}),
        alert(3, {**base, "family_status": "benign"}), alert(4, base),
    ))
    got = {r.id: (r.family_state, r.attack_family, r.attack_family_confidence, r.legacy_unavailable) for r in df.collect()}
    assert got == {1: ("known", "DoS", 0.93, False), 2: ("unknown", None, 0.61, False), 3: ("benign", None, None, False), 4: ("legacy_unavailable", None, None, True)}


def test_suppression(spark):
    df = table(spark, alert(1, {"src_ip": "10.1.1.10", "note": "x"}), alert(2, {"src_ip": "10.1.1.11", "note": "y"}, src_port=9))
    hydrated = al.hydrate(df)
    hidden = lambda *pairs: sorted(r.id for r in al.flag_suppressed(hydrated, rules(spark, *pairs)).filter("suppressed").collect())
    assert hidden(("src_ip", "10.1.1.10")) == [1]
    assert hidden(("note", "y"), ("note", "y"), (" src_port ", "9")) == [2]
    assert hidden(("note", "x"), ("src_port", "9")) == [1, 2]
    assert hidden() == [] and hidden((" ", "x"), ("note", "")) == []
    off = al.deactivate_rule(rules(spark, ("note", "x")), 0, "now")
    assert al.active_rules(off).count() == 0
    assert al.visible_alerts(al.flag_suppressed(hydrated, rules(spark, ("note", "x")))).first().payload_json == df.collect()[1].payload_json


def test_limit_comes_before_suppression(spark):
    df = table(spark, *[alert(i, {"note": "x" if i > 2 else "y"}) for i in range(1, 6)])
    rule = rules(spark, ("note", "x"))
    assert al.triage_alerts(df, rule, 3).count() == 0
    assert [r.id for r in al.triage_alerts(df, rule, 3, exact=True).collect()] == [2, 1]
    with pytest.raises(ValueError):
        al.triage_alerts(df, rule, 3, "odd")


def test_upsert_keeps_triage(spark):
    old = table(spark, alert(1, {"v": 1}, status="resolved", source_event_id="e1"), alert(2, {}, source_event_id=None))
    new = table(spark, alert(3, {"v": 2}, source_event_id="e1"), alert(4, {}, source_event_id=None), alert(5, {}, source_event_id="e2"))
    got = {r.id: r for r in al.upsert_alerts(old, new).collect()}
    assert sorted(got) == [1, 2, 4, 5]
    assert got[1].triage_status == "resolved" and json.loads(got[1].payload_json) == {"v": 2} and got[1].event_ts == TS.format(3)


def test_transitions(spark):
    df = table(spark, alert(1, {}), alert(2, {}))
    moves = spark.createDataFrame(
        [(1, " Acknowledged ", "a", "2026-01-01T00", 1), (1, "resolved", "a", "2026-01-03T00", 2), (1, "new", "a", "2026-01-03T00", 3)],
        "alert_id long, to_status string, changed_by string, changed_at string, seq long",
    )
    updated, history = al.apply_transitions(df, moves)
    assert [(r.from_status, r.to_status) for r in history.orderBy("seq").collect()] == [("new", "acknowledged"), ("acknowledged", "resolved"), ("resolved", "new")]
    assert {r.id: (r.triage_status, r.triage_updated_at) for r in updated.collect()} == {1: ("new", "2026-01-03T00"), 2: ("new", "t")}
    with pytest.raises(Exception, match="invalid triage status"):
        al.apply_transitions(df, moves.withColumn("to_status", F.lit("bogus")))[1].collect()


def delivery(i, status="pending", attempts=0, key="k", **other):
    row = dict.fromkeys(OUTBOX_SCHEMA.names)
    row.update(id=i, alert_id=i, channel="telegram", target="c", dedupe_key=f"{key}{i}", payload_json="{}", status=status,
               attempt_count=attempts, created_at=f"t{i}", updated_at=f"t{i}")
    row.update(other)
    return tuple(row[c] for c in OUTBOX_SCHEMA.names)


NOW = "2026-01-01T00:00:00+00:00"


def test_enqueue_keeps_sent(spark):
    outbox = spark.createDataFrame([delivery(1, "sent", 2), delivery(2, dedupe_key=None)], OUTBOX_SCHEMA)
    new = spark.createDataFrame([("telegram", "c", "k1", 7, "new"), ("telegram", "c", "k9", 9, "new")], "channel string, target string, dedupe_key string, alert_id long, payload_json string")
    got = {r.dedupe_key: r for r in ob.enqueue(outbox, new, NOW).collect()}
    assert len(got) == 3
    assert (got["k1"].status, got["k1"].attempt_count, got["k1"].payload_json, got["k1"].alert_id, got["k1"].updated_at) == ("sent", 2, "new", 7, NOW)
    assert (got["k9"].status, got["k9"].attempt_count, got["k9"].created_at) == ("pending", 0, NOW)


def test_retry_states(spark):
    outbox = spark.createDataFrame([delivery(i, attempts=a) for i, a in ((1, 0), (2, 2), (3, 4), (4, 0), (5, 0), (6, 3))], OUTBOX_SCHEMA)
    results = spark.createDataFrame(
        [(1, True, True, None, None, "m"), (2, False, True, "e", None, None), (3, False, True, "e", None, None), (4, False, False, "e", None, None), (5, False, True, "e", 7, None)],
        "id long, ok boolean, retryable boolean, error string, retry_after int, message_id string",
    )
    got = {r.id: r for r in ob.apply_attempts(outbox, results, NOW).collect()}
    assert (got[1].status, got[1].provider_message_id, got[1].last_error) == ("sent", "m", None)
    assert (got[2].status, got[2].attempt_count, got[2].next_attempt_at) == ("retry", 3, "2026-01-01T00:02:00+00:00")
    assert got[3].status == "failed" and got[3].next_attempt_at is None and got[4].status == "failed"
    assert got[5].next_attempt_at == "2026-01-01T00:00:07+00:00" and got[6].status == "pending"


def test_redrive_and_summary(spark):
    outbox = spark.createDataFrame(
        [delivery(1, "failed", 5, last_error="a"), delivery(2, "failed", 5, last_error="b"), delivery(3, "retry", 1, next_attempt_at="2027", last_error=" "), delivery(4)], OUTBOX_SCHEMA
    )
    one = {r.id: r.status for r in ob.redrive_failed(outbox, NOW, limit=1).collect()}
    assert one == {1: "pending", 2: "failed", 3: "retry", 4: "pending"}
    assert all(r.attempt_count == 0 for r in ob.redrive_failed(outbox, NOW, limit=None).collect() if r.id < 3)
    s = ob.delivery_summary(outbox, NOW).first()
    assert (s.pending_count, s.retry_count, s.failed_count, s.due_count, s.oldest_due_at, s.last_error) == (1, 1, 2, 1, "t4", "b")


def test_freshness_states(spark):
    def event(ts="2026-01-01T00:00:00Z", kind="live_sensor_summary", reason="x", root="/r"):
        return json.dumps({"event_type": kind, "timestamp": ts, "reason": reason, "active_bundle": {"activation_path": "/a", "active_bundle_root": root, "active_bundle_name": "n"}})
    rows = [("ok", 1, event("bad")), ("ok", 2, event()), ("old", 1, event("2025-12-31T00:00:00")), ("odd", 1, event(kind="y")), ("bad", 1, event("soon")),
            ("cap", 1, event(reason="capture-failure")), ("mis", 1, event(root="/z"))]
    summaries = spark.createDataFrame(rows, "sensor_id string, id long, payload_json string")
    sensors = spark.createDataFrame([(x,) for x in ("ok", "old", "odd", "bad", "cap", "mis", "none")], "sensor_id string")
    activation = {"activation_path": "/a", "active_bundle_root": "/r", "active_bundle_name": "n"}
    got = rp.summary_freshness(sensors, summaries, F.to_timestamp(F.lit("2026-01-01T00:01:00Z")), activation)
    assert {r.sensor_id: r.state for r in got.collect()} == {
        "ok": "current", "old": "stale", "odd": "unexpected_event", "bad": "malformed", "cap": "capture_failure", "mis": "mismatch", "none": "missing"
    }
