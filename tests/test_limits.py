"""Inputs beyond former limits: long headers and lines, many rules, recurring folders."""

import json

import compare
import duckdb
import pytest
from pyspark.sql import functions as F

from flowlens.functions.metadata import relative_path
from flowlens.operators import alerts as al
from flowlens.operators import views
from flowlens.plans.catalog import all_checks, all_queries
from flowlens.sources import flow_csv, jsonl
from flowlens.streaming import runtime as rt


def _write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_header_longer_than_a_read(spark, tmp_path):
    wide = ",".join(f"column_number_{k:06d}_with_a_long_name" for k in range(2000))
    _write(tmp_path / "DoS" / "a" / "wide.csv", (wide + "\n1\n").encode())
    # A two-byte character lies across byte 65,536.
    names = "n" * 65_535 + "é,b"
    _write(tmp_path / "DoS" / "a" / "accent.csv", (names + "\n1,2\n").encode())
    _write(tmp_path / "DoS" / "a" / "broken.csv", b"\xff\xfe,b\n")
    _write(tmp_path / "DoS" / "a" / "later.csv", b"a,b\n\xff,1\n")
    files = flow_csv.with_headers(flow_csv.discover_files(spark, str(tmp_path)))
    found = {r.source_file.split("/")[-1]: r for r in files.collect()}
    assert len(found["wide.csv"].header) == 2000
    assert found["accent.csv"].header == ["n" * 65_535 + "é", "b"]
    assert found["broken.csv"].read_error == "UnicodeDecodeError"
    assert found["later.csv"].header == ["a", "b"]


def test_unreadable_storage_fails_the_job(spark, tmp_path):
    _write(tmp_path / "DoS" / "a" / "gone.csv", b"a,b\n1,2\n")
    files = flow_csv.discover_files(spark, str(tmp_path)).cache()
    assert files.count() == 1
    (tmp_path / "DoS" / "a" / "gone.csv").unlink()
    with pytest.raises(Exception, match="FileNotFoundError"):
        flow_csv.with_headers(files).collect()
    files.unpersist()


def test_columns_are_bound_by_name(spark, tmp_path):
    root = tmp_path / "raw"
    _write(root / "DoS" / "x" / "a.csv", b"Flow ID,Src IP,Timestamp,f1,f2,Label\ni1,s,t,1,2,L\n")
    _write(root / "DoS" / "raw" / "b.csv", b"Flow ID,f1,Src IP,f2,Label,Timestamp\ni2,3,s,4,L,t\n")
    checked = flow_csv.header_reasons(
        flow_csv.with_headers(flow_csv.discover_files(spark, str(root))), expected_count=6, first_column="Flow ID"
    ).cache()
    assert checked.filter("quarantine_reason is null").count() == 2
    header = ["Flow ID", "Src IP", "Timestamp", "f1", "f2", "Label"]
    rows = {r["source_file"]: r for r in flow_csv.read_valid_rows(spark, str(root), header, checked).collect()}
    assert {k: (r["Flow ID"], r["f1"], r["f2"], r["Timestamp"]) for k, r in rows.items()} == {
        "DoS/x/a.csv": ("i1", "1", "2", "t"), "DoS/raw/b.csv": ("i2", "3", "4", "t"),
    }
    assert {r["attack_scenario"] for r in rows.values()} == {"x", "raw"}
    checked.unpersist()


@pytest.mark.parametrize("path,root,want", [
    ("file:/raw/DoS/raw/x.csv", "/raw", "DoS/raw/x.csv"), ("file:///raw/DoS/x.csv", "file:/raw/", "DoS/x.csv"),
    ("hdfs://nn:8020/raw/DoS/raw/x.csv", "hdfs:///raw", "DoS/raw/x.csv"), ("file:/home/u/data/in/DoS/x.csv", "data/in", "DoS/x.csv"),
    ("s3a://bucket/raw/a%20b/x+y.csv", "s3a://bucket/raw", "a b/x+y.csv"),
])
def test_relative_path(spark, path, root, want):
    assert spark.range(1).select(relative_path(F.lit(path), root)).first()[0] == want


def test_lines_have_no_limit_unless_set(spark):
    line = json.dumps({"k": "v" * 2_000_000})
    rows = spark.createDataFrame([(line,)], "value string")
    free = jsonl.parse_lines(rows).first()
    assert free.parse_reason is None and free.value == line
    cut = jsonl.parse_lines(rows, max_length=1_048_576).first()
    assert cut.parse_reason == "jsonl_line_too_large" and cut.value == line[:512] and cut.raw_char_count == len(line)


def test_long_alert_is_stored(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    record = {"source_event_id": "big", "event_ts": "2024-01-01T00:00:00+00:00", "note": "n" * 1_200_000}
    _write(source / "a.jsonl", (json.dumps(record) + "\n").encode())
    rt.ingest_stream(spark, str(source), "alert", store, str(tmp_path / "check"), drain=True).awaitTermination()
    stored = rt.stored_alerts(spark, store).first()
    assert stored.source_event_id == "big" and len(stored.payload_json) > 1_200_000


@pytest.mark.parametrize("max_values", [10_000, 3])
def test_rules_on_many_fields(spark, max_values):
    alerts = spark.createDataFrame(
        [(k, json.dumps({f"field{k}": "bad", "other": "x"}), None if k % 2 else "10.0.0.1") for k in range(80)],
        "id long, payload_json string, src_ip string",
    )
    rules = spark.createDataFrame(
        [(f" field{k}", "bad ") for k in range(65)] + [("src_ip", "10.0.0.9"), ("", "x"), ("other", "")],
        "match_field string, match_value string",
    )
    if max_values == 3:  # the joined form, over fewer fields
        rules = rules.filter(F.col("match_field").isin(" field0", " field1", " field4", " field9", "src_ip", "", "other"))
    hit = {0, 1, 4, 9} if max_values == 3 else set(range(65))
    found = {r.id: r.suppressed for r in al.flag_suppressed(alerts, rules, max_values=max_values).collect()}
    assert found == {k: k in hit for k in range(80)}


def test_many_unexpected_labels_are_reported(spark):
    rows = spark.range(12_000).select(F.concat(F.lit("L"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("derived_label_family"), F.lit("train").alias("split"))
    with pytest.raises(ValueError, match="unexpected labels in split train.*L000000"):
        views.derive_view(rows, views.ATTACK_ONLY)


@pytest.mark.parametrize("name", ["packet_decoding", "capture_file_packets", "capture_range_packets"])
def test_more_users_than_ports(spark, tmp_path, name):
    duck = duckdb.connect()
    duck.execute("SET TimeZone = 'UTC'")
    duck.execute(f"""COPY (SELECT * REPLACE (user_id * 9001 AS user_id) FROM '/root/testdata/sf0.001/events.parquet')
      TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert duck.execute("SELECT max(user_id) FROM events").fetchone()[0] > 65_536
    assert compare.difference(all_queries()[name](spark, str(tmp_path)), duck, all_checks()[name]) is None


@pytest.mark.parametrize("name", ["outbox_enqueue", "outbox_redrive", "outbox_retry", "outbox_round", "recent_incidents_exact"])
def test_alerts_are_hydrated_once(spark, name):
    """What a query reads several times is stored, so its result comes from the stored table alone."""
    df = all_queries()[name](spark, "/root/testdata/sf0.001")
    assert df.inputFiles() and not [f for f in df.inputFiles() if "events.parquet" in f]
