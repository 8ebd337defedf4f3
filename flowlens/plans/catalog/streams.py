"""Streaming jobs, file sinks and sources on data derived from the tables.

Each query writes its input below the shared work folder, runs the job to the
end and reads the result back.
"""

from __future__ import annotations

import os
import struct
from itertools import groupby

from pyspark.sql import functions as F

from flowlens.functions.records import json_text
from flowlens.operators.adapter import PRIMARY_PROFILE
from flowlens.operators.packets import decode_frames
from flowlens.operators.scoring import ScoringConfig, binary_columns
from flowlens.plans import bindings as b
from flowlens.plans.catalog import alerting
from flowlens.plans.catalog.flows import CHECKS as FLOW_CHECKS
from flowlens.plans.catalog.flows import _frames, _ID, numbered_users, sample_flows
from flowlens.plans.catalog.records import CONTRACT
from flowlens.plans.catalog.registry import Registry
from flowlens.plans.prepare import prepare
from flowlens.plans.workspace import stored, work_folder
from flowlens.schemas import FAMILY_ORDER
from flowlens.sources import jsonl, tables
from flowlens.sources.flow_csv import flow_export
from flowlens.sources.pcap import read_packets, split_captures
from flowlens.streaming import incidents as si
from flowlens.streaming import runtime as rt

_r = Registry()
QUERIES, CHECKS = _r.queries, _r.checks
CONFIG = ScoringConfig(threshold=0.9)
TREE_FILE_ROWS = 50_000  # rows in a file of the CSV tree; at least four files a family


def value_scorer(rows):
    """Stand-in model: a score from one feature, so that results are exact."""
    duration = F.col("features").getField("Flow Duration")
    return rows.withColumns(binary_columns(duration / (duration + 2.0), CONFIG))


def _finish(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


@_r.query(f"""WITH {b.CONTRACT_LINES}
SELECT CASE WHEN outcome <> 'valid' THEN outcome WHEN value / (value + CAST(2 AS DOUBLE)) >= 0.9 THEN 'alert' ELSE 'benign' END AS event, count(*) AS rows FROM val GROUP BY 1""")
def stream_validate_score(spark, sf):
    folder = work_folder(spark, "stream-score")
    b.contract_lines(spark, sf).select("value").write.text(f"{folder}/in")
    _finish(rt.score_stream(spark, f"{folder}/in", CONTRACT, value_scorer, f"{folder}/out", f"{folder}/checkpoint", drain=True))
    quarantined = spark.read.text(f"{folder}/out/quarantine").select(json_text(F.col("value"), "reason").alias("event"))
    predicted = spark.read.parquet(f"{folder}/out/predictions").select(F.when(F.col("is_alert"), "alert").otherwise("benign").alias("event"))
    return quarantined.unionByName(predicted).groupBy("event").agg(F.count(F.lit(1)).alias("rows"))


_MINUTES = f"""WITH {b.ALERTS}, w AS (SELECT strftime(make_timestamp((epoch_us(CAST(replace(event_ts, '+00:00', '') AS TIMESTAMP)) // 21600000000) * 21600000000), '%Y-%m-%dT%H:%M:%S') AS window_start, src_ip, dst_ip, protocol, dst_port, score FROM hx)
SELECT window_start, src_ip, dst_ip, protocol, count(*) AS incident_alert_count, max(score) AS attack_score, min(dst_port) AS lowest_dst_port, max(dst_port) AS highest_dst_port,
  array_to_string(list_sort(list(DISTINCT dst_port) FILTER (WHERE dst_port IS NOT NULL)), ',') AS dst_ports FROM w GROUP BY 1, 2, 3, 4"""


def _timed(alerts):
    return alerts.withColumn("event_time", F.to_timestamp("event_ts"))


def _window_text(df):
    shown = df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ss"))
    ports = F.when(F.size("incident_dst_ports") > 0, F.array_join("incident_dst_ports", ","))
    return shown.withColumn("dst_ports", ports).drop("incident_src_ports", "incident_dst_ports")


@_r.query(_MINUTES)
def windowed_incidents(spark, sf):
    return _window_text(si.windowed_incidents(_timed(alerting.hydrated(spark, sf)), width="6 hours", lateness=None))


@_r.query(_MINUTES)
def stream_incidents(spark, sf):
    folder = work_folder(spark, "stream-incidents")
    timed = _timed(alerting.hydrated(spark, sf)).select("event_time", *si.KEYS, "dst_port", "attack_score")
    timed.write.parquet(f"{folder}/in")
    source = spark.readStream.schema(timed.schema).parquet(f"{folder}/in")
    _finish(si.incident_stream(source, f"{folder}/out", f"{folder}/checkpoint", drain=True, width="6 hours", lateness="60 days"))
    return _window_text(si.latest_incidents(spark, f"{folder}/out"))


@_r.query(f"""WITH {b.ALERTS} SELECT sensor_id, source_event_id, count(*) AS rows FROM (SELECT DISTINCT sensor_id, source_event_id FROM al WHERE source_event_id IS NOT NULL) GROUP BY 1, 2
UNION ALL SELECT sensor_id, NULL, count(*) FROM al WHERE source_event_id IS NULL GROUP BY 1""")
def stream_unique_alerts(spark, sf):
    folder = work_folder(spark, "stream-unique")
    timed = _timed(b.raw_alerts(spark, sf)).select("event_time", "sensor_id", "source_event_id")
    timed.write.parquet(f"{folder}/in")
    source = spark.readStream.schema(timed.schema).parquet(f"{folder}/in")
    unique = si.unique_alerts(source, lateness="60 days")
    _finish(unique.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    return spark.read.schema(timed.schema).parquet(f"{folder}/out").groupBy("sensor_id", "source_event_id").agg(F.count(F.lit(1)).alias("rows"))


@_r.query(f"""WITH {b.ALERTS} SELECT count(DISTINCT source_event_id) + count(*) FILTER (WHERE source_event_id IS NULL) AS alerts, count(DISTINCT source_event_id) AS named,
  0::BIGINT AS parse_errors FROM al""")
def stream_ingest_alerts(spark, sf):
    folder = work_folder(spark, "stream-ingest")
    rows = b.raw_alerts(spark, sf)
    payload = F.to_json(F.struct("source_event_id", F.col("event_ts").alias("timestamp"), "src_ip", "protocol"))
    rows.select(payload.alias("value")).write.text(f"{folder}/in")
    _finish(rt.ingest_stream(spark, f"{folder}/in", "alert", f"{folder}/store", f"{folder}/checkpoint", drain=True))
    stored = rt.stored_alerts(spark, f"{folder}/store")
    errors = spark.read.parquet(f"{folder}/store/parse_errors").agg(F.count(F.lit(1)).alias("parse_errors"))
    totals = stored.agg(F.count(F.lit(1)).alias("alerts"), F.count_distinct("source_event_id").alias("named"))
    return totals.withColumn("one", F.lit(1)).join(errors.withColumn("one", F.lit(1)), "one").drop("one")


@_r.query(f"""WITH {b.ALERTS}, good AS (SELECT * FROM al WHERE id % 17 <> 3)
SELECT count(DISTINCT source_event_id) + count(*) FILTER (WHERE source_event_id IS NULL) AS alerts, count(DISTINCT source_event_id) AS named,
  (SELECT count(*) FROM al WHERE id % 17 = 3) AS parse_errors FROM good""")
def stream_tail_alerts(spark, sf):
    """One growing file per sensor, followed over three runs: a line is cut short, then completed and appended to, then the file is replaced."""
    folder = work_folder(spark, "stream-tail").removeprefix("file:")
    rows = b.raw_alerts(spark, sf)
    payload = F.to_json(F.struct("source_event_id", F.col("event_ts").alias("timestamp"), "src_ip", "protocol"))
    lines = rows.select(
        F.col("sensor_id").alias("file"), "id", F.pmod(F.xxhash64("id"), F.lit(3)).alias("wave"),
        F.when(F.col("id") % 17 == 3, F.lit("not json")).otherwise(payload).alias("value"),
    )

    def put(wave: int):
        def write(part):
            os.makedirs(f"{folder}/in", exist_ok=True)
            for file, held in groupby(part, lambda r: r["file"]):
                path = f"{folder}/in/{file}.jsonl"
                new = path if wave < 2 else f"{folder}/{file}.next"
                with open(new, "a") as handle:
                    # The first run ends within a line; the second one completes it.
                    handle.writelines(("" if wave == 2 else "\n") + r["value"] + ("\n" if wave == 2 else "") for r in held)
                if wave == 2:
                    os.replace(new, path)

        return write

    for wave in range(3):
        part = lines.filter(F.col("wave") == wave).repartition("file").sortWithinPartitions("file", "id")
        part.foreachPartition(put(wave))
        if wave == 1:
            part.groupBy("file").count().foreachPartition(_end_lines(folder))
        _finish(rt.ingest_stream(spark, f"{folder}/in", "alert", f"{folder}/store", f"{folder}/checkpoint", drain=True, tail=True))
    totals = rt.stored_alerts(spark, f"{folder}/store").agg(
        F.count(F.lit(1)).alias("alerts"), F.count_distinct("source_event_id").alias("named")
    )
    errors = spark.read.parquet(f"{folder}/store/parse_errors").agg(F.count(F.lit(1)).alias("parse_errors"))
    return totals.withColumn("one", F.lit(1)).join(errors.withColumn("one", F.lit(1)), "one").drop("one")


def _end_lines(folder):
    """Give the last line of every file of a partition its line end."""
    def write(part):
        for row in part:
            with open(f"{folder}/in/{row['file']}.jsonl", "a") as handle:
                handle.write("\n")

    return write


@_r.query("""WITH l AS (SELECT source, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS v FROM documents)
SELECT source, count(*) AS lines, CAST(sum(n) AS BIGINT) AS numbers FROM (SELECT source, row_number() OVER (PARTITION BY source) AS n FROM l) GROUP BY 1""")
def jsonl_line_numbers(spark, sf):
    """All document lines, a file per source: the numbers of each file must run 1..n without gaps."""
    folder = work_folder(spark, "lines")
    lines = tables.read_table(spark, sf, "documents").select("source", F.regexp_replace("text", "\r\n?", "\n").alias("value"))
    lines.repartition("source").write.partitionBy("source").text(folder)
    numbered = jsonl.read_lines(spark, folder)
    return numbered.groupBy(F.regexp_extract("source", "source=([^/]*)", 1).alias("source")).agg(
        F.count_distinct("line_number").alias("lines"), F.sum("line_number").alias("numbers")
    )


@_r.query(f"WITH {b.SCORED} SELECT split, count(*) AS rows, round(sum(value), 4) AS total FROM scored GROUP BY 1")
def split_sink_roundtrip(spark, sf):
    folder = work_folder(spark, "splits")
    tables.write_splits(b.scored_events(spark, sf), folder)
    return spark.read.parquet(folder).groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("total"))


@_r.query(f"WITH {b.SCORED} SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(value AS VARCHAR) AS value, model FROM scored")
def prediction_sink_csv(spark, sf):
    folder = work_folder(spark, "predictions") + ".csv"
    tables.write_predictions(b.scored_events(spark, sf).select("event_id", "value", "model"), folder)
    return tables.read_scoring_input(spark, folder)


@_r.query(FLOW_CHECKS["packet_decoding"].replace("SELECT event_id AS packet_ordinal", "SELECT CAST(1 AS BIGINT) AS packet_ordinal, event_id"))
def capture_file_packets(spark, sf):
    """Every event as a little-endian capture ``<site>/<event>`` of two records, the second being its frame."""
    def little(value):
        text = F.lpad(F.hex(value.cast("long")), 8, "0")
        return F.concat(*[F.substring(text, i, 2) for i in (7, 5, 3, 1)])

    frame = F.hex("frame")
    micros = F.round(F.col("ts") * 1e6).cast("long")
    stamp = F.concat(little(F.floor(micros / 1_000_000)), little(F.pmod(micros, F.lit(1_000_000))))
    size = (F.length(frame) / 2).cast("long")
    content = F.concat(
        F.lit("D4C3B2A1020004000000000000000000FFFF000001000000"),
        stamp, F.lit("0400000004000000"), F.lit("DEADBEEF"), stamp, little(size), little(size), frame,
    )
    files = _frames(spark, sf).select(F.concat_ws("/", "window_path", "packet_ordinal").alias("window_path"), F.unhex(content).alias("content"))
    name = F.split("window_path", "/")
    packets = numbered_users(decode_frames(split_captures(files)), name[0].cast("long"))
    return packets.withColumn("event_id", name[1].cast("long")).drop("window_path", "ts")


@_r.query(f"""WITH d AS ({FLOW_CHECKS["packet_decoding"]}) SELECT protocol, count(*) AS packets, CAST(sum(packet_length) AS BIGINT) AS bytes, CAST(sum(payload_length) AS BIGINT) AS payload,
  count(DISTINCT src_ip || ':' || src_port) AS senders FROM d GROUP BY 1""")
def capture_range_packets(spark, sf):
    """All frames in eight capture files per site, read back in ranges of 10,000 bytes that cut records anywhere."""
    folder = work_folder(spark, "captures").removeprefix("file:")

    def write(part):
        os.makedirs(folder, exist_ok=True)
        for file, rows in groupby(part, lambda r: r["file"]):
            with open(f"{folder}/{file}.pcap", "wb") as handle:
                handle.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
                for r in rows:
                    seconds, micros = divmod(round(r["ts"] * 1e6), 1_000_000)
                    handle.write(struct.pack("<IIII", seconds, micros, len(r["frame"]), len(r["frame"])) + bytes(r["frame"]))

    number = F.pmod("packet_ordinal", F.lit(8)).cast("string")
    frames = _frames(spark, sf).withColumn("file", F.concat(F.lit("site-"), F.col("window_path"), F.lit("-"), number))
    frames.repartition("file").sortWithinPartitions("file", "packet_ordinal").foreachPartition(write)
    packets = read_packets(spark, folder, range_bytes=10_000)
    packets = numbered_users(packets, F.regexp_extract("window_path", r"site-(\d+)-\d+\.pcap$", 1).cast("long"))
    return packets.groupBy("protocol").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("packet_length").alias("bytes"), F.sum("payload_length").alias("payload"),
        F.count_distinct(F.concat("src_ip", F.lit(":"), "src_port")).alias("senders"),
    )


@_r.query(f"""WITH {_ID} SELECT source_flow_id AS flow_id, CAST(src_port AS VARCHAR) AS "SrcPort", 'offline-window-extractor' AS collector_id,
  CASE protocol WHEN 6 THEN 'tcp' ELSE 'udp' END AS transport_family, CAST(protocol AS VARCHAR) AS "Protocol" FROM ids""")
def flow_csv_export(spark, sf):
    export = flow_export(sample_flows(spark, sf), PRIMARY_PROFILE)
    return export.select("flow_id", F.col("SrcPort").cast("string").alias("SrcPort"), "collector_id", "transport_family", "Protocol")


@_r.query(f"""WITH {b.SCORED}, r AS (SELECT DISTINCT family, k, CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS v FROM scored)
SELECT family AS derived_label_family, CASE WHEN family = 'Benign' THEN 'Benign' ELSE 'Attack' END AS derived_label_binary, count(*) AS rows FROM r WHERE v IS NOT NULL GROUP BY 1, 2""")
def prepared_csv_tree(spark, sf):
    """Events written as a tree of 84-column CSV files, then prepared end to end."""
    folder = work_folder(spark, "prepare")
    # Narrow rows are stored and dealt out, and get their 84 columns where they are written.
    rows = stored(b.scored_events(spark, sf).select("family", "event_id", "k", "value"), "prepare-rows")
    counts = {r[0]: r[1] for r in rows.groupBy("family").count().collect()}
    broken = F.when(F.col("event_id") % 10 == 0, "oops").otherwise(F.floor("value").cast("string"))
    features = [F.col("k").alias("f1"), broken.alias("f2"), F.lit("7").alias("f3")]
    features += [(F.col("k") * i).alias(f"f{i}") for i in range(4, 80)]
    for family in FAMILY_ORDER:
        part = rows.filter(F.col("family") == family).repartition(max(4, -(-counts.get(family, 0) // TREE_FILE_ROWS)))
        part.select(
            F.col("event_id").alias("Flow ID"), F.lit("10.0.0.1").alias("Src IP"), F.lit("10.0.0.2").alias("Dst IP"),
            F.lit("2024").alias("Timestamp"), *features, F.lit("-").alias("Label"),
        ).write.option("header", True).csv(f"{folder}/raw/{family}/scenario")
    prepared = prepare(spark, f"{folder}/raw", f"{folder}/out", across_splits=True)
    return spark.read.parquet(prepared.splits).groupBy("derived_label_family", "derived_label_binary").agg(F.count(F.lit(1)).alias("rows"))


@_r.query(f"""WITH {_ID} SELECT 'valid' AS outcome, 'cicflowmeter_primary_v1' AS profile, count(*) AS rows, count(DISTINCT source_flow_id) AS flows FROM ids""")
def bridged_flow_exports(spark, sf):
    """Flow CSV exports read back and adapted record by record."""
    from flowlens.plans.runtime import bridge_windows
    from flowlens.sources.flow_csv import write_flow_csv

    folder = work_folder(spark, "bridge")
    write_flow_csv(sample_flows(spark, sf), folder, PRIMARY_PROFILE)
    adapted = bridge_windows(spark, folder, PRIMARY_PROFILE.profile_id)
    return adapted.groupBy(F.coalesce("reason", F.lit("valid")).alias("outcome"), "profile").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(F.try_element_at("metadata", F.lit("source_flow_id"))).alias("flows"),
    )


@_r.query(f"""WITH {b.CONTRACT_LINES} SELECT count(*) AS records, count(*) FILTER (WHERE outcome <> 'valid') AS quarantined, count(*) FILTER (WHERE outcome = 'valid') AS valid FROM val""")
def pipeline_counters(spark, sf):
    """Counters observed while the routed records are written, without another pass."""
    from flowlens.operators.reporting import with_pipeline_metrics
    from flowlens.plans.catalog.records import validated_contract
    from pyspark.sql import Observation

    seen = Observation("pipeline")
    routed = with_pipeline_metrics(validated_contract(spark.newSession(), sf), seen)
    routed.select("event_id", "reason").write.parquet(work_folder(spark, "routed"))
    return spark.createDataFrame([tuple(seen.get[c] for c in ("records", "quarantined", "valid"))], "records long, quarantined long, valid long")


@_r.query(f"""WITH {b.EVENTS} SELECT 'live_sensor_summary' AS event_type, 'sensor-' || (user_id % 4) AS sensor_id, CAST(count(*) FILTER (WHERE event_type IN ('view', 'click') AND value >= 30) AS VARCHAR) AS alert_records FROM ev GROUP BY 2""")
def sensor_summary_events(spark, sf):
    from flowlens.operators.reporting import summary_events

    events = summary_events(alerting.sensor_counters(spark, sf), "interval", F.lit(alerting.NOW))
    value = F.col("value")
    return events.select(*[json_text(value, c).alias(c) for c in ("event_type", "sensor_id", "alert_records")])


@_r.query(f"""WITH {b.SCORED} SELECT split, CAST(count(*) AS BIGINT) AS rows FROM scored GROUP BY 1""")
def report_files(spark, sf):
    """A report written as one JSON file and read back."""
    folder = work_folder(spark, "report")
    counts = b.scored_events(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    tables.write_report(counts, folder)
    return spark.read.schema("split string, rows long").json(folder)


@_r.query(f"""WITH {b.ALERTS}, {b.RULES}, top AS (SELECT * FROM sup ORDER BY event_ts DESC, id DESC LIMIT 100), s AS (SELECT * FROM al ORDER BY event_ts DESC, id DESC LIMIT 20)
SELECT 'alert' AS kind, id FROM top WHERE NOT suppressed UNION ALL SELECT 'summary', id FROM s""")
def console_snapshot(spark, sf):
    from flowlens.operators import alerts as al
    from flowlens.operators.reporting import console_snapshot as snapshot

    raw = b.raw_alerts(spark, sf)
    summaries = raw.select("id", "sensor_id", F.col("event_ts").alias("summary_ts"), "payload_json")
    shown = snapshot(raw, alerting.anomaly_table(spark, sf), summaries, al.active_rules(b.rules(spark, sf)))
    return shown["alerts"].select(F.lit("alert").alias("kind"), "id").unionByName(
        shown["summaries"].select(F.lit("summary").alias("kind"), "id")
    )
