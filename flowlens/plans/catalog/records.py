"""JSON lines, feature contract and source adapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.records import json_text
from flowlens.operators import adapter, contract
from flowlens.plans import bindings as b
from flowlens.plans.catalog.registry import Registry, joined
from flowlens.schemas import MAX_JSONL_LINE_LENGTH
from flowlens.sources.jsonl import parse_anomalies, parse_lines

_r = Registry()
QUERIES, CHECKS = _r.queries, _r.checks

FEATURES = ("Src Port", "Dst Port", "Protocol", "Flow Duration")
CONTRACT = contract.FeatureContract(
    FEATURES, {"SrcPort": "Src Port", "DstPort": "Dst Port", "FlowDuration": "Flow Duration"}
)
PROFILE = adapter.AdapterProfile(
    "sample", {"SrcPort": "Src Port", "DstPort": "Dst Port", "FlowDuration": "Flow Duration", "Protocol": "Protocol"},
    {"flow_id": "source_flow_id"}, ("flow_family",),
)


def parsed_contract(spark, sf):
    return parse_lines(b.contract_lines(spark, sf))


def validated_contract(spark, sf):
    return contract.validate(parsed_contract(spark, sf), CONTRACT, keep_reason="parse_reason")


def adapted_records(spark, sf):
    return adapter.adapt(parse_lines(b.adapter_lines(spark, sf), max_length=MAX_JSONL_LINE_LENGTH), PROFILE, CONTRACT, keep_reason="parse_reason")


@_r.query(f"""WITH {b.CONTRACT_LINES}
SELECT event_id, coalesce(parse_reason, 'object') AS outcome,
       CASE parse_reason WHEN 'invalid_record_type' THEN 3 WHEN 'invalid_json' THEN CAST(11 + length(CAST(k AS VARCHAR)) AS INTEGER) ELSE 0 END AS bad_chars
FROM val""")
def jsonl_outcomes(spark, sf):
    parsed = parsed_contract(spark, sf)
    return parsed.select(
        "event_id", F.coalesce("parse_reason", F.lit("object")).alias("outcome"),
        F.when(F.col("parse_reason").isNotNull(), F.col("raw_char_count")).otherwise(0).cast("int").alias("bad_chars"),
    )




@_r.query("""SELECT doc_id, CASE WHEN length(text) > 5000 THEN 'jsonl_line_too_large' ELSE 'invalid_json' END AS reason, length(text) AS raw_char_count
FROM documents WHERE trim(replace(replace(text, chr(10), ''), chr(13), '')) <> ''""")
def jsonl_line_limit(spark, sf):
    from flowlens.sources.tables import read_table

    lines = read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("value"))
    parsed = parse_lines(lines, max_length=5000)
    return parsed.select("doc_id", F.col("parse_reason").alias("reason"), "raw_char_count")


@_r.query(f"""WITH {b.CONTRACT_LINES}
SELECT 'sensor-local' AS sensor_id, 'ingest_parse_error' AS anomaly_type, 'alerts: ' || parse_reason AS reason,
       CASE parse_reason WHEN 'invalid_json' THEN '{{"broken": ' || k ELSE '[1]' END AS raw_line, count(*) AS rows
FROM val WHERE parse_reason IS NOT NULL GROUP BY ALL""")
def ingest_parse_anomalies(spark, sf):
    anomalies = parse_anomalies(parsed_contract(spark, sf), "alerts", F.current_timestamp(), "sensor-local")
    return anomalies.groupBy(
        "sensor_id", "anomaly_type", "reason", json_text(F.col("payload_json"), "raw_line").alias("raw_line")
    ).agg(F.count(F.lit(1)).alias("rows"))


@_r.query(f"""WITH {b.CONTRACT_LINES}
SELECT event_id, outcome, CASE WHEN outcome = 'alias_collision' THEN 'Src Port' ELSE '' END AS alias_collisions,
       CASE WHEN outcome = 'missing_required_features' THEN 'Flow Duration' ELSE '' END AS missing_features,
       CASE WHEN outcome <> 'non_numeric_required_features' THEN '' WHEN bad_port AND bad_proto THEN 'Src Port,Protocol'
            WHEN bad_port THEN 'Src Port' ELSE 'Protocol' END AS non_numeric_features,
       CASE WHEN parse_reason IS NULL THEN collector END AS collector
FROM val""")
def contract_validation(spark, sf):
    v = validated_contract(spark, sf)
    return v.select(
        "event_id", F.coalesce("reason", F.lit("valid")).alias("outcome"),
        *[joined(F.col(c)).alias(c) for c in contract.DETAIL_COLUMNS],
        F.try_element_at("passthrough", F.lit("collector_id")).alias("collector"),
    )


@_r.query(f"WITH {b.CONTRACT_LINES} SELECT outcome, count(*) AS rows FROM val GROUP BY 1")
def contract_reason_counts(spark, sf):
    return contract.reason_counts(validated_contract(spark, sf))


@_r.query(f"""WITH {b.CONTRACT_LINES}
SELECT event_id, CAST(k AS DOUBLE) AS src_port, CAST(80 AS DOUBLE) AS dst_port, CAST(6 AS DOUBLE) AS protocol, value AS flow_duration
FROM val WHERE outcome = 'valid'""")
def contract_valid_rows(spark, sf):
    good = contract.valid_records(validated_contract(spark, sf))
    return good.select("event_id", *[
        F.col("features").getField(f).alias(f.lower().replace(" ", "_")) for f in FEATURES
    ])


@_r.query(f"""WITH {b.CONTRACT_LINES}
SELECT event_id, 'schema_anomaly' AS event_type, outcome AS reason,
       CASE WHEN outcome = 'missing_required_features' THEN '["Flow Duration"]' ELSE '[]' END AS missing_features
FROM val WHERE outcome <> 'valid'""")
def contract_quarantine_events(spark, sf):
    bad = contract.quarantined_records(validated_contract(spark, sf))
    events = contract.quarantine_events(bad, index="event_id")
    value = F.col("value")
    return events.select(
        json_text(value, "record_index").cast("long").alias("event_id"),
        json_text(value, "event_type").alias("event_type"),
        json_text(value, "reason").alias("reason"),
        json_text(value, "missing_features").alias("missing_features"),
    )


@_r.query(f"""WITH {b.ADAPTER_LINES}
SELECT event_id, outcome, CASE outcome WHEN 'blank_source_keys' THEN '  ' ELSE '' END AS blank_source_keys,
       CASE outcome WHEN 'normalized_key_collision' THEN 'SrcPort' ELSE '' END AS normalized_key_collisions,
       CASE outcome WHEN 'unmapped_source_fields' THEN 'Src Port,surprise' ELSE '' END AS unmapped_fields,
       CASE outcome WHEN 'missing_required_features' THEN 'Flow Duration' ELSE '' END AS missing_features,
       CASE outcome WHEN 'non_numeric_required_features' THEN 'Protocol' ELSE '' END AS non_numeric_features
FROM ad""")
def adapter_outcomes(spark, sf):
    a = adapted_records(spark, sf)
    details = ["blank_source_keys", "normalized_key_collisions", "unmapped_fields", "missing_features", "non_numeric_features"]
    return a.select(
        "event_id", F.coalesce("reason", F.lit("valid")).alias("outcome"), *[joined(F.col(c)).alias(c) for c in details]
    )


@_r.query(f"WITH {b.ADAPTER_LINES} SELECT outcome, count(*) AS rows FROM ad GROUP BY 1")
def adapter_reason_counts(spark, sf):
    return contract.reason_counts(adapted_records(spark, sf))


@_r.query(f"""WITH {b.ADAPTER_LINES}
SELECT CAST(k AS DOUBLE) AS "Src Port", CAST(80 AS DOUBLE) AS "Dst Port", CAST(6 AS DOUBLE) AS "Protocol", value AS "Flow Duration",
       'sample' AS adapter_profile, 'f-' || event_id AS source_flow_id, CASE WHEN event_id % 2 = 0 THEN 'bidirectional' END AS flow_family
FROM ad WHERE outcome = 'valid'""")
def adapter_accepted_rows(spark, sf):
    return adapter.adapted_rows(adapted_records(spark, sf), PROFILE, CONTRACT)


@_r.query(f"""WITH {b.ADAPTER_LINES}
SELECT event_id, outcome AS reason, 'true' AS redacted, CAST(fields AS VARCHAR) AS field_count,
       CASE WHEN outcome IN ('blank_source_keys', 'normalized_key_collision') THEN 'false' ELSE 'true' END AS metadata_redacted
FROM ad WHERE outcome <> 'valid'""")
def adapter_redacted_events(spark, sf):
    events = adapter.adapter_quarantine_events(adapted_records(spark, sf), index="event_id")
    value = F.col("value")
    return events.select(
        json_text(value, "record_index").cast("long").alias("event_id"),
        json_text(value, "reason").alias("reason"),
        json_text(value, "source_record", "redacted").alias("redacted"),
        json_text(value, "source_record", "field_count").alias("field_count"),
        json_text(value, "metadata_redacted").alias("metadata_redacted"),
    )


@_r.query(f"""WITH {b.ADAPTER_LINES}
SELECT CAST(k AS DOUBLE) AS "SrcPort", CAST(80 AS DOUBLE) AS "DstPort", value AS "FlowDuration", CAST(6 AS DOUBLE) AS "Protocol",
       'f-' || event_id AS flow_id, CASE WHEN event_id % 2 = 0 THEN 'bidirectional' END AS flow_family
FROM ad WHERE outcome = 'valid'""")
def adapter_inverse_names(spark, sf):
    rows = adapter.adapted_rows(adapted_records(spark, sf), PROFILE, CONTRACT)
    return adapter.to_source_names(rows, PROFILE)
