"""The sample tables seen as flow data.

``events`` has a time, a user, a type, a value and a small number ``k`` in its
JSON properties. Each function below derives one input of the operators from a
whole table; the text next to it is the same derivation for the SQL check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.sources.tables import read_table, spread


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read_table(spark, sf, "events")).withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )


EVENTS = """ev AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso, epoch_us(ts) AS us
  FROM events)"""


def iso(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def _by_type(**names: str) -> Column:
    ladder = None
    for event_type, value in names.items():
        hit = F.col("event_type") == event_type
        ladder = F.when(hit, value) if ladder is None else ladder.when(hit, value)
    return ladder


FAMILY_OF_TYPE = {
    "view": "Benign", "click": "DoS", "signup": "Mirai", "purchase": "Spoofing", "error": "BruteForce",
}


def scored_events(spark: SparkSession, sf: str) -> DataFrame:
    """Truth (error or not), a score in (0, 1), a split by day and one of three models."""
    day = F.dayofmonth("ts")
    return events(spark, sf).select(
        "event_id", "user_id", "event_type", "k", "value",
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y"),
        (F.col("value") / (F.col("value") + 2.0)).cast("float").alias("score"),
        F.when(day <= 18, "train").when(day <= 22, "val").when(day <= 26, "test")
        .otherwise("ood_attack_holdout").alias("split"),
        F.concat(F.lit("model_"), F.pmod("k", F.lit(3)).cast("string")).alias("model"),
        _by_type(**FAMILY_OF_TYPE).alias("family"),
    )


SCORED = EVENTS + """, scored AS (
  SELECT event_id, user_id, event_type, k, value,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y,
         CAST(value / (value + CAST(2 AS DOUBLE)) AS FLOAT) AS score,
         CASE WHEN day(ts) <= 18 THEN 'train' WHEN day(ts) <= 22 THEN 'val' WHEN day(ts) <= 26 THEN 'test'
              ELSE 'ood_attack_holdout' END AS split,
         'model_' || (k % 3) AS model,
         CASE event_type WHEN 'view' THEN 'Benign' WHEN 'click' THEN 'DoS' WHEN 'signup' THEN 'Mirai'
              WHEN 'purchase' THEN 'Spoofing' ELSE 'BruteForce' END AS family
  FROM ev)"""


def text_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as CSV cells, some of them faulty."""
    n = F.col("event_id")
    value = (
        F.when(n % 17 == 0, "abc").when(n % 19 == 0, "inf").when(n % 23 == 0, "").when(n % 29 == 0, "1_000")
        .when(n % 31 == 0, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit("e1 ")))
        .when(n % 37 == 0, "12d").otherwise(F.col("value").cast("string"))
    )
    return events(spark, sf).select(
        "event_id", "event_type", value.alias("value_text"),
        F.when(n % 41 == 0, F.lit(None).cast("string")).otherwise(F.col("k").cast("string")).alias("k_text"),
    )


TEXT_EVENTS = EVENTS + """, txt AS (
  SELECT event_id, event_type,
         CASE WHEN event_id % 17 = 0 THEN 'abc' WHEN event_id % 19 = 0 THEN 'inf' WHEN event_id % 23 = 0 THEN ''
              WHEN event_id % 29 = 0 THEN '1_000' WHEN event_id % 31 = 0 THEN ' ' || CAST(value AS VARCHAR) || 'e1 '
              WHEN event_id % 37 = 0 THEN '12d' ELSE CAST(value AS VARCHAR) END AS value_text,
         CASE WHEN event_id % 41 = 0 THEN NULL ELSE CAST(k AS VARCHAR) END AS k_text
  FROM ev), num AS (
  SELECT event_id, event_type,
         CASE WHEN regexp_full_match(trim(value_text), '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?')
              THEN CAST(trim(value_text) AS DOUBLE) END AS value_text,
         CAST(k_text AS DOUBLE) AS k_text
  FROM txt)"""


def document_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as rows of flow files: a language is a family, a source a file."""
    family = (
        F.when(F.col("lang") == "en", "Benign").when(F.col("lang") == "de", "DoS")
        .when(F.col("lang") == "fr", "Mirai").when(F.col("lang") == "es", "BruteForce").otherwise("Other")
    )
    scenario = F.when(F.col("source").isin("src1", "src2"), F.concat(family, F.lit("-TCP_Flood/"))).when(
        F.col("source") == "src3", F.lit("a/b/")
    ).otherwise(F.lit(""))
    return read_table(spark, sf, "documents").select(
        "doc_id", "lang", "source", "n_chars",
        F.concat(family, F.lit("/"), scenario, F.col("source"), F.lit(".csv")).alias("source_file"),
    )


DOC_FILES = """docs AS (
  SELECT doc_id, lang, source, n_chars,
         CASE lang WHEN 'en' THEN 'Benign' WHEN 'de' THEN 'DoS' WHEN 'fr' THEN 'Mirai' WHEN 'es' THEN 'BruteForce'
              ELSE 'Other' END AS fam
  FROM documents), files AS (
  SELECT doc_id, lang, source, n_chars, fam,
         CASE WHEN source IN ('src1', 'src2') THEN fam || '-TCP_Flood' WHEN source = 'src3' THEN 'a/b' END AS mid,
         fam || '/' || CASE WHEN source IN ('src1', 'src2') THEN fam || '-TCP_Flood/' WHEN source = 'src3' THEN 'a/b/'
              ELSE '' END || source || '.csv' AS source_file
  FROM docs)"""


def document_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (language, source) file."""
    return read_table(spark, sf, "documents").groupBy(
        F.col("lang").alias("attack_family"), F.concat("lang", F.lit("/"), "source").alias("source_file")
    ).agg(F.count(F.lit(1)).alias("clean_rows_pre_dedupe"))


DOC_MANIFEST = """manifest AS (
  SELECT lang AS attack_family, lang || '/' || source AS source_file, count(*) AS n
  FROM documents GROUP BY 1, 2)"""


def packets(spark: SparkSession, sf: str) -> DataFrame:
    """Events as packets: a week is a capture window, a user talks to one of three services."""
    n, k = F.col("event_id"), F.col("k")
    length = F.least(F.floor(F.col("value")) + 54, F.lit(1514)).cast("int")
    user_ip = F.concat(
        F.lit("10.0."), F.floor(F.col("user_id") / 256).cast("int").cast("string"), F.lit("."),
        F.pmod("user_id", F.lit(256)).cast("string"),
    )
    service_ip = F.concat(F.lit("192.168.0."), (F.pmod("user_id", F.lit(3)) + 1).cast("string"))
    outgoing = F.col("event_type").isin("click", "purchase", "signup")
    user_port = (F.pmod("user_id", F.lit(50000)) + 1024).cast("int")
    service_port = F.lit(443)
    return events(spark, sf).select(
        F.concat(F.lit("week-"), F.floor((F.dayofmonth("ts") - 1) / 7).cast("string")).alias("window_path"),
        n.alias("packet_ordinal"),
        (F.unix_micros("ts") / F.lit(1e6)).alias("ts"),
        F.when(outgoing, user_ip).otherwise(service_ip).alias("src_ip"),
        F.when(outgoing, user_port).otherwise(service_port).alias("src_port"),
        F.when(outgoing, service_ip).otherwise(user_ip).alias("dst_ip"),
        F.when(outgoing, service_port).otherwise(user_port).alias("dst_port"),
        F.when(F.pmod("user_id", F.lit(5)) == 0, 17).otherwise(6).alias("protocol"),
        length.alias("packet_length"),
        (length - 54).alias("payload_length"),
        F.lit(40).alias("header_length"),
        n.bitwiseAND(F.lit(0xFF)).cast("int").alias("flags"),
        (k * 64).cast("int").alias("window_size"),
    )


PACKETS = EVENTS + """, pk AS (
  SELECT 'week-' || CAST((day(ts) - 1) // 7 AS VARCHAR) AS window_path, event_id AS ord, us / 1e6 AS t,
         '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS user_ip, 1024 + user_id % 50000 AS user_port,
         '192.168.0.' || (user_id % 3 + 1) AS service_ip,
         event_type IN ('click', 'purchase', 'signup') AS outgoing,
         CASE WHEN user_id % 5 = 0 THEN 17 ELSE 6 END AS protocol,
         CAST(least(floor(value) + 54, 1514) AS INTEGER) AS len,
         CAST(least(floor(value) + 54, 1514) AS INTEGER) - 54 AS pay,
         CAST(event_id & 255 AS INTEGER) AS flags, k * 64 AS win
  FROM ev), fl AS (
  SELECT *, first_value(outgoing) OVER (PARTITION BY window_path, user_ip, user_port, service_ip, protocol ORDER BY ord) AS head
  FROM pk), p AS (
  SELECT *, outgoing = head AS fwd,
         CASE WHEN head THEN user_ip ELSE service_ip END AS src_ip, CASE WHEN head THEN service_ip ELSE user_ip END AS dst_ip,
         CAST(CASE WHEN head THEN user_port ELSE 443 END AS INTEGER) AS src_port,
         CAST(CASE WHEN head THEN 443 ELSE user_port END AS INTEGER) AS dst_port
  FROM fl), g AS (
  SELECT *, t - lag(t) OVER (PARTITION BY window_path, src_ip, src_port, dst_ip, dst_port, protocol ORDER BY t, ord) AS gap,
         t - lag(t) OVER (PARTITION BY window_path, src_ip, src_port, dst_ip, dst_port, protocol, fwd ORDER BY t, ord) AS dgap
  FROM p)"""


def contract_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as JSON flow records with seeded faults."""
    n = F.col("event_id")
    key = F.when(n % 3 == 0, '"SrcPort"').otherwise('"Src Port"')
    port = F.when(n % 11 == 0, "null").when(n % 13 == 0, '" "').when(n % 5 == 0, F.concat(F.lit('"'), F.col("k").cast("string"), F.lit('"'))).otherwise(F.col("k").cast("string"))
    proto = F.when(n % 7 == 0, '"tcp"').when(n % 19 == 0, "true").otherwise("6")
    fields = F.concat_ws(
        ", ",
        F.concat(key, F.lit(": "), port),
        F.when(n % 17 == 0, F.concat(F.lit('"SrcPort": 1, "Src Port": '), F.col("k").cast("string"))),
        F.lit('"DstPort": 80'),
        F.concat(F.lit('"Protocol": '), proto),
        F.when(n % 23 != 0, F.concat(F.lit('"Flow Duration": '), F.col("value").cast("string"))),
        F.concat(F.lit('"collector_id": "sensor-'), F.pmod("user_id", F.lit(4)).cast("string"), F.lit('"')),
    )
    line = (
        F.when(n % 29 == 0, F.concat(F.lit('{"broken": '), F.col("k").cast("string")))
        .when(n % 31 == 0, F.lit("[1]"))
        .when(n % 37 == 0, F.lit(" "))
        .otherwise(F.concat(F.lit("{"), fields, F.lit("}")))
    )
    return events(spark, sf).select("event_id", line.alias("value"))


CONTRACT_LINES = EVENTS + """, rec AS (
  SELECT event_id, k, value,
         CASE WHEN event_id % 37 = 0 AND event_id % 29 <> 0 AND event_id % 31 <> 0 THEN 'blank'
              WHEN event_id % 29 = 0 THEN 'invalid_json' WHEN event_id % 31 = 0 THEN 'invalid_record_type' END AS parse_reason,
         event_id % 17 = 0 AS collide, event_id % 23 = 0 AS no_duration,
         event_id % 11 = 0 OR event_id % 13 = 0 AS bad_port, event_id % 7 = 0 OR event_id % 19 = 0 AS bad_proto,
         'sensor-' || (user_id % 4) AS collector
  FROM ev), val AS (
  SELECT *, CASE WHEN parse_reason IS NOT NULL THEN parse_reason WHEN collide THEN 'alias_collision'
                 WHEN no_duration THEN 'missing_required_features'
                 WHEN bad_port OR bad_proto THEN 'non_numeric_required_features' ELSE 'valid' END AS outcome
  FROM rec WHERE parse_reason IS NULL OR parse_reason <> 'blank')"""


def adapter_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as source-profile JSON records with seeded faults."""
    n = F.col("event_id")
    text_k = F.col("k").cast("string")
    fields = F.concat_ws(
        ", ",
        F.concat(F.lit('" SrcPort": '), text_k),
        F.when(n % 17 == 0, F.concat(F.lit('"SrcPort ": '), text_k)),
        F.when(n % 19 == 0, F.lit('"  ": 1')),
        F.lit('"DstPort": 80'),
        F.concat(F.lit('"Protocol": '), F.when(n % 7 == 0, '"tcp"').otherwise("6")),
        F.when(n % 23 != 0, F.concat(F.lit('"FlowDuration": '), F.col("value").cast("string"))),
        F.when(n % 13 == 0, F.lit('"surprise": 1, "Src Port": 5')),
        F.concat(F.lit('"flow_id": "f-'), n.cast("string"), F.lit('"')),
        F.when(n % 2 == 0, F.lit('"flow_family": "bidirectional"')),
    )
    return events(spark, sf).select("event_id", F.concat(F.lit("{"), fields, F.lit("}")).alias("value"))


ADAPTER_LINES = EVENTS + """, ad AS (
  SELECT event_id, k, value,
         5 + CAST(event_id % 17 = 0 AS INT) + CAST(event_id % 19 = 0 AS INT) - CAST(event_id % 23 = 0 AS INT)
           + 2 * CAST(event_id % 13 = 0 AS INT) + CAST(event_id % 2 = 0 AS INT) AS fields,
         CASE WHEN event_id % 19 = 0 THEN 'blank_source_keys' WHEN event_id % 17 = 0 THEN 'normalized_key_collision'
              WHEN event_id % 13 = 0 THEN 'unmapped_source_fields' WHEN event_id % 23 = 0 THEN 'missing_required_features'
              WHEN event_id % 7 = 0 THEN 'non_numeric_required_features' ELSE 'valid' END AS outcome
  FROM ev)"""


def raw_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as stored alerts; the fields sit in columns, payload or flow id by event type."""
    n, k = F.col("event_id"), F.col("k")
    user = F.col("user_id")
    src = F.concat(
        F.lit("10.0."), F.floor(user / 256).cast("int").cast("string"), F.lit("."), F.pmod(user, F.lit(256)).cast("string")
    )
    dst = F.concat(F.lit("192.168.0."), F.pmod(user, F.lit(3)).cast("string"))
    sport, dport = (F.lit(1024) + k).cast("int"), (F.lit(8000) + F.pmod(k, F.lit(16))).cast("int")
    score = F.round(F.col("value") / (F.col("value") + 2.0), 4).cast("string")
    kind = F.col("event_type")
    family = (
        F.when(k % 4 == 0, F.concat(F.lit(', "family_status": "Known", "attack_family": "DoS", "attack_family_confidence": '), score))
        .when(k % 4 == 1, ', "family_status": "unknown", "attack_family_margin": 0.11')
        .when(k % 4 == 2, ', "family_status": "benign", "attack_family": "DDoS"')
        .otherwise("")
    )
    flow_id = F.concat(src, F.lit(":"), sport.cast("string"), F.lit("-"), dst, F.lit(":"), dport.cast("string"), F.lit("-00007"))
    body = (
        F.when(kind == "view", F.concat(F.lit('"attack_score": '), score))
        .when(kind == "click", F.concat(
            F.lit('"source_ip": "'), src, F.lit('", "destination_ip": "'), dst, F.lit('", "source_port": '), sport.cast("string"),
            F.lit(', "destination_port": "'), dport.cast("string"), F.lit('", "Protocol": "UDP", "score": '), score))
        .when(kind == "signup", F.concat(
            F.lit('"attack_score": '), score, F.lit(', "passthrough": {"source_flow_id": "'), flow_id,
            F.lit('", "transport_family": "tcp"}')))
        .when(kind == "purchase", F.concat(
            F.lit('"Src IP": "'), src, F.lit('", "Dst IP": "'), dst, F.lit('", "Src Port": '), sport.cast("string"),
            F.lit(', "Dst Port": '), dport.cast("string"), F.lit(', "protocol": "tcp", "attack_score": "'), score, F.lit('"')))
        .otherwise(F.concat(F.lit('"flow_id": "broken", "attack_score": '), score))
    )
    in_columns = kind == "view"
    status = (
        F.when(k % 10 == 1, "acknowledged").when(k % 10 == 2, "investigating").when(k % 10 == 3, "resolved")
        .when(k % 10 == 4, "false_positive").otherwise("new")
    )
    return events(spark, sf).select(
        n.alias("id"),
        F.concat(F.lit("sensor-"), F.pmod(user, F.lit(4)).cast("string")).alias("sensor_id"),
        F.when(k % 5 != 0, F.concat(user.cast("string"), F.lit("-"), k.cast("string"))).alias("source_event_id"),
        iso(F.col("ts")).alias("event_ts"),
        F.when((kind == "error") & (k % 2 == 0), "HIGH").alias("severity"),
        F.when(in_columns, src).when(kind == "purchase", " ").alias("src_ip"),
        F.when(in_columns, dst).alias("dst_ip"),
        F.when(in_columns, sport).when(kind == "purchase", 0).alias("src_port"),
        F.when(in_columns, dport).alias("dst_port"),
        F.when(in_columns, "tcp").alias("protocol"),
        F.lit(None).cast("string").alias("fingerprint"),
        F.concat(F.lit("{"), body, family, F.lit("}")).alias("payload_json"),
        status.alias("triage_status"),
        iso(F.col("ts")).alias("triage_updated_at"),
        iso(F.col("ts")).alias("created_at"),
        iso(F.col("ts")).alias("updated_at"),
    )


ALERTS = EVENTS + """, al AS (
  SELECT event_id AS id, iso AS event_ts, event_type AS kind, user_id, k,
         'sensor-' || (user_id % 4) AS sensor_id,
         CASE WHEN k % 5 <> 0 THEN user_id || '-' || k END AS source_event_id,
         '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS src, '192.168.0.' || (user_id % 3) AS dst,
         1024 + k AS sport, 8000 + k % 16 AS dport,
         round(value / (value + CAST(2 AS DOUBLE)), 4) AS score,
         CASE k % 10 WHEN 1 THEN 'acknowledged' WHEN 2 THEN 'investigating' WHEN 3 THEN 'resolved'
              WHEN 4 THEN 'false_positive' ELSE 'new' END AS triage_status
  FROM ev), hy AS (
  SELECT id, event_ts, kind, user_id, k, sensor_id, source_event_id, triage_status, score,
         CASE WHEN kind <> 'error' THEN src END AS src_ip, CASE WHEN kind <> 'error' THEN dst END AS dst_ip,
         CASE WHEN kind <> 'error' THEN sport END AS src_port, CASE WHEN kind <> 'error' THEN dport END AS dst_port,
         CASE WHEN kind = 'error' THEN NULL WHEN kind = 'click' THEN 'UDP' ELSE 'tcp' END AS protocol,
         CASE WHEN kind = 'error' AND k % 2 = 0 THEN 'HIGH' WHEN score >= 0.995 THEN 'critical' WHEN score >= 0.9 THEN 'high'
              WHEN score >= 0.75 THEN 'medium' WHEN score >= 0.5 THEN 'low' ELSE 'unknown' END AS severity,
         CASE WHEN kind = 'signup' THEN src || ':' || sport || '-' || dst || ':' || dport || '-00007' END AS source_flow_id,
         CASE k % 4 WHEN 0 THEN 'known' WHEN 1 THEN 'unknown' WHEN 2 THEN 'benign' ELSE 'legacy_unavailable' END AS family_state,
         CASE WHEN k % 4 = 0 THEN 'DoS' END AS attack_family,
         CASE WHEN k % 4 = 0 THEN score END AS family_confidence,
         CASE WHEN k % 4 = 1 THEN 0.11 END AS family_margin
  FROM al), hx AS (
  SELECT *, coalesce(src_ip, '?') || coalesce(':' || src_port, '') || ' -> ' || coalesce(dst_ip, '?')
            || coalesce(':' || dst_port, '') || coalesce(' (' || upper(protocol) || ')', '') AS flow_summary,
         CASE lower(severity) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS severity_rank
  FROM hy)"""


def rules(spark: SparkSession, sf: str) -> DataFrame:
    """Suppression rules derived from suppliers: hide some users' addresses and one port."""
    supplier = read_table(spark, sf, "supplier")
    number = F.col("s_suppkey")
    field = F.when(number % 3 == 0, "src_ip").when(number % 3 == 1, "dst_port").otherwise("family_status")
    value = F.when(number % 3 == 0, F.concat(F.lit("10.0.0."), number.cast("string"))).when(
        number % 3 == 1, (F.lit(8000) + number).cast("string")
    ).otherwise(F.lit("unused"))
    return supplier.select(
        number.alias("id"), F.lit("sensor-local").alias("sensor_id"), F.col("s_name").alias("rule_name"),
        field.alias("match_field"), value.alias("match_value"), F.lit("model_alert").alias("applies_to"),
        (F.col("s_acctbal") > 6000).alias("is_active"),
        F.lit("2024-01-01T00:00:00+00:00").alias("created_at"), F.lit("2024-01-01T00:00:00+00:00").alias("updated_at"),
    )


RULES = """ru AS (
  SELECT CASE s_suppkey % 3 WHEN 0 THEN 'src_ip' WHEN 1 THEN 'dst_port' ELSE 'family_status' END AS f,
         CASE s_suppkey % 3 WHEN 0 THEN '10.0.0.' || s_suppkey WHEN 1 THEN CAST(8000 + s_suppkey AS VARCHAR) ELSE 'unused' END AS v
  FROM supplier WHERE s_acctbal > 6000), sup AS (
  SELECT hx.*, (coalesce(src_ip IN (SELECT v FROM ru WHERE f = 'src_ip'), false)
             OR coalesce(CAST(dst_port AS VARCHAR) IN (SELECT v FROM ru WHERE f = 'dst_port'), false)) AS suppressed
  FROM hx)"""
