"""Alert extraction, hydration, suppression, incidents, triage and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlens.functions.alerting import clean_flow_parts, flow_id_parts, severity_from_score, severity_rank, shaped_flow_id
from flowlens.operators import alerts as al
from flowlens.operators import incidents as inc
from flowlens.operators import reporting as rp
from flowlens.plans import bindings as b
from flowlens.plans.catalog.registry import Registry, joined, rounded
from flowlens.sources.tables import read_table

_r = Registry()
QUERIES, CHECKS = _r.queries, _r.checks
DAY = 10
NOW = "2024-02-01T00:00:00+00:00"


def hydrated(spark, sf):
    return al.hydrate(b.raw_alerts(spark, sf))


def flagged(spark, sf):
    return al.flag_suppressed(hydrated(spark, sf), al.active_rules(b.rules(spark, sf)))


@_r.query(f"""WITH {b.ALERTS} SELECT id, src_ip, src_port, dst_ip, dst_port, protocol, severity, score AS attack_score, source_flow_id,
  CASE WHEN source_flow_id IS NOT NULL THEN '00007' END AS flow_sequence, flow_summary, severity_rank, source_flow_id AS fingerprint FROM hx""")
def alert_hydration(spark, sf):
    return hydrated(spark, sf).select(
        "id", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "severity", "attack_score", "source_flow_id",
        "flow_sequence", "flow_summary", severity_rank(F.col("severity")).alias("severity_rank"), "fingerprint",
    )


@_r.query(f"""WITH {b.ALERTS} SELECT id, CASE WHEN family_state <> 'legacy_unavailable' THEN family_state END AS family_status, attack_family,
  family_confidence AS attack_family_confidence, family_margin AS attack_family_margin, family_state, family_state = 'legacy_unavailable' AS legacy_unavailable FROM hx""")
def family_view(spark, sf):
    return hydrated(spark, sf).select(
        "id", "family_status", "attack_family", "attack_family_confidence", "attack_family_margin", "family_state", "legacy_unavailable"
    )


@_r.query(f"""WITH {b.EVENTS} SELECT event_id, CASE WHEN k % 7 = 0 THEN NULL ELSE 'h' || user_id END AS src_ip, CASE WHEN k % 7 = 0 OR k % 5 = 0 THEN NULL ELSE k END AS src_port,
  CASE WHEN k % 7 = 0 THEN NULL ELSE 'a-b' END AS dst_ip, CASE WHEN k % 7 = 0 THEN NULL ELSE 80 END AS dst_port, CASE WHEN k % 7 = 0 THEN NULL ELSE lpad(CAST(k AS VARCHAR), 5, '0') END AS flow_sequence FROM ev""")
def flow_id_parse(spark, sf):
    k = F.col("k")
    text = F.when(k % 7 == 0, F.concat(F.lit("h"), F.col("user_id").cast("string"), F.lit("-nothing"))).otherwise(F.concat(
        F.lit(" h"), F.col("user_id").cast("string"), F.lit(":"), F.when(k % 5 == 0, "x").otherwise(k.cast("string")),
        F.lit("-a-b:80-"), F.lpad(k.cast("string"), 5, "0"), F.lit(" "),
    ))
    parts = clean_flow_parts(flow_id_parts(shaped_flow_id(F.col("flow_id"))))
    return b.events(spark, sf).select("event_id", text.alias("flow_id")).select(
        "event_id", *[parts[c].alias(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port", "flow_sequence")]
    )


@_r.query(f"""WITH {b.SCORED}, s AS (SELECT CASE WHEN CAST(score AS DOUBLE) >= 0.995 THEN 'critical' WHEN CAST(score AS DOUBLE) >= 0.9 THEN 'high' WHEN CAST(score AS DOUBLE) >= 0.75 THEN 'medium'
  WHEN CAST(score AS DOUBLE) >= 0.5 THEN 'low' ELSE 'unknown' END AS severity FROM scored) SELECT severity, count(*) AS rows FROM s GROUP BY 1""")
def severity_ladder(spark, sf):
    severity = F.coalesce(severity_from_score(F.col("score").cast("double")), F.lit("unknown"))
    return b.scored_events(spark, sf).groupBy(severity.alias("severity")).agg(F.count(F.lit(1)).alias("rows"))


def _payloads(spark, sf):
    """Sensor payloads with the many spellings that ingestion accepts."""
    n, k = F.col("event_id"), F.col("k")
    text_k = k.cast("string")
    fields = F.concat_ws(
        ", ",
        F.when(n % 3 == 0, F.concat(F.lit('"timestamp": " "'))),
        F.when(n % 3 != 2, F.concat(F.lit('"ts": "'), b.iso(F.col("ts")), F.lit('"'))),
        F.when(n % 4 == 0, F.concat(F.lit('"event_id": '), n.cast("string"))),
        F.when(n % 4 == 1, F.concat(F.lit('"id": " e-'), n.cast("string"), F.lit(' "'))),
        F.when(n % 5 == 0, F.concat(F.lit('"passthrough": {"source_ip": "p-'), text_k, F.lit('", "Dst Port": 9.7}'))),
        F.when(n % 5 == 1, F.concat(F.lit('"Src IP": "  "'))),
        F.when(n % 5 == 2, F.concat(F.lit('"src_ip": "s-'), text_k, F.lit('", "dst_port": "'), text_k, F.lit('.9"'))),
        F.when(n % 5 == 3, F.lit('"dst_port": true')),
        F.when(n % 6 == 0, F.concat(F.lit('"reason": "r'), text_k, F.lit('"'))),
        F.when(n % 6 == 1, F.concat(F.lit('"event_type": "odd", "redacted_summary": "short"'))),
        F.lit('"z": 0'),
    )
    return b.events(spark, sf).select("event_id", F.concat(F.lit("{"), fields, F.lit("}")).alias("payload_json"))


@_r.query(f"""WITH {b.EVENTS} SELECT event_id, 'sensor-local' AS sensor_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN 'e-' || event_id END AS source_event_id,
  CASE WHEN event_id % 3 = 2 THEN '{NOW}' ELSE iso END AS event_ts, CASE event_id % 5 WHEN 0 THEN 'p-' || k WHEN 2 THEN 's-' || k END AS src_ip,
  CAST(CASE event_id % 5 WHEN 0 THEN 9 WHEN 2 THEN k WHEN 3 THEN 1 END AS INTEGER) AS dst_port, 'new' AS triage_status FROM ev""")
def alert_extraction(spark, sf):
    return al.alert_rows(_payloads(spark, sf), F.lit(NOW)).select(
        "event_id", "sensor_id", "source_event_id", "event_ts", "src_ip", "dst_port", "triage_status"
    )


def anomaly_table(spark, sf):
    rows = al.anomaly_rows(_payloads(spark, sf), F.lit(NOW))
    return rows.withColumn("id", F.length("payload_json").cast("long"))


@_r.query(f"""WITH {b.EVENTS} SELECT CASE event_id % 6 WHEN 1 THEN 'odd' ELSE 'schema_anomaly' END AS anomaly_type, CASE event_id % 6 WHEN 0 THEN 'r' || k END AS reason,
  CASE event_id % 6 WHEN 0 THEN 'r' || k WHEN 1 THEN 'short' END AS redacted_summary, count(*) AS rows FROM ev GROUP BY ALL""")
def anomaly_extraction(spark, sf):
    return al.anomaly_rows(_payloads(spark, sf), F.lit(NOW)).groupBy("anomaly_type", "reason", "redacted_summary").agg(F.count(F.lit(1)).alias("rows"))


@_r.query(f"WITH {b.EVENTS} SELECT count(DISTINCT CASE event_id % 6 WHEN 1 THEN 'odd' ELSE 'schema_anomaly' END) AS anomaly_types FROM ev")
def anomaly_type_count(spark, sf):
    return rp.anomaly_types(anomaly_table(spark, sf))


@_r.query(f"""WITH {b.ALERTS}, keyed AS (SELECT *, CASE WHEN kind IN ('view', 'click') THEN 0 ELSE 1 END AS gen FROM al WHERE source_event_id IS NOT NULL), m AS (
  SELECT sensor_id, source_event_id, arg_min(id, gen * 1000000000000 + id) AS id, arg_min(triage_status, gen * 1000000000000 + id) AS triage_status,
         arg_max(event_ts, gen * 1000000000000 + id) AS event_ts FROM keyed GROUP BY 1, 2)
SELECT id, sensor_id, source_event_id, event_ts, triage_status FROM m UNION ALL SELECT id, sensor_id, source_event_id, event_ts, triage_status FROM al WHERE source_event_id IS NULL""")
def alert_upsert(spark, sf):
    rows = b.raw_alerts(spark, sf)
    kind = b.events(spark, sf).select(F.col("event_id").alias("id"), F.col("event_type").isin("view", "click").alias("old"))
    both = rows.join(kind, "id").select(*rows.columns, "old")
    merged = al.upsert_alerts(both.filter("old").drop("old"), both.filter("NOT old").drop("old"))
    return merged.select("id", "sensor_id", "source_event_id", "event_ts", "triage_status")


@_r.query(f"""WITH {b.EVENTS}, s AS (SELECT 'sensor-' || (user_id % 4) AS sensor_id, substr(iso, 1, 13) AS summary_ts, event_id AS id FROM ev)
SELECT sensor_id, summary_ts, min(id) AS id, CAST(max(id) AS VARCHAR) AS payload_json FROM s GROUP BY 1, 2""")
def summary_upsert(spark, sf):
    rows = b.events(spark, sf).select(
        F.col("event_id").alias("id"), F.concat(F.lit("sensor-"), F.pmod("user_id", F.lit(4)).cast("string")).alias("sensor_id"),
        F.substring(b.iso(F.col("ts")), 1, 13).alias("summary_ts"), F.col("event_id").cast("string").alias("payload_json"),
        F.col("event_id").alias("updated_at"),
    )
    empty = rows.filter("false")
    return al.upsert_summaries(empty, rows).select("sensor_id", "summary_ts", "id", "payload_json")


@_r.query("""SELECT coalesce(c.c_custkey, s.s_suppkey) AS key, coalesce(s.s_name, c.c_name) AS name, coalesce(s.s_acctbal, c.c_acctbal) AS balance
FROM customer c FULL JOIN supplier s ON s.s_suppkey = c.c_custkey""")
def dimension_upsert(spark, sf):
    stored = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    incoming = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return al.upsert_dimension(stored, incoming, "key")


@_r.query(f"WITH {b.ALERTS}, {b.RULES} SELECT id, suppressed FROM sup")
def suppressed_alerts(spark, sf):
    return flagged(spark, sf).select("id", "suppressed")


@_r.query(f"WITH {b.ALERTS}, {b.RULES} SELECT severity, triage_status, count(*) AS rows FROM sup WHERE NOT suppressed AND triage_status NOT IN ('resolved', 'false_positive') GROUP BY 1, 2")
def notification_candidates(spark, sf):
    open_alerts = al.notification_candidates(al.visible_alerts(flagged(spark, sf)))
    return open_alerts.groupBy("severity", "triage_status").agg(F.count(F.lit(1)).alias("rows"))


@_r.query("""SELECT s_suppkey AS id, s_name AS rule_name FROM supplier WHERE s_acctbal > 6000 AND s_suppkey <> 3
UNION ALL SELECT CAST(-1 AS BIGINT), 'added'""")
def rule_table(spark, sf):
    rules = b.rules(spark, sf)
    extra = rules.agg(F.max("created_at").alias("created_at")).select(
        F.lit(-1).cast("long").alias("id"), F.lit("sensor-local").alias("sensor_id"), F.lit("added").alias("rule_name"), F.lit("src_ip").alias("match_field"),
        F.lit("x").alias("match_value"), F.lit("model_alert").alias("applies_to"), F.lit(True).alias("is_active"), "created_at", F.col("created_at").alias("updated_at"),
    )
    changed = al.deactivate_rule(al.create_rule(rules, extra), 3, NOW)
    return al.active_rules(changed).select("id", "rule_name")


INCIDENTS = f"""{b.ALERTS}, {b.RULES}, vis AS (SELECT *,
  src_ip IS NOT NULL AND dst_ip IS NOT NULL AND protocol IS NOT NULL AS full_key FROM sup WHERE NOT suppressed), keyed AS (
  SELECT *, CASE WHEN full_key THEN src_ip ELSE 'singleton' END AS key_src, CASE WHEN full_key THEN dst_ip ELSE CAST(id AS VARCHAR) END AS key_dst,
         CASE WHEN full_key THEN lower(protocol) ELSE coalesce(protocol, 'unknown') END AS key_protocol, substr(event_ts, 1, {DAY}) AS key_bucket FROM vis), grp AS (
  SELECT key_src, key_dst, key_protocol, key_bucket, count(*) AS n, max(score) AS attack_score,
         list_sort(list(DISTINCT src_port) FILTER (WHERE src_port IS NOT NULL)) AS sp, list_sort(list(DISTINCT dst_port) FILTER (WHERE dst_port IS NOT NULL)) AS dp FROM keyed GROUP BY 1, 2, 3, 4), last AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key_src, key_dst, key_protocol, key_bucket ORDER BY event_ts DESC, id DESC) AS rn FROM keyed) WHERE rn = 1), worst AS (
  SELECT key_src, key_dst, key_protocol, key_bucket, severity AS top_severity FROM (
    SELECT *, row_number() OVER (PARTITION BY key_src, key_dst, key_protocol, key_bucket ORDER BY severity_rank DESC, event_ts DESC, id DESC) AS rn FROM keyed) WHERE rn = 1), it AS (
  SELECT g.*, l.id, l.event_ts, l.src_ip, l.dst_ip, l.protocol, l.source_event_id AS own_id, l.flow_summary, l.triage_status, l.source_flow_id, l.src_port, l.dst_port, w.top_severity AS severity,
         coalesce(l.source_event_id, 'alert-' || l.id) AS own_name,
         coalesce(l.src_ip, '?') || ' -> ' || coalesce(l.dst_ip, '?') || ' (' || g.n || ' alerts)' AS burst
  FROM grp g JOIN last l USING (key_src, key_dst, key_protocol, key_bucket) JOIN worst w USING (key_src, key_dst, key_protocol, key_bucket)), ports AS (
  SELECT *, src_ip || CASE WHEN len(sp) = 1 THEN ':' || sp[1] ELSE ' (' || array_to_string(sp[1:4], ', ') || CASE WHEN len(sp) > 4 THEN ' +' || (len(sp) - 4) || ' more' ELSE '' END || ')' END AS src_text,
         dst_ip || CASE WHEN len(dp) = 1 THEN ':' || dp[1] ELSE ' (' || array_to_string(dp[1:4], ', ') || CASE WHEN len(dp) > 4 THEN ' +' || (len(dp) - 4) || ' more' ELSE '' END || ')' END AS dst_text
  FROM it), inc AS (
  SELECT *, CASE WHEN n > 1 THEN burst ELSE own_id END AS source_event_id, CASE WHEN n > 1 THEN burst ELSE own_name END AS incident_label,
         CASE WHEN n > 1 THEN own_name ELSE own_id END AS latest_source_event_id,
         CASE WHEN n > 1 THEN coalesce(src_text, '?') || ' -> ' || coalesce(dst_text, '?') || coalesce(' (' || upper(protocol) || ')', '') ELSE flow_summary END AS incident_summary
  FROM ports)"""


def incidents(spark, sf):
    return inc.group_incidents(al.visible_alerts(flagged(spark, sf)), DAY)


@_r.query(f"""WITH {INCIDENTS} SELECT key_src, key_dst, key_protocol, key_bucket, id, event_ts, n AS incident_alert_count, severity, attack_score, incident_label, incident_summary,
  latest_source_event_id, source_event_id, coalesce(array_to_string(dp, ','), '') AS dst_ports FROM inc""")
def incident_table(spark, sf):
    return incidents(spark, sf).select(
        *inc.KEY_COLUMNS, "id", "event_ts", "incident_alert_count", "severity", "attack_score", "incident_label", "incident_summary",
        "latest_source_event_id", "source_event_id", joined(F.col("incident_dst_ports").cast("array<string>")).alias("dst_ports"),
    )


@_r.query(f"WITH {INCIDENTS} SELECT key_src, key_dst, key_protocol, key_bucket, id AS alert_id FROM keyed")
def incident_members(spark, sf):
    return inc.incident_members(al.visible_alerts(flagged(spark, sf)), DAY).select(*inc.KEY_COLUMNS, "alert_id")


@_r.query(f"""WITH {INCIDENTS} SELECT 'total' AS dimension, 'all' AS value, count(*) AS rows FROM inc UNION ALL SELECT 'status', triage_status, count(*) FROM inc GROUP BY 2
UNION ALL SELECT 'severity', severity, count(*) FROM inc GROUP BY 2""")
def incident_rollup(spark, sf):
    return rp.alert_rollup(incidents(spark, sf))


@_r.query(f"""WITH {b.ALERTS} SELECT id, event_ts, triage_status FROM al ORDER BY event_ts DESC, id DESC LIMIT 100""")
def recent_alerts(spark, sf):
    return al.recent(b.raw_alerts(spark, sf), 100).select("id", "event_ts", "triage_status")


@_r.query(f"""WITH {b.ALERTS}, {b.RULES}, top AS (SELECT * FROM sup WHERE triage_status = 'new' ORDER BY event_ts DESC, id DESC LIMIT 300)
SELECT id, event_ts, severity, flow_summary FROM top WHERE NOT suppressed AND sensor_id = 'sensor-1'""")
def triage_page(spark, sf):
    page = al.triage_alerts(b.raw_alerts(spark, sf), al.active_rules(b.rules(spark, sf)), 300, "new", sensor_id="sensor-1")
    return page.select("id", "event_ts", "severity", "flow_summary")


@_r.query(f"""WITH {b.ALERTS}, {b.RULES}
SELECT id, event_ts, severity FROM sup WHERE triage_status = 'new' AND NOT suppressed AND sensor_id = 'sensor-1' ORDER BY event_ts DESC, id DESC LIMIT 50""")
def triage_page_exact(spark, sf):
    page = al.triage_alerts(
        b.raw_alerts(spark, sf), al.active_rules(b.rules(spark, sf)), 50, " NEW ", sensor_id="sensor-1", exact=True
    )
    return page.select("id", "event_ts", "severity")


@_r.query(f"""WITH {INCIDENTS} SELECT id, event_ts, n AS incident_alert_count, incident_label FROM inc ORDER BY event_ts DESC, id DESC LIMIT 40""")
def recent_incidents_exact(spark, sf):
    rows = inc.recent_incidents(b.raw_alerts(spark, sf), al.active_rules(b.rules(spark, sf)), 40, exact=True, prefix=DAY)
    return rows.select("id", "event_ts", "incident_alert_count", "incident_label")


_TOP_INCIDENTS = INCIDENTS.replace(
    "FROM sup WHERE NOT suppressed)", "FROM (SELECT * FROM sup ORDER BY event_ts DESC, id DESC LIMIT 400) WHERE NOT suppressed)"
)


@_r.query(f"""WITH {_TOP_INCIDENTS}, ids AS (SELECT key_src, key_dst, key_protocol, key_bucket, string_agg(coalesce(source_event_id, 'alert-' || id), ',' ORDER BY event_ts DESC, id DESC) AS source_event_ids FROM keyed GROUP BY 1, 2, 3, 4)
SELECT id, event_ts, n AS incident_alert_count, source_event_ids FROM inc JOIN ids USING (key_src, key_dst, key_protocol, key_bucket) ORDER BY event_ts DESC, id DESC LIMIT 40""")
def recent_incidents_page(spark, sf):
    rows = inc.recent_incidents(b.raw_alerts(spark, sf), al.active_rules(b.rules(spark, sf)), 40, prefix=DAY)
    return rows.select("id", "event_ts", "incident_alert_count", joined(F.col("source_event_ids")).alias("source_event_ids"))


def transitions(spark, sf):
    """Events as status changes of one alert per user."""
    state = (
        F.when(F.col("event_type") == "view", "acknowledged").when(F.col("event_type") == "click", " Investigating ")
        .when(F.col("event_type") == "signup", "NEW").when(F.col("event_type") == "purchase", "resolved").otherwise("false_positive")
    )
    return b.events(spark, sf).select(
        F.col("user_id").alias("alert_id"), state.alias("to_status"), F.lit("admin").alias("changed_by"),
        b.iso(F.col("ts")).alias("changed_at"), F.col("event_id").alias("seq"),
    )


_TRANSITIONS = b.EVENTS + """, tr AS (
  SELECT user_id AS alert_id, CASE event_type WHEN 'view' THEN 'acknowledged' WHEN 'click' THEN 'investigating' WHEN 'signup' THEN 'new' WHEN 'purchase' THEN 'resolved' ELSE 'false_positive' END AS to_status,
         iso AS changed_at, event_id AS seq FROM ev), a0 AS (SELECT event_id AS alert_id, CASE k % 10 WHEN 1 THEN 'acknowledged' WHEN 2 THEN 'investigating' WHEN 3 THEN 'resolved' WHEN 4 THEN 'false_positive' ELSE 'new' END AS st, iso FROM ev)"""


@_r.query(f"""WITH {_TRANSITIONS}
SELECT alert_id, coalesce(lag(to_status) OVER (PARTITION BY alert_id ORDER BY changed_at, seq), st) AS from_status, to_status, changed_at, seq FROM tr JOIN a0 USING (alert_id)""")
def status_history(spark, sf):
    _, history = al.apply_transitions(b.raw_alerts(spark, sf), transitions(spark, sf))
    return history.select("alert_id", "from_status", "to_status", "changed_at", "seq")


@_r.query(f"""WITH {_TRANSITIONS}, last AS (SELECT alert_id, arg_max(to_status, changed_at || lpad(CAST(seq AS VARCHAR), 12, '0')) AS st, max(changed_at) AS at FROM tr GROUP BY 1)
SELECT alert_id AS id, coalesce(last.st, a0.st) AS triage_status, coalesce(last.at, iso) AS triage_updated_at FROM a0 LEFT JOIN last USING (alert_id)""")
def status_after_transitions(spark, sf):
    updated, _ = al.apply_transitions(b.raw_alerts(spark, sf), transitions(spark, sf))
    return updated.select("id", "triage_status", "triage_updated_at")


@_r.query("""WITH n AS (SELECT doc_id AS alert_id, 'note' AS kind, '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T08' AS stamp, lang AS detail, source AS actor, doc_id + 1 AS entry_id FROM documents), c AS (
  SELECT conv_id AS alert_id, 'status' AS kind, '2024-01-' || lpad(CAST(turn * 5 % 28 + 1 AS VARCHAR), 2, '0') || 'T07' AS stamp, 'new -> ' || role AS detail, 'admin' AS actor, turn AS entry_id FROM conversations)
SELECT alert_id, kind, detail, actor, entry_id, row_number() OVER (PARTITION BY alert_id ORDER BY stamp DESC, entry_id DESC) AS place
FROM (SELECT * FROM n UNION ALL SELECT * FROM c) x WHERE alert_id IN (SELECT event_id FROM events)""")
def alert_timeline(spark, sf):
    """Notes and status changes of many days; ``place`` is a row's place among its alert's rows as they are returned."""
    def day(n, hour):
        return F.concat(F.lit("2024-01-"), F.lpad((F.pmod(n, F.lit(28)) + 1).cast("string"), 2, "0"), F.lit(hour))

    notes = read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("alert_id"), day(F.col("doc_id"), "T08").alias("created_at"), F.col("lang").alias("note_text"), F.col("source").alias("author"), (F.col("doc_id") + 1).alias("id")
    )
    history = read_table(spark, sf, "conversations").select(
        F.col("conv_id").alias("alert_id"), F.lit("new").alias("from_status"), F.col("role").alias("to_status"), F.lit("admin").alias("changed_by"), day(F.col("turn") * 5, "T07").alias("changed_at"), F.col("turn").alias("id")
    )
    timeline = al.newest_first(al.status_timeline(b.raw_alerts(spark, sf), notes, history)).withColumn("at_row", F.monotonically_increasing_id())
    placed = timeline.withColumn("place", F.row_number().over(Window.partitionBy("alert_id").orderBy("at_row")).cast("long"))
    return placed.select("alert_id", "kind", "detail", "actor", "entry_id", "place")


@_r.query(f"""WITH {b.ALERTS} SELECT s.s AS triage_status, count(al.id) AS rows FROM (VALUES ('new'), ('acknowledged'), ('investigating'), ('resolved'), ('false_positive')) s(s) LEFT JOIN al ON al.triage_status = s.s GROUP BY 1""")
def triage_state_counts(spark, sf):
    return rp.triage_state_counts(b.raw_alerts(spark, sf))


@_r.query(f"WITH {b.ALERTS} SELECT round(100.0 * count(*) FILTER (WHERE triage_status = 'false_positive') / count(*), 1) AS false_positive_percent FROM al")
def false_positive_percent(spark, sf):
    return rp.false_positive_percent(b.raw_alerts(spark, sf))


@_r.query(f"""WITH {b.ALERTS}, {b.RULES}, top AS (SELECT * FROM sup ORDER BY event_ts DESC, id DESC LIMIT 500)
SELECT id, sensor_id, source_event_id, event_ts, severity, triage_status, suppressed, src_ip, dst_ip, protocol FROM top WHERE NOT suppressed""")
def report_alert_export(spark, sf):
    summaries = b.raw_alerts(spark, sf).select("id", "sensor_id", F.col("event_ts").alias("summary_ts"), "payload_json")
    bundle = rp.report_bundle(b.raw_alerts(spark, sf), anomaly_table(spark, sf), summaries, al.active_rules(b.rules(spark, sf)))
    return bundle["alerts"].drop("payload")


@_r.query(f"WITH {b.ALERTS} SELECT id, sensor_id, event_ts AS summary_ts FROM al ORDER BY event_ts DESC, id DESC LIMIT 200")
def report_summary_export(spark, sf):
    summaries = b.raw_alerts(spark, sf).select("id", "sensor_id", F.col("event_ts").alias("summary_ts"), "payload_json")
    bundle = rp.report_bundle(b.raw_alerts(spark, sf), anomaly_table(spark, sf), summaries, al.active_rules(b.rules(spark, sf)))
    return bundle["summaries"].drop("payload")


@_r.query(f"""WITH {b.ALERTS} SELECT 'alert' AS kind, severity AS headline, count(*) AS rows FROM hx GROUP BY 2 UNION ALL
SELECT 'anomaly', CASE event_id % 6 WHEN 1 THEN 'odd' ELSE 'schema_anomaly' END, count(*) FROM ev GROUP BY 2""")
def live_feed(spark, sf):
    feed = rp.live_feed(hydrated(spark, sf), anomaly_table(spark, sf))
    return feed.groupBy("kind", "headline").agg(F.count(F.lit(1)).alias("rows"))


@_r.query("SELECT strftime(max(ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS latest_summary_ts FROM events")
def latest_summary(spark, sf):
    return rp.latest_summary_ts(b.events(spark, sf).select(b.iso(F.col("ts")).alias("summary_ts")))


def _sensor_summaries(spark, sf):
    user, k = F.col("user_id"), F.col("k")
    stamp = F.when(user % 11 == 0, F.lit("never")).when(user % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(b.iso(F.col("ts")))
    payload = F.concat(
        F.lit('{"event_type": "'), F.when(user % 13 == 0, "other").otherwise("live_sensor_summary"), F.lit('", "timestamp": "'), stamp,
        F.lit('", "reason": "'), F.when(k % 6 == 0, "capture-failure").otherwise("interval"),
        F.lit('", "active_bundle": {"activation_path": "/a", "active_bundle_root": "/r", "active_bundle_name": "b'), F.pmod(k, F.lit(2)).cast("string"), F.lit('"}}'),
    )
    return b.events(spark, sf).select(
        user.cast("string").alias("sensor_id"), F.col("event_id").alias("id"), b.iso(F.col("ts")).alias("summary_ts"), payload.alias("payload_json")
    )


_LATEST = b.EVENTS + """, newest AS (SELECT user_id, arg_max(k, event_id) AS k, arg_max(us, event_id) // 1000000 AS s FROM ev GROUP BY 1)"""
_FRESH_NOW = 1706659200  # 2024-01-31T00:00:00Z


@_r.query(f"""WITH {_LATEST}, c AS (SELECT c_custkey, user_id, k, CASE WHEN user_id % 11 <> 0 THEN greatest(CAST({_FRESH_NOW} - s AS DOUBLE), 0) END AS age_seconds FROM customer LEFT JOIN newest ON user_id = c_custkey)
SELECT CAST(c_custkey AS VARCHAR) AS sensor_id, state, state = 'current' AS ok, age_seconds FROM (SELECT *, CASE WHEN user_id IS NULL THEN 'missing' WHEN user_id % 13 = 0 THEN 'unexpected_event' WHEN user_id % 11 = 0 THEN 'malformed'
  WHEN age_seconds > 86400 THEN 'stale' WHEN k % 6 = 0 THEN 'capture_failure' WHEN k % 2 = 1 THEN 'mismatch' ELSE 'current' END AS state FROM c)""")
def summary_freshness(spark, sf):
    sensors = read_table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("sensor_id"))
    activation = {"activation_path": "/a", "active_bundle_root": "/r", "active_bundle_name": "b0"}
    return rp.summary_freshness(
        sensors, _sensor_summaries(spark, sf), F.timestamp_seconds(F.lit(_FRESH_NOW)), activation, 86400.0
    )


@_r.query(f"""WITH {_LATEST} SELECT CAST(user_id AS VARCHAR) AS sensor_id, 'b' || (k % 2) AS bundle FROM newest""")
def active_bundle_state(spark, sf):
    states = rp.active_bundle_state(_sensor_summaries(spark, sf))
    return states.select("sensor_id", F.get_json_object("active_bundle", "$.active_bundle_name").alias("bundle"))


@_r.query(f"""WITH {b.EVENTS} SELECT 'sensor-' || (user_id % 4) AS sensor_id, count(*) FILTER (WHERE event_type IN ('view', 'click') AND value >= 30) AS alert_records, count(*) FILTER (WHERE event_type = 'error') AS quarantine_records,
  count(*) FILTER (WHERE event_type IN ('view', 'click') AND value < 30) AS benign_predictions, count(*) FILTER (WHERE event_type = 'purchase') AS processed_windows, count(*) FILTER (WHERE event_type = 'signup') AS extractor_failures,
  round(coalesce(sum(value) FILTER (WHERE event_type IN ('purchase', 'signup')), 0), 4) AS total_extractor_runtime_seconds FROM ev GROUP BY 1""")
def sensor_counters(spark, sf):
    kind = (
        F.when(F.col("event_type").isin("view", "click"), "prediction").when(F.col("event_type") == "error", "quarantine")
        .when(F.col("event_type") == "purchase", "window").otherwise("failure")
    )
    rows = b.events(spark, sf).select(
        F.concat(F.lit("sensor-"), F.pmod("user_id", F.lit(4)).cast("string")).alias("sensor_id"), kind.alias("kind"),
        (F.col("value") >= 30).alias("is_alert"), F.col("value").alias("runtime_seconds"),
    )
    return rounded(rp.sensor_counters(rows, ["sensor_id"]), 4, "total_extractor_runtime_seconds")


@_r.query(f"""WITH {b.SCORED} SELECT count(*) AS rows, count(*) FILTER (WHERE CAST(score AS DOUBLE) >= 0.9) AS alerts, CAST(0.9 AS DOUBLE) AS threshold FROM scored""")
def scoring_summary(spark, sf):
    rows = b.scored_events(spark, sf).withColumn("is_alert", F.col("score").cast("double") >= 0.9)
    return rp.scoring_summary(rows, 0.9)


@_r.query(f"WITH {b.ALERTS} SELECT id, event_ts, sensor_id FROM al WHERE id = 17")
def alert_by_id(spark, sf):
    return al.alert_by_id(b.raw_alerts(spark, sf), 17).select("id", "event_ts", "sensor_id")
