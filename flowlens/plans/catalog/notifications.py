"""Outbox steps over incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.records import json_text
from flowlens.operators import outbox as ob
from flowlens.plans import bindings as b
from flowlens.plans.catalog.alerting import DAY, INCIDENTS, incidents
from flowlens.plans.catalog.registry import Registry
from flowlens.plans.workspace import stored

_r = Registry()
QUERIES, CHECKS = _r.queries, _r.checks
NOW = "2024-02-01T00:00:00+00:00"
TARGET = "chat-1"

_CAND = f"""{INCIDENTS}, texts AS (SELECT *,
  CASE WHEN n > 1 THEN 'incident:' || coalesce(src_ip, 'unknown-src') || ':' || coalesce(dst_ip, 'unknown-dst') || ':' || lower(coalesce(protocol, 'unknown-proto')) || ':' || substr(event_ts, 1, {DAY})
       WHEN source_flow_id IS NOT NULL THEN 'flow:' || source_flow_id || ':' || substr(event_ts, 1, {DAY})
       WHEN source_event_id IS NOT NULL THEN source_event_id ELSE 'alert-id:' || id END AS dedupe_key,
  CASE WHEN n > 1 THEN '[IDS ALERT BURST]' || chr(10) || 'incident=' || own_name || chr(10) || 'severity=' || upper(severity) || chr(10) || 'alerts=' || n || chr(10) || 'flow=' || incident_summary || chr(10)
            || 'protocol=' || upper(coalesce(protocol, 'n/a')) || chr(10) || 'score_max=' || printf('%.4f', attack_score)
            || CASE WHEN coalesce(len(dp), 0) > 0 THEN chr(10) || 'dst_ports=' || array_to_string(dp[1:6], ', ') || CASE WHEN len(dp) > 6 THEN ' +' || (len(dp) - 6) || ' more' ELSE '' END ELSE '' END
            || chr(10) || 'timestamp=' || event_ts
       ELSE '[IDS ALERT]' || chr(10) || 'event=' || own_name || chr(10) || 'severity=' || upper(severity) || chr(10) || 'flow=' || coalesce(src_ip, 'n/a') || coalesce(':' || src_port, '') || ' -> ' || coalesce(dst_ip, 'n/a') || coalesce(':' || dst_port, '') || chr(10)
            || 'protocol=' || upper(coalesce(protocol, 'n/a')) || chr(10) || 'label=unknown' || chr(10) || 'family=' || {{fam}} || chr(10) || 'score=' || printf('%.4f', attack_score) || chr(10) || 'timestamp=' || event_ts END AS text
  FROM (SELECT inc.*, hx.k, hx.kind FROM inc JOIN hx ON hx.id = inc.id)), cand AS (
  SELECT dedupe_key, arg_min(id, event_ts || lpad(CAST(id AS VARCHAR), 12, '0')) AS alert_id, arg_min(text, event_ts || lpad(CAST(id AS VARCHAR), 12, '0')) AS text FROM texts GROUP BY 1)"""
# The family text: known rows carry DoS, benign rows still name the raw payload family.
_CAND = _CAND.format(fam="CASE k % 4 WHEN 0 THEN 'DoS' WHEN 2 THEN 'DDoS' ELSE 'unknown' END")


def candidates(spark, sf):
    return ob.candidates(incidents(spark, sf), TARGET, prefix=DAY)


@_r.query(f"WITH {_CAND} SELECT 'telegram' AS channel, '{TARGET}' AS target, dedupe_key, alert_id, text FROM cand")
def notification_texts(spark, sf):
    rows = candidates(spark, sf)
    return rows.select("channel", "target", "dedupe_key", "alert_id", json_text(F.col("payload_json"), "text").alias("text"))


def stored_outbox(rows, known=None):
    """Candidates as deliveries already stored, in mixed states, some without a key.

    ``known`` picks which of them are stored; the others then arrive as new.
    """
    number = F.col("alert_id")
    status = F.when(number % 4 == 0, "pending").when(number % 4 == 1, "retry").when(number % 4 == 2, "failed").otherwise("sent")
    created = F.concat(F.lit("2024-01-"), F.lpad((F.pmod(number, F.lit(28)) + 1).cast("string"), 2, "0"), F.lit("T00:00:00+00:00"))
    return (rows if known is None else rows.filter(known)).select(
        number.alias("id"), number.alias("alert_id"), "channel", "target",
        F.when(number % 7 != 0, F.col("dedupe_key")).alias("dedupe_key"), F.lit("{}").alias("payload_json"),
        status.alias("status"), F.pmod(number, F.lit(5)).cast("int").alias("attempt_count"), F.lit(None).cast("string").alias("last_attempt_at"),
        F.when(status == "retry", F.when(number % 8 == 1, "2024-03-01T00:00:00+00:00").otherwise("2024-01-15T00:00:00+00:00")).alias("next_attempt_at"),
        F.when(status.isin("failed", "retry"), F.concat(F.lit("error "), number.cast("string"))).when(number % 9 == 0, " ").alias("last_error"),
        F.when(status == "sent", F.concat(F.lit("m"), number.cast("string"))).alias("provider_message_id"),
        created.alias("created_at"), created.alias("updated_at"),
    )


_OUTBOX = f"""{_CAND}, ob AS (
  SELECT alert_id AS id, alert_id, CASE WHEN alert_id % 7 <> 0 THEN dedupe_key END AS dedupe_key, CASE alert_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'retry' WHEN 2 THEN 'failed' ELSE 'sent' END AS status,
         CAST(alert_id % 5 AS INTEGER) AS attempt_count, CASE WHEN alert_id % 4 = 1 THEN CASE WHEN alert_id % 8 = 1 THEN '2024-03-01T00:00:00+00:00' ELSE '2024-01-15T00:00:00+00:00' END END AS next_attempt_at,
         CASE WHEN alert_id % 4 IN (1, 2) THEN 'error ' || alert_id WHEN alert_id % 9 = 0 THEN ' ' END AS last_error, CASE WHEN alert_id % 4 = 3 THEN 'm' || alert_id END AS provider_message_id,
         '2024-01-' || lpad(CAST(alert_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00+00:00' AS created_at FROM cand)"""
# Enqueueing meets two thirds of the candidates in the store; the rest are new.
_PART = _OUTBOX[:-1] + " WHERE alert_id % 3 <> 0)"


@_r.query(f"""WITH {_PART}, j AS (SELECT c.dedupe_key, c.alert_id, o.id, o.status, o.attempt_count, o.created_at, c.dedupe_key IS NOT NULL AS fresh FROM cand c LEFT JOIN ob o ON o.dedupe_key = c.dedupe_key)
SELECT coalesce(id, CAST('0x' || substr(md5('telegram' || chr(31) || '{TARGET}' || chr(31) || dedupe_key), 1, 15) AS BIGINT)) AS id, alert_id, dedupe_key, coalesce(status, 'pending') AS status, CASE WHEN status IS NULL THEN 0 ELSE attempt_count END AS attempt_count, coalesce(created_at, '{NOW}') AS created_at, '{NOW}' AS updated_at FROM j
UNION ALL SELECT id, alert_id, dedupe_key, status, attempt_count, created_at, created_at FROM ob WHERE dedupe_key IS NULL""")
def outbox_enqueue(spark, sf):
    rows = stored(candidates(spark, sf), "candidates")
    known = stored_outbox(rows, F.pmod(F.col("alert_id"), F.lit(3)) != 0)
    after = ob.enqueue(known, rows, NOW)
    return after.select("id", "alert_id", "dedupe_key", "status", "attempt_count", "created_at", "updated_at")


@_r.query(f"""WITH {_CAND} SELECT dedupe_key, CASE alert_id % 3 WHEN 0 THEN 'sent' WHEN 1 THEN 'retry' ELSE 'pending' END AS status,
  CAST(CASE WHEN alert_id % 3 = 2 THEN 0 ELSE 1 END AS INTEGER) AS attempt_count,
  CASE alert_id % 3 WHEN 0 THEN 'm' || alert_id END AS provider_message_id FROM cand""")
def outbox_round(spark, sf):
    """From an empty outbox: enqueue, find what is due, try it once, redrive what failed."""
    rows = candidates(spark, sf)
    filled = stored(ob.enqueue(stored_outbox(rows, F.lit(False)), rows, NOW), "outbox")
    number = F.col("alert_id")
    results = ob.due_deliveries(filled, NOW, limit=None).select(
        "id", (number % 3 == 0).alias("ok"), (number % 3 == 1).alias("retryable"), F.lit("boom").alias("error"),
        F.lit(None).cast("int").alias("retry_after"), F.concat(F.lit("m"), number.cast("string")).alias("message_id"),
    )
    after = ob.redrive_failed(ob.apply_attempts(filled, results, NOW), NOW, limit=None)
    return after.select("dedupe_key", "status", "attempt_count", "provider_message_id")


@_r.query(f"""WITH {_OUTBOX} SELECT id, status, created_at FROM ob WHERE status IN ('pending', 'retry') AND (next_attempt_at IS NULL OR next_attempt_at <= '{NOW}') ORDER BY created_at, id LIMIT 100""")
def outbox_due(spark, sf):
    return ob.due_deliveries(stored_outbox(candidates(spark, sf)), NOW).select("id", "status", "created_at")


@_r.query(f"""WITH {_OUTBOX}, r AS (SELECT *, status IN ('pending', 'retry') AS tried, id % 6 < 2 AS ok, id % 6 < 4 AS retryable, CASE WHEN id % 16 = 4 THEN 77 END AS after FROM ob), s AS (
  SELECT *, NOT ok AND retryable AND attempt_count + 1 < 4 AS again, CAST(coalesce(after, least(30 * pow(2, attempt_count), 3600)) AS BIGINT) AS delay FROM r)
SELECT id, CASE WHEN NOT tried THEN status WHEN ok THEN 'sent' WHEN again THEN 'retry' ELSE 'failed' END AS status, CAST(attempt_count + CASE WHEN tried THEN 1 ELSE 0 END AS INTEGER) AS attempt_count,
       CASE WHEN NOT tried THEN next_attempt_at WHEN again THEN strftime(make_timestamp((1706745600 + delay) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS next_attempt_at,
       CASE WHEN NOT tried THEN last_error WHEN NOT ok THEN 'boom' END AS last_error, CASE WHEN tried AND ok THEN 'new' || id ELSE provider_message_id END AS provider_message_id FROM s""")
def outbox_retry(spark, sf):
    outbox = stored(stored_outbox(candidates(spark, sf)), "outbox")
    number = F.col("id")
    results = outbox.filter(F.col("status").isin("pending", "retry")).select(
        "id", (number % 6 < 2).alias("ok"), (number % 6 < 4).alias("retryable"), F.lit("boom").alias("error"),
        F.when(number % 16 == 4, 77).alias("retry_after"), F.concat(F.lit("new"), number.cast("string")).alias("message_id"),
    )
    after = ob.apply_attempts(outbox, results, NOW, max_attempts=4)
    return after.select("id", "status", "attempt_count", "next_attempt_at", "last_error", "provider_message_id")


@_r.query(f"""WITH {_OUTBOX}, pick AS (SELECT id FROM ob WHERE status = 'failed' ORDER BY created_at, id LIMIT 150)
SELECT id, CASE WHEN id IN (SELECT id FROM pick) THEN 'pending' ELSE status END AS status, CASE WHEN id IN (SELECT id FROM pick) THEN 0 ELSE attempt_count END AS attempt_count,
       CASE WHEN id NOT IN (SELECT id FROM pick) THEN last_error END AS last_error FROM ob""")
def outbox_redrive(spark, sf):
    outbox = stored(stored_outbox(candidates(spark, sf)), "outbox")
    return ob.redrive_failed(outbox, NOW, limit=150).select("id", "status", "attempt_count", "last_error")


@_r.query(f"""WITH {_OUTBOX}, d AS (SELECT *, status IN ('pending', 'retry') AND (next_attempt_at IS NULL OR next_attempt_at <= '{NOW}') AS due FROM ob)
SELECT 'telegram' AS channel, count(*) FILTER (WHERE status = 'pending') AS pending_count, count(*) FILTER (WHERE status = 'retry') AS retry_count, count(*) FILTER (WHERE status = 'failed') AS failed_count,
       count(*) FILTER (WHERE status = 'sent') AS sent_count, count(*) FILTER (WHERE due) AS due_count, min(coalesce(next_attempt_at, created_at)) FILTER (WHERE due) AS oldest_due_at,
       arg_max(last_error, created_at || lpad(CAST(id AS VARCHAR), 12, '0')) FILTER (WHERE trim(last_error) <> '') AS last_error,
       arg_max(status, created_at || lpad(CAST(id AS VARCHAR), 12, '0')) FILTER (WHERE trim(last_error) <> '') AS last_error_status,
       arg_max(created_at, created_at || lpad(CAST(id AS VARCHAR), 12, '0')) FILTER (WHERE trim(last_error) <> '') AS last_error_at FROM d""")
def outbox_summary(spark, sf):
    return ob.delivery_summary(stored_outbox(candidates(spark, sf)), NOW)
