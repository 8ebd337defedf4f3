"""Notification texts and the outbox as table-to-table steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.alerting import endpoint_text, port_list_preview
from flowlens.functions.records import json_text
from flowlens.operators.incidents import MINUTE_PREFIX

# Message headings and retry limits.
BURST_HEADING = "[IDS ALERT BURST]"
ALERT_HEADING = "[IDS ALERT]"
MAX_BACKOFF_SECONDS = 3600
SHOWN_PORTS = 6
DEFAULT_CHANNEL = "telegram"


def _filled(column: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))


def score_text(score: Column) -> Column:
    return F.coalesce(F.format_string("%.4f", score), F.lit("n/a"))


def notification_text() -> Column:
    """Message of an incident row: a burst or a single alert."""
    name = F.coalesce(
        "latest_source_event_id", "source_event_id", F.concat(F.lit("alert-"), F.col("id").cast("string"))
    )
    severity = F.upper(_filled("severity", "unknown"))
    protocol = F.upper(_filled("protocol", "n/a"))
    ports = F.col("incident_dst_ports")
    port_line = F.when(
        F.size(ports) > 0, F.concat(F.lit("\ndst_ports="), port_list_preview(ports, SHOWN_PORTS))
    ).otherwise(F.lit(""))

    def lines(*parts: Column) -> Column:
        return F.concat_ws("\n", *parts)

    def field(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}="), value)

    burst = lines(
        F.lit(BURST_HEADING),
        field("incident", name),
        field("severity", severity),
        field("alerts", F.col("incident_alert_count").cast("string")),
        field("flow", F.col("incident_summary")),
        field("protocol", protocol),
        F.concat(field("score_max", score_text(F.col("attack_score"))), port_line),
        field("timestamp", _filled("event_ts", "unknown")),
    )
    flow = F.concat(
        endpoint_text(_filled("src_ip", "n/a"), F.col("src_port")), F.lit(" -> "),
        endpoint_text(_filled("dst_ip", "n/a"), F.col("dst_port")),
    )
    family = F.coalesce(
        F.nullif(F.col("attack_family"), F.lit("")), json_text(F.col("payload_json"), "attack_family"), F.lit("unknown")
    )
    single = lines(
        F.lit(ALERT_HEADING),
        field("event", name),
        field("severity", severity),
        field("flow", flow),
        field("protocol", protocol),
        field("label", _filled("predicted_label", "unknown")),
        field("family", family),
        field("score", score_text(F.col("attack_score"))),
        field("timestamp", _filled("event_ts", "unknown")),
    )
    return F.when(F.col("incident_alert_count") > 1, burst).otherwise(single)


def dedupe_key(prefix: int = MINUTE_PREFIX) -> Column:
    bucket = F.substring(_filled("event_ts", "unknown-ts"), 1, prefix)
    return (
        F.when(F.col("incident_alert_count") > 1, F.concat_ws(
            ":", F.lit("incident"), _filled("src_ip", "unknown-src"), _filled("dst_ip", "unknown-dst"),
            F.lower(_filled("protocol", "unknown-proto")), bucket,
        ))
        .when(F.length("fingerprint") > 0, F.concat_ws(":", F.lit("flow"), F.col("fingerprint"), bucket))
        .when(F.length("source_event_id") > 0, F.col("source_event_id"))
        .otherwise(F.concat(F.lit("alert-id:"), F.col("id").cast("string")))
    )


def candidates(incidents: DataFrame, target: str, channel: str = DEFAULT_CHANNEL, prefix: int = MINUTE_PREFIX) -> DataFrame:
    """One delivery per dedupe key; of several incidents with one key the oldest counts."""
    if not target.strip():
        raise ValueError("target must not be blank")
    payload = F.to_json(F.struct(
        notification_text().alias("text"), "source_event_id", "triage_status", "event_ts"
    ))
    rows = incidents.select(
        F.col("id").alias("alert_id"), "event_ts", dedupe_key(prefix).alias("dedupe_key"),
        payload.alias("payload_json"),
    )
    # Two aggregates, so that no message is written where only the ids are read.
    order = F.struct("event_ts", "alert_id")
    merged = rows.groupBy("dedupe_key").agg(*[F.min_by(c, order).alias(c) for c in ("alert_id", "payload_json")])
    return merged.select(
        F.lit(channel).alias("channel"), F.lit(target).alias("target"), "dedupe_key", "alert_id", "payload_json",
    )


def delivery_id() -> Column:
    """Id of a delivery that no store has numbered."""
    digest = F.md5(F.concat_ws("\u001f", "channel", "target", "dedupe_key"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def enqueue(outbox: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """Outbox after inserting candidates: existing keys keep status and attempts.

    A new row's id is a 60-bit digest of its key, so it is the same whenever and
    wherever the row is made, and due, tried and redriven rows can name it. Among
    a million deliveries two ids collide with a chance of one in two million.
    """
    keys = ["channel", "target", "dedupe_key"]
    loose = outbox.filter(F.col("dedupe_key").isNull())
    keyed = outbox.filter(F.col("dedupe_key").isNotNull())
    arrivals = new.select(
        *keys, F.col("alert_id").alias("__alert"), F.col("payload_json").alias("__payload"), F.lit(True).alias("__new")
    )
    joined = keyed.join(arrivals, keys, "full")
    fresh = F.col("__new").isNotNull()
    inserted = F.col("status").isNull()
    merged = joined.withColumns({
        "id": F.coalesce("id", delivery_id()),
        "alert_id": F.coalesce("__alert", "alert_id"),
        "payload_json": F.coalesce("__payload", "payload_json"),
        "attempt_count": F.when(inserted, F.lit(0)).otherwise(F.col("attempt_count")),
        "created_at": F.when(inserted, F.lit(now)).otherwise(F.col("created_at")),
        "updated_at": F.when(fresh, F.lit(now)).otherwise(F.col("updated_at")),
        "status": F.coalesce("status", F.lit("pending")),
    })
    return merged.select(*outbox.columns).unionByName(loose)


def _due(now: str) -> Column:
    ready = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)
    return F.coalesce(F.col("status").isin("pending", "retry") & ready, F.lit(False))


def due_deliveries(outbox: DataFrame, now: str, channel: str = DEFAULT_CHANNEL, limit: int | None = 100) -> DataFrame:
    due = outbox.filter((F.col("channel") == channel) & _due(now))
    return due if limit is None else due.orderBy("created_at", "id").limit(limit)


def iso_after(now: str, seconds: Column) -> Column:
    """ISO text of ``now`` plus whole seconds, in UTC."""
    moment = F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.lit(now))) + seconds)
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def apply_attempts(
    outbox: DataFrame, results: DataFrame, now: str, max_attempts: int = 5, base_seconds: int = 30
) -> DataFrame:
    """Outbox after one dispatch round.

    ``results`` has one row per tried delivery: id, ok, retryable, error,
    retry_after, message_id. A retryable failure with attempts left waits
    base x 2^(n-1) seconds (at most an hour) or what the provider asks for.
    """
    tried = results.select(
        "id", F.col("ok").alias("__ok"), F.col("retryable").alias("__retryable"), F.col("error").alias("__error"),
        F.col("retry_after").alias("__after"), F.col("message_id").alias("__message"),
    )
    joined = outbox.join(tried, "id", "left")
    was_tried = F.col("__ok").isNotNull()
    attempts = F.col("attempt_count") + 1
    again = ~F.col("__ok") & F.col("__retryable") & (attempts < max_attempts)
    backoff = F.least(
        F.lit(base_seconds) * F.pow(F.lit(2.0), (attempts - 1).cast("double")), F.lit(float(MAX_BACKOFF_SECONDS))
    ).cast("long")
    delay = F.when(F.col("__after") > 0, F.col("__after").cast("long")).otherwise(backoff)
    status = F.when(F.col("__ok"), "sent").when(again, "retry").otherwise("failed")

    def tried_or(value: Column, old: str) -> Column:
        return F.when(was_tried, value).otherwise(F.col(old))

    return joined.withColumns({
        "status": tried_or(status, "status"),
        "attempt_count": tried_or(attempts, "attempt_count"),
        "last_attempt_at": tried_or(F.lit(now), "last_attempt_at"),
        "next_attempt_at": tried_or(F.when(again, iso_after(now, delay)), "next_attempt_at"),
        "last_error": tried_or(F.when(~F.col("__ok"), F.col("__error")), "last_error"),
        "provider_message_id": tried_or(
            F.coalesce(F.when(F.col("__ok"), F.col("__message")), F.col("provider_message_id")), "provider_message_id"
        ),
        "updated_at": tried_or(F.lit(now), "updated_at"),
    }).select(*outbox.columns)


def redrive_failed(outbox: DataFrame, now: str, channel: str = DEFAULT_CHANNEL, limit: int | None = 100) -> DataFrame:
    """Failed deliveries back to pending, oldest first, up to ``limit``."""
    failed = outbox.filter((F.col("channel") == channel) & (F.col("status") == "failed"))
    if limit is None:
        chosen = F.coalesce((F.col("channel") == channel) & (F.col("status") == "failed"), F.lit(False))
        marked = outbox.withColumn("__redrive", chosen)
    else:
        picked = failed.orderBy("updated_at", "id").limit(limit).select("id", F.lit(True).alias("__redrive"))
        marked = outbox.join(picked, "id", "left").withColumn("__redrive", F.coalesce("__redrive", F.lit(False)))
    go = F.col("__redrive")

    def cleared(name: str) -> Column:
        return F.when(~go, F.col(name))

    return marked.withColumns({
        "status": F.when(go, F.lit("pending")).otherwise(F.col("status")),
        "attempt_count": F.when(go, F.lit(0)).otherwise(F.col("attempt_count")),
        "last_attempt_at": cleared("last_attempt_at"),
        "next_attempt_at": cleared("next_attempt_at"),
        "last_error": cleared("last_error"),
        "provider_message_id": cleared("provider_message_id"),
        "updated_at": F.when(go, F.lit(now)).otherwise(F.col("updated_at")),
    }).select(*outbox.columns)


def delivery_summary(outbox: DataFrame, now: str, channel: str = DEFAULT_CHANNEL) -> DataFrame:
    """Counts by state, due count, oldest due time and the latest error, in one pass."""
    due = _due(now)
    has_error = F.length(F.trim("last_error")) > 0
    newest = F.max_by(
        F.when(has_error, F.struct("last_error", "status", "updated_at")),
        F.when(has_error, F.struct("updated_at", "id")),
    )
    rows = outbox.filter(F.col("channel") == channel)
    return rows.agg(
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("pending", "retry", "failed", "sent")],
        F.count_if(due).alias("due_count"),
        F.min(F.when(due, F.coalesce("next_attempt_at", "created_at"))).alias("oldest_due_at"),
        newest.alias("__newest"),
    ).select(
        F.lit(channel).alias("channel"), *[f"{s}_count" for s in ("pending", "retry", "failed", "sent")], "due_count", "oldest_due_at",
        F.col("__newest.last_error").alias("last_error"), F.col("__newest.status").alias("last_error_status"),
        F.col("__newest.updated_at").alias("last_error_at"),
    )
