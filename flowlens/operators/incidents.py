"""Grouping of alerts into incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.alerting import port_summary, severity_rank, text_or_null
from flowlens.operators.alerts import notification_candidates, recent, triage_alerts
from flowlens.plans.workspace import stored

MINUTE_PREFIX = 16


def incident_key(prefix: int = MINUTE_PREFIX) -> dict[str, Column]:
    """(k1, k2, k3, k4): endpoints, protocol and time prefix, or a singleton key."""
    src, dst, proto = (text_or_null(F.col(c)) for c in ("src_ip", "dst_ip", "protocol"))
    bucket = F.substring(F.coalesce(text_or_null(F.col("event_ts")), F.lit("unknown")), 1, prefix)
    full = src.isNotNull() & dst.isNotNull() & proto.isNotNull()
    return {
        "key_src": F.when(full, src).otherwise(F.lit("singleton")),
        "key_dst": F.when(full, dst).otherwise(F.col("id").cast("string")),
        "key_protocol": F.when(full, F.lower(proto)).otherwise(F.coalesce(proto, F.lit("unknown"))),
        "key_bucket": bucket,
    }


KEY_COLUMNS = ("key_src", "key_dst", "key_protocol", "key_bucket")
_LATEST = (
    "id", "sensor_id", "source_event_id", "event_ts", "src_ip", "dst_ip", "src_port", "dst_port",
    "protocol", "fingerprint", "flow_summary", "triage_status", "predicted_label", "attack_family",
    "family_status", "payload_json",
)


def group_incidents(hydrated: DataFrame, prefix: int = MINUTE_PREFIX, with_ids: bool = False) -> DataFrame:
    """One row per incident.

    Port sets are bounded by the port range. The list of member ids is not, so
    it is only collected when asked for (a limited console page); otherwise use
    :func:`incident_members`.
    """
    keyed = hydrated.withColumns(incident_key(prefix))
    order = F.struct("event_ts", "id")
    latest = [c for c in _LATEST if c in hydrated.columns]
    # Ties in rank keep the newest alert's own spelling of the severity.
    worst = F.max_by(F.col("severity"), F.struct(severity_rank(F.col("severity")), F.col("event_ts"), F.col("id")))
    member = F.struct(
        F.col("event_ts"), F.col("id"),
        F.coalesce("source_event_id", F.concat(F.lit("alert-"), F.col("id").cast("string"))).alias("name"),
    )
    aggregates = [
        F.count(F.lit(1)).alias("incident_alert_count"),
        F.max_by(F.struct(*latest), order).alias("__latest"),
        worst.alias("severity"),
        F.max("attack_score").alias("attack_score"),
        F.array_sort(F.collect_set("src_port")).alias("incident_src_ports"),
        F.array_sort(F.collect_set("dst_port")).alias("incident_dst_ports"),
    ]
    if with_ids:
        aggregates.append(F.collect_list(member).alias("__members"))
    grouped = keyed.groupBy(*KEY_COLUMNS).agg(*aggregates)
    many = F.col("incident_alert_count") > 1
    own_name = F.coalesce(
        F.col("__latest.source_event_id"),
        F.concat(F.lit("alert-"), F.col("__latest.id").cast("string")),
    )
    burst = F.concat(
        F.coalesce(F.col("__latest.src_ip"), F.lit("?")), F.lit(" -> "),
        F.coalesce(F.col("__latest.dst_ip"), F.lit("?")),
        F.lit(" ("), F.col("incident_alert_count").cast("string"), F.lit(" alerts)"),
    )
    summary = F.concat(
        F.coalesce(port_summary(F.col("__latest.src_ip"), F.col("incident_src_ports")), F.lit("?")),
        F.lit(" -> "),
        F.coalesce(port_summary(F.col("__latest.dst_ip"), F.col("incident_dst_ports")), F.lit("?")),
        F.coalesce(F.concat(F.lit(" ("), F.upper("__latest.protocol"), F.lit(")")), F.lit("")),
    )
    label = F.when(many, burst).otherwise(own_name)
    columns = [
        *KEY_COLUMNS,
        *[F.col(f"__latest.{c}").alias(c) for c in latest if c != "source_event_id"],
        F.when(many, burst).otherwise(F.col("__latest.source_event_id")).alias("source_event_id"),
        "incident_alert_count", "severity", "attack_score", "incident_src_ports", "incident_dst_ports",
        label.alias("incident_label"),
        F.when(many, summary).otherwise(F.col("__latest.flow_summary")).alias("incident_summary"),
        F.when(many, own_name).otherwise(F.col("__latest.source_event_id")).alias("latest_source_event_id"),
    ]
    if with_ids:
        ids = F.transform(F.sort_array("__members", asc=False), lambda m: m["name"])
        columns.append(ids.alias("source_event_ids"))
    return grouped.select(*columns)


def incident_members(hydrated: DataFrame, prefix: int = MINUTE_PREFIX) -> DataFrame:
    """(incident key, alert id): membership as rows, safe for incidents of any size."""
    return hydrated.withColumns(incident_key(prefix)).select(
        *KEY_COLUMNS, F.col("id").alias("alert_id"), "event_ts", "source_event_id"
    )


def recent_incidents(
    alerts: DataFrame,
    rules: DataFrame,
    limit: int = 100,
    triage_status: str | None = None,
    include_suppressed: bool = False,
    for_notification: bool = False,
    exact: bool = False,
    prefix: int = MINUTE_PREFIX,
) -> DataFrame:
    """Newest incidents: read ten alerts per wanted incident, group, cut.

    ``exact`` groups all alerts before cutting, so no burst is truncated; the
    columns are the same.
    """
    shown = triage_alerts(
        alerts, rules,
        limit=None if exact else limit * 10,
        triage_status=triage_status, include_suppressed=include_suppressed,
    )
    if for_notification:
        shown = notification_candidates(shown)
    if not exact:
        return recent(group_incidents(shown, prefix, with_ids=True), limit)
    # The page is cut first; only its members are then gathered. Both read the hydrated alerts.
    used = [*_LATEST, "severity", "attack_score"]
    shown = stored(shown.select(*[c for c in dict.fromkeys(used) if c in shown.columns]), "shown-alerts")
    page = recent(group_incidents(shown, prefix), limit)
    keys = [F.col(c).alias(f"__{c}") for c in KEY_COLUMNS]
    wanted = page.select(*keys)
    members = incident_members(shown, prefix)
    match = [F.col(c) == F.col(f"__{c}") for c in KEY_COLUMNS]
    named = members.join(wanted, match, "left_semi").groupBy(*KEY_COLUMNS).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(
                "event_ts", F.col("alert_id").alias("id"),
                F.coalesce("source_event_id", F.concat(F.lit("alert-"), F.col("alert_id").cast("string"))).alias("name"),
            )), asc=False),
            lambda m: m["name"],
        ).alias("source_event_ids")
    )
    return recent(page.join(named, list(KEY_COLUMNS)).select(*page.columns, "source_event_ids"), limit)
