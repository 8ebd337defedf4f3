"""Exports, rollups, counters and sensor freshness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from flowlens.functions.numeric import safe_ratio, strip
from flowlens.functions.records import json_text
from flowlens.operators.alerts import recent, triage_alerts
from flowlens.schemas import FRESHNESS_SECONDS, TRIAGE_STATES


def export_alerts(shown: DataFrame) -> DataFrame:
    return shown.select(
        "id", "sensor_id", "source_event_id", "event_ts", "severity", "triage_status", "suppressed",
        "src_ip", "dst_ip", "protocol", F.col("payload_json").alias("payload"),
    )


def export_anomalies(anomalies: DataFrame, include_payload: bool = False) -> DataFrame:
    columns = ["id", "sensor_id", "source_event_id", "event_ts", "anomaly_type", "reason", "redacted_summary"]
    extra = [F.col("payload_json").alias("payload")] if include_payload else []
    return anomalies.select(*columns, *extra)


def export_summaries(summaries: DataFrame) -> DataFrame:
    return summaries.select("id", "sensor_id", "summary_ts", F.col("payload_json").alias("payload"))


def report_bundle(
    alerts: DataFrame, anomalies: DataFrame, summaries: DataFrame, rules: DataFrame,
    alert_limit: int | None = 500, anomaly_limit: int = 500, summary_limit: int = 200,
    triage_status: str | None = None, include_suppressed: bool = False, include_payload: bool = False,
) -> dict[str, DataFrame]:
    """The three exports of an operator report."""
    return {
        "alerts": export_alerts(triage_alerts(alerts, rules, alert_limit, triage_status, include_suppressed)),
        "anomalies": export_anomalies(recent(anomalies, anomaly_limit), include_payload),
        "summaries": export_summaries(recent(summaries, summary_limit, "summary_ts")),
    }


def console_snapshot(
    alerts: DataFrame, anomalies: DataFrame, summaries: DataFrame, rules: DataFrame,
    alert_limit: int = 100, anomaly_limit: int = 100, summary_limit: int = 20, include_suppressed: bool = False,
) -> dict[str, DataFrame]:
    return {
        "alerts": triage_alerts(alerts, rules, alert_limit, None, include_suppressed),
        "anomalies": recent(anomalies, anomaly_limit),
        "summaries": recent(summaries, summary_limit, "summary_ts"),
    }


def alert_rollup(alerts: DataFrame) -> DataFrame:
    """Total, by status and by severity as (dimension, value, rows).

    Counts per (status, severity) are taken first, so the grouping sets expand a
    handful of rows instead of every alert.
    """
    status = F.coalesce("triage_status", F.lit("unknown")).alias("triage_status")
    severity = F.coalesce("severity", F.lit("unknown")).alias("severity")
    small = alerts.groupBy(status, severity).agg(F.count(F.lit(1)).alias("n"))
    sets = small.groupingSets(
        [[F.col("triage_status")], [F.col("severity")], []], "triage_status", "severity"
    ).agg(F.sum("n").alias("rows"), F.grouping_id().alias("__g"))
    kind = F.when(F.col("__g") == 1, "status").when(F.col("__g") == 2, "severity").otherwise("total")
    value = F.when(F.col("__g") == 1, F.col("triage_status")).when(F.col("__g") == 2, F.col("severity")).otherwise("all")
    return sets.select(kind.alias("dimension"), value.alias("value"), F.coalesce("rows", F.lit(0)).alias("rows"))


def latest_summary_ts(summaries: DataFrame) -> DataFrame:
    return summaries.agg(F.max("summary_ts").alias("latest_summary_ts"))


def triage_state_counts(alerts: DataFrame, states: Sequence[str] = TRIAGE_STATES) -> DataFrame:
    """One row per fixed state, zero when absent."""
    counts = alerts.agg(*[F.count_if(F.col("triage_status") == s).alias(s) for s in states])
    rows = F.explode(F.array(*[
        F.struct(F.lit(s).alias("triage_status"), F.col(s).alias("rows")) for s in states
    ]))
    return counts.select(rows.alias("r")).select("r.*")


def false_positive_percent(alerts: DataFrame) -> DataFrame:
    share = safe_ratio(F.count_if(F.col("triage_status") == "false_positive"), F.count(F.lit(1)))
    return alerts.agg(F.round(share * 100, 1).alias("false_positive_percent"))


def anomaly_types(anomalies: DataFrame) -> DataFrame:
    return anomalies.agg(F.count_distinct("anomaly_type").alias("anomaly_types"))


def live_feed(alerts: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Alerts and anomalies in one list with a kind column."""
    left = alerts.select(
        F.lit("alert").alias("kind"), "id", "event_ts", F.col("severity").alias("headline")
    )
    right = anomalies.select(
        F.lit("anomaly").alias("kind"), "id", "event_ts", F.col("anomaly_type").alias("headline")
    )
    return left.unionByName(right)


def sensor_counters(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals per sensor (and window) from routed runtime events.

    Expects kind in (prediction, quarantine, window, failure), is_alert and
    runtime_seconds.
    """
    prediction = F.col("kind") == "prediction"
    window_done = F.col("kind").isin("window", "failure")
    return events.groupBy(*keys).agg(
        F.count_if(prediction & F.col("is_alert")).alias("alert_records"),
        F.count_if(F.col("kind") == "quarantine").alias("quarantine_records"),
        F.count_if(prediction & ~F.col("is_alert")).alias("benign_predictions"),
        F.count_if(F.col("kind") == "window").alias("processed_windows"),
        F.count_if(F.col("kind") == "failure").alias("extractor_failures"),
        F.coalesce(F.sum(F.when(window_done, F.col("runtime_seconds"))), F.lit(0.0)).alias("total_extractor_runtime_seconds"),
    )


def summary_events(counters: DataFrame, reason: str, timestamp: Column) -> DataFrame:
    """JSON ``live_sensor_summary`` events from sensor counters."""
    event = F.to_json(F.struct(
        F.lit("live_sensor_summary").alias("event_type"),
        F.lit(reason).alias("reason"),
        timestamp.alias("timestamp"),
        *[F.col(f"`{c}`") for c in counters.columns],
    ))
    return counters.select(event.alias("value"))


def with_pipeline_metrics(routed: DataFrame, observation: Observation) -> DataFrame:
    """Attach counters that fill while the job runs, without another pass.

    Build ``routed`` in a session of its own (``spark.newSession()``): reading an
    observation leaves an object in the session that cannot be serialized, which
    later breaks the scoring closures of Spark ML models in the same session.
    """
    return routed.observe(
        observation,
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("reason").isNotNull()).alias("quarantined"),
        F.count_if(F.col("reason").isNull()).alias("valid"),
    )


def scoring_summary(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("is_alert").alias("alerts"),
    ).withColumn("threshold", F.lit(float(threshold)))


def parse_event_time(text: Column) -> Column:
    """ISO time; a ``Z`` or missing zone means UTC; null when malformed."""
    return F.try_to_timestamp(F.nullif(strip(text), F.lit("")))


ACTIVATION_FIELDS = ("activation_path", "active_bundle_root", "active_bundle_name")


def summary_freshness(
    sensors: DataFrame,
    summaries: DataFrame,
    now: Column,
    activation: dict[str, str] | None = None,
    window_seconds: float = FRESHNESS_SECONDS,
) -> DataFrame:
    """State of the newest summary of every sensor.

    ``sensors`` lists the expected sensors; ``summaries`` has sensor_id, id
    (arrival order) and payload_json. ``activation`` holds the expected bundle.
    """
    latest = summaries.groupBy("sensor_id").agg(F.max_by("payload_json", "id").alias("payload"))
    joined = sensors.select("sensor_id").join(latest, "sensor_id", "left")
    payload = F.col("payload")
    joined = joined.withColumn("event_time", parse_event_time(json_text(payload, "timestamp")))
    seconds = now.cast("double") - F.col("event_time").cast("double")
    age = F.when(seconds.isNotNull(), F.greatest(seconds, F.lit(0.0)))
    mismatch = F.lit(False)
    if activation is not None:
        for name in ACTIVATION_FIELDS:
            seen = json_text(payload, "active_bundle", name)
            expected = activation.get(name)
            mismatch = mismatch | F.coalesce(seen != F.lit(expected), F.lit(True))
    state = (
        F.when(payload.isNull(), "missing")
        .when(~F.coalesce(json_text(payload, "event_type") == "live_sensor_summary", F.lit(False)), "unexpected_event")
        .when(F.col("event_time").isNull(), "malformed")
        .when(F.col("age_seconds") > window_seconds, "stale")
        .when(json_text(payload, "reason") == "capture-failure", "capture_failure")
        .when(mismatch, "mismatch")
        .otherwise("current")
    )
    aged = joined.withColumn("age_seconds", age)
    return aged.withColumn("state", state).withColumn("ok", F.col("state") == "current").select(
        "sensor_id", "state", "ok", "age_seconds"
    )


def active_bundle_state(summaries: DataFrame) -> DataFrame:
    """Active bundle object of the newest summary of every sensor."""
    newest = summaries.groupBy("sensor_id").agg(
        F.max_by("payload_json", F.struct("summary_ts", "id")).alias("payload")
    )
    return newest.select("sensor_id", json_text(F.col("payload"), "active_bundle").alias("active_bundle"))


def pipeline_rollup(manifest: DataFrame, deduped_rows: DataFrame) -> DataFrame:
    """Totals of a preparation run: raw, clean, dropped, deduplicated rows."""
    totals = manifest.agg(
        F.sum("raw_rows").alias("raw_rows"),
        F.sum("clean_rows_pre_dedupe").alias("clean_rows"),
        F.sum("dropped_rows_nan_inf").alias("dropped_rows"),
        F.count(F.lit(1)).alias("files"),
    ).withColumn("__k", F.lit(1))
    kept = deduped_rows.agg(F.count(F.lit(1)).alias("rows_after_dedupe")).withColumn("__k", F.lit(1))
    return totals.join(kept, "__k").drop("__k").withColumn(
        "duplicate_rows", F.col("clean_rows") - F.col("rows_after_dedupe")
    )
