"""Streaming incident counts and duplicate removal with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlens.streaming import state

DEFAULT_LATENESS = "10 minutes"
KEYS = ("src_ip", "dst_ip", "protocol")
PORTS = ("src_port", "dst_port")  # their sets are bounded by the range of ports


def unique_alerts(alerts: DataFrame, ts: str = "event_time", lateness: str = DEFAULT_LATENESS) -> DataFrame:
    """Drop repeated (sensor, source id) arrivals; rows without an id are kept.

    State is one entry per id and expires with the watermark.
    """
    timed = alerts.withWatermark(ts, lateness)
    named = timed.filter(F.col("source_event_id").isNotNull())
    loose = timed.filter(F.col("source_event_id").isNull())
    return named.dropDuplicatesWithinWatermark(["sensor_id", "source_event_id"]).unionByName(loose)


def windowed_incidents(
    alerts: DataFrame, ts: str = "event_time", width: str = "1 minute", lateness: str | None = DEFAULT_LATENESS
) -> DataFrame:
    """Count, port sets and top score per endpoints, protocol and time window.

    Batch incidents bucket by the text prefix of the time; here window and
    lateness are event time. ``lateness=None`` is for batch tables.
    """
    source = alerts if lateness is None else alerts.withWatermark(ts, lateness)
    return source.groupBy(F.window(ts, width), *KEYS).agg(
        F.count(F.lit(1)).alias("incident_alert_count"),
        F.max("attack_score").alias("attack_score"),
        F.min("dst_port").alias("lowest_dst_port"),
        F.max("dst_port").alias("highest_dst_port"),
        *[F.array_sort(F.collect_set(c)).alias(f"incident_{c}s") for c in PORTS if c in alerts.columns],
    ).select(
        F.col("window.start").alias("window_start"), *KEYS, "incident_alert_count", "attack_score",
        "lowest_dst_port", "highest_dst_port", *[f"incident_{c}s" for c in PORTS if c in alerts.columns],
    )


def incident_stream(
    alerts: DataFrame, out: str, checkpoint: str, drain: bool = False, seconds: float = 1.0,
    width: str = "1 minute", lateness: str = DEFAULT_LATENESS, compact_every: int = state.EVERY,
) -> StreamingQuery:
    """Write changed incidents of every batch; :func:`latest_incidents` reads the state."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            state.compact(batch.sparkSession, out, _newest, batch_id)

    writer = windowed_incidents(alerts, width=width, lateness=lateness).writeStream.outputMode("update")
    trigger = {"availableNow": True} if drain else {"processingTime": f"{seconds} seconds"}
    return writer.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _newest(held: DataFrame | None, rows: DataFrame | None) -> DataFrame:
    """Newest version of every incident; ``version`` is the batch it is from."""
    if rows is None:
        return held
    rows = rows.withColumn("version", F.col("batch_id").cast("long")).drop("batch_id")
    every = rows if held is None else held.unionByName(rows)
    keys = ["window_start", *KEYS]
    values = [c for c in every.columns if c not in (*keys, "version")]
    newest = every.groupBy(*keys).agg(F.max_by(F.struct(*values), "version").alias("v"), F.max("version").alias("version"))
    return newest.select(*keys, "v.*", "version")


def latest_incidents(spark: SparkSession, out: str) -> DataFrame:
    """Newest version of every incident written by :func:`incident_stream`."""
    parts = state.parts(spark, out)
    if parts == (None, None):
        raise ValueError(f"nothing is stored in {out}")
    return _newest(*parts).drop("version")
