"""Streaming form of validate -> route -> score, and of alert storage.

Sources are landed, immutable files, or growing ones that are tailed. Every sink folder is written per batch
under ``batch_id=<n>`` in overwrite mode, so a batch that is retried after a
failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlens.operators.alerts import alert_rows, anomaly_rows, summary_rows, upsert_alerts, upsert_summaries
from flowlens.operators.contract import FeatureContract, quarantine_events, quarantined_records, valid_records, validate
from flowlens.operators.scoring import prediction_events
from flowlens.schemas import DEFAULT_SENSOR_ID
from flowlens.sources.jsonl import number_lines, parse_anomalies, parse_lines, stream_lines
from flowlens.sources.tail import tail_lines
from flowlens.streaming import state
from flowlens.streaming.state import BATCH

Scorer = Callable[[DataFrame], DataFrame]


def _write(df: DataFrame, folder: str, batch_id: int, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(f"{folder}/{BATCH}={batch_id}")


def _start(stream: DataFrame, handle, checkpoint: str, drain: bool, seconds: float) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if drain else {"processingTime": f"{seconds} seconds"}
    return writer.trigger(**trigger).start()


def routed_records(lines: DataFrame, contract: FeatureContract) -> DataFrame:
    """Parsed and validated lines; works on batch and streaming tables alike."""
    return validate(parse_lines(lines), contract, keep_reason="parse_reason")


def score_stream(
    spark: SparkSession,
    source: str,
    contract: FeatureContract,
    scorer: Scorer,
    out: str,
    checkpoint: str,
    two_stage: bool = False,
    max_files: int | None = None,
    drain: bool = False,
    seconds: float = 1.0,
) -> StreamingQuery:
    """Landed JSON lines -> prediction, alert and quarantine event folders.

    ``scorer`` gets valid rows with ``features`` and adds the scoring columns. A
    failure in it fails the batch. Alert events leave out benign predictions,
    which stay in the prediction folder.
    """
    lines = stream_lines(spark, source, max_files, blocks=True)

    def handle(batch: DataFrame, batch_id: int) -> None:
        routed = routed_records(number_lines(batch), contract).withColumnRenamed("line_number", "record_index").persist()
        try:
            _write(quarantine_events(quarantined_records(routed)), f"{out}/quarantine", batch_id, "text")
            events = prediction_events(scorer(valid_records(routed)), two_stage=two_stage, source="source")
            _write(events, f"{out}/predictions", batch_id, "parquet")
        finally:
            routed.unpersist()

    return _start(lines, handle, checkpoint, drain, seconds)


def alert_events(spark: SparkSession, out: str) -> DataFrame:
    """Alert events of a scored stream: predictions without the benign ones."""
    return spark.read.parquet(f"{out}/predictions").filter("is_alert").select("value")


def ingest_stream(
    spark: SparkSession,
    source: str,
    kind: str,
    store: str,
    checkpoint: str,
    sensor_id: str = DEFAULT_SENSOR_ID,
    drain: bool = False,
    seconds: float = 1.0,
    tail: bool = False,
    compact_every: int = state.EVERY,
) -> StreamingQuery:
    """Sensor output of one kind (alert, anomaly, summary) into stored tables.

    ``source`` holds landed files or, with ``tail``, files that still grow. Rows are appended; every ``compact_every`` batches those of alerts and summaries are merged
    into a snapshot. :func:`stored_alerts` and :func:`stored_summaries` give the
    upserted state. Lines that are not JSON
    become anomalies.
    """
    builders = {"alert": alert_rows, "anomaly": anomaly_rows, "summary": summary_rows}
    if kind not in builders:
        raise ValueError(f"unknown stream kind: {kind}")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")

    def handle(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_lines(batch).persist()
        try:
            good = parsed.filter(F.col("parse_reason").isNull()).select(
                F.col("value").alias("payload_json"), F.monotonically_increasing_id().alias("row_id")
            )
            columns = builders[kind](good, now, sensor_id=sensor_id)
            if "row_id" not in columns.columns:
                columns = columns.withColumn("row_id", F.monotonically_increasing_id())
            _write(columns, f"{store}/{kind}", batch_id)
            _write(parse_anomalies(parsed, kind, now, sensor_id), f"{store}/parse_errors/stream={kind}", batch_id)
            if kind in MERGES and (batch_id + 1) % compact_every == 0:
                state.compact(batch.sparkSession, f"{store}/{kind}", MERGES[kind], batch_id)
        finally:
            parsed.unpersist()

    lines = tail_lines(spark, source).drop("start") if tail else stream_lines(spark, source)
    return _start(lines, handle, checkpoint, drain, seconds)


def _arrivals(rows: DataFrame) -> DataFrame:
    """Stored rows with their arrival order as (batch, row)."""
    return rows.withColumn("arrival", F.struct(F.col(BATCH).cast("long").alias(BATCH), "row_id")).drop(BATCH, "row_id")


def _merged_alerts(held: DataFrame | None, rows: DataFrame | None) -> DataFrame:
    """Alerts after upserts on (sensor, source id); ``id`` is the first arrival."""
    later = None if rows is None else _arrivals(rows).withColumnRenamed("arrival", "id")
    if later is None:
        return held
    return upsert_alerts(later.filter("false") if held is None else held, later)


def _merged_summaries(held: DataFrame | None, rows: DataFrame | None) -> DataFrame:
    later = None if rows is None else _arrivals(rows).withColumnRenamed("arrival", "updated_at")
    if later is None:
        return held
    return upsert_summaries(later.filter("false") if held is None else held, later)


MERGES = {"alert": _merged_alerts, "summary": _merged_summaries}


def _state(spark: SparkSession, store: str, kind: str) -> DataFrame:
    parts = state.parts(spark, f"{store}/{kind}")
    if parts == (None, None):
        raise ValueError(f"nothing is stored in {store}/{kind}")
    return MERGES[kind](*parts)


def stored_alerts(spark: SparkSession, store: str) -> DataFrame:
    """Alert table after upserts on (sensor, source id), newest fields, first triage state."""
    # The first arrival never changes, so neither does the long id made of it.
    return _state(spark, store, "alert").withColumn("id", F.xxhash64("id").bitwiseAND(F.lit((1 << 63) - 1)))


def stored_summaries(spark: SparkSession, store: str) -> DataFrame:
    return _state(spark, store, "summary").drop("updated_at")
