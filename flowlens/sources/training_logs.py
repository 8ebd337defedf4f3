"""Scans of training results and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.numeric import strip
from flowlens.functions.records import literal_map
from flowlens.operators.trials import leaderboard

# Fixed value: one progress line of a boosted-tree trainer.
PROGRESS_LINE = r"^(\d+):\s+learn:\s([0-9.]+)\s+test:\s([0-9.]+)"
SUMMARY_METRICS = (
    "train_seconds", "val_f1", "test_f1", "test_recall", "test_precision", "test_fpr", "ood_recall",
)


def read_benchmark_summaries(spark: SparkSession, root: str, labels: dict[str, str]) -> DataFrame:
    """Per-model ``summary.csv`` files below ``root/<model>/`` as one leaderboard."""
    rows = spark.read.option("header", True).csv(f"{root}/*/summary.csv")
    key = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return benchmark_summary(rows.withColumn("model_key", key), labels)


def benchmark_summary(rows: DataFrame, labels: dict[str, str]) -> DataFrame:
    named = rows.withColumn("model_label", F.try_element_at(literal_map(labels), F.col("model_key")))
    chosen = named.filter(F.col("model_label").isNotNull()).select(
        "model_key", "model_label", *[F.col(m).try_cast("double").alias(m) for m in SUMMARY_METRICS]
    )
    return leaderboard(chosen)


def read_log_events(spark: SparkSession, path: str) -> DataFrame:
    """Log events as (time, data, source); a log is JSON objects, one per line or an array."""
    return spark.read.schema("time double, data string").json(path).withColumn(
        "source", F.col("_metadata.file_path")
    )


def progress_rows(events: DataFrame) -> DataFrame:
    """Iteration, train and validation score of every progress line."""
    data = strip(F.col("data"))
    return events.filter(data.rlike(PROGRESS_LINE)).select(
        F.regexp_extract(data, PROGRESS_LINE, 1).cast("int").alias("iteration"),
        F.regexp_extract(data, PROGRESS_LINE, 2).cast("double").alias("learn_f1"),
        F.regexp_extract(data, PROGRESS_LINE, 3).cast("double").alias("val_f1"),
        F.col("time").cast("double").alias("wall_time_seconds"),
    )


def epoch_timeline(events: DataFrame, model: str, marker: str) -> DataFrame:
    """Log lines that contain ``marker``, with their time."""
    data = strip(F.col("data"))
    return events.filter(data.contains(marker)).select(
        F.lit(model).alias("model"),
        data.alias("event"),
        F.col("time").cast("double").alias("wall_time_seconds"),
    )
