"""Readers for the sample star schema and for scoring inputs, and plain sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.cleaning import quoted


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One sample table; zone-less timestamps become UTC timestamps."""
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


SCAN_PARTITIONS = "spark.flowlens.scan.partitions"


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan out over as many partitions as the session setting ``spark.flowlens.scan.partitions`` asks for.

    Unset, as in production, the scan is used as it is. The benchmark sets it,
    because its single-row-group file would otherwise be one task.
    """
    wanted = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted else df


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Parquet scan pruned to the given columns."""
    return spark.read.parquet(path).select(*[quoted(c) for c in columns])


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for suffix in ("csv", "parquet"):
        if name.endswith("." + suffix):
            return suffix
    raise ValueError(f"unsupported file type: {path} (expected .csv or .parquet)")


def read_scoring_input(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """CSV (all text) or parquet by suffix, optionally cut to ``limit`` rows."""
    if _suffix(path) == "csv":
        df = spark.read.option("header", True).csv(path)
    else:
        df = spark.read.parquet(path)
    return df if limit is None else df.limit(limit)


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    if _suffix(path) == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).parquet(path)


def write_splits(df: DataFrame, path: str, split: str = "split", mode: str = "overwrite") -> None:
    """One partition folder per split that has rows."""
    df.write.mode(mode).partitionBy(split).option("compression", "snappy").parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A small report as one JSON or CSV part file."""
    single = df.coalesce(1).write.mode("overwrite")
    if fmt == "json":
        single.json(path)
    elif fmt == "csv":
        single.option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported report format: {fmt}")
