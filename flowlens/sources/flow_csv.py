"""Trees of raw flow CSV files: discovery, labels, header checks, scans, export."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.metadata import is_known_bad, is_known_family, path_labels, relative_path
from flowlens.operators.adapter import AdapterProfile, to_source_names
from flowlens.operators.cleaning import quoted
from flowlens.operators.flows import flow_order
from flowlens.schemas import EXPECTED_COLUMN_COUNT, EXPECTED_FIRST_COLUMN, LEAKAGE_COLUMNS

_CHUNK = 1 << 16
_SEPARATOR = "\x1f"


def discover_files(spark: SparkSession, root: str) -> DataFrame:
    """CSV files below ``root`` whose first folder is a known family, with labels.

    Listing goes through Spark's file source without reading any content.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .load(root)
        .select("path", "length")
    )
    named = listed.withColumn("source_file", relative_path(F.col("path"), root))
    labelled = named.withColumns(path_labels(F.col("source_file")))
    return labelled.filter(is_known_family(F.col("attack_family")))


def first_line(read: Callable[[int], bytes]) -> bytes:
    """Bytes up to the first line end, however long the line is."""
    held = b""
    while chunk := read(_CHUNK):
        held += chunk
        if ends := [k for k in (held.find(b"\n"), held.find(b"\r")) if k >= 0]:
            return held[:min(ends)]
    return held


def _read_headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First line of each file, read where the task runs.

    A line that is no CSV header is recorded; storage that cannot be read fails
    the job, since leaving out its files would lose data unseen.
    """
    import csv

    from pyarrow import fs

    for batch in batches:
        headers, errors = [], []
        for path in batch["path"]:
            plain = path if "://" in path else path.replace("file:", "file://", 1)
            system, inner = fs.FileSystem.from_uri(plain)
            with system.open_input_file(inner) as handle:
                line = first_line(handle.read)
            try:
                text = line.decode("utf-8-sig")
                if not text.strip():
                    raise EOFError("empty file")
                headers.append(_SEPARATOR.join(next(csv.reader([text]))))
                errors.append(None)
            except (UnicodeDecodeError, csv.Error, EOFError) as error:
                headers.append(None)
                errors.append(type(error).__name__)
        yield batch.assign(header=headers, read_error=errors)


def with_headers(files: DataFrame) -> DataFrame:
    """Add the header fields of every file; only its first line is read."""
    base = files.select("path", "source_file")
    schema = T.StructType([*base.schema.fields, T.StructField("header", T.StringType()),
                           T.StructField("read_error", T.StringType())])
    probed = base.mapInPandas(_read_headers, schema)
    columns = F.split("header", _SEPARATOR)
    return files.join(probed.select("source_file", columns.alias("header"), "read_error"), "source_file")


def header_reasons(
    files: DataFrame,
    expected_count: int = EXPECTED_COLUMN_COUNT,
    first_column: str = EXPECTED_FIRST_COLUMN,
) -> DataFrame:
    """Quarantine reason per file (null when valid), joined with a pipe.

    The first valid file in name order fixes the feature list; valid files with
    another list are quarantined as ``feature_schema_mismatch``.
    """
    size, first = F.size("header"), F.get("header", F.lit(0))
    checks = F.concat_ws(
        "|",
        F.when(is_known_bad(F.col("source_file")), F.lit("known_bad_file")),
        F.when(size != expected_count, F.concat(F.lit("unexpected_column_count:"), size.cast("string"))),
        F.when(first != first_column, F.concat(F.lit("unexpected_first_column:"), first)),
    )
    reason = F.when(
        F.col("read_error").isNotNull(), F.concat(F.lit("read_header_failed:"), F.col("read_error"))
    ).otherwise(F.nullif(checks, F.lit("")))
    drop = F.array(*[F.lit(c) for c in LEAKAGE_COLUMNS])
    checked = files.withColumns({
        "quarantine_reason": reason,
        "features": F.filter("header", lambda c: ~F.array_contains(drop, c)),
    })
    standard = checked.filter(F.col("quarantine_reason").isNull()).agg(
        F.min_by("features", "source_file").alias("standard"),
    ).withColumn("__k", F.lit(1))
    # ``standard`` is a single row, so this is a constant lookup.
    joined = checked.withColumn("__k", F.lit(1)).join(F.broadcast(standard), "__k", "left")
    mismatch = F.col("quarantine_reason").isNull() & (F.col("features") != F.col("standard"))
    return joined.withColumn(
        "quarantine_reason",
        F.when(mismatch, F.lit("feature_schema_mismatch")).otherwise(F.col("quarantine_reason")),
    ).drop("__k", "standard")


def quarantine_manifest(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("quarantine_reason").isNotNull()).select(
        "source_file", "attack_family", "attack_scenario", "quarantine_reason"
    )


def read_flow_rows(
    spark: SparkSession, root: str | list[str], header: Sequence[str], recursive: bool = True, base: str | None = None
) -> DataFrame:
    """All rows of a CSV tree (or of listed files below ``base``) as text columns, with the relative source file."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True)
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    rows = reader.csv(root)
    return rows.withColumn("source_file", relative_path(F.col("_metadata.file_path"), base or root))


def read_valid_rows(spark: SparkSession, root: str, header: Sequence[str], checked: DataFrame) -> DataFrame:
    """Rows of valid files only, with path labels, under the columns of ``header``.

    Columns are bound by name: files that share the given header are read as one
    tree, and files that order their columns otherwise are read by their own
    headers. Quarantined files are removed by an anti join on the file name;
    families outside the known order are dropped as in discovery.
    """
    valid = F.col("quarantine_reason").isNull()
    same = F.coalesce(F.col("header") == F.array(*[F.lit(c) for c in header]), F.lit(False))
    left_out = checked.filter(~valid | ~same).select("source_file")
    kept = read_flow_rows(spark, root, header).join(left_out, "source_file", "left_anti")
    # File lists are metadata the driver plans scans with anyway; headers are few.
    others = checked.filter(valid & ~same).groupBy("header").agg(F.collect_list("path").alias("paths")).collect()
    for group in others:
        rows = read_flow_rows(spark, group["paths"], group["header"], recursive=False, base=root)
        kept = kept.unionByName(rows, allowMissingColumns=True)
    kept = kept.select(*[quoted(c) for c in header], "source_file")
    labelled = kept.withColumns(path_labels(F.col("source_file")))
    return labelled.filter(is_known_family(F.col("attack_family")))


def read_flow_csv(spark: SparkSession, path: str) -> DataFrame:
    """Flow CSV exports with a header, all text, tagged with their file.

    A missing header leaves no columns to read, which fails the job.
    """
    rows = spark.read.option("header", True).csv(path)
    if not rows.columns:
        raise ValueError(f"flow CSV has no header: {path}")
    return rows.withColumn("window_path", F.col("_metadata.file_path"))


def csv_number(value: Column) -> Column:
    """Whole numbers without a point, others with up to six decimals, no trailing zeros."""
    number = value.cast("double")
    rounded = F.format_string("%.6f", number)
    trimmed = F.regexp_replace(F.regexp_replace(rounded, "0+$", ""), r"\.$", "")
    return F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(trimmed)


def flow_export(flows: DataFrame, profile: AdapterProfile) -> DataFrame:
    """Flows under the profile's column names, numbers formatted, in stable order."""
    numeric = (T.DoubleType, T.FloatType)
    ordered = flows.orderBy("window_path", *flow_order())
    formatted = ordered.withColumns({
        f.name: csv_number(F.col(f"`{f.name}`"))
        for f in flows.schema.fields
        if isinstance(f.dataType, numeric) and f.name in profile.feature_map.values()
    })
    return to_source_names(formatted, profile)


def write_flow_csv(flows: DataFrame, path: str, profile: AdapterProfile) -> None:
    flow_export(flows, profile).write.mode("overwrite").option("header", True).csv(path)
