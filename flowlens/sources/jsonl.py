"""JSON-lines readers (batch and streaming) and event sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.functions.numeric import strip
from flowlens.functions.records import is_json, last_wins, parsed_array, parsed_object
from flowlens.operators.staging import compute_once, lookup
from flowlens.schemas import INGEST_ERROR_PREVIEW

TOO_LARGE = "jsonl_line_too_large"
INVALID_JSON = "invalid_json"
INVALID_TYPE = "invalid_record_type"


def read_lines(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    """Lines of text files as (source, line_number, value); line numbers start at 1.

    Numbers are counted per file block and shifted by the lines of the blocks
    before, so a huge file is numbered in parallel.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("__block"),
        "value",
    )
    if not numbered:
        return lines.select("source", "value")
    return number_lines(lines)


def number_lines(lines: DataFrame) -> DataFrame:
    """(source, line_number, value) of lines that still have their file block.

    A task reads a block from its first line to its last, so a line's place in its
    block is its row number there; lines stay where they are read, and only one row
    per block is shuffled.
    """
    placed = lines.withColumn("__seq", F.monotonically_increasing_id())
    blocks = placed.groupBy("source", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__seq").alias("__first"))
    earlier = Window.partitionBy("source").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("source", "__block", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    number = F.col("__before") + F.col("__seq") - F.col("__first") + 1
    return placed.join(lookup(starts), ["source", "__block"]).select("source", number.alias("line_number"), "value")


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None, blocks: bool = False) -> DataFrame:
    """Landed text files as a stream of (source, value), with the file block for :func:`number_lines` if asked."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    block = [F.col("_metadata.file_block_start").alias("__block")] if blocks else []
    return reader.load(path).select(F.col("_metadata.file_path").alias("source"), *block, "value")


def parse_reason(line: Column, record: Column, max_length: int | None = None) -> Column:
    too_large = F.lit(False) if max_length is None else F.length(line) > max_length
    return (
        F.when(too_large, TOO_LARGE)
        .when(record.isNotNull(), F.lit(None).cast("string"))
        .when(is_json(line), INVALID_TYPE)
        .otherwise(INVALID_JSON)
    )


def parse_lines(
    lines: DataFrame, value: str = "value", max_length: int | None = None
) -> DataFrame:
    """Add ``record`` (map or null) and ``parse_reason`` (null when parsed).

    Blank lines are dropped but keep their place in the numbering. Lines have no
    limit unless ``max_length`` sets one, as the adapter does; longer ones are
    then not parsed, and only their length and first characters are kept.
    """
    text = F.col(value)
    fits = F.lit(True) if max_length is None else F.length(text) <= max_length
    short = F.when(fits, text)
    lines = lines.filter(strip(text) != "")
    parsed = compute_once(lines, {"__parsed": parsed_array(short)})
    objects = compute_once(parsed, {"__object": parsed_object(F.col("__parsed"))})
    return compute_once(objects, {
        "record": last_wins(F.col("__object")),
        "parse_reason": parse_reason(text, F.col("__object"), max_length),
        "raw_char_count": F.length(text).cast("long"),
        value: F.when(fits, text).otherwise(F.substring(strip(text), 1, INGEST_ERROR_PREVIEW)),
    }).drop("__parsed", "__object")


def parse_anomalies(parsed: DataFrame, stream_name: str, event_ts: Column, sensor_id: str) -> DataFrame:
    """Anomaly rows for lines that are not JSON; the first characters are kept."""
    bad = parsed.filter(F.col("parse_reason").isNotNull())
    return bad.select(
        F.lit(sensor_id).alias("sensor_id"),
        F.lit(None).cast("string").alias("source_event_id"),
        event_ts.cast("string").alias("event_ts"),
        F.lit("ingest_parse_error").alias("anomaly_type"),
        F.concat(F.lit(f"{stream_name}: "), F.col("parse_reason")).alias("reason"),
        F.lit(f"ingest parse failure in {stream_name}").alias("redacted_summary"),
        F.to_json(F.struct(
            F.lit(stream_name).alias("stream_name"),
            F.substring(strip(F.col("value")), 1, INGEST_ERROR_PREVIEW).alias("raw_line"),
        )).alias("payload_json"),
    )
