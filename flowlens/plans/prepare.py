"""Batch preparation: raw CSV tree -> cleaned, split, deduplicated, pruned parquet, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.operators import cleaning, dedupe, splits, views
from flowlens.operators.reporting import pipeline_rollup
from flowlens.schemas import LABEL_COLUMNS, METADATA_COLUMNS
from flowlens.sources import flow_csv
from flowlens.sources.tables import write_report, write_splits

FILE_KEYS = ["source_file", "attack_family", "attack_scenario", "derived_label_binary", "derived_label_family"]


@dataclass(frozen=True)
class PreparedData:
    splits: str
    features: list[str]
    dropped_features: list[str]


def prepare(
    spark: SparkSession, root: str, out: str, seed: int = 42, across_splits: bool = False
) -> PreparedData:
    """Run the whole preparation.

    The CSV text is parsed once: flagged rows go to a staged parquet table in
    the output folder, which every later step reads with pruned columns. Copies
    are found by grouping on the feature values with the smallest file name.
    """
    files = flow_csv.header_reasons(flow_csv.with_headers(flow_csv.discover_files(spark, root)))
    files.write.mode("overwrite").parquet(f"{out}/_stage/files")
    checked = spark.read.parquet(f"{out}/_stage/files")
    write_report(flow_csv.quarantine_manifest(checked), f"{out}/manifests/quarantine", "csv")
    first = checked.filter(F.col("quarantine_reason").isNull()).orderBy("source_file").select("header").first()
    if first is None:
        raise ValueError("no valid input files were found")
    header = list(first["header"])
    features = cleaning.feature_columns_of(header)

    rows = flow_csv.read_valid_rows(spark, root, header, checked)
    flagged = cleaning.coerce_cells(rows, features, FILE_KEYS, "is_clean")
    flagged.write.mode("overwrite").parquet(f"{out}/_stage/rows")
    staged = spark.read.parquet(f"{out}/_stage/rows")

    manifest = staged.groupBy(*FILE_KEYS).agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if("is_clean").alias("clean_rows_pre_dedupe"),
        F.count_if(~F.col("is_clean")).alias("dropped_rows_nan_inf"),
    )
    manifest.write.mode("overwrite").parquet(f"{out}/_stage/manifest")
    manifest = spark.read.parquet(f"{out}/_stage/manifest")
    assignment = splits.assign_splits(manifest, seed)
    assignment.write.mode("overwrite").parquet(f"{out}/_stage/assignment")
    assignment = spark.read.parquet(f"{out}/_stage/assignment")
    splits.assert_disjoint(assignment)
    write_report(manifest.join(assignment, "source_file"), f"{out}/manifests/files", "csv")

    # Files are numbered in name order (one row per file), so copies are merged by
    # a hash aggregate on a number and names come back at the end.
    by_name = Window.partitionBy(F.lit(1)).orderBy("source_file")
    numbered = assignment.withColumn("file_no", F.row_number().over(by_name))
    clean = staged.filter("is_clean").drop("is_clean").join(numbered, "source_file").drop("source_file")
    across = [] if across_splits else ["split"]
    if across_splits:
        clean = clean.drop("split")
    kept = dedupe.keep_first(clean, [*features, *LABEL_COLUMNS], ["file_no"], across)
    kept = kept.drop("split").join(numbered, "file_no").drop("file_no")
    kept.write.mode("overwrite").parquet(f"{out}/_stage/kept")
    kept = spark.read.parquet(f"{out}/_stage/kept")

    pruned, useful, dropped = cleaning.prune_zero_variance(kept, features, "split")
    output = cleaning.ordered_output(pruned, useful, METADATA_COLUMNS)
    cleaning.assert_no_forbidden(output)
    cleaning.assert_finite(output, useful)
    write_splits(output, f"{out}/splits")

    write_report(views.label_distribution(kept, "derived_label_binary"), f"{out}/reports/labels")
    write_report(splits.split_targets(manifest), f"{out}/reports/targets")
    write_report(pipeline_rollup(manifest, kept), f"{out}/reports/cleaning")
    return PreparedData(f"{out}/splits", useful, dropped)


def write_views(spark: SparkSession, prepared: str, out: str) -> None:
    """Both label views of prepared splits, guarded, with reports."""
    rows: DataFrame = spark.read.parquet(prepared)
    for spec in (views.ATTACK_ONLY, views.DIRECT_MULTICLASS):
        write_splits(views.derive_view(rows, spec), f"{out}/{spec.name}")
        write_report(views.view_report(rows, spec), f"{out}/{spec.name}_report")
