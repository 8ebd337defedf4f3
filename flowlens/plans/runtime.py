"""Batch runtime: captures or flow exports -> adapted records -> scores."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.adapter import AdapterProfile, adapt, require_profile
from flowlens.operators.cleaning import align_features
from flowlens.operators.contract import FeatureContract
from flowlens.operators.flows import assemble_flows
from flowlens.operators.scoring import ScoringConfig, score_binary, score_two_stage
from flowlens.sources.flow_csv import read_flow_csv, write_flow_csv
from flowlens.sources.pcap import read_packets
from flowlens.sources.tables import read_scoring_input, write_predictions


def captures_to_flow_csv(spark: SparkSession, captures: str, out: str, profile: AdapterProfile) -> None:
    """Flow rows of all capture files, written under the profile's column names."""
    write_flow_csv(assemble_flows(read_packets(spark, captures)), out, profile)


def bridge_windows(
    spark: SparkSession, path: str, profile_id: str, contract: FeatureContract | None = None,
    profiles: dict[str, AdapterProfile] | None = None,
) -> DataFrame:
    """Adapt every row of flow CSV exports, tagged with its window file.

    An unknown profile gives one error row per window instead of records.
    """
    rows = read_flow_csv(spark, path)
    try:
        profile = require_profile(profile_id, profiles)
    except KeyError:
        return rows.select("window_path").distinct().select(
            "window_path", F.lit("adapter").alias("stage"), F.lit("unknown_adapter_profile").alias("reason")
        )
    fields = [c for c in rows.columns if c != "window_path"]
    record = F.map_filter(
        F.create_map(*[x for c in fields for x in (F.lit(c), F.col(f"`{c}`"))]), lambda k, v: v.isNotNull()
    )
    return adapt(rows.select("window_path", record.alias("record")), profile, contract)


def score_files(
    spark: SparkSession, source: str, out: str, model: PipelineModel, config: ScoringConfig,
    family_model: PipelineModel | None = None, limit: int | None = None, include_input: bool = True,
) -> DataFrame:
    """Score a CSV or parquet file set and write the predictions by suffix."""
    frame = read_scoring_input(spark, source, limit)
    aligned = align_features(frame, config.features)
    if family_model is None:
        result = score_binary(aligned, model, config, include_input)
    else:
        result = score_two_stage(aligned, model, family_model, config, include_input)
    write_predictions(result, out)
    return spark.read.parquet(out) if out.endswith(".parquet") else read_scoring_input(spark, out)
