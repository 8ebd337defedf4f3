"""Binary and two-stage scoring as column logic over model probabilities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.numeric import sigmoid
from flowlens.functions.probabilities import argmax_label, margin, top1
from flowlens.operators.boosting import MASK
from flowlens.operators.staging import compute_once
from flowlens.schemas import KNOWN_ATTACK_FAMILIES


@dataclass(frozen=True)
class ScoringConfig:
    """Everything that must stay with a trained model; fields cannot be overridden at run time."""

    threshold: float = 0.5
    positive_label: str = "Attack"
    negative_label: str = "Benign"
    features: tuple[str, ...] = ()
    family_labels: tuple[str, ...] = KNOWN_ATTACK_FAMILIES
    family_features: tuple[str, ...] = ()
    top1_threshold: float | None = None
    margin_threshold: float | None = None

    def require_family_thresholds(self) -> tuple[float, float]:
        if self.top1_threshold is None or self.margin_threshold is None:
            raise ValueError("two-stage scoring needs both abstention thresholds")
        return self.top1_threshold, self.margin_threshold


def positive_score(df: DataFrame, scaled_margin: bool = False) -> Column:
    """Positive-class score of a transformed table: probability, or sigmoid of the margin."""
    if scaled_margin or "probability" not in df.columns:
        return sigmoid(F.get(vector_to_array("rawPrediction"), F.lit(1)))
    return F.get(vector_to_array("probability"), F.lit(1))


def binary_columns(score: Column, config: ScoringConfig) -> dict[str, Column]:
    alert = score >= F.lit(config.threshold)
    return {
        "attack_score": score,
        "predicted_label": F.when(alert, config.positive_label).otherwise(config.negative_label),
        "is_alert": alert,
        "threshold": F.lit(config.threshold),
    }


def family_columns(is_alert: Column, probabilities: Column, config: ScoringConfig) -> dict[str, Column]:
    """Family, confidence, margin and status; the family only where it is known."""
    top_floor, margin_floor = config.require_family_thresholds()
    confident = (top1(probabilities) >= top_floor) & (margin(probabilities) >= margin_floor)
    return {
        "attack_family": F.when(is_alert & confident, argmax_label(probabilities, config.family_labels)),
        "attack_family_confidence": F.when(is_alert, top1(probabilities)),
        "attack_family_margin": F.when(is_alert, margin(probabilities)),
        "family_status": F.when(~is_alert, "benign").when(confident, "known").otherwise("unknown"),
    }


def score_binary(df: DataFrame, model: PipelineModel, config: ScoringConfig, include_input: bool = True) -> DataFrame:
    keep = list(df.columns) if include_input else []
    scored = model.transform(df)
    columns = binary_columns(positive_score(scored), config)
    return scored.select(*[F.col(f"`{c}`") for c in keep], *[c.alias(n) for n, c in columns.items()])


def score_two_stage(
    df: DataFrame,
    model: PipelineModel,
    family_model: PipelineModel,
    config: ScoringConfig,
    include_input: bool = True,
) -> DataFrame:
    """Binary score, then family columns on alert rows, in one pass over the input.

    Family features are only needed on alert rows: a null there fails the job,
    while benign rows get a neutral value and their family result is blank. Boosted
    family models score alert rows only; those of Spark ML have no way to skip a row.
    Splitting the rows into two branches would read and score everything twice.
    """
    config.require_family_thresholds()
    first = model.transform(df)
    names = list(binary_columns(F.lit(0.0), config))
    base = list(df.columns) if include_input else []
    kept = {c: f"__in{i}" for i, c in enumerate(df.columns)}
    scored = compute_once(
        first.select(*[F.col(f"`{c}`").alias(k) for c, k in kept.items()], positive_score(first).alias("attack_score")),
        binary_columns(F.col("attack_score"), config),
    )
    alert = F.col("is_alert")

    def stage2_input(name: str) -> Column:
        value = F.col(kept[name])
        if name not in config.family_features:
            return value.alias(name)
        problem = F.lit(f"stage 2 feature {name} is missing on an alert row")
        required = F.when(value.isNull(), F.raise_error(problem).cast("double")).otherwise(value)
        return F.when(alert, required).otherwise(F.lit(0.0)).alias(name)

    wanted = [c for c in df.columns if not config.family_features or c in config.family_features]
    second = family_model.transform(
        scored.select(*kept.values(), *names, alert.alias(MASK), *[stage2_input(c) for c in wanted])
    )
    staged = compute_once(second, {"__probability": vector_to_array("probability")})
    columns = family_columns(alert, F.col("__probability"), config)
    return staged.select(
        *[F.col(kept[c]).alias(c) for c in base], *names, *[c.alias(n) for n, c in columns.items()]
    )


def prediction_events(scored: DataFrame, index: str = "record_index", passthrough: str = "passthrough",
                      two_stage: bool = False, source: str | None = None) -> DataFrame:
    """JSON ``model_prediction`` events, benign rows included; ``source`` names the file a record came from."""
    fields = [
        F.lit("model_prediction").alias("event_type"),
        F.col(index).alias("record_index"),
        *([F.col(source).alias("source_file")] if source else []),
        F.col(passthrough),
        "attack_score", "predicted_label", "is_alert", "threshold",
    ]
    if two_stage:
        fields += ["attack_family", "attack_family_confidence", "attack_family_margin", "family_status"]
    event = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return scored.select("is_alert", event.alias("value"))
