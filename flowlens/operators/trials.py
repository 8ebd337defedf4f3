"""Trial metrics, ranking, promotion, leaderboards and learning-curve summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.evaluation import (
    choose_threshold,
    confusion_at_threshold,
    evaluate_at_threshold,
    threshold_sweep,
)
from flowlens.functions.metrics import with_metrics
from flowlens.operators.staging import lookup
from flowlens.schemas import GATE_MAX_FPR, PROMOTION_PLAN, TUNING_FPR_CAPS


def _at_tuned_points(df, trial, truth, score, points) -> DataFrame:
    """Confusion metrics of each trial at its own threshold."""
    joined = df.join(lookup(points.select(trial, "threshold")), trial)
    counts = confusion_at_threshold(joined, [trial], truth, score, F.col("threshold"))
    return with_metrics(counts)


def trial_metrics(
    df: DataFrame,
    trial: str,
    split: str,
    truth: str,
    score: str,
    caps: Sequence[float] = TUNING_FPR_CAPS,
    thresholds: Sequence[float] | None = None,
) -> DataFrame:
    """One row per trial: default and tuned metrics on ``val``, recall on ``ood``."""
    val = df.filter(F.col(split) == "val")
    ood = df.filter(F.col(split) == "ood")
    sweep = threshold_sweep(val, [trial], truth, score, thresholds)
    ood_sweep = threshold_sweep(ood, [trial], truth, score, thresholds)
    result = evaluate_at_threshold(val, [trial], truth, score, 0.5).select(
        trial,
        F.col("f1").alias("val_f1_at_default_0.5"),
        F.col("recall").alias("val_recall_at_default_0.5"),
        F.col("fpr").alias("val_fpr_at_default_0.5"),
    )
    default_ood = evaluate_at_threshold(ood, [trial], truth, score, 0.5).select(
        trial, F.col("recall").alias("ood_recall_at_default_0.5")
    )
    result = result.join(default_ood, trial, "left")
    for cap in caps:
        key = f"cap_{cap:.3f}"
        point = choose_threshold(sweep, [trial], cap)
        tuned = _at_tuned_points(val, trial, truth, score, point).select(
            trial,
            F.col("f1").alias(f"val_f1_at_tuned_{key}"),
            F.col("recall").alias(f"val_recall_at_tuned_{key}"),
            F.col("fpr").alias(f"val_fpr_at_tuned_{key}"),
        )
        own_ood = _at_tuned_points(
            ood, trial, truth, score, choose_threshold(ood_sweep, [trial], cap)
        ).select(trial, F.col("recall").alias(f"ood_recall_at_tuned_{key}"))
        result = (
            result.join(point.select(trial, F.col("threshold").alias(f"val_threshold_at_{key}")), trial, "left")
            .join(tuned, trial, "left")
            .join(own_ood, trial, "left")
        )
    return result


def _rank_order():
    return [
        F.col("passes_gate").desc(),
        F.col("`val_f1_at_tuned_cap_0.010`").desc(),
        F.col("`val_fpr_at_default_0.5`").asc(),
        F.col("`ood_recall_at_tuned_cap_0.020`").desc(),
        F.col("train_seconds").asc(),
    ]


def rank_trials(trials: DataFrame, model: str | None = "model_name", tie: str = "trial_id") -> DataFrame:
    """Gate, then best tuned f1, lowest default fpr, ood recall, fastest."""
    gated = trials.withColumn("passes_gate", F.col("`val_fpr_at_default_0.5`") <= GATE_MAX_FPR)
    scope = Window.partitionBy(model) if model else Window.partitionBy(F.lit(1))
    return gated.withColumn(
        "trial_rank", F.row_number().over(scope.orderBy(*_rank_order(), F.col(tie).asc()))
    )


def promoted_trials(
    trials: DataFrame, plan: dict[str, int] | None = None, tie: str = "trial_id"
) -> DataFrame:
    """Top-k trials per model; the literal upper bound lets Spark rank per partition first."""
    plan = plan or PROMOTION_PLAN
    wanted = trials.filter(F.col("model_name").isin(*plan))
    top = rank_trials(wanted, tie=tie).filter(F.col("trial_rank") <= max(plan.values()))
    allowed = None
    for name, k in plan.items():
        step = F.col("model_name") == name
        allowed = F.when(step, F.lit(k)) if allowed is None else allowed.when(step, F.lit(k))
    return top.filter(F.col("trial_rank") <= allowed)


def leaderboard(summary: DataFrame, by: str = "test_f1") -> DataFrame:
    return summary.orderBy(F.col(by).desc())


def learning_curve_summary(
    curves: DataFrame, model: str = "model", stage: str = "stage_index",
    train: str = "train_f1", val: str = "val_f1",
) -> DataFrame:
    """First, last and best stage per model, with gap and gains."""
    point = F.struct(F.col(train).alias("train"), F.col(val).alias("val"), F.col(stage).alias("stage"))
    packed = curves.groupBy(model).agg(
        F.count(F.lit(1)).alias("curve_points"),
        F.min_by(point, stage).alias("first"),
        F.max_by(point, stage).alias("last"),
        F.max_by(point, F.struct(F.col(val), -F.col(stage))).alias("best"),
    )
    return packed.select(
        model,
        "curve_points",
        F.col("first.train").alias("train_f1_start"),
        F.col("first.val").alias("val_f1_start"),
        F.col("last.train").alias("train_f1_end"),
        F.col("last.val").alias("val_f1_end"),
        (F.col("last.train") - F.col("last.val")).alias("generalization_gap_end"),
        F.col("best.val").alias("best_val_f1"),
        F.col("best.stage").alias("best_stage_index"),
        (F.col("last.val") - F.col("first.val")).alias("val_gain"),
        (F.col("last.train") - F.col("first.train")).alias("train_gain"),
    )


def curve_with_summary(curves: DataFrame, summary: DataFrame, model: str = "model") -> DataFrame:
    """Learning-curve summary joined with the final metrics of each model."""
    return learning_curve_summary(curves, model).join(summary, model)
