"""Multiclass reports, out-of-distribution profiles and gated evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.metrics import f1
from flowlens.functions.numeric import safe_ratio
from flowlens.functions.records import literal_array
from flowlens.operators.ordering import numeric_profile


def label_index(labels: Sequence[str]) -> dict[str, int]:
    return {label: i for i, label in enumerate(labels)}


def with_label_index(df: DataFrame, label: str, labels: Sequence[str], out: str = "label_index") -> DataFrame:
    """Class index of a label; rows with any other label are dropped."""
    position = F.array_position(literal_array(labels), F.col(label)).cast("int") - 1
    return df.withColumn(out, position).filter(F.col(out) >= 0)


def confusion_matrix(
    df: DataFrame, truth: str, predicted: str, labels: Sequence[str], groups: Sequence[str] = ()
) -> DataFrame:
    """Long matrix (true_label, pred_label, n) over a fixed label order, zeros kept."""
    known = df.filter(F.col(truth).isin(*labels) & F.col(predicted).isin(*labels))
    counts = known.groupBy(
        *groups, F.col(truth).alias("true_label"), F.col(predicted).alias("pred_label")
    ).agg(F.count(F.lit(1)).alias("n"))
    # At most len(labels)^2 counts per group, so one map per group is bounded.
    packed = counts.groupBy(*groups).agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.struct("true_label", "pred_label"), "n"))
        ).alias("__cells")
    )
    cells = F.explode(F.array(*[
        F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("pred_label"))
        for t in labels for p in labels
    ]))
    return packed.withColumn("__c", cells).select(
        *groups, "__c.true_label", "__c.pred_label",
        F.coalesce(F.try_element_at("__cells", F.col("__c")), F.lit(0).cast("long")).alias("n"),
    )


def class_report(matrix: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, f1 and support per class from a long confusion matrix."""
    hit = F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)
    sides = matrix.select(
        *groups,
        F.explode(F.array(
            F.struct(F.col("true_label").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), hit.alias("h")),
            F.struct(F.col("pred_label").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")),
        )).alias("s"),
    )
    totals = sides.groupBy(*groups, F.col("s.label").alias("label")).agg(
        F.sum("s.t").alias("support"), F.sum("s.p").alias("__pred"), F.sum("s.h").alias("__hit")
    )
    p = safe_ratio(F.col("__hit"), F.col("__pred"))
    r = safe_ratio(F.col("__hit"), F.col("support"))
    return totals.select(
        *groups, "label", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), "support",
        F.col("__hit").alias("hits"),
    )


def overall_report(report: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro and weighted averages from a class report."""
    weight = F.col("support")
    return report.groupBy(*groups).agg(
        F.sum(weight).alias("rows"),
        safe_ratio(F.sum("hits"), F.sum(weight)).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        safe_ratio(F.sum(F.col("f1") * weight), F.sum(weight)).alias("weighted_f1"),
    )


def ood_prediction_counts(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Predicted-family counts per true family and overall (null true family)."""
    return (
        df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
        .groupingSets([[F.col(truth), F.col(predicted)], [F.col(predicted)]], truth, predicted)
        .agg(F.sum("n").alias("n"))
    )


def ood_profile(
    df: DataFrame, truth: str, predicted: str, top1: str, margin: str
) -> DataFrame:
    """Rows, distinct predicted families and confidence profiles per true family."""
    base = df.groupBy(truth).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(predicted).alias("predicted_rows"),
    )
    base = base.withColumn("zero_pass_through", (F.col("rows") > 0) & (F.col("predicted_rows") == 0))
    for name, column in (("top1", top1), ("margin", margin)):
        profile = numeric_profile(df, [truth], column)
        renamed = profile.select(
            truth, *[F.col(c).alias(f"{name}_{c}") for c in profile.columns if c != truth]
        )
        base = base.join(renamed, truth, "left")
    return base


def gated_summary(
    df: DataFrame, groups: Sequence[str], alert: str, scored: str | None = None
) -> DataFrame:
    """Stage-1 alert rate and stage-2 row count; denominators are all rows."""
    hit = F.col(alert)
    stage2 = hit if scored is None else hit & F.col(scored).isNotNull()
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(hit).alias("stage1_alert_rows"),
        F.count_if(stage2).alias("stage2_scored_rows"),
    ).withColumns({
        "stage1_alert_rate": safe_ratio(F.col("stage1_alert_rows"), F.greatest(F.lit(1), F.col("rows"))),
        "zero_pass_through": F.col("stage1_alert_rows") == 0,
    })


def gated_class_report(
    df: DataFrame, alert: str, truth: str, predicted: str, labels: Sequence[str]
) -> DataFrame:
    """Family quality measured only on rows that passed stage 1."""
    return class_report(confusion_matrix(df.filter(F.col(alert)), truth, predicted, labels))


def oracle_gap(oracle: DataFrame, gated: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Difference between evaluation on all rows and on gated rows."""
    left = oracle.select(*keys, F.col(metric).alias(f"oracle_{metric}"))
    right = gated.select(*keys, F.col(metric).alias(f"gated_{metric}"))
    return left.join(right, list(keys), "full").withColumn(
        "gap", F.col(f"oracle_{metric}") - F.col(f"gated_{metric}")
    )


def abstention_thresholds(df: DataFrame, top1: str, margin: str) -> DataFrame:
    """Mean out-of-distribution confidence and margin, used as abstention floors."""
    return df.agg(
        F.avg(top1).alias("top1_confidence_threshold"),
        F.avg(margin).alias("runner_up_margin_threshold"),
    )
