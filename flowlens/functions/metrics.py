"""Classification metric columns from confusion counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.functions.numeric import safe_ratio


def precision(tp: Column, fp: Column) -> Column:
    return safe_ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return safe_ratio(tp, tp + fn)


def false_positive_rate(fp: Column, tn: Column) -> Column:
    return safe_ratio(fp, fp + tn)


def f1(p: Column, r: Column) -> Column:
    return safe_ratio(F.lit(2.0) * p * r, p + r)


def confusion_aggregates(truth: Column, predicted: Column) -> list[Column]:
    """tp, fp, tn, fn counters for 0/1 truth and a boolean prediction."""
    hit = predicted.cast("boolean")
    return [
        F.count_if(hit & (truth == 1)).alias("tp"),
        F.count_if(hit & (truth == 0)).alias("fp"),
        F.count_if(~hit & (truth == 0)).alias("tn"),
        F.count_if(~hit & (truth == 1)).alias("fn"),
    ]


def with_metrics(df, extended: bool = False):
    """Add accuracy, precision, recall, fpr and f1 to a table of tp/fp/tn/fn."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    p, r = precision(tp, fp), recall(tp, fn)
    columns = {
        "accuracy": safe_ratio(tp + tn, F.greatest(F.lit(1), tp + fp + tn + fn)),
        "precision": p,
        "recall": r,
        "fpr": false_positive_rate(fp, tn),
        "f1": f1(p, r),
    }
    if extended:
        specificity = safe_ratio(tn, tn + fp)
        columns["specificity"] = specificity
        columns["tpr"] = r
        columns["balanced_accuracy"] = (r + specificity) / 2
    return df.withColumns(columns)
