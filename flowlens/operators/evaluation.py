"""Binary model quality: confusion, sweeps, operating points, ROC and AP."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.metrics import (
    confusion_aggregates,
    f1,
    false_positive_rate,
    precision,
    recall,
    with_metrics,
)
from flowlens.functions.numeric import safe_ratio
from flowlens.operators.ordering import quantile_bounds, running_totals, with_value_bucket
from flowlens.operators.staging import lookup
from flowlens.schemas import FPR_CAPS, SWEEP_POINTS


def threshold_grid(points: int = SWEEP_POINTS) -> list[float]:
    """Evenly spaced thresholds over [0, 1], rounded to ten places."""
    return sorted({round(i / (points - 1), 10) for i in range(points)})


def confusion_at_threshold(
    df: DataFrame, groups: Sequence[str], truth: str, score: str, threshold: float | Column
) -> DataFrame:
    """tp/fp/tn/fn per group; score and threshold are compared in single precision."""
    bar = (F.lit(threshold) if isinstance(threshold, (int, float)) else threshold).cast("float")
    return df.groupBy(*groups).agg(
        *confusion_aggregates(F.col(truth), F.col(score).cast("float") >= bar)
    )


def evaluate_at_threshold(df, groups, truth, score, threshold: float) -> DataFrame:
    counts = confusion_at_threshold(df, groups, truth, score, threshold)
    return with_metrics(counts).withColumn("threshold", F.lit(float(threshold)))


def evaluate_splits(
    df: DataFrame, groups: Sequence[str], truth: str, predicted: str, score: str | None = None
) -> DataFrame:
    """Per-split report with balanced accuracy, specificity and mean score."""
    extras = [F.count(F.lit(1)).alias("rows")]
    if score:
        extras.append(F.avg(score).alias("mean_score"))
    counts = df.groupBy(*groups).agg(
        *confusion_aggregates(F.col(truth), F.col(predicted)), *extras
    )
    return with_metrics(counts, extended=True)


def threshold_sweep(
    df: DataFrame,
    groups: Sequence[str],
    truth: str,
    score: str,
    thresholds: Sequence[float] | None = None,
) -> DataFrame:
    """Confusion counts and metrics for every threshold of the grid.

    One pass puts each score into the grid interval it reaches, so the running
    sums work on at most len(grid) + 1 rows per group whatever the input size.
    Scores are single precision, thresholds double.
    """
    grid = sorted({round(float(t), 10) for t in (threshold_grid() if thresholds is None else thresholds)})
    single = df.withColumn("__score", F.col(score).cast("float"))
    reached = with_value_bucket(single, "__score", grid, "__slot")
    counted = reached.groupBy(*groups, "__slot").agg(
        F.count_if(F.col(truth) == 1).alias("__pos"),
        F.count_if(F.col(truth) != 1).alias("__neg"),
    )
    # Spread the counts of each group over the whole grid: slot i holds scores
    # that reach threshold i (1-based) but not i + 1; slot 0 reaches none.
    packed = counted.groupBy(*groups).agg(
        F.map_from_entries(F.collect_list(F.struct("__slot", F.struct("__pos", "__neg")))).alias("__by_slot"),
        F.sum("__pos").alias("__positives"),
        F.sum("__neg").alias("__negatives"),
    )
    slots = F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("slot"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)
    ]))
    spread = packed.withColumn("__s", slots).withColumns({
        "threshold": F.col("__s.threshold"),
        "__hit": F.try_element_at("__by_slot", F.col("__s.slot")),
    })
    down = (
        Window.partitionBy(*[F.col(g) for g in groups] or [F.lit(1)])
        .orderBy(F.col("threshold").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counts = spread.select(
        *groups,
        "threshold",
        F.sum(F.coalesce(F.col("__hit.__pos"), F.lit(0))).over(down).alias("tp"),
        F.sum(F.coalesce(F.col("__hit.__neg"), F.lit(0))).over(down).alias("fp"),
        "__positives",
        "__negatives",
    ).withColumns({
        "tn": F.col("__negatives") - F.col("fp"),
        "fn": F.col("__positives") - F.col("tp"),
    })
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    p, r = precision(tp, fp), recall(tp, fn)
    return counts.select(
        *groups, "threshold", "tp", "fp", "tn", "fn",
        p.alias("precision"), r.alias("recall"), r.alias("tpr"),
        false_positive_rate(fp, tn).alias("fpr"), f1(p, r).alias("f1"),
    )


def choose_threshold(
    sweep: DataFrame, groups: Sequence[str], fpr_cap: float, tie_break: str = "high"
) -> DataFrame:
    """Best operating point of each group under a false-positive-rate cap.

    With eligible rows: best f1, then recall, then (``high``) lowest fpr and
    highest threshold or (``low``) lowest threshold. With none: lowest fpr, then
    (``high``) f1, recall, highest threshold or (``low``) lowest threshold.
    """
    return choose_thresholds(sweep, groups, [fpr_cap], tie_break)


def _preference(fpr_cap: float, tie_break: str) -> Column:
    """What an operating point under a cap is ranked by."""
    if tie_break not in ("high", "low"):
        raise ValueError("tie_break must be 'high' or 'low'")
    fits = F.col("fpr") <= F.lit(fpr_cap)
    none = F.lit(0.0)
    if tie_break == "high":
        good = (F.lit(1), F.col("f1"), F.col("recall"), -F.col("fpr"), F.col("threshold"))
        poor = (F.lit(0), -F.col("fpr"), F.col("f1"), F.col("recall"), F.col("threshold"))
    else:
        good = (F.lit(1), F.col("f1"), F.col("recall"), -F.col("threshold"), none)
        poor = (F.lit(0), -F.col("fpr"), -F.col("threshold"), none, none)
    names = ("fits", "k1", "k2", "k3", "k4")
    return F.when(fits, F.struct(*[c.alias(n) for c, n in zip(good, names)])).otherwise(
        F.struct(*[c.alias(n) for c, n in zip(poor, names)])
    )


def choose_thresholds(sweep, groups, caps=FPR_CAPS, tie_break="high") -> DataFrame:
    """Operating points for several caps, one row per group and cap, from one pass over the sweep."""
    kept = [c for c in sweep.columns if c not in groups]
    best = sweep.groupBy(*groups).agg(*[
        F.max_by(F.struct(F.lit(float(cap)).alias("fpr_cap"), *kept), _preference(cap, tie_break)).alias(f"__best{i}")
        for i, cap in enumerate(caps)
    ])
    points = F.inline(F.array(*[F.col(f"__best{i}") for i in range(len(caps))]))
    return best.select(*groups, points)


def _curve(df, groups, truth, score, buckets=256) -> DataFrame:
    single = df.withColumn("__score", F.col(score).cast("float"))
    return running_totals(
        single, groups, "__score",
        {"pos": F.count_if(F.col(truth) == 1), "neg": F.count_if(F.col(truth) != 1)},
        descending=True,
        bounds=quantile_bounds(single, "__score", buckets),
    )


def curve_metrics(
    df: DataFrame, groups: Sequence[str], truth: str, score: str, buckets: int = 256
) -> DataFrame:
    """Exact ROC-AUC (trapezoid) and average precision (step sum) per group."""
    curve = _curve(df, groups, truth, score, buckets)
    pos, neg, before_pos = F.col("pos"), F.col("neg"), F.col("before_pos")
    seen_pos = before_pos + pos
    seen_neg = F.col("before_neg") + neg
    sums = curve.groupBy(*groups).agg(
        F.sum(neg * (before_pos + pos / 2)).alias("__area"),
        F.sum(pos * safe_ratio(seen_pos, seen_pos + seen_neg)).alias("__steps"),
        F.sum("pos").alias("__p"),
        F.sum("neg").alias("__n"),
    )
    return sums.select(
        *groups,
        safe_ratio(F.col("__area"), F.col("__p").cast("double") * F.col("__n")).alias("roc_auc"),
        safe_ratio(F.col("__steps"), F.col("__p")).alias("average_precision"),
    )


def threshold_evaluation_table(
    df: DataFrame,
    model: str,
    split: str,
    truth: str,
    score: str,
    caps: Sequence[float] = FPR_CAPS,
    recommended_cap: float = 0.02,
    validation_split: str = "val",
    thresholds: Sequence[float] | None = None,
) -> DataFrame:
    """Model x split x threshold-type table: the default and one tuned point per cap.

    The tuned thresholds come from the validation sweep. They are attached as
    columns of one row per model, and all confusion counts are taken in a
    single pass over the scored rows.
    """
    sweep = threshold_sweep(df.filter(F.col(split) == validation_split), [model], truth, score, thresholds)
    names = {"default_0.5": None} | {f"tuned_fpr_cap_{cap:.3f}": cap for cap in caps}
    tuned = choose_thresholds(sweep, [model], caps).groupBy(model).agg(*[
        F.max(F.when(F.col("fpr_cap") == F.lit(float(cap)), F.col("threshold"))).alias(label)
        for label, cap in names.items() if cap is not None
    ]).withColumn("default_0.5", F.lit(0.5))
    rows = df.select(model, split, truth, F.col(score).cast("float").alias("__score")).join(lookup(tuned), model)
    aggregates = []
    for i, label in enumerate(names):
        hit = F.col("__score") >= F.col(f"`{label}`").cast("float")
        aggregates.append(F.min(f"`{label}`").alias(f"t{i}"))
        aggregates += [
            F.count_if(hit & (F.col(truth) == 1)).alias(f"tp{i}"),
            F.count_if(hit & (F.col(truth) == 0)).alias(f"fp{i}"),
            F.count_if(~hit & (F.col(truth) == 0)).alias(f"tn{i}"),
            F.count_if(~hit & (F.col(truth) == 1)).alias(f"fn{i}"),
        ]
    wide = rows.groupBy(model, split).agg(*aggregates)
    options = F.explode(F.array(*[
        F.struct(
            F.lit(label).alias("threshold_type"),
            F.lit(cap == recommended_cap).alias("is_recommended"),
            F.col(f"t{i}").alias("threshold"),
            *[F.col(f"{c}{i}").alias(c) for c in ("tp", "fp", "tn", "fn")],
        )
        for i, (label, cap) in enumerate(names.items())
    ]))
    return with_metrics(wide.select(model, split, options.alias("o")).select(model, split, "o.*"))


def downsample(df: DataFrame, groups: Sequence[str], order: str, points: int = 200) -> DataFrame:
    """Evenly spaced rows of a small ordered table (a sweep), first and last included."""
    scope = Window.partitionBy(*[F.col(g) for g in groups] or [F.lit(1)])
    indexed = df.withColumns({
        "__i": F.row_number().over(scope.orderBy(order)) - 1,
        "__n": F.count(F.lit(1)).over(scope),
    })
    last = F.col("__n") - 1
    marks = F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda k: F.when(k == points - 1, last).otherwise(
            F.floor(k * (last / F.lit(float(points - 1)))).cast("long")
        ),
    )
    chosen = F.array_contains(marks, F.col("__i").cast("long"))
    return indexed.filter((F.col("__n") <= points) | chosen).drop("__i", "__n")
