"""Training of the model families on Spark ML, search, curves and scaling runs."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.metadata import binary_label
from flowlens.functions.numeric import sigmoid
from flowlens.operators.boosting import BoostedModel, HistBoosting, Tree
from flowlens.operators.evaluation import evaluate_at_threshold
from flowlens.operators.multiclass import with_label_index
from flowlens.operators.sampling import (
    balanced_weights,
    capped_sample,
    class_counts,
    class_weights,
    target_size_caps,
    with_weights,
)
from flowlens.operators.scoring import positive_score
from flowlens.operators.trials import trial_metrics
from flowlens.plans.workspace import discard, stored
from flowlens.session import cut_lineage

# Model names, per-model sampling limits, search spaces, curve stages.
MODEL_NAMES = ("logreg", "random_forest", "hist_gb", "catboost", "mlp")
SAMPLING_LIMITS = {
    "logreg": (4, 400_000),
    "random_forest": (6, 600_000),
    "hist_gb": (8, 1_000_000),
    "catboost": (10, 1_500_000),
    "mlp": (4, 300_000),
}
SEARCH_SPACES = {
    "catboost": {
        "maxDepth": [6, 8, 10],
        "stepSize": ("loguniform", 0.02, 0.15),
        "maxIter": [300, 500, 700, 900],
        "maxBins": [64, 128, 254],
        "attack_multiplier": [1.0, 1.15, 1.3],
    },
    "random_forest": {
        "numTrees": [200, 400, 600],
        "maxDepth": [14, 18, 24],
        "minInstancesPerNode": [1, 2, 4, 8],
        "featureSubsetStrategy": ["sqrt", "0.2", "0.35", "0.5"],
        "subsamplingRate": [0.1, 0.2, 0.35],
    },
    "hist_gb": {
        "stepSize": [0.02, 0.05, 0.08, 0.1],
        "maxIter": [200, 400, 600, 800],
        "minInstancesPerNode": [20, 50, 100, 200],
        "maxBins": [64, 128, 255],
    },
}
FOREST_STAGES = (25, 50, 75, 100, 125, 150)
BOOSTING_STAGES = (50, 100, 150, 200, 250, 300)
FILE_ROWS = 100_000
SCALING_SIZES = (2_000_000, 4_000_000, 8_000_000, None)

BOOSTED = ("hist_gb", "catboost")
BOOSTING_DEFAULTS = {
    "hist_gb": {"max_iter": 200, "step_size": 0.05, "max_depth": 5, "min_instances": 20, "l2": 0.0, "symmetric": False},
    "catboost": {"max_iter": 300, "step_size": 0.05, "max_depth": 8, "l2": 3.0, "symmetric": True},
}
BOOSTING_PARAMS = {
    "maxIter": "max_iter", "stepSize": "step_size", "maxDepth": "max_depth", "maxBins": "max_bins",
    "minInstancesPerNode": "min_instances", "l2": "l2",
}
SCALED = ("logreg", "mlp")
WEIGHTLESS = ("mlp",)


def boosting_settings(name: str, classes: int, params: dict) -> dict:
    """Settings of a boosted family under the parameter names of the other estimators."""
    return {"classes": classes, **BOOSTING_DEFAULTS[name], **{BOOSTING_PARAMS[k]: v for k, v in params.items()}}


def classifier(name: str, inputs: int, classes: int = 2, seed: int = 42, weight: str | None = None, **params):
    """Estimator standing for a model family; the boosted families grow free and symmetric trees."""
    common = {"featuresCol": "features", "labelCol": "label"}
    if weight and name not in WEIGHTLESS:
        common["weightCol"] = weight
    if name == "logreg":
        return LogisticRegression(**common, **{"maxIter": 100, **params})
    if name == "random_forest":
        return RandomForestClassifier(**common, seed=seed, **{"numTrees": 100, "maxDepth": 14, **params})
    if name in BOOSTED:
        return HistBoosting(**boosting_settings(name, classes, params), **({"weightCol": weight} if weight else {}))
    if name == "mlp":
        layers = params.pop("layers", [inputs, 64, 32, classes])
        return MultilayerPerceptronClassifier(**common, seed=seed, layers=layers, **{"maxIter": 100, **params})
    raise ValueError(f"unsupported model: {name}")


def pipeline(name: str, features: Sequence[str], classes: int = 2, seed: int = 42, weight: str | None = None, **params) -> Pipeline:
    """Assembler, scaling for the models that need it, classifier."""
    raw = "raw_features" if name in SCALED else "features"
    stages = [VectorAssembler(inputCols=list(features), outputCol=raw, handleInvalid="error")]
    if name in SCALED:
        stages.append(StandardScaler(inputCol=raw, outputCol="features", withMean=True, withStd=True))
    stages.append(classifier(name, len(features), classes, seed, weight, **params))
    return Pipeline(stages=stages)


def train_binary(
    train: DataFrame, name: str, features: Sequence[str], label: str = "derived_label_binary",
    seed: int = 42, attack_multiplier: float = 1.0, **params,
) -> PipelineModel:
    """Fit a binary model on Benign / Attack rows with balanced class weights."""
    weights = balanced_weights(class_counts(train, label), label, attack_multiplier)
    weighted = with_weights(train, label, weights).withColumn("label", binary_label(F.col(label)).cast("double"))
    return pipeline(name, features, 2, seed, "weight", **params).fit(weighted)


def train_family(
    train: DataFrame, features: Sequence[str], labels: Sequence[str], label: str = "derived_label_family",
    name: str = "random_forest", exponent: float = 0.5, seed: int = 42, **params,
) -> PipelineModel:
    """Fit a weighted multiclass model; class order is ``labels``.

    With "Benign" among the labels this is the direct multiclass baseline.
    """
    known = with_label_index(train, label, labels)
    weights = class_weights(class_counts(known, label), label, exponent)
    weighted = with_weights(known, label, weights).withColumn("label", F.col("label_index").cast("double"))
    return pipeline(name, features, len(labels), seed, "weight", **params).fit(weighted)


def scored(model: PipelineModel, df: DataFrame, label: str = "derived_label_binary", keep: Sequence[str] = ()) -> DataFrame:
    """Truth and single-precision score of labelled rows."""
    transformed = model.transform(df)
    return transformed.select(
        *keep, binary_label(F.col(label)).alias("y_true"), positive_score(transformed).cast("float").alias("y_score")
    )


def draw_params(name: str, seed: int, trial: int, spaces: dict | None = None) -> dict:
    """Seeded draw of one trial: lists are discrete, ("loguniform", lo, hi) is continuous."""
    rng = random.Random(f"{seed}|{name}|{trial}")
    drawn = {}
    for key, space in (spaces or SEARCH_SPACES)[name].items():
        if isinstance(space, tuple) and space[0] == "loguniform":
            drawn[key] = round(math.exp(rng.uniform(math.log(space[1]), math.log(space[2]))), 5)
        else:
            drawn[key] = rng.choice(space)
    return drawn


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows stored for many passes, in a file for each ``FILE_ROWS`` of them if the scan has fewer parts."""
    wanted = -(-rows.count() // FILE_ROWS)
    return stored(rows.repartition(wanted) if wanted > rows.rdd.getNumPartitions() else rows, "search")


def random_search(
    train: DataFrame, evaluation: DataFrame, names: Sequence[str], trials: int, features: Sequence[str],
    label: str = "derived_label_binary", split: str = "part", seed: int = 42, spaces: dict | None = None,
) -> DataFrame:
    """Trial table of a random search.

    ``evaluation`` carries ``val`` and ``ood`` rows. Both are derived once and
    stored, since every fit passes over them many times. Each trial is one fit; the
    scored rows of all trials are evaluated together in one grouped pass.
    """
    train, evaluation = _dealt(train.select(*features, label)), _dealt(evaluation.select(*features, label, split))
    rows, scored_parts = [], None
    for name in names:
        for trial in range(trials):
            params = draw_params(name, seed, trial, spaces)
            fit_params = {k: v for k, v in params.items() if k != "attack_multiplier"}
            begun = time.monotonic()
            model = train_binary(
                train, name, features, label, seed, params.get("attack_multiplier", 1.0), **fit_params
            )
            trial_id = f"{name}-{trial + 1:03d}"
            rows.append((trial_id, name, {k: str(v) for k, v in params.items()}, time.monotonic() - begun))
            part = scored(model, evaluation, label, [split]).withColumn("trial_id", F.lit(trial_id))
            scored_parts = part if scored_parts is None else scored_parts.unionByName(part)
    table = train.sparkSession.createDataFrame(
        rows, "trial_id string, model_name string, params map<string,string>, train_seconds double"
    )
    # Sweeps and tuned points read the scores several times: score once, in storage.
    scored_parts = cut_lineage(scored_parts)
    discard(train, evaluation)
    return table.join(trial_metrics(scored_parts, "trial_id", split, "y_true", "y_score"), "trial_id")


def staged_scores(model: PipelineModel, df: DataFrame, stages: Sequence[int]) -> Column:
    """Positive-class scores of the first trees of a fitted ensemble, one per stage, from vector column ``features``."""
    ensemble = model.stages[-1]
    features = vector_to_array("features")
    if isinstance(ensemble, BoostedModel):
        return F.transform(ensemble.staged_margins(stages)(features), lambda m: sigmoid(m[0]))
    forest = forest_of(ensemble)

    @F.pandas_udf("array<double>")
    def score(rows: pd.Series) -> pd.Series:
        values = np.stack(rows.to_list()).astype(float) if len(rows) else np.zeros((0, 1))
        total, out, at = np.zeros(len(values)), [], 0
        for stage in stages:
            for tree in forest[at:stage]:
                total += tree.value[tree.nodes(values, tree.threshold)]
            at = max(at, stage)
            out.append(total / min(stage, len(forest)))
        return pd.Series(np.stack(out, axis=1).tolist(), dtype=object)

    return score(features)


def forest_of(model) -> list[Tree]:
    """Trees of a fitted binary forest, with the positive share of each leaf."""
    depth = max((t.depth for t in model.trees), default=0)

    def copied(source) -> Tree:
        tree = Tree.empty(depth)
        waiting = [(1, source._call_java("rootNode"))]
        while waiting:
            place, node = waiting.pop()
            if node.subtreeDepth() == 0:
                stats = list(node.impurityStats().stats())
                tree.value[place] = stats[1] / sum(stats)
            else:
                split = node.split()
                tree.feature[place], tree.threshold[place] = split.featureIndex(), split.threshold()
                waiting += [(2 * place, node.leftChild()), (2 * place + 1, node.rightChild())]
        return tree

    return [copied(t) for t in model.trees]


def learning_curve(
    train: DataFrame, probes: dict[str, DataFrame], name: str, stages: Sequence[int], features: Sequence[str],
    label: str = "derived_label_binary", seed: int = 42, **params,
) -> DataFrame:
    """F1 of fixed probe sets at growing stage counts; columns stage_index, train_f1, val_f1.

    One fit of the largest stage: a smaller stage is the ensemble of its first
    trees, and all stages are scored in one pass over each probe set.
    """
    size = "numTrees" if name == "random_forest" else "maxIter"
    model = train_binary(train, name, features, label, seed, **{**params, size: max(stages)})
    assembler, numbers = model.stages[0], F.array(*[F.lit(s) for s in stages])
    parts = None
    for probe, rows in probes.items():
        scores = assembler.transform(rows).select(
            binary_label(F.col(label)).alias("y_true"), F.posexplode(F.arrays_zip(numbers.alias("stage"), staged_scores(model, rows, stages).alias("score")))
        )
        part = scores.select(
            "y_true", F.col("col.score").cast("float").alias("y_score"), F.col("pos").alias("stage_index"), F.col("col.stage").alias("stage"),
            F.lit(probe).alias("probe"), F.lit(name).alias("model"),
        )
        parts = part if parts is None else parts.unionByName(part)
    metrics = evaluate_at_threshold(parts, ["model", "stage_index", "stage", "probe"], "y_true", "y_score", 0.5)
    return metrics.groupBy("model", "stage_index", "stage").agg(*[
        F.max(F.when(F.col("probe") == probe, F.col("f1"))).alias(f"{probe}_f1") for probe in probes
    ])


def scaling_experiment(
    train: DataFrame, evaluation: DataFrame, names: Sequence[str], sizes: Sequence[int | None], features: Sequence[str],
    keys: Sequence[str], label: str = "derived_label_binary", split: str = "split", seed: int = 42,
    params: dict[str, dict] | None = None,
) -> DataFrame:
    """Metrics per model, training size and evaluation split."""
    counts = class_counts(train, label)
    parts = None
    for size in sizes:
        sample = train if size is None else capped_sample(train, label, target_size_caps(counts, label, size), seed, keys)
        for name in names:
            model = train_binary(sample, name, features, label, seed, **(params or {}).get(name, {}))
            part = scored(model, evaluation, label, [split]).withColumns({
                "model": F.lit(name), "train_size": F.lit("full" if size is None else str(size)),
            })
            parts = part if parts is None else parts.unionByName(part)
    return evaluate_at_threshold(parts, ["model", "train_size", split], "y_true", "y_score", 0.5)
