"""Training, scoring, search, curves and size scaling on the whole events table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from flowlens.operators import models as md
from flowlens.operators.evaluation import evaluate_at_threshold
from flowlens.operators.scoring import ScoringConfig, prediction_events, score_binary, score_two_stage
from flowlens.plans import bindings as b
from flowlens.plans.catalog.registry import Registry
from flowlens.plans.workspace import work_folder

_r = Registry()
QUERIES, CHECKS = _r.queries, _r.checks

FEATURES = ("value", "k", "hour", "weekday")
FAMILIES = ("DoS", "Mirai", "Spoofing")
LABELS = ("Benign", *FAMILIES)
SMALL = {
    "logreg": {"maxIter": 10}, "random_forest": {"numTrees": 8, "maxDepth": 5}, "hist_gb": {"maxIter": 4, "maxDepth": 3},
    "catboost": {"maxIter": 4, "maxDepth": 4}, "mlp": {"maxIter": 10, "layers": [4, 6, 2]},
}


def labelled_events(spark, sf):
    """Events with four numeric features, both labels and a split by day."""
    rows = b.events(spark, sf)
    day = F.dayofmonth("ts")
    family = reduce(
        lambda ladder, pair: ladder.when(F.col("event_type") == pair[0], pair[1]),
        list(b.FAMILY_OF_TYPE.items())[1:], F.when(F.col("event_type") == "view", "Benign"),
    )
    return rows.select(
        "event_id", F.col("value"), F.col("k").cast("double").alias("k"), F.hour("ts").cast("double").alias("hour"),
        F.dayofweek("ts").cast("double").alias("weekday"), family.alias("derived_label_family"),
        F.when(F.col("event_type") == "view", "Benign").otherwise("Attack").alias("derived_label_binary"),
        F.when(day <= 18, "train").when(day <= 22, "val").when(day <= 26, "test").otherwise("ood").alias("split"),
    )


@_r.query()
def train_and_evaluate_models(spark, sf):
    """All five model families fitted on the train split, evaluated on every other split."""
    rows = labelled_events(spark, sf)
    train, rest = rows.filter("split = 'train'"), rows.filter("split <> 'train'")
    parts = [
        md.scored(md.train_binary(train, name, FEATURES, **params), rest, keep=["split"]).withColumn("model", F.lit(name))
        for name, params in SMALL.items()
    ]
    return evaluate_at_threshold(reduce(lambda x, y: x.unionByName(y), parts), ["model", "split"], "y_true", "y_score", 0.5)


def _two_stage(spark, sf):
    rows = labelled_events(spark, sf)
    train = rows.filter("split = 'train'")
    model = md.train_binary(train, "logreg", FEATURES, maxIter=10)
    family = md.train_family(train, FEATURES, FAMILIES, numTrees=8, maxDepth=5)
    config = ScoringConfig(
        threshold=0.5, features=FEATURES, family_labels=FAMILIES, family_features=FEATURES,
        top1_threshold=0.4, margin_threshold=0.05,
    )
    return rows, model, family, config


@_r.query()
def score_two_stage_model(spark, sf):
    rows, model, family, config = _two_stage(spark, sf)
    scored = score_two_stage(rows.filter("split <> 'train'"), model, family, config)
    return scored.groupBy("split", "family_status", "attack_family").agg(F.count(F.lit(1)).alias("rows"))


@_r.query(f"""WITH {b.EVENTS}, s AS (SELECT CASE WHEN day(ts) <= 18 THEN 'train' WHEN day(ts) <= 22 THEN 'val' WHEN day(ts) <= 26 THEN 'test' ELSE 'ood' END AS split FROM ev)
SELECT split, count(*) AS rows, count(*) AS alerts_by_threshold, count(*) AS families_by_floors, count(*) AS same_after_loading FROM s GROUP BY 1""")
def bundle_scores(spark, sf):
    """Boosted binary and family models scored from a saved bundle: each row alerts by the threshold, is known by both floors, and scores as before saving."""
    from flowlens.operators.bundles import Bundle, load_bundle, save_bundle

    rows = labelled_events(spark, sf)
    train = rows.filter("split = 'train'")
    small = {"maxIter": 3, "maxDepth": 3, "stepSize": 0.5}
    config = ScoringConfig(
        threshold=0.5, features=FEATURES, family_labels=FAMILIES, family_features=FEATURES, top1_threshold=0.4, margin_threshold=0.05,
    )
    bundle = Bundle(
        md.train_binary(train, "hist_gb", FEATURES, **small), config,
        md.train_family(train, FEATURES, FAMILIES, name="catboost", **small),
    )
    folder = work_folder(spark, "bundle")
    save_bundle(bundle, folder)
    scored = load_bundle(spark, folder).score(rows)
    before = bundle.score(rows).select("event_id", *[F.col(c).alias(f"{c}_before") for c in ("attack_score", "family_status")])
    known = (F.col("attack_family_confidence") >= 0.4) & (F.col("attack_family_margin") >= 0.05)
    status = F.when(~F.col("is_alert"), "benign").when(known, "known").otherwise("unknown")
    return scored.join(before, "event_id").groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("is_alert") == (F.col("attack_score") >= 0.5)).alias("alerts_by_threshold"),
        F.count_if((F.col("family_status") == status) & ((status == "known") == F.col("attack_family").isNotNull())).alias("families_by_floors"),
        F.count_if((F.col("attack_score") == F.col("attack_score_before")) & (F.col("family_status") == F.col("family_status_before"))).alias("same_after_loading"),
    )


@_r.query()
def prediction_event_rows(spark, sf):
    rows, model, _, config = _two_stage(spark, sf)
    scored = score_binary(rows.withColumn("passthrough", F.create_map(F.lit("split"), F.col("split"))), model, config)
    return prediction_events(scored, index="event_id")


@_r.query()
def direct_multiclass_baseline(spark, sf):
    from flowlens.functions.probabilities import argmax_label
    from flowlens.operators.multiclass import class_report, confusion_matrix
    from pyspark.ml.functions import vector_to_array

    rows = labelled_events(spark, sf)
    model = md.train_family(rows.filter("split = 'train'"), FEATURES, LABELS, name="logreg", maxIter=10)
    predicted = model.transform(rows.filter("split = 'test'")).select(
        "derived_label_family", argmax_label(vector_to_array("probability"), LABELS).alias("predicted")
    )
    return class_report(confusion_matrix(predicted, "derived_label_family", "predicted", LABELS))


@_r.query()
def random_search_trials(spark, sf):
    rows = labelled_events(spark, sf).withColumnRenamed("split", "part")
    spaces = {
        "random_forest": {"numTrees": [4, 6, 8], "maxDepth": [3, 4, 5]},
        "hist_gb": {"stepSize": ("loguniform", 0.02, 0.15), "maxIter": [2, 3]},
    }
    return md.random_search(
        rows.filter("part = 'train'"), rows.filter("part IN ('val', 'ood')"), ("random_forest", "hist_gb"), 2, FEATURES, spaces=spaces,
    ).drop("train_seconds")


@_r.query()
def forest_learning_curve(spark, sf):
    rows = labelled_events(spark, sf)
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
    return md.learning_curve(train, {"train": train, "val": val}, "random_forest", (2, 4, 6), FEATURES, maxDepth=4)


@_r.query()
def size_scaling_experiment(spark, sf):
    rows = labelled_events(spark, sf)
    total = rows.filter("split = 'train'").count()
    return md.scaling_experiment(
        rows.filter("split = 'train'"), rows.filter("split <> 'train'"), ("logreg",), (total // 2, None), FEATURES, ["event_id"],
        params={"logreg": {"maxIter": 5}},
    )
