import pytest
from pyspark.sql import functions as F

from flowlens.operators import models as md
from flowlens.operators import multiclass as mc
from flowlens.operators import scoring as sc
from flowlens.schemas import KNOWN_ATTACK_FAMILIES

CONFIG = sc.ScoringConfig(threshold=0.5, top1_threshold=0.55, margin_threshold=0.30)


def test_two_stage_columns(spark):
    df = spark.createDataFrame(
        [(1, 0.9, [0.60, 0.25, 0.15]), (2, 0.8, [0.51, 0.30, 0.19]), (3, 0.1, None), (4, 0.5, [1.0])], "id int, s double, p array<double>"
    )
    rows = df.withColumns(sc.binary_columns(F.col("s"), CONFIG))
    got = {r.id: r for r in rows.withColumns(sc.family_columns(F.col("is_alert"), F.col("p"), CONFIG)).collect()}
    assert (got[1].attack_family, got[1].attack_family_confidence, got[1].family_status) == (KNOWN_ATTACK_FAMILIES[0], 0.6, "known")
    assert got[1].attack_family_margin == pytest.approx(0.35)
    assert (got[2].attack_family, got[2].attack_family_confidence, got[2].family_status) == (None, 0.51, "unknown")
    assert (got[3].attack_family_confidence, got[3].family_status, got[3].predicted_label) == (None, "benign", "Benign")
    assert got[4].is_alert and got[4].attack_family_margin == 1.0
    with pytest.raises(ValueError):
        sc.family_columns(F.col("is_alert"), F.col("p"), sc.ScoringConfig())


def training(spark, n=120):
    return spark.range(n).select(
        "id", (F.pmod("id", F.lit(2)) * 2.2 + F.pmod("id", F.lit(7)) / 50).alias("f1"), (F.pmod("id", F.lit(3)) * 1.0).alias("f2"),
        F.when(F.col("id") % 2 == 0, "Benign").otherwise("Attack").alias("derived_label_binary"),
        F.when(F.col("id") % 3 == 0, "DoS").otherwise("Mirai").alias("derived_label_family"),
    )


@pytest.mark.parametrize("name", md.MODEL_NAMES)
def test_every_model_family_learns(spark, name):
    params = {"mlp": {"layers": [2, 4, 2], "maxIter": 60}, "random_forest": {"numTrees": 5, "maxDepth": 3}, "logreg": {"maxIter": 20}}.get(name, {"maxIter": 3, "maxDepth": 2})
    df = training(spark)
    model = md.train_binary(df, name, ["f1", "f2"], **params)
    wrong = sc.score_binary(df, model, CONFIG).filter("predicted_label <> derived_label_binary").count()
    assert wrong == 0


def test_two_stage_model(spark):
    df = training(spark)
    model = md.train_binary(df, "logreg", ["f1", "f2"], maxIter=20)
    family = md.train_family(df.filter("id % 2 = 1"), ["f1", "f2"], ("DoS", "Mirai"), numTrees=5, maxDepth=3)
    config = sc.ScoringConfig(family_labels=("DoS", "Mirai"), family_features=("f1", "f2"), top1_threshold=0.5, margin_threshold=0.1)
    scored = sc.score_two_stage(df, model, family, config)
    assert scored.count() == 120 and scored.filter("family_status = 'benign'").count() == 60
    assert scored.filter("attack_family <> derived_label_family").count() == 0
    # A missing family feature only matters on alert rows.
    benign_gap = df.withColumn("f2", F.when(F.col("id") % 2 == 1, F.col("f2")))
    first = md.train_binary(df, "logreg", ["f1"], maxIter=20)
    assert sc.score_two_stage(benign_gap, first, family, config).count() == 120
    alert_gap = df.withColumn("f2", F.when(F.col("id") % 2 == 0, F.col("f2")))
    with pytest.raises(Exception, match="stage 2 feature f2"):
        sc.score_two_stage(alert_gap, first, family, config).collect()
    assert md.classifier("catboost", 2, classes=3).settings.symmetric and not md.classifier("hist_gb", 2).settings.symmetric
    with pytest.raises(ValueError):
        md.classifier("svm", 2)


def test_zero_division_and_absent_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "t string, p string")
    matrix = mc.confusion_matrix(df, "t", "p", ("a", "b", "c"))
    assert matrix.count() == 9
    report = {r.label: r for r in mc.class_report(matrix).collect()}
    assert (report["c"].f1, report["c"].support, report["b"].recall, report["a"].recall) == (0.0, 0, 0.0, 0.5)


def test_draws_are_seeded():
    one = md.draw_params("catboost", 1, 0)
    assert one == md.draw_params("catboost", 1, 0) != md.draw_params("catboost", 1, 1)
    assert 0.02 <= one["stepSize"] <= 0.15
