"""Saved bundles: equal scores after loading, refused overrides and changed files; family stage on alerts only."""

import glob

import pytest
from pyspark.sql import functions as F

from flowlens.operators import bundles as bd
from flowlens.operators import models as md
from flowlens.operators import scoring as sc

CONFIG = sc.ScoringConfig(
    threshold=0.4, features=("f1", "f2"), family_labels=("DoS", "Mirai"), family_features=("f1", "f2"), top1_threshold=0.5, margin_threshold=0.1,
)


@pytest.fixture(scope="module")
def trained(spark):
    df = spark.range(160).select(
        "id", (F.pmod("id", F.lit(2)) * 2.2 + F.pmod("id", F.lit(7)) / 50).alias("f1"), (F.pmod("id", F.lit(3)) * 1.0).alias("f2"),
        F.when(F.col("id") % 2 == 0, "Benign").otherwise("Attack").alias("derived_label_binary"),
        F.when(F.col("id") % 3 == 0, "DoS").otherwise("Mirai").alias("derived_label_family"),
    )
    small = {"maxIter": 5, "maxDepth": 2, "stepSize": 0.5}
    model = md.train_binary(df, "hist_gb", ["f1", "f2"], **small)
    family = md.train_family(df.filter("id % 2 = 1"), ["f1", "f2"], ("DoS", "Mirai"), name="catboost", **small)
    return df, bd.Bundle(model, CONFIG, family)


def _rows(df):
    return sorted(map(tuple, df.drop("derived_label_binary").collect()), key=repr)


def test_saved_bundle_scores_alike(spark, trained, tmp_path):
    df, bundle = trained
    bd.save_bundle(bundle, str(tmp_path / "b"))
    read = bd.load_bundle(spark, str(tmp_path / "b"))
    assert read.config == CONFIG and _rows(read.score(df)) == _rows(bundle.score(df))
    binary = bd.Bundle(bundle.model, CONFIG)
    bd.save_bundle(binary, str(tmp_path / "one"))
    again = bd.load_bundle(spark, str(tmp_path / "one"))
    assert again.family is None and _rows(again.score(df)) == _rows(binary.score(df))
    # A loaded bundle can be saved again.
    bd.save_bundle(read, str(tmp_path / "c"))
    assert bd.load_bundle(spark, str(tmp_path / "c")).config == CONFIG


def test_overrides_and_changed_files_are_refused(spark, trained, tmp_path):
    df, bundle = trained
    with pytest.raises(ValueError, match="overridden: threshold"):
        bundle.score(df, threshold=0.9)
    with pytest.raises(ValueError, match="lacks features of the bundle: f2"):
        bundle.score(df.drop("f2"))
    with pytest.raises(ValueError, match="abstention"):
        bd.save_bundle(bd.Bundle(bundle.model, sc.ScoringConfig(), bundle.family), str(tmp_path / "no"))
    folder = str(tmp_path / "b")
    bd.save_bundle(bundle, folder)
    path = next(p for p in glob.glob(f"{folder}/binary/stages/*ConfigStage*/metadata/part-*"))
    with open(path) as handle:
        text = handle.read()
    with open(path, "w") as handle:
        handle.write(text.replace("0.4", "0.1"))
    for crc in glob.glob(path.rsplit("/", 1)[0] + "/.*.crc"):
        open(crc, "wb").close()
    with pytest.raises(Exception, match="differ from its manifest|[Cc]hecksum"):
        bd.load_bundle(spark, folder)


def test_only_alert_rows_reach_the_family_stage(spark, trained):
    df, bundle = trained
    stage = bundle.family.stages[-1]
    stage.counter = spark.sparkContext.accumulator(0)
    try:
        rows = bundle.score(df).select("is_alert", "family_status", "attack_family").collect()
        alerts = sum(r["is_alert"] for r in rows)
        assert 0 < alerts < len(rows) and stage.counter.value == alerts
        assert all((r["family_status"] == "benign") == (not r["is_alert"]) for r in rows)
    finally:
        stage.counter = None


def test_captures_and_files_are_scored(spark, trained, tmp_path):
    """The batch runtime: captures to a flow CSV, and a file set to predictions."""
    from test_flows import A, B, capture, frame

    from flowlens.operators.adapter import PRIMARY_PROFILE
    from flowlens.plans.runtime import captures_to_flow_csv, score_files
    from flowlens.sources.flow_csv import read_flow_csv

    (tmp_path / "captures").mkdir()
    (tmp_path / "captures" / "one.pcap").write_bytes(capture([frame(A, B, payload=b"abc"), frame(B, A), frame(A, B, 17)]))
    captures_to_flow_csv(spark, str(tmp_path / "captures"), str(tmp_path / "flows"), PRIMARY_PROFILE)
    assert read_flow_csv(spark, str(tmp_path / "flows")).count() == 2
    df, bundle = trained
    df.select("id", "f1", "f2").write.parquet(str(tmp_path / "rows.parquet"))
    out = score_files(spark, str(tmp_path / "rows.parquet"), str(tmp_path / "scores.parquet"), bundle.model, bundle.config, bundle.family, limit=50)
    assert out.count() == 50 and {"attack_score", "family_status"} <= set(out.columns)
