"""Histogram boosting against a plain single-process version, other models, saving and masks."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowlens.operators import boosting as bo
from flowlens.operators import models as md


def _plain(x, y, w, settings, cuts):
    """Level-wise boosting over all rows in one place; margins of every row."""
    k = 1 if settings.classes == 2 else settings.classes
    mass = np.array([w[y == c].sum() for c in range(settings.classes)])
    share = np.log(mass / mass.sum())
    margins = np.tile(share[1:] - share[:1] if k == 1 else share, (len(x), 1))
    score = lambda g, h: g * g / (h + settings.l2)
    for _ in range(settings.max_iter):
        p = bo.probabilities(margins)
        p = p[:, 1:] if k == 1 else p
        grown = []
        for t in range(k):
            truth = y == (1 if k == 1 else t)
            g, h = w * (p[:, t] - truth), w * p[:, t] * (1 - p[:, t])
            leaves = [np.arange(len(x))]
            for _ in range(settings.max_depth):
                options = {}
                for n, rows in enumerate(leaves):
                    for f, points in enumerate(cuts):
                        for b, c in enumerate(points):
                            left = x[rows, f] <= c
                            gain = score(g[rows][left].sum(), h[rows][left].sum()) + score(g[rows][~left].sum(), h[rows][~left].sum())
                            gain -= score(g[rows].sum(), h[rows].sum())
                            few = min(left.sum(), (~left).sum()) < settings.min_instances and not settings.symmetric
                            options[n, f, b] = -np.inf if few else gain
                following = []
                for n, rows in enumerate(leaves):
                    total = lambda o: sum(options[m, *o] for m in range(len(leaves))) if settings.symmetric else options[n, *o]  # noqa: B023, E731
                    f, b = max(((f, b) for f, p_ in enumerate(cuts) for b in range(len(p_))), key=lambda o: (round(total(o), 9), -o[0], -o[1]))
                    if total((f, b)) <= 1e-12:
                        following.append(rows)
                        continue
                    left = x[rows, f] <= cuts[f][b]
                    following += [rows[left], rows[~left]]
                leaves = [r for r in following if len(r)]
            grown.append([(rows, -settings.step_size * g[rows].sum() / (h[rows].sum() + settings.l2)) for rows in leaves])
        for t, leaves in enumerate(grown):
            for rows, value in leaves:
                margins[rows, t] += value
    return margins


@pytest.mark.parametrize("classes,symmetric", [(2, False), (2, True), (3, False), (3, True)])
def test_matches_plain_boosting(spark, monkeypatch, classes, symmetric):
    monkeypatch.setattr(bo, "REFRESH", 2)
    monkeypatch.setattr(bo, "ROWS", 37)
    rng = np.random.default_rng(classes)
    x = np.round(rng.normal(size=(240, 3)), 1)
    y = ((x[:, 0] > 0).astype(int) + (x[:, 1] * x[:, 0] > 0.3)) % classes
    w = rng.choice([1.0, 2.5], 240)
    settings = bo.Settings(classes, max_iter=5, step_size=0.3, max_depth=3, max_bins=8, min_instances=5, l2=1.0, symmetric=symmetric)
    rows = spark.createDataFrame([(r.tolist(), int(c), float(v)) for r, c, v in zip(x, y, w)], "features array<double>, label int, weight double")
    cuts = bo.cut_points(rows, "features", 3, 8)
    base, trees = bo.fit(rows.repartition(4), settings, 3)
    margins = bo._add(np.tile(base, (240, 1)), trees, x, False)
    assert np.abs(margins - _plain(x, y, w, settings, cuts)).max() < 1e-8


def _labelled(spark, n=3000):
    """Four classes in a ring and a checkerboard, two of them rare."""
    rng = np.random.default_rng(8)
    x = rng.uniform(-1, 1, (n, 4))
    y = np.where(x[:, 0] * x[:, 1] > 0, 0, 1) + 2 * (np.abs(x[:, 2]) > 0.85)
    return spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(x, y)], "a double, b double, c double, d double, y int")


def _macro_f1(rows):
    truth, found = (np.array([r[i] for r in rows]) for i in (0, 1))
    scores = []
    for c in sorted(set(truth)):
        hit = ((truth == c) & (found == c)).sum()
        scores.append(2 * hit / max(1, (truth == c).sum() + (found == c).sum()))
    return float(np.mean(scores))


def test_family_stage_beats_the_forest(spark):
    df = _labelled(spark).withColumn("derived_label_family", F.concat(F.lit("f"), "y"))
    train, rest = df.limit(2000), df.subtract(df.limit(2000))
    labels = ("f0", "f1", "f2", "f3")
    found = {}
    for name, params in {"catboost": {"maxIter": 30, "maxDepth": 4, "stepSize": 0.3}, "random_forest": {"numTrees": 30, "maxDepth": 4}}.items():
        model = md.train_family(train, ["a", "b", "c", "d"], labels, name=name, **params)
        found[name] = _macro_f1(model.transform(rest).select("y", F.col("prediction").cast("int")).collect())
        total = model.transform(rest).select(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, p: a + p).alias("s"))
        assert total.filter("abs(s - 1) > 1e-9").count() == 0
    assert found["catboost"] > 0.85 and found["catboost"] > found["random_forest"] + 0.05


def test_saved_with_its_pipeline(spark, tmp_path):
    df = _labelled(spark, 400).withColumn("label", (F.col("y") % 2).cast("double"))
    stages = [VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features"), bo.HistBoosting(max_iter=4, max_depth=3, max_bins=16)]
    model = Pipeline(stages=stages).fit(df)
    model.write().overwrite().save(str(tmp_path / "model"))
    read = PipelineModel.load(str(tmp_path / "model"))
    score = lambda m: [r[0] for r in m.transform(df.orderBy("a")).select(vector_to_array("probability")).collect()]
    assert score(read) == score(model)


def test_masked_rows_are_not_scored(spark):
    df = _labelled(spark, 400).withColumn("label", (F.col("y") % 2).cast("double"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), bo.HistBoosting(max_iter=2, max_depth=2)]).fit(df)
    model.stages[-1].counter = spark.sparkContext.accumulator(0)
    out = model.transform(df.withColumn(bo.MASK, F.col("c") > 0.5)).select("c", vector_to_array("probability").alias("p")).collect()
    wanted = sum(r["c"] > 0.5 for r in out)
    assert 0 < wanted < 400 and model.stages[-1].counter.value == wanted
    assert all((sum(r["p"]) > 0.99) == (r["c"] > 0.5) for r in out)


def test_staged_margins_are_those_of_shorter_fits(spark):
    df = _labelled(spark, 500).select(F.array("a", "b", "c").alias("features"), (F.col("y") % 2).alias("label"), F.lit(1.0).alias("weight"))
    long, short = (bo.BoostedModel.of(*bo.fit(df, bo.Settings(max_iter=n, max_depth=3, max_bins=16), 3)) for n in (6, 2))
    rows = df.select(long.staged_margins([2, 6])("features").alias("l"), short.staged_margins([2])("features").alias("s")).collect()
    assert max(abs(r["l"][0][0] - r["s"][0][0]) for r in rows) < 1e-9
    assert any(abs(r["l"][1][0] - r["l"][0][0]) > 1e-3 for r in rows)


def test_odd_features(spark):
    rows = [([float("nan"), 1.0], 1), ([None, 1.0], 1), ([0.5, 1.0], 0), ([0.2, 1.0], 0)] * 30
    df = spark.createDataFrame([(r, y, 1.0) for r, y in rows], "features array<double>, label int, weight double")
    base, trees = bo.fit(df, bo.Settings(max_iter=3, max_depth=2, min_instances=1), 2)
    x = np.array([[np.nan, 1.0], [0.5, 1.0], [0.2, 1.0]])
    margins = bo._add(np.tile(base, (3, 1)), trees, x, False)[:, 0]
    assert margins[0] > 0 > margins[1] and margins[1] == margins[2]
    with pytest.raises(ValueError, match="label 5"):
        bo.fit(df.withColumn("label", F.lit(5)), bo.Settings(), 2)


@pytest.mark.parametrize("name", ["random_forest", "hist_gb"])
def test_curve_from_one_fit(spark, name):
    """Every stage scores as the ensemble of that many trees; the last one as the model itself."""
    df = _labelled(spark, 600).withColumn("derived_label_binary", F.when(F.col("y") % 2 == 1, "Attack").otherwise("Benign"))
    size = {"random_forest": {"numTrees": 6}, "hist_gb": {"maxIter": 6}}[name]
    model = md.train_binary(df, name, ["a", "b", "c"], maxDepth=4, **size)
    rows = model.stages[0].transform(df)
    whole = model.stages[-1].transform(rows).select("a", vector_to_array("probability")[1].alias("p"), md.staged_scores(model, rows, (1, 3, 6)).alias("s"))
    found = whole.collect()
    assert max(abs(r["p"] - r["s"][2]) for r in found) < 1e-9 and any(abs(r["s"][0] - r["s"][1]) > 1e-3 for r in found)
    if name == "random_forest":
        first = model.stages[-1].trees[0].transform(rows).select("a", vector_to_array("probability")[1].alias("p"))
        one = {r["a"]: r["p"] for r in first.collect()}
        assert max(abs(one[r["a"]] - r["s"][0]) for r in found) < 1e-9
    curve = {r["stage"]: r for r in md.learning_curve(df, {"train": df, "val": df.limit(300)}, name, (1, 3, 6), ["a", "b", "c"], maxDepth=4).collect()}
    assert sorted(curve) == [1, 3, 6] and curve[6]["train_f1"] >= curve[1]["train_f1"] - 0.02 and curve[6]["stage_index"] == 2


def test_search_rows_are_stored_in_more_files_than_a_small_scan_has(spark, monkeypatch):
    from flowlens.operators import models

    monkeypatch.setattr(models, "FILE_ROWS", 25)
    rows = spark.range(0, 101, 1, 1).selectExpr("id", "'train' part")
    held = models._dealt(rows)
    assert len(held.inputFiles()) == 5 and sorted(map(tuple, held.collect())) == [(i, "train") for i in range(101)]
    assert len(models._dealt(rows.filter("id < 20")).inputFiles()) == 1 and models._dealt(rows.filter("id < 0")).count() == 0
