import numpy as np
import pytest

from flowlens.operators import evaluation as ev
from flowlens.operators import trials as tr


def scores(spark):
    return spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, s float")


def test_sweep(spark):
    rows = {r["threshold"]: r for r in ev.threshold_sweep(scores(spark), [], "y", "s", [0.3, 0.5]).collect()}
    assert (rows[0.3].tp, rows[0.3].fp, rows[0.3].tn, rows[0.3].fn) == (2, 1, 1, 0)
    assert (rows[0.5].tp, rows[0.5].fp, rows[0.5].tn, rows[0.5].fn) == (1, 0, 2, 1)
    assert rows[0.3].f1 == pytest.approx(0.8) and rows[0.5].f1 == pytest.approx(2 / 3)
    assert rows[0.3].fpr == 0.5


def test_single_precision_boundary(spark):
    """A score equal to the threshold: below it in the sweep, at it in a single evaluation."""
    df = spark.createDataFrame([(1, 0.35)], "y int, s float")
    assert ev.threshold_sweep(df, [], "y", "s", [0.35]).first().tp == 0
    assert ev.evaluate_at_threshold(df, [], "y", "s", 0.35).first().tp == 1


def test_choice_under_cap(spark):
    sweep = spark.createDataFrame(
        [(0.2, 0.82, 0.60, 1.0), (0.4, 0.79, 0.10, 0.75), (0.6, 0.74, 0.02, 0.60)],
        "threshold double, f1 double, fpr double, recall double",
    )
    pick = lambda cap, tie="high": ev.choose_threshold(sweep, [], cap, tie).first().threshold
    assert (pick(0.15), pick(0.05), pick(1.0)) == (0.4, 0.6, 0.2)
    assert pick(0.001) == 0.6
    tied = spark.createDataFrame(
        [(0.2, 0.5, 0.1, 0.5), (0.6, 0.5, 0.1, 0.5)], "threshold double, f1 double, fpr double, recall double"
    )
    assert ev.choose_threshold(tied, [], 0.2).first().threshold == 0.6
    assert ev.choose_threshold(tied, [], 0.2, "low").first().threshold == 0.2


def test_curves_match_brute_force(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) * 0.6 + y * 0.2, 2).astype(np.float32)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    row = ev.curve_metrics(df, [], "y", "s", buckets=16).first()
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    steps, before = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = (s >= t)
        recall, precision = (y[hit] == 1).sum() / len(pos), (y[hit] == 1).mean()
        steps, before = steps + (recall - before) * precision, recall
    assert row.roc_auc == pytest.approx(auc) and row.average_precision == pytest.approx(steps)


def test_downsample_keeps_ends(spark):
    df = spark.range(401).withColumnRenamed("id", "i")
    kept = sorted(r.i for r in ev.downsample(df, [], "i", 200).collect())
    assert len(kept) == 200 and kept[0] == 0 and kept[-1] == 400
    assert kept == [int(x) for x in np.linspace(0, 400, 200, dtype=int)]


def test_ranking_and_promotion(spark):
    rows = [
        ("cat-1", "catboost", 0.019, 0.984, 0.420, 100.0), ("cat-2", "catboost", 0.015, 0.986, 0.430, 110.0),
        ("cat-3", "catboost", 0.024, 0.990, 0.450, 90.0), ("rf-1", "random_forest", 0.018, 0.982, 0.425, 80.0),
        ("rf-2", "random_forest", 0.017, 0.981, 0.440, 75.0),
    ]
    trials = spark.createDataFrame(
        rows, "trial_id string, model_name string, `val_fpr_at_default_0.5` double, `val_f1_at_tuned_cap_0.010` double, "
        "`ood_recall_at_tuned_cap_0.020` double, train_seconds double",
    )
    ranked = [r.trial_id for r in tr.rank_trials(trials).orderBy("model_name", "trial_rank").collect()]
    assert ranked == ["cat-2", "cat-1", "cat-3", "rf-1", "rf-2"]
    promoted = tr.promoted_trials(trials, {"catboost": 2, "random_forest": 1}).orderBy("model_name", "trial_rank")
    assert [r.trial_id for r in promoted.collect()] == ["cat-2", "cat-1", "rf-1"]
