"""Helpers that replace whole-group windows, on data with one hot group."""

import numpy as np
from pyspark.sql import functions as F

from flowlens.operators import ordering as od


def hot(spark, n=3000):
    """Two thirds of the rows in one group, many equal values."""
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, float(rng.integers(0, 50)) / 4, int(rng.integers(0, 2))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, id long, x double, y int")


def test_percentiles_match_numpy(spark):
    rows, df = hot(spark)
    got = {r["g"]: r for r in od.numeric_profile(df, ["g"], "x").collect()}
    for g in {r[0] for r in rows}:
        values = np.array([r[2] for r in rows if r[0] == g])
        for name, p in od.PERCENTILES.items():
            assert abs(got[g][name] - np.percentile(values, 100 * p)) < 1e-9
        assert abs(got[g]["std"] - values.std()) < 1e-9 and got[g]["count"] == len(values)


def test_empty_profile_is_zero(spark):
    row = od.numeric_profile(spark.createDataFrame([], "x double"), [], "x").first()
    assert row["count"] == 0 and row["p50"] == 0.0 and row["max"] == 0.0


def test_running_totals(spark):
    rows, df = hot(spark)
    got = od.running_totals(df, ["g"], "x", {"n": F.count(F.lit(1))}, descending=True, buckets=8).collect()
    for r in got:
        assert r["before_n"] == sum(1 for q in rows if q[0] == r["g"] and q[2] > r["x"])
        assert r["n"] == sum(1 for q in rows if q[0] == r["g"] and q[2] == r["x"])


def test_number_rows_and_previous_value(spark):
    rows, df = hot(spark)
    numbered = od.number_rows(df, ["g"], F.floor(F.col("id") / 100), [F.col("id")], "n").collect()
    seen = {}
    for r in sorted(numbered, key=lambda r: r["id"]):
        assert r["n"] == seen.get(r["g"], 0)
        seen[r["g"]] = r["n"] + 1
    lagged = od.previous_value(df, ["g"], F.floor(F.col("id") / 100), [F.col("id")], "x", "before").collect()
    last = {}
    for r in sorted(lagged, key=lambda r: r["id"]):
        assert r["before"] == last.get(r["g"])
        last[r["g"]] = r["x"]


def test_smallest_per_group_is_exact(spark):
    rows, df = hot(spark)
    caps = spark.createDataFrame([("hot", 501), ("g0", 0), ("g1", None), ("g3", 10**6)], "g string, cap long")
    got = od.smallest_per_group(df, "g", caps, 9, ["id"])
    counts = {r["g"]: r["count"] for r in got.groupBy("g").count().collect()}
    size = lambda g: sum(1 for r in rows if r[0] == g)
    assert counts == {"hot": 501, "g1": size("g1"), "g3": size("g3")}
    again = od.smallest_per_group(df.repartition(5), "g", caps, 9, ["id"])
    assert {r["id"] for r in got.collect()} == {r["id"] for r in again.collect()}


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 3.0), ("a", 3, 5.0)], "g string, id long, x double")
    assert {(r.g, r.p50) for r in od.numeric_profile(df, ["g"], "x").collect()} == {(None, 2.0), ("a", 5.0)}
    assert od.number_rows(df, ["g"], F.col("id"), [F.col("id")], "n").count() == 3
    assert {(r.id, r.b) for r in od.previous_value(df, ["g"], F.col("id"), [F.col("id")], "x", "b").collect()} == {(1, None), (2, 1.0), (3, None)}
    assert od.running_totals(df, ["g"], "x", {"n": F.count(F.lit(1))}, buckets=2).count() == 3
