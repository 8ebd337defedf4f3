"""Exact top-k against brute force: ties, odd rows, levels of the merge."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import exact_search as es


def _brute(rows, k):
    usable = []
    for vec_id, v in rows:
        if vec_id is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((vec_id, [math.floor(64 * x) for x in v]))
    out = []
    for q in sorted({i for i, _ in usable if i % 20 == 0}):
        scored = sorted(
            (-sum(x * y for x, y in zip(a, b)), c)
            for i, a in usable if i == q for c, b in usable if c != q and len(b) == len(a)
        )
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard,fan", [(8192, 16), (10, 2)])
def test_matches_brute_force(spark, monkeypatch, shard, fan):
    monkeypatch.setattr(es, "SHARD", shard)
    monkeypatch.setattr(es, "QUERY_BLOCK", 3)
    monkeypatch.setattr(es, "STRIP", 7)
    monkeypatch.setattr(es, "QUERY_STRIP", 2)
    monkeypatch.setattr(es, "FAN", fan)
    rng = random.Random(4)
    rows = [(k * 4, [rng.choice([-0.5, 0.25, 0.3, 1.0, -1.01]) for _ in range(5)]) for k in range(-10, 90)]
    rows += [(1, None), (3, [None] * 5), (5, [float("nan")] * 5), (7, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 5),
             (400, [1.0, 2.0]), (401, [1.0, -2.0]), (403, []), (420, []), rows[10], rows[10], (44, [0.0] * 5)]
    table = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<float>, size long")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    found = sorted(tuple(r) for r in es.search(table, F.col("id") % 20 == 0, k=6).collect())
    assert found == _brute(exact, 6)


def test_repeated_ids_all_take_part(spark):
    """The best candidate stands in a row whose id another row has with a smaller vector; a query id stands in two rows."""
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (7, [-1.0, -1.0]), (7, [2.0, 0.5]), (9, [0.5, 0.5]), *[(11, [0.25, 3.0])] * 3]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted(tuple(r) for r in es.search(table, F.col("id") % 20 == 0, k=4).collect())
    assert found == _brute(rows, 4) and (20, 4, 7, 64 * 128) in found


def test_large_values_stay_exact():
    q = np.array([[2**40 + 1, 3]])
    assert es._products(q, np.array([[2**21 + 1, 5]]))[0, 0] == (2**40 + 1) * (2**21 + 1) + 15


def test_empty_table(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert es.search(table, F.col("id") % 20 == 0).count() == 0


def test_large_components_take_part(spark):
    """Every finite size counts, in queries and in candidates, while scores fit a long."""
    rng = random.Random(9)
    rows = [(k, [float(rng.randint(-3, 3)) for _ in range(4)]) for k in range(60)]
    rows += [(60, [2.0**21, 1.0, 0.0, -2.0]), (61, [-(2.0**20), 1.5, 2.0, 0.0]), (80, [0.0, 0.0, 2.0**33, 1.0]),
             (81, [0.0, 2.0**35, 0.0, 3.0])]
    found = es.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 20 == 0, k=6)
    found = sorted(tuple(r) for r in found.collect())
    assert found == _brute(rows, 6)
    assert {60, 80} <= {r[0] for r in found} and {61, 81} & {r[2] for r in found}


def test_wide_sums():
    """Products that cancel are exact, no matter how large; own pairs have no score."""
    q, v = np.array([[2.0**40, 2.0**40, 3.0]]), np.array([[2.0**40, -(2.0**40), 5.0], [2.0**70, -(2.0**70), 0.0]])
    assert es._products(q, v, np.array([1]), np.array([2, 3])).tolist() == [[15, 0]]
    assert es._products(np.array([[2.0**70, 0.0]]), np.array([[0.0, 7.0]])).tolist() == [[0]]
    assert es._products(q, q, np.array([1]), np.array([1])).shape == (1, 1)


def test_score_beyond_a_long_fails():
    with pytest.raises(OverflowError, match="vectors 1 and 2"):
        es._products(np.array([[2.0**40, 1.0]]), np.array([[2.0**24, 1.0]]), np.array([1]), np.array([2]))
