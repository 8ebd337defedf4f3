"""Whitening against a dense eigensolver and exact arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest

from flowlens.llm import whitening as wh


def _symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize("values,wanted", [
    (np.linspace(1, 9, 40), 32), (np.r_[np.full(20, 3.0), np.linspace(0.1, 2, 20)], 32), (np.full(12, 2.0), 5),
    (np.r_[5.0, 4.0, np.zeros(10)], 6), (10.0 ** -np.arange(0, 30), 12), (np.r_[1.0, 1.0 - 1e-13, 0.5], 1), ([3.0], 4),
    (np.r_[1e6, np.linspace(1, 2, 63)], 32),
])
def test_feast_finds_the_leading_pairs(values, wanted):
    m = _symmetric(values)
    m = (m + m.T) / 2
    found, u = wh.leading_pairs(m, wanted)
    want = np.sort(np.linalg.eigvalsh(m))[::-1][:wanted]
    want = want[want > wh.NO_VARIANCE * want[0]]
    assert len(found) == len(want) and np.abs(found - want).max() < 1e-12 * max(values)
    assert np.abs(u.T @ u - np.eye(len(found))).max() < 1e-12
    assert np.abs(m @ u - u * found).max() < 1e-11 * max(values)


def test_inertia_counts():
    m = _symmetric(np.arange(30.0))
    d, e = wh.tridiagonal(m)
    assert [wh.count_above(d, e, s) for s in (-1.0, 0.5, 12.5, 28.5, 30.0)] == [30, 29, 17, 1, 0]


def test_missing_pairs_fail():
    with pytest.raises(ArithmeticError):
        wh.feast(_symmetric(np.arange(8.0)), 2.5, 5.5, 2)


def _brute(rows, k):
    lengths = [len(v) for _, v in rows]
    size = max(set(lengths), key=lambda s: (lengths.count(s), s))
    rows = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if len(v) == size]
    n = len(rows)
    sums = [sum(x[j] for _, x in rows) for j in range(size)]
    y = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for _, x in rows])
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for _, x in rows]
    return [i for i, _ in rows], deviation, y @ vectors / np.sqrt(values), values / np.trace(v)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(wh, "ROWS", 7)
    rng = np.random.default_rng(2)
    mix = rng.standard_normal((10, 10)) * (0.6 ** np.arange(10))
    good = [(k, [float(np.float32(c)) for c in rng.standard_normal(10) @ mix]) for k in range(150)]
    good += [good[3], good[3], (None, good[4][1]), (7, [0.0] * 10)]
    bad = [(500, None), (501, [None] * 10), (502, [float("nan")] * 10), (503, [float("inf")] + [0.0] * 9), (504, []), (505, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 5, "a") for i, v in good + bad], "vec_id long, embedding array<float>, n int, x string")
    found = wh.whiten(table.repartition(6), components=6).collect()
    ids, deviation, whitened, explained = _brute(good, 6)
    assert len(found) == 6 * len(good) and {r["n"] for r in found} == {len(good)}
    assert max(r["identity_error"] for r in found) < 1e-9 and len({r["identity_error"] for r in found}) == 1
    signs = {}
    want = sorted(zip(map(str, ids), deviation, map(list, whitened)))
    got = {}
    for r in found:
        got.setdefault((str(r["vec_id"]), r["deviation"]), []).append((r["component"], r["whitened"]))
        assert abs(r["explained"] - explained[r["component"] - 1]) < 1e-9
    for i, d, w in want:
        for c, value in set(got[(i, d)]):
            signs.setdefault(c, np.sign(value * w[c - 1]))
            assert abs(value - signs[c] * w[c - 1]) < 1e-7


def test_tables_without_variance(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]):
        assert wh.whiten(make(rows)).count() == 0
    flat = wh.whiten(make([(k, [float(k), 1.0]) for k in range(5)])).collect()
    assert len(flat) == 5 and {r["component"] for r in flat} == {1}


def test_huge_components_fail_loudly(spark):
    table = spark.createDataFrame([(1, [1e30]), (2, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit a long"):
        wh.whiten(table).count()
