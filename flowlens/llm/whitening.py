"""Embedding whitening by contour integration (operator 12).

Vectors become whole numbers x = floor(scale * c) + shift. One pass sums them
exactly; a second one sums products of centred vectors (n * x - S, exact, over
n), one partial matrix a task, added up by Spark. What reaches the driver is the
covariance, whose size depends on the dimensions only.

Its leading eigenpairs come from FEAST. Inertia counts (Sturm counts on the
tridiagonal form) place interval ends in gaps of the spectrum and tell how many
eigenvalues lie between them. For each interval, quadrature over a contour around
it solves complex shifted systems; their weighted sum projects random vectors
onto the wanted eigenspace, Rayleigh-Ritz extracts the pairs, and the step is
repeated until residuals reach double precision. An interval that does not
yield exactly as many pairs as the inertia counts tell fails the job, so none is
missed.

A third pass sums products of the whitened vectors themselves for
``identity_error``; the last one writes them.

Defined cases: rows whose vector is null, or holds a null, infinite or NaN
component, are dropped; so are those of another length than the most frequent
one (the longer of two), which cannot share a covariance. Null and repeated ids
are kept, each row by itself. Directions without variance (an eigenvalue below
``NO_VARIANCE`` of the largest) cannot be whitened and give no component; so an
empty table, one row, or equal rows give an empty result. Sums and deviations
that do not fit a long fail the job. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.plans.workspace import discard, stored

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
NO_VARIANCE = 1e-12
NODES = 8  # quadrature points on a half contour
PER_INTERVAL = 16
SPAN = 4
APART = 1e-7  # eigenvalues nearer than this, relative to the interval, are not parted
MAX_STEPS = 60
ROWS = 2048  # rows of a block in a task
_LONG = 2.0**62


# -- eigenpairs of a symmetric matrix


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix (Householder)."""
    a = matrix.copy()
    size = len(a)
    for k in range(size - 2):
        v = a[k + 1:, k].copy()
        norm = np.linalg.norm(v)
        if norm == 0:
            continue
        v[0] += norm if v[0] >= 0 else -norm
        v /= np.linalg.norm(v)
        a[k + 1:, k:] -= 2 * np.outer(v, v @ a[k + 1:, k:])
        a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def count_above(diagonal: np.ndarray, off: np.ndarray, shift: float) -> int:
    """Inertia: how many eigenvalues exceed ``shift``."""
    tiny = np.finfo(float).tiny ** 0.5
    above, pivot = 0, 1.0
    for k, d in enumerate(diagonal.tolist()):
        pivot = d - shift - (off[k - 1] ** 2 / pivot if k else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        above += pivot > 0
    return above


def eigenvalue(diagonal: np.ndarray, off: np.ndarray, place: int, low: float, high: float) -> float:
    """The ``place`` largest eigenvalue (from 1), bisected by inertia counts."""
    for _ in range(200):
        middle = (low + high) / 2
        if not low < middle < high:
            break
        if count_above(diagonal, off, middle) >= place:
            low = middle
        else:
            high = middle
    return low


def intervals(diagonal: np.ndarray, off: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, count): intervals with ends in gaps that hold the ``wanted`` largest eigenvalues, if positive.

    An interval spans a factor of ``SPAN`` at most, so that its ends are far from
    its eigenvalues in proportion to its width. Eigenvalues that no gap parts
    stay together, and so may exceed ``wanted``.
    """
    size, done, out = len(diagonal), 0, []
    reach = float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0)) * 1.125
    first = eigenvalue(diagonal, off, 1, -reach, reach)
    ceiling = reach
    while done < min(wanted, size):
        top = eigenvalue(diagonal, off, done + 1, -reach, reach)
        if top <= NO_VARIANCE * first:
            break
        last = max(done + 1, min(wanted, done + PER_INTERVAL, count_above(diagonal, off, top / SPAN)))
        value = eigenvalue(diagonal, off, last, -reach, reach)
        while last < size:
            following = eigenvalue(diagonal, off, last + 1, -reach, reach)
            if value - following > APART * top:
                break
            last, value = last + 1, following
        floor = value - top / SPAN if last == size else max((value + following) / 2, value - top / SPAN)
        out.append((floor, min(ceiling, top + top / SPAN), last - done))
        done, ceiling = last, floor
    return out


def _refine(matrix: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz on the span of ``basis``."""
    q, r = np.linalg.qr(basis)
    q, _ = np.linalg.qr(q)
    values, vectors = np.linalg.eigh(q.T @ matrix @ q)
    return values, q @ vectors


def feast(matrix: np.ndarray, low: float, high: float, count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs with values in (low, high)."""
    size = len(matrix)
    width = min(size, count + count // 2 + 4)
    basis = np.random.default_rng(seed).standard_normal((size, width))
    points, weights = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    angles = np.pi / 2 * (points + 1)
    eye = np.eye(size)
    scale = np.abs(matrix).sum(axis=1).max()
    best, result = np.inf, None
    for _ in range(MAX_STEPS):
        projected = np.zeros_like(basis)
        for angle, weight in zip(angles, weights):
            turn = np.exp(1j * angle)
            solved = np.linalg.solve((centre + radius * turn) * eye - matrix, basis)
            projected += weight / 2 * radius * (turn * solved).real
        values, vectors = _refine(matrix, projected)
        inside = (values > low) & (values < high)
        residual = np.inf
        if inside.sum() == count:
            u = vectors[:, inside]
            residual = np.abs(matrix @ u - u * values[inside]).max() / scale
            if residual < best:
                best, result = residual, (values[inside], u)
            if residual < 1e-14 or (residual >= best and best < 1e-12):
                break
        basis = vectors
    if result is None or best > 1e-11:
        raise ArithmeticError(f"{count} eigenvalues between {low} and {high} were not all found")
    return result


def leading_pairs(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest positive eigenvalues, falling, and their unit eigenvectors as columns."""
    if not len(matrix) or not matrix.any():
        return np.zeros(0), np.zeros((len(matrix), 0))
    scale = np.abs(matrix).sum(axis=1).max()
    work = matrix / scale
    found = [feast(work, *interval)[1] for interval in intervals(*tridiagonal(work), wanted)]
    if not found:
        return np.zeros(0), np.zeros((len(matrix), 0))
    values, vectors = _refine(work, np.concatenate(found, axis=1))
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order] * scale, vectors[:, order]


# -- passes over the vectors


def whole_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x, size): usable vectors as arrays of longs."""
    values = F.transform(F.col(vector), lambda c: c.cast("double"))
    usable = F.col(vector).isNotNull() & F.forall(
        values, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    )
    scaled = F.transform(values, lambda c: F.floor(c * F.lit(float(scale))))
    fits = F.forall(values, lambda c: F.abs(c * F.lit(float(scale))) < F.lit(_LONG))
    whole = F.when(fits, F.transform(scaled, lambda c: c + F.lit(shift))).otherwise(
        F.raise_error(F.lit("a component does not fit a long"))
    )
    return table.filter(usable).select(F.col(vec_id).alias("vec_id"), whole.alias("x")).withColumn("size", F.size("x"))


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            flat = part.column(column).flatten().to_numpy()
            yield part, flat.reshape(part.num_rows, -1)


def _fitting(total: float, what: str) -> None:
    if total >= _LONG:
        raise OverflowError(f"{what} may not fit a long")


def _matrix_sums(parts: DataFrame, size: int) -> np.ndarray:
    """Sum of partial matrices of rows (i, values)."""
    cells = parts.select("i", F.posexplode("row")).groupBy("i", "pos").agg(F.sum("col").alias("v"))
    out = np.zeros((size, size))
    for i, j, v in cells.collect():
        out[i, j] = v
    return out


def _partial(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"]
    )


@dataclass
class Fit:
    """What whitening needs: counts, sums and the scaled directions."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    trace: float
    directions: np.ndarray  # eigenvectors over the root of their eigenvalues

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        _fitting(float(self.n) * most + float(np.abs(self.sums).max(initial=0)), "n * x - S")
        return x * self.n - self.sums

    def whiten(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations / self.n) @ self.directions


def exact_sums(vectors: DataFrame, size: int) -> np.ndarray:
    """Sum of every dimension."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, object)
        for _, x in _blocks(batches, 0):
            _fitting(float(np.abs(x.astype(np.float64)).max(initial=0)) * len(x), "a sum of components")
            total = total + x.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size, dtype=np.int32)), pa.array([int(v) for v in total], pa.int64())], names=["i", "v"]
        )

    sums = np.zeros(size, np.int64)
    for i, v in vectors.select("x").mapInArrow(add, "i int, v long").groupBy("i").agg(F.sum("v")).collect():
        sums[i] = v
    return sums


def covariance(vectors: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """Centred before multiplying, divisor n."""
    centre = Fit(n, sums, np.zeros(0), 0.0, np.zeros((len(sums), 0)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sums), len(sums)))
        for _, x in _blocks(batches, 0):
            y = centre.deviations(x) / n
            total += y.T @ y
        yield _partial(total)

    v = _matrix_sums(vectors.select("x").mapInArrow(add, "i int, row array<double>"), len(sums)) / n
    return (v + v.T) / 2


def identity_error(vectors: DataFrame, fit: Fit) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, from the vectors themselves."""
    k = len(fit.values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for _, x in _blocks(batches, 0):
            w = np.column_stack([fit.whiten(fit.deviations(x)), np.ones(len(x))])
            total += w.T @ w
        yield _partial(total)

    # Whitened vectors are centred up to rounding; what is left of their mean is taken out.
    total = _matrix_sums(vectors.select("x").mapInArrow(add, "i int, row array<double>"), k + 1) / fit.n
    return float(np.abs(total[:k, :k] - np.outer(total[k, :k], total[k, :k]) - np.eye(k)).max())


def fit_whitening(vectors: DataFrame, size: int, n: int, components: int = COMPONENTS) -> Fit:
    sums = exact_sums(vectors, size)
    v = covariance(vectors, n, sums)
    values, directions = leading_pairs(v, components)
    return Fit(n, sums, values, float(np.trace(v)), directions / np.sqrt(values))


def whiten(
    table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
    scale: int = SCALE, shift: int = SHIFT,
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per row and component."""
    vectors = stored(whole_vectors(table, vec_id, vector, scale, shift), "vectors")
    common = vectors.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    schema = (
        f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, "
        "whitened double, explained double, identity_error double"
    )
    size, n = (common["size"], common["count"]) if common else (0, 0)
    vectors_fit = vectors.filter(F.col("size") == size)
    fit = fit_whitening(vectors_fit, size, n, components) if size else None
    if fit is None or not len(fit.values):
        discard(vectors)
        return table.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors_fit, fit)
    explained, k = fit.values / fit.trace, len(fit.values)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, 1):
            y = fit.deviations(x)
            _fitting(float(np.square(y.astype(np.float64)).sum(axis=1).max(initial=0)), "a deviation")
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(rows), fit.n, np.int64)), pa.array(np.square(y).sum(axis=1)[rows]),
                 pa.array(fit.whiten(y).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(rows), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors_fit.select("vec_id", "x").mapInArrow(write, schema)
