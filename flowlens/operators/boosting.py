"""Histogram boosting for two or more classes.

Features are cut into at most ``max_bins`` bins once. A round grows one tree per
class (one in all for two classes) on the gradients of the softmax loss, level by
level: each task sums gradients, curvatures and counts per (tree, node, feature,
bin), one shuffle brings the sums of a feature together, and the best split of
each feature is found there. The driver only sees the best split of each node, at
most ``classes * 2 ** depth`` rows.

Trees are free (``symmetric=False``: each node has its own split) or symmetric
(all nodes of a level share one, chosen by their summed gain); the former stand for
histogram boosting, the latter for ordered boosting libraries, whose trees are
of that shape.

Rows keep their margins in a table that is written anew every ``REFRESH`` rounds;
in between a task adds the trees grown since. So a pass costs the same however
many trees there are, and a lost executor repeats no round.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.plans.workspace import discard, stored

REFRESH = 10
MASK = "__scored"  # if a table has it, only rows where it holds are scored
ROWS = 8192


@dataclass
class Tree:
    """Nodes in heap order from 1; a node without a feature (-1) is a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1)
        return cls(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(size))

    def nodes(self, rows: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The node each row ends in; ``cuts`` are bins or thresholds, as the rows are."""
        node, every = np.ones(len(rows), np.int64), np.arange(len(rows))
        for _ in range(len(self.feature).bit_length() - 2):
            feature = self.feature[node]
            inner = feature >= 0
            # Missing values are no smaller than any threshold.
            right = ~(rows[every, np.maximum(feature, 0)] <= cuts[node])
            node = np.where(inner, 2 * node + right, node)
        return node

    def to_list(self) -> list:
        return [self.feature.tolist(), self.bin.tolist(), self.threshold.tolist(), self.value.tolist()]

    @classmethod
    def from_list(cls, parts: list) -> Tree:
        feature, bins, threshold, value = parts
        return cls(np.array(feature), np.array(bins), np.array(threshold, float), np.array(value, float))


@dataclass(frozen=True)
class Settings:
    classes: int = 2
    max_iter: int = 50
    step_size: float = 0.1
    max_depth: int = 5
    max_bins: int = 64
    min_instances: int = 20
    l2: float = 1.0
    symmetric: bool = False


def probabilities(margins: np.ndarray) -> np.ndarray:
    """Softmax; one margin is that of the second of two classes."""
    if margins.shape[1] == 1:
        margins = np.concatenate([np.zeros_like(margins), margins], axis=1)
    odds = np.exp(margins - margins.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def _gradients(margins: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = probabilities(margins)
    p = p[:, 1:] if margins.shape[1] == 1 else p
    truth = label[:, None] == (np.arange(p.shape[1]) + (p.shape[1] == 1))
    return weight[:, None] * (p - truth), weight[:, None] * np.maximum(p * (1 - p), 1e-16)


def _add(margins: np.ndarray, rounds: Sequence[Sequence[Tree]], rows: np.ndarray, binned: bool) -> np.ndarray:
    margins = margins.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            margins[:, k] += tree.value[tree.nodes(rows, tree.bin if binned else tree.threshold)]
    return margins


def _matrix(column: pa.Array, width: int, kind=np.uint8) -> np.ndarray:
    if kind == np.uint8:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            yield batch.slice(low, ROWS)


def cut_points(rows: DataFrame, features: str, width: int, bins: int) -> list[np.ndarray]:
    """Upper bounds of the bins of each feature, from one mergeable sketch per feature."""
    shares = [k / bins for k in range(1, bins)]
    sketches = rows.select([
        F.percentile_approx(F.when(~F.isnan(F.col(features)[i]), F.col(features)[i]), shares, 10_000).alias(f"q{i}")
        for i in range(width)
    ]).first()
    return [np.unique(np.array(sketches[i] or [], float)) for i in range(width)]


def _binned(rows: DataFrame, cuts: list[np.ndarray], base: np.ndarray) -> DataFrame:
    width = len(cuts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            values = _matrix(part.column(0), width, np.float64)
            bins = np.stack([
                np.where(np.isnan(values[:, f]), len(cuts[f]), np.searchsorted(cuts[f], values[:, f])) for f in range(width)
            ], axis=1).astype(np.uint8) if width else np.zeros((len(values), 0), np.uint8)
            start = np.tile(base, part.num_rows)
            edges = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(base))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in bins], pa.binary()), part.column(1), part.column(2),
                 pa.ListArray.from_arrays(edges, pa.array(start))],
                names=["bins", "label", "weight", "margins"],
            )

    return stored(rows.mapInArrow(cut, "bins binary, label int, weight double, margins array<double>"), "binned")


def _refreshed(table: DataFrame, rounds: list[list[Tree]], width: int, trees: int) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            margins = _add(_matrix(part.column(3), trees, np.float64), rounds, _matrix(part.column(0), width), True)
            edges = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * trees)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.ListArray.from_arrays(edges, pa.array(margins.ravel()))],
                names=["bins", "label", "weight", "margins"],
            )

    return stored(table.mapInArrow(add, table.schema), "binned")


def _best_splits(
    table: DataFrame, rounds: list[list[Tree]], growing: list[Tree], level: int, width: int, sizes: list[int], settings: Settings,
) -> list:
    """Best split of every open node: rows (tree, node, split), split = (gain, -feature, bin, left and whole sums)."""
    first, count, bins, trees = 2**level, 2**level, max(sizes, default=1), len(growing)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((trees, width, 3, count * bins))
        for part in _parts(batches):
            rows = _matrix(part.column(0), width)
            margins = _add(_matrix(part.column(3), trees, np.float64), rounds, rows, True)
            g, h = _gradients(margins, part.column(1).to_numpy(), part.column(2).to_numpy())
            for k, tree in enumerate(growing):
                node = tree.nodes(rows, tree.bin) - first
                some = node >= 0
                for f in range(width):
                    cell = node[some] * bins + rows[some, f]
                    for j, values in enumerate((g[some, k], h[some, k], None)):
                        total[k, f, j] += np.bincount(cell, values, count * bins)
        held = total.reshape(trees, width, 3, count, bins)
        tree, feature, node = np.nonzero(held[:, :, 2].sum(axis=-1) > 0)
        cells = held[tree, feature, :, node].reshape(len(tree), 3 * bins)
        yield pa.RecordBatch.from_arrays(
            [pa.array(tree.astype(np.int32)), pa.array(feature.astype(np.int32)), pa.array((node + first).astype(np.int32)),
             pa.ListArray.from_arrays(pa.array(np.arange(len(tree) + 1, dtype=np.int32) * 3 * bins), pa.array(cells.ravel()))],
            names=["tree", "feature", "node", "cells"],
        )

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], dict[int, np.ndarray]] = {}
        for batch in batches:
            cells = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, 3, bins)
            for i, (t, f, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                nodes = held.setdefault((t, f), {})
                nodes[n] = nodes[n] + cells[i] if n in nodes else cells[i].copy()
        out = []
        for (t, f), nodes in held.items():
            if sizes[f] < 2:
                continue
            sums = np.stack(list(nodes.values()))
            left, whole = np.cumsum(sums, axis=2)[:, :, :sizes[f] - 1], sums.sum(axis=2, keepdims=True)
            right = whole - left

            def score(s: np.ndarray) -> np.ndarray:
                return s[:, 0] ** 2 / (s[:, 1] + settings.l2)

            with np.errstate(invalid="ignore", divide="ignore"):  # empty sides count below as no split
                gain = score(left) + score(right) - score(whole)
            gain = np.where(np.isnan(gain), -np.inf, gain)
            if settings.symmetric:
                gain = np.broadcast_to(gain.sum(axis=0), gain.shape)
            else:
                few = np.minimum(left[:, 2], right[:, 2]) < settings.min_instances
                gain = np.where(few, -np.inf, gain)
            best = gain.argmax(axis=1)
            for i, n in enumerate(nodes):
                b = int(best[i])
                out.append((t, n, (float(gain[i, b]), -f, b, *left[i, :2, b].tolist(), *whole[i, :2, 0].tolist())))
        fields = ["gain", "feature", "bin", "gl", "hl", "g", "h"]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()),
             pa.array([dict(zip(fields, r[2])) for r in out], pa.struct(
                 [(x, pa.int32() if x in ("feature", "bin") else pa.float64()) for x in fields]))],
            names=["tree", "node", "split"],
        )

    split = "struct<gain:double,feature:int,bin:int,gl:double,hl:double,g:double,h:double>"
    added = table.mapInArrow(sums, "tree int, feature int, node int, cells array<double>")
    found = added.repartition("tree", "feature").mapInArrow(splits, f"tree int, node int, split {split}")
    return found.groupBy("tree", "node").agg(F.max("split")).collect()


def fit(rows: DataFrame, settings: Settings, width: int) -> tuple[np.ndarray, list[list[Tree]]]:
    """Base margins and trees per round from rows (features, label, weight)."""
    rows = rows.select(
        F.col("features").cast("array<double>"), F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight")
    )
    mass = np.zeros(settings.classes)
    for label, total in rows.groupBy("label").agg(F.sum("weight")).collect():
        if not 0 <= label < settings.classes:
            raise ValueError(f"label {label} is none of {settings.classes} classes")
        mass[label] = total
    share = np.log(np.maximum(mass / max(mass.sum(), 1e-300), 1e-12))
    base = share[1:] - share[:1] if settings.classes == 2 else share
    cuts = cut_points(rows, "features", width, settings.max_bins)
    sizes = [len(c) + 1 for c in cuts]
    table = _binned(rows, cuts, base)
    done: list[list[Tree]] = []
    fresh = 0  # rounds already in the table's margins
    for _ in range(settings.max_iter):
        growing = [Tree.empty(settings.max_depth) for _ in base]
        for level in range(settings.max_depth):
            grown = 0
            for t, node, s in _best_splits(table, done[fresh:], growing, level, width, sizes, settings):
                tree = growing[t]
                if level == 0:
                    tree.value[1] = -settings.step_size * s["g"] / (s["h"] + settings.l2)
                if s["gain"] <= 1e-12:
                    continue
                grown += 1
                tree.feature[node], tree.bin[node] = -s["feature"], s["bin"]
                tree.threshold[node] = cuts[-s["feature"]][s["bin"]]
                for child, g, h in ((2 * node, s["gl"], s["hl"]), (2 * node + 1, s["g"] - s["gl"], s["h"] - s["hl"])):
                    tree.value[child] = -settings.step_size * g / (h + settings.l2)
            if not grown:
                break
        done.append(growing)
        if len(done) - fresh == REFRESH and len(done) < settings.max_iter:
            older, table = table, _refreshed(table, done[fresh:], width, len(base))
            discard(older)
            fresh = len(done)
    discard(table)
    return base, done


class BoostedModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees as a transformer that is saved with its pipeline.

    Adds ``rawPrediction`` (margins), ``probability`` and ``prediction``. With a
    column ``MASK``, rows where it does not hold are not scored: theirs are zeros.
    """

    ensemble = Param(Params._dummy(), "ensemble", "base margins and trees as JSON", TypeConverters.toString)

    def __init__(self, ensemble: str | None = None):
        super().__init__()
        self.counter = None  # an accumulator that counts scored rows, if set
        if ensemble is not None:
            self._set(ensemble=ensemble)

    @classmethod
    def of(cls, base: np.ndarray, rounds: list[list[Tree]]) -> BoostedModel:
        return cls(json.dumps({"base": base.tolist(), "rounds": [[t.to_list() for t in trees] for trees in rounds]}))

    def parts(self) -> tuple[np.ndarray, list[list[Tree]]]:
        held = json.loads(self.getOrDefault(self.ensemble))
        return np.array(held["base"], float), [[Tree.from_list(t) for t in trees] for trees in held["rounds"]]

    def staged_margins(self, stages: Sequence[int]) -> Column:
        """Margins after each number of rounds, in one pass over ``features``: array of arrays."""
        base, rounds = self.parts()
        marks = list(stages)
        counter = self.counter

        @F.pandas_udf("array<array<double>>")
        def score(features: pd.Series) -> pd.Series:
            out: list = [None] * len(features)
            some = np.flatnonzero(features.notna().to_numpy())
            if len(some):
                rows = np.stack(features.iloc[some].to_list()).astype(float)
                margins, steps, at = np.tile(base, (len(rows), 1)), [], 0
                for mark in marks:
                    margins = _add(margins, rounds[at:mark], rows, False)
                    at = max(at, mark)
                    steps.append(margins)
                for i, found in zip(some.tolist(), np.stack(steps, axis=1).tolist()):
                    out[i] = found
                if counter is not None:
                    counter.add(len(some))
            return pd.Series(out, dtype=object)

        return score

    def _transform(self, df: DataFrame) -> DataFrame:
        base, rounds = self.parts()
        classes = max(2, len(base))
        features = vector_to_array("features")
        if MASK in df.columns:
            features = F.when(F.col(MASK), features)
        margins = F.element_at(self.staged_margins([len(rounds)])(features), 1)
        zeros = F.array(*[F.lit(0.0)] * len(base))
        staged = df.withColumn("__margins", F.coalesce(margins, zeros))
        raw = F.col("__margins")
        pair = F.concat(F.transform(raw, lambda m: -m), raw) if len(base) == 1 else raw
        wide = F.concat(F.array(F.lit(0.0)), raw) if len(base) == 1 else raw
        odds = F.transform(wide, lambda m: F.exp(m - F.array_max(wide)))
        share = F.transform(odds, lambda o: o / F.aggregate(odds, F.lit(0.0), lambda a, x: a + x))
        scored = F.col(MASK) if MASK in df.columns else F.lit(True)
        share = F.when(scored, share).otherwise(F.array(*[F.lit(0.0)] * classes))
        return staged.withColumns({
            "rawPrediction": array_to_vector(pair), "probability": array_to_vector(share),
            "prediction": (F.array_position(wide, F.array_max(wide)) - 1).cast("double"),
        }).drop("__margins")


class HistBoosting(Estimator):
    """Pipeline stage that fits a :class:`BoostedModel` to a vector column ``features`` and ``label``."""

    def __init__(self, *, weightCol: str | None = None, **settings):
        super().__init__()
        self.weight, self.settings = weightCol, Settings(**settings)

    def _fit(self, df: DataFrame) -> BoostedModel:
        weight = F.col(self.weight) if self.weight else F.lit(1.0)
        rows = df.select(vector_to_array("features").alias("features"), "label", weight.alias("weight"))
        one = rows.select(F.size("features")).first()
        if one is None:
            raise ValueError("no rows to fit")
        return BoostedModel.of(*fit(rows, self.settings, one[0]))
