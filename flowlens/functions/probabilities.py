"""Columns over class-probability arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.functions.records import literal_array


def top1(probabilities: Column) -> Column:
    return F.array_max(probabilities)


def runner_up(probabilities: Column) -> Column:
    """Second largest probability, 0 for a single class."""
    return F.coalesce(F.get(F.sort_array(probabilities, asc=False), F.lit(1)), F.lit(0.0))


def margin(probabilities: Column) -> Column:
    return top1(probabilities) - runner_up(probabilities)


def argmax(probabilities: Column) -> Column:
    """Zero-based class index, lowest on ties."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def argmax_label(probabilities: Column, labels) -> Column:
    return F.get(literal_array(labels), argmax(probabilities))
