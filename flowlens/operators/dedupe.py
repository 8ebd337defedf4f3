"""Exact duplicate removal and accounting.

Copies are merged by aggregation, not by a window: partial aggregation shrinks a
hot group of copies to one row per task before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.cleaning import quoted


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 over the typed values of ``columns``; nulls stay distinct from blanks."""
    return F.sha2(F.to_json(F.struct(*[quoted(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def keep_first(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], across: Sequence[str] = ()
) -> DataFrame:
    """The lowest row by ``order`` of every set of equal ``keys`` (and ``across``).

    With one numeric order column and nothing else to carry this is a plain hash
    aggregate.
    """
    group = [*keys, *across]
    carried = [c for c in df.columns if c not in group]
    if list(order) == carried and len(carried) == 1:
        kept = df.groupBy(*[quoted(c) for c in group]).agg(F.min(quoted(order[0])).alias(order[0]))
        return kept.select(*[quoted(c) for c in df.columns])
    rest = [c for c in carried if c not in order]
    packed = F.struct(*[quoted(c) for c in [*order, *rest]])
    kept = df.groupBy(*[quoted(c) for c in group]).agg(F.min_by(packed, F.struct(*[quoted(c) for c in order])).alias("__row"))
    return kept.select(*[
        quoted(c) if c in group else F.col("__row").getField(c).alias(c) for c in df.columns
    ])


def first_copies(df: DataFrame, content: Sequence[str], id_column: str) -> DataFrame:
    """(id, copies) of the first row of every set of equal content.

    Long content is shuffled as a digest, never as text.
    """
    digests = df.select(row_digest(content).alias("digest"), quoted(id_column))
    return digests.groupBy("digest").agg(
        F.min(quoted(id_column)).alias(id_column), F.count(F.lit(1)).alias("copies")
    )


def duplicate_accounting(df: DataFrame, content: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Rows, distinct rows and surplus copies per group, really measured."""
    per_digest = df.select(*groups, row_digest(content).alias("digest")).groupBy(*groups, "digest").agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_digest.groupBy(*groups).agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        (F.sum("n") - F.count(F.lit(1))).alias("duplicate_rows"),
    )
