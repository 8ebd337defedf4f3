"""Compute costly columns once.

The optimizer copies a column's expression into every filter and projection
above it. For a JSON parse feeding dozens of columns those copies multiply, so
parsed values are emitted through a one-row generator: expressions above it
refer to its output instead of being merged into it. Nothing is shuffled and
unused columns are still pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


LOOKUP_ROWS = 100_000


def lookup(table: DataFrame, limit: int = LOOKUP_ROWS) -> DataFrame:
    """A small table to join many rows with: broadcast if it has at most ``limit`` rows.

    Tables of one row per label, model or file keep the many rows where they
    are. The size is checked, not assumed: a larger table is returned as it is,
    and the join shuffles both sides.
    """
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        return table
    return F.broadcast(table.sparkSession.createDataFrame(rows, table.schema))


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose expressions are evaluated exactly once per row."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    row = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select(*kept, F.inline(row))
