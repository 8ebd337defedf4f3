"""Compare a Spark query with its SQL check on DuckDB, as order-free value sets."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(directory: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{directory}/{name}.parquet')")
    return connection


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return float(f"{value:.9g}")
    if isinstance(value, Decimal):
        return float(value)
    return value


def normalised(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def _kind(value):
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, (float, Decimal)):
        return "float"
    return type(value).__name__


def _kinds(rows, columns):
    seen = {}
    for row in rows[:2000]:
        for name, value in zip(columns, row):
            if value is not None:
                seen.setdefault(name, _kind(value))
    return seen


def difference(spark_df, connection, sql) -> str | None:
    """None when equal, else a short description."""
    columns = spark_df.columns
    left = [tuple(r) for r in spark_df.collect()]
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    right = result.fetchall()
    if sorted(columns) != sorted(names):
        return f"columns differ: {sorted(columns)} vs {sorted(names)}"
    if len(left) != len(right):
        return f"rows differ: {len(left)} vs {len(right)}"
    a, b = normalised(left, columns), normalised(right, names)
    if a != b:
        return f"values differ: only spark {list((a - b).items())[:3]} only sql {list((b - a).items())[:3]}"
    ka, kb = _kinds(left, columns), _kinds(right, names)
    if ka != kb:
        return f"types differ: { {k: (ka.get(k), kb.get(k)) for k in set(ka) | set(kb) if ka.get(k) != kb.get(k)} }"
    return None
