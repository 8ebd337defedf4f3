"""Small helpers for declaring queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.checks: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def wrap(function):
            name = function.__name__
            self.queries[name] = function
            if sql is not None:
                self.checks[name] = sql
            return function

        return wrap


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def joined(array: Column) -> Column:
    return F.array_join(array, ",")


def text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})
