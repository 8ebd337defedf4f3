"""Every registered query with its SQL check, gathered from the group modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _groups():
    from flowlens.plans.catalog import (
        alerting,
        evaluation,
        flows,
        modelling,
        notifications,
        preparation,
        records,
        sampling,
        streams,
    )

    return (
        preparation, records, flows, evaluation, sampling, alerting, notifications, modelling, streams,
    )


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for group in _groups():
        for name, query in group.QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = query
    return found


def all_checks() -> dict[str, str]:
    found: dict[str, str] = {}
    for group in _groups():
        found.update(group.CHECKS)
    return found
