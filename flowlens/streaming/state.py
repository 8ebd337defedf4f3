"""Upserted state of a stream: one snapshot and the batches since.

A sink folder holds ``batch_id=<n>`` folders. ``compact`` merges the last snapshot
and the batches after it into ``<folder>__state/upto=<n>``. Readers take the newest
complete snapshot and the later batches, so a read opens a bounded number of
folders however long the stream runs. Compaction overwrites its own output and
is named by its batch, so running it again does no harm; batches and snapshots go
only when a later snapshot has replaced them twice, which leaves readers theirs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BATCH = "batch_id"
EVERY = 100  # batches between two compactions
Merge = Callable[[DataFrame | None, DataFrame | None], DataFrame]


def _numbered(spark: SparkSession, folder: str, prefix: str) -> dict[int, str]:
    """Complete folders ``<prefix>=<n>`` below a folder, by number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return {}
    found = {}
    for status in store.listStatus(path):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith(f"{prefix}=") and store.exists(done):
            found[int(name.split("=", 1)[1])] = f"{folder}/{name}"
    return dict(sorted(found.items()))


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parts(spark: SparkSession, folder: str) -> tuple[DataFrame | None, DataFrame | None]:
    """The newest snapshot and the batches after it (with ``batch_id``)."""
    snapshots = _numbered(spark, f"{folder}__state", "upto")
    upto = max(snapshots, default=-1)
    later = [path for n, path in _numbered(spark, folder, BATCH).items() if n > upto]
    rows = spark.read.option("basePath", folder).parquet(*later) if later else None
    return (spark.read.parquet(snapshots[upto]) if snapshots else None), rows


def compact(spark: SparkSession, folder: str, merge: Merge, upto: int) -> None:
    """Write the snapshot of all batches up to ``upto``; let go of what two snapshots have replaced."""
    snapshots = _numbered(spark, f"{folder}__state", "upto")
    before = max((n for n in snapshots if n < upto), default=-1)
    later = [path for n, path in _numbered(spark, folder, BATCH).items() if before < n <= upto]
    state = spark.read.parquet(snapshots[before]) if before >= 0 else None
    rows = spark.read.option("basePath", folder).parquet(*later) if later else None
    if state is None and rows is None:
        return
    merge(state, rows).write.mode("overwrite").parquet(f"{folder}__state/upto={upto}")
    for n, path in snapshots.items():
        if n < before:
            _remove(spark, path)
    for n, path in _numbered(spark, folder, BATCH).items():
        if n <= before:
            _remove(spark, path)
