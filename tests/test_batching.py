"""Micro-batches that leave by count and by age."""

import time

import pytest

from flowlens.streaming import batching


def test_batches_by_count_and_by_age(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    batching.use_rocksdb(spark)
    folder = str(tmp_path / "in")
    put = lambda key, low, high: spark.createDataFrame([(key, f"{n:04d}") for n in range(low, high)], "key string, value string").coalesce(1).write.mode("append").parquet(folder)
    put("a", 0, 70)
    put("b", 0, 5)
    source = spark.readStream.schema("key string, value string").parquet(folder)
    rows = []
    query = batching.in_batches(source, "key", max_records=32, seconds=1.0).writeStream.foreachBatch(
        lambda batch, _: rows.extend(batch.collect())
    ).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="1 second").start()
    try:
        wait = time.time() + 120
        while len(rows) < 75 and time.time() < wait and query.exception() is None:
            time.sleep(0.5)
        put("b", 5, 45)
        while len(rows) < 115 and time.time() < wait and query.exception() is None:
            time.sleep(0.5)
    finally:
        query.stop()
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert query.exception() is None
    batches = {}
    for r in rows:
        batches.setdefault((r["key"], r["batch"], r["cause"]), []).append(r["value"])
    sizes = {k: len(v) for k, v in batches.items()}
    assert sizes == {
        ("a", 0, "records"): 32, ("a", 1, "records"): 32, ("a", 2, "interval"): 6,
        ("b", 0, "interval"): 5, ("b", 1, "records"): 32, ("b", 2, "interval"): 8,
    }
    assert sorted(v for k, b in batches.items() if k[0] == "a" for v in b) == [f"{n:04d}" for n in range(70)]


def test_empty_batches_are_refused(spark):
    with pytest.raises(ValueError):
        batching.in_batches(spark.createDataFrame([("a", "b")], "key string, value string"), "key", max_records=0)
