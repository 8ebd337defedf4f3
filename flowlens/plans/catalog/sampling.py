"""Sampling and class weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import sampling as sm
from flowlens.plans import bindings as b
from flowlens.plans.catalog.registry import Registry, rounded
from flowlens.sources.tables import read_table

_r = Registry()
QUERIES, CHECKS = _r.queries, _r.checks


def labelled_orders(spark, sf):
    """Orders as labelled rows: finished ones are benign."""
    return read_table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", F.when(F.col("o_orderstatus") == "F", "Benign").otherwise("Attack").alias("label")
    )


_ORDERS = """lo AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'Benign' ELSE 'Attack' END AS label FROM orders), n AS (
  SELECT label, count(*) AS rows FROM lo GROUP BY 1), hashed AS (
  SELECT *, md5('{seed}|' || o_orderkey) AS h FROM lo), rk AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, o_orderkey) AS rn FROM hashed)"""


@_r.query(f"""WITH {_ORDERS.format(seed=7)}, bn AS (SELECT max(rows) FILTER (WHERE label = 'Benign') AS b, max(rows) FILTER (WHERE label = 'Attack') AS a FROM n)
SELECT o_orderkey, o_orderpriority, label FROM rk, bn WHERE label = 'Benign' OR rn <= least(a, b * 2, 8001)""")
def training_sample(spark, sf):
    return sm.training_sample(labelled_orders(spark, sf), "label", 7, ["o_orderkey"], 2, 8001)


@_r.query(f"WITH {_ORDERS.format(seed=11)} SELECT o_orderkey, o_orderpriority, label FROM rk WHERE rn <= CASE label WHEN 'Benign' THEN 1234 ELSE 777 END")
def class_capped_sample(spark, sf):
    rows = labelled_orders(spark, sf)
    caps = sm.class_counts(rows, "label").select("label", F.when(F.col("label") == "Benign", 1234).otherwise(777).alias("cap"))
    return sm.capped_sample(rows, "label", caps, 11, ["o_orderkey"])


@_r.query("""WITH h AS (SELECT event_id, md5('5|' || event_id) AS h FROM events)
SELECT event_id FROM h ORDER BY h, event_id LIMIT 2500""")
def evaluation_subset(spark, sf):
    return sm.row_subset(read_table(spark, sf, "events").select("event_id"), 2500, 5, ["event_id"])


@_r.query(f"""WITH {_ORDERS.format(seed=3)}, f AS (SELECT o_orderpriority AS c, min(o_orderkey) AS first FROM lo GROUP BY 1), rest AS (
  SELECT h.*, row_number() OVER (ORDER BY h, o_orderkey) AS r FROM hashed h JOIN f ON f.c = h.o_orderpriority WHERE h.o_orderkey <> f.first)
SELECT o_orderkey, o_orderpriority, label FROM lo JOIN f ON f.c = lo.o_orderpriority AND f.first = lo.o_orderkey
UNION ALL SELECT o_orderkey, o_orderpriority, label FROM rest WHERE r <= 500 - (SELECT count(*) FROM f)""")
def class_preserving_sample(spark, sf):
    return sm.class_preserving_sample(labelled_orders(spark, sf), "o_orderpriority", 500, 3, ["o_orderkey"])


@_r.query(f"""WITH {_ORDERS.format(seed=1)}, bn AS (SELECT coalesce(max(rows) FILTER (WHERE label = 'Benign'), 0) AS b FROM n)
SELECT 'small' AS plan, 'Benign' AS label, CAST(CASE WHEN 1000 <= b THEN 1000 ELSE -1 END AS BIGINT) AS cap FROM bn UNION ALL SELECT 'small', 'Attack', CASE WHEN 1000 <= b THEN 0 ELSE 1000 - b END FROM bn
UNION ALL SELECT 'large', 'Benign', CASE WHEN 100000000 <= b THEN 100000000 ELSE -1 END FROM bn UNION ALL SELECT 'large', 'Attack', CASE WHEN 100000000 <= b THEN 0 ELSE 100000000 - b END FROM bn
UNION ALL SELECT 'all', 'Benign', -1 UNION ALL SELECT 'all', 'Attack', -1""")
def target_size_caps(spark, sf):
    counts = sm.class_counts(labelled_orders(spark, sf), "label")
    tables = [
        sm.target_size_caps(counts, "label", size).select(F.lit(plan).alias("plan"), "label", F.coalesce("cap", F.lit(-1).cast("long")).alias("cap"))
        for plan, size in (("small", 1000), ("large", 100_000_000), ("all", None))
    ]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


@_r.query(f"""WITH {_ORDERS.format(seed=1)}, c AS (SELECT *, CASE label WHEN 'Attack' THEN 777 END AS cap FROM n)
SELECT label, rows AS total_rows, CAST(coalesce(least(rows, cap), rows) AS BIGINT) AS sampled_rows,
       round(CASE WHEN cap IS NULL THEN CAST(1 AS DOUBLE) ELSE least(1, CAST(cap AS DOUBLE) / rows) END, 8) AS keep_probability FROM c""")
def keep_probabilities(spark, sf):
    counts = sm.class_counts(labelled_orders(spark, sf), "label")
    caps = counts.select("label", F.when(F.col("label") == "Attack", 777).cast("long").alias("cap"))
    return rounded(sm.keep_probabilities(counts, "label", caps), 8, "keep_probability")


@_r.query("""WITH n AS (SELECT l_returnflag, count(*) AS rows FROM lineitem GROUP BY 1)
SELECT l_returnflag, rows, round(pow(CAST((SELECT max(rows) FROM n) AS DOUBLE) / rows, 0.5), 8) AS weight FROM n""")
def class_weights(spark, sf):
    counts = sm.class_counts(read_table(spark, sf, "lineitem"), "l_returnflag")
    return rounded(sm.class_weights(counts, "l_returnflag", 0.5), 8, "weight")


@_r.query(f"""WITH {_ORDERS.format(seed=1)}
SELECT label, rows, round((SELECT sum(rows) FROM n) / (2 * CAST(rows AS DOUBLE)) * CASE label WHEN 'Attack' THEN CAST(1.15 AS DOUBLE) ELSE 1 END, 8) AS weight FROM n""")
def balanced_weights(spark, sf):
    counts = sm.class_counts(labelled_orders(spark, sf), "label")
    return rounded(sm.balanced_weights(counts, "label", 1.15), 8, "weight")


@_r.query(f"""WITH {b.SCORED}, n AS (SELECT family, count(*) AS rows FROM scored GROUP BY 1)
SELECT family, count(*) AS rows, round(sum(w), 4) AS total_weight FROM scored JOIN (
  SELECT family, pow(CAST((SELECT max(rows) FROM n) AS DOUBLE) / rows, 1) AS w FROM n) USING (family) GROUP BY 1""")
def weighted_rows(spark, sf):
    rows = b.scored_events(spark, sf)
    weights = sm.class_weights(sm.class_counts(rows, "family"), "family", 1.0)
    return sm.with_weights(rows, "family", weights).groupBy("family").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("weight"), 4).alias("total_weight")
    )
