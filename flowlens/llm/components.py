"""Connected components of a table of links, by alternating stars.

Each round points every node's larger neighbours, then its smaller ones, at its
smallest neighbour. Rounds grow with the logarithm of the longest path. Every
step is a grouped minimum, which is pre-aggregated, and an equality join that
Spark can split where one node has very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.plans.workspace import discard, stored

MAX_ROUNDS = 60


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    if larger:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        out = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        pairs = down.join(least, "u")
        out = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); the smallest node names its component."""
    edges = stored(
        links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter(F.col("u") != F.col("v")).distinct(), "links"
    )
    seen = None
    for _ in range(MAX_ROUNDS):
        before, edges = edges, stored(_star(_star(edges, larger=True), larger=False), "links")
        discard(before)
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("links did not settle")
    labelled = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return labelled.unionByName(roots)
