"""Exact top-k inner-product search by tiled matrix products (operator 5).

Vectors become whole numbers, floor(scale * x), so scores are exact. Queries
are cut into blocks and all vectors into shards; each pair of a block and a
shard is one tile, computed as matrix products of bounded size. A tile keeps a
query's k best of its shard; lists are then merged level by level, ``FAN``
shards to a node, until one list per query is left. No task ever holds more
than a tile, and no list is longer than ``FAN`` times k.

Products run in double precision where every partial sum stays below 2^53 and
so is exact, otherwise on longs, and on unbounded whole numbers where a long
might overflow. Scores are longs: a pair whose score does not fit one fails the
query.

Defined cases: vectors that are null, or hold a null, infinite or NaN
component, and rows with a null id take no part; vectors of other lengths than
a query's are not compared with it; rows that repeat an id all take part, none
against a row of its own id, and the answers of query rows that share an id are
ranked together; ties go to the smaller id; an empty table gives an empty
result; extra columns are ignored. Finite components may have any size.

Whole numbers travel as integers where all of them fit, and blocks of queries are
large, so that each vector is sent few times.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.plans.workspace import stored

SCALE = 64
TOP = 20
QUERY_BLOCK = 8192
QUERY_STRIP = 1024
SHARD = 8192
STRIP = 2048
FAN = 16


def whole_vectors(table: DataFrame, vec_id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, v): usable vectors as arrays of whole numbers.

    They are doubles, since a long cannot hold every finite component; from 2^53 on every double is whole.
    """
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    usable = F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & F.forall(
        values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    scaled = F.transform(values, lambda x: x * F.lit(float(scale)))
    whole = F.transform(
        scaled, lambda x: F.when(F.abs(x) < F.lit(float(1 << 53)), F.floor(x).cast("double")).otherwise(x)
    )
    return table.filter(usable).select(F.col(vec_id).cast("long").alias("id"), whole.alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()) if len(column) else np.zeros((0, 0))


def _products(
    queries: np.ndarray, vectors: np.ndarray, own: np.ndarray | None = None, ids: np.ndarray | None = None
) -> np.ndarray:
    """Exact inner products as longs; pairs of a query with its own id may hold anything."""
    n = max(1, queries.shape[1])
    most = [np.abs(m).max(axis=1, initial=0).astype(np.float64) for m in (queries, vectors)]
    with np.errstate(over="ignore", invalid="ignore"):
        left, right = queries.astype(np.float64), vectors.astype(np.float64)
        if not len(left) or not len(right) or most[0].max() * most[1].max() * n < 2**53:
            return (left @ right.T).astype(np.int64)
        scores = (left @ right.T).astype(np.int64)
        whole = queries.astype(np.int64), vectors.astype(np.int64)
        # Longs wrap around, so a sum is right whenever the score itself fits; whether it must fit is seen from the
        # sum of sizes, of which a double knows enough.
        for i in np.flatnonzero(~(most[0] * most[1].max() * n < 2**53)):
            columns = np.flatnonzero(~(most[0][i] * most[1] * n < 2**53))
            if own is not None:
                columns = columns[ids[columns] != own[i]]
            scores[i, columns] = whole[1][columns] @ whole[0][i]
            sizes = np.abs(right[columns]) @ np.abs(left[i])
            for j in columns[~(sizes < 2**62)]:
                score = sum(int(x) * int(y) for x, y in zip(queries[i].tolist(), vectors[j].tolist()))
                if abs(score) >= 2**63:
                    pair = "" if own is None else f" of vectors {own[i]} and {ids[j]}"
                    raise OverflowError(f"the score{pair} does not fit a long: {score}")
                scores[i, j] = score
    return scores


def best_of(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """Row, id and score of each row's k best columns; its own id is left out."""
    rows, columns = np.nonzero(ids[None, :] == own[:, None])
    floor = np.iinfo(np.int64).min
    scores[rows, columns] = floor
    if scores.shape[1] > k:
        # Everything at or above the k-th score, then exact order among these.
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        rows, columns = np.nonzero((scores >= kth[:, None]) & (scores > floor))
    else:
        rows, columns = np.nonzero(scores > floor)
    found = scores[rows, columns]
    order = np.lexsort((ids[columns], -found, rows))
    rows, columns, found = rows[order], columns[order], found[order]
    first = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - first < k
    return rows[keep], ids[columns[keep]], found[keep]


def _tile(k: int):
    def run(keys, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(vectors):
            q, own = _matrix(queries["q"]), queries["query"].to_numpy()
            for low in range(0, len(vectors), STRIP):
                part = vectors.iloc[low:low + STRIP]
                held, matrix = part["id"].to_numpy(), _matrix(part["v"])
                for first in range(0, len(q), QUERY_STRIP):
                    mine = own[first:first + QUERY_STRIP]
                    rows, ids, scores = best_of(_products(q[first:first + QUERY_STRIP], matrix, mine, held), held, mine, k)
                    out.append(pd.DataFrame({"query_id": mine[rows], "vec_id": ids, "score": scores}))
        found = pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        if len(out) > 1:
            found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            found = found.groupby("query_id", sort=False).head(k)
        return found.assign(node=np.int64(keys[2]))[["query_id", "vec_id", "score", "node"]]

    return run


def search(
    table: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = TOP, scale: int = SCALE
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best vectors of every row that ``is_query`` holds for."""
    vectors = stored(whole_vectors(table, vec_id, vector, scale).withColumn("size", F.size("v")), "vectors")
    counts = vectors.agg(
        F.count(F.lit(1)), F.count(F.when(is_query, 1)), F.max(F.array_max(F.transform("v", F.abs)))
    ).first()
    kind = "int" if (counts[2] or 0) < 2**31 else "double"
    # Numbered rows: those of one id are dealt out like any others.
    vectors = stored(
        vectors.select("id", F.col("v").cast(f"array<{kind}>").alias("v"), "size", F.monotonically_increasing_id().alias("row")), "numbered"
    )
    queries = vectors.filter(is_query)
    shards, blocks = -(-counts[0] // SHARD) or 1, -(-counts[1] // QUERY_BLOCK) or 1
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(
        F.col("id").alias("query"), F.col("v").alias("q"), F.col("size").alias("qsize"),
        F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("qblock"), span(shards).alias("qshard"),
    )
    held = vectors.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).withColumn("block", span(blocks))
    tiles = asked.groupBy("qsize", "qblock", "qshard").cogroup(held.groupBy("size", "block", "shard"))
    lists = tiles.applyInPandas(_tile(k), "query_id long, vec_id long, score long, node long")
    nodes = shards
    while True:
        lists = lists.withColumn("node", F.floor(F.col("node") / F.lit(FAN)).cast("long"))
        best = Window.partitionBy("query_id", "node").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        nodes = -(-nodes // FAN)
        if nodes <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")
