"""N-gram Jaccard self-join with a count-vector R-tree (operator 4).

A document is the set of its 5-word shingles. Shingles are hashed into
``GROUPS`` groups; the numbers of shingles per group are a point, and the sum
of coordinate minima of two points bounds the overlap of their sets. Two sets of
sizes p and q have Jaccard similarity of at least t only if they share
t / (1 + t) * (p + q) shingles, so a pair whose bound is smaller is pruned, and a
node of the tree is pruned by the same sum over its box. Points that pass are
also compared by the parities of ``PARITY_BITS`` finer groups: each odd
difference is a shingle that only one set has. Surviving pairs are verified on
the sets themselves.

One tree over all documents would be one task, so the space is cut first,
without loss: under any fixed order of all shingles, two similar sets share one
within their first size - ceil(t * size) + 1. The order is by hash, with
frequent shingles last (rarest first), so common passages do not lead sets of
other content. Each leading shingle that two sets share is a block with a tree
of its own; large blocks are cut into tiles that meet pairwise.

Copies make blocks large. Equal sets are one node from the start. Then every
node of a block is compared with two pivots of the block (its smallest and
largest node), and blocks whose nodes are already connected are done. Trees
search the rest, and only for pairs of different components. No link between
components is lost, and a group of k copies costs about k comparisons.

Hashes: shingles and set ids have 64 bits; with 10^10 different sets about three
pairs of set ids are expected to collide.

Defined cases: null texts and texts without words have an empty set and are
linked with nothing, not even each other; shorter texts have one shingle; equal
rows are linked; a null id takes part but never names a component unless all
ids in it are null; an empty table gives an empty result; extra columns pass
through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.bitmaps import bitmap_of
from flowlens.llm.common import document_key, fresh, quoted
from flowlens.llm.components import components
from flowlens.llm.shingles import Hasher, set_id
from flowlens.llm.tokens import chunks
from flowlens.plans.workspace import discard, stored

PERCENT = 80
GROUPS = 64
PARITY_BITS = 2048  # beside every point
SET_BITS = 16_384  # beside every set that is to be verified
MAX_FREQUENT = 65_536
SEGMENT = 4_000_000
TILE = 1024
SMALL = 24
LEAF = 16


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    hasher = Hasher()
    for batch in batches:
        for part, texts in chunks(batch, "text"):
            yield part, hasher.sets(texts)


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of shingles in about a thousandth of all documents or more.

    They only decide an order, so any table is right; this one is counted over
    all documents, in segments that report what is frequent inside them. The
    most frequent ``MAX_FREQUENT`` are kept, which bounds it.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def report(held: list[np.ndarray], documents: int) -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= max(3, documents // 2000)
            return pa.RecordBatch.from_arrays(
                [pa.array(found[often].view(np.int64)), pa.array(times[often].astype(np.int64))], names=["h", "n"]
            )

        held, size, documents = [], 0, 0
        for _, found in _sets(batches):
            held += found
            size += sum(map(len, found))
            documents += len(found)
            if size >= SEGMENT:
                yield report(held, documents)
                held, size, documents = [], 0, 0
        if held:
            yield report(held, documents)

    total = docs.count()
    counted = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counted.filter(F.col("n") >= max(50, total // 1000)).orderBy(F.desc("n"), "h").limit(MAX_FREQUENT).collect()
    ordered = sorted((r["h"] % (1 << 64), r["n"]) for r in top)
    return np.array([h for h, _ in ordered], np.uint64), np.array([n for _, n in ordered], np.int64)


def count_vector(hashes: np.ndarray) -> bytes:
    """Shingles per group, in the narrowest whole numbers that hold them."""
    counts = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS)
    width = np.uint8 if counts.max() < 256 else np.uint16 if counts.max() < 65_536 else np.uint32
    return counts.astype(width).tobytes()


def parities(hashes: np.ndarray, bits: int = PARITY_BITS) -> bytes:
    """One bit per fine group: whether it holds an odd number of shingles."""
    fine = (hashes >> np.uint64(8)).astype(np.int64) % bits
    return np.packbits(np.bincount(fine, minlength=bits) & 1).tobytes()


def _bits(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(r, np.uint64) for r in column.to_pylist()]) if len(column) else np.zeros((0, 1), np.uint64)


def _few_differences(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the differences seen leave room for the similarity; ``sizes`` are sums of both sizes."""
    seen = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return (100 + PERCENT) * seen <= (100 - PERCENT) * sizes


def _points(column: pa.Array) -> np.ndarray:
    """Count vectors as one matrix."""
    rows = column.to_pylist()
    widest = max((len(r) for r in rows), default=GROUPS) // GROUPS
    kinds = {1: "<u1", 2: "<u2", 4: "<u4"}
    return np.stack([np.frombuffer(r, kinds[len(r) // GROUPS]).astype(kinds[widest]) for r in rows])


def leading(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first size - ceil(t * size) + 1 shingles in the common order."""
    size = len(hashes)
    want = size - -(-PERCENT * size // 100) + 1
    if not len(frequent):
        return hashes[:want]
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    common = frequent[at] == hashes
    first = hashes[~common][:want]
    if len(first) == want:
        return first
    rest, times = hashes[common], counts[at[common]]
    return np.concatenate([first, rest[np.lexsort((rest, times))][:want - len(first)]])


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, ha, hb, n, node, lead, counts, parity) per document; node is null without shingles."""
    frequent, counts = frequent_shingles(docs)
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("ha", T.LongType()), T.StructField("hb", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("node", T.LongType()),
        T.StructField("lead", T.ArrayType(T.LongType())), T.StructField("counts", T.BinaryType()),
        T.StructField("parity", T.BinaryType()),
    ])

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _sets(batches):
            lead = [leading(h, frequent, counts) if len(h) else h for h in found]
            ends = np.cumsum([0, *map(len, lead)]).astype(np.int32)
            flat = np.concatenate(lead).view(np.int64) if lead else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), part.column(3), pa.array([len(h) for h in found], pa.int64()),
                 pa.array([set_id(h) if len(h) else None for h in found], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                 pa.array([count_vector(h) for h in found], pa.binary()), pa.array([parities(h) for h in found], pa.binary())],
                names=schema.fieldNames(),
            )

    key = document_key()["h"]
    return stored(docs.select("doc_id", "text", key["a"].alias("ha"), key["b"].alias("hb")).mapInArrow(profile, schema), "profiles")


def shared_postings(profiled: DataFrame) -> DataFrame:
    """(token, node, low, high): leading shingles of two sets or more, with the block's pivots.

    Most leading shingles occur in one set only. A bounded bitmap of the shared
    ones drops nearly all others before anything is shuffled for the join.
    """
    named = profiled.filter("node is not null").select("node", "lead")
    blocks = stored(
        named.select(F.explode("lead").alias("token"), "node")
        .groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high"))
        .filter(F.col("low") < F.col("high")),
        "blocks",
    )
    shared = bitmap_of(blocks, "token")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(1).flatten().to_numpy()
            node = np.repeat(batch.column(0).to_numpy(), pc.list_value_length(batch.column(1)).to_numpy())
            some = shared.holds(tokens)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[some]), pa.array(node[some])], names=["token", "node"])

    posted = named.mapInArrow(keep, "token long, node long")
    postings = stored(posted.join(blocks, "token").distinct(), "postings")
    discard(blocks)
    return postings


def _fits(a: str, b: str):
    """Sizes that allow the similarity at all."""
    return (F.col(a) * 100 >= F.col(b) * PERCENT) & (F.col(b) * 100 >= F.col(a) * PERCENT)


def _pass_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose summed coordinate minima reach the overlap they need, with few odd differences."""
    for batch in batches:
        if batch.num_rows:
            x, y = _points(batch.column(4)), _points(batch.column(5))
            overlap = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            keep = (100 + PERCENT) * overlap >= PERCENT * sizes
            keep = pa.array(keep & _few_differences(_bits(batch.column(6)), _bits(batch.column(7)), sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def pivot_candidates(postings: DataFrame, points: DataFrame) -> DataFrame:
    """(a, b): each node with its blocks' pivots, where sizes and count vectors allow."""
    pairs = postings.select(F.explode(F.array("low", "high")).alias("b"), F.col("node").alias("a"))
    pairs = pairs.filter(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()
    x = points.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca"), F.col("parity").alias("pa"))
    y = points.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb"), F.col("parity").alias("pb"))
    # Sizes first, in their own join, so that vectors travel only for pairs that fit.
    sized = pairs.join(x.select("a", "na"), "a").join(y.select("b", "nb"), "b").filter(_fits("na", "nb"))
    both = sized.join(x.select("a", "ca", "pa"), "a").join(y.select("b", "cb", "pb"), "b").select(
        "a", "b", "na", "nb", "ca", "cb", "pa", "pb"
    )
    return both.mapInArrow(_pass_bound, "a long, b long")


class RTree:
    """A packed tree over points with sizes; boxes hold coordinate maxima and the range of sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        # Packed along the sizes, then the heaviest coordinates, so leaves hold like points.
        heavy = np.argsort(-points.astype(np.int64).var(axis=0))[:2]
        self.order = np.lexsort((points[:, heavy[1]], points[:, heavy[0]], labels, sizes))
        self.points, self.sizes, self.labels = points[self.order], sizes[self.order], labels[self.order]
        self.levels = []
        top, low, high = self.points, self.sizes, self.sizes
        while len(top) > LEAF:
            cuts = np.arange(0, len(top), LEAF)
            top, low, high = (
                np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            )
            self.levels.append((top, low, high))

    @staticmethod
    def _may(point: np.ndarray, size: int, tops: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether something in each box can be similar: its size fits and the overlap bound suffices."""
        least = np.maximum(low, -(-PERCENT * size // 100))
        bound = np.minimum(tops, point).sum(axis=1, dtype=np.int64)
        return (least <= high) & (low * PERCENT <= 100 * size) & ((100 + PERCENT) * bound >= PERCENT * (size + least))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Places (in packed order) of the points that survive every bound."""
        below = [len(self.points), *(len(top) for top, _, _ in self.levels)]
        alive = np.arange(below[-1])
        for k in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[k]
            alive = alive[self._may(point, size, top[alive], low[alive], high[alive])]
            alive = (alive[:, None] * LEAF + np.arange(LEAF)).ravel()
            alive = alive[alive < below[k]]
        return alive[self._may(point, size, self.points[alive], self.sizes[alive], self.sizes[alive])]


def _small_blocks(edges: np.ndarray, sizes: np.ndarray, points: np.ndarray, labels: np.ndarray):
    """All pairs at each distance inside short blocks, pruned by the same bounds."""
    block = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    for lag in range(1, SMALL):
        a = np.flatnonzero(block[lag:] == block[:-lag]) if lag < len(block) else np.zeros(0, np.int64)
        if not len(a):
            break
        b = a + lag
        fit = (labels[a] != labels[b]) & (sizes[a] * 100 >= sizes[b] * PERCENT) & (sizes[b] * 100 >= sizes[a] * PERCENT)
        a, b = a[fit], b[fit]
        overlap = np.minimum(points[a], points[b]).sum(axis=1, dtype=np.int64)
        keep = (100 + PERCENT) * overlap >= PERCENT * (sizes[a] + sizes[b])
        yield a[keep], b[keep]


def _large_block(diagonal: bool, side: np.ndarray, sizes: np.ndarray, points: np.ndarray, labels: np.ndarray):
    """Tree search of one tile: a part of a block against itself, or side 1 against the tree of side 0."""
    first = np.flatnonzero(side == 0)
    queries = first if diagonal else np.flatnonzero(side == 1)
    if not len(first):
        return
    tree = RTree(points[first], sizes[first], labels[first])
    for q in queries.tolist():
        hits = first[tree.order[tree.search(points[q], int(sizes[q]))]]
        hits = hits[labels[hits] != labels[q]]
        if diagonal:
            hits = hits[hits > q]
        if len(hits):
            yield np.full(len(hits), q), hits


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of a partition sorted by block and tile."""
    held: pa.Table | None = None

    def pairs(table: pa.Table) -> pa.RecordBatch:
        batch = table.combine_chunks()
        key = np.stack([batch.column(k).to_numpy() for k in ("token", "i", "j")], axis=1)
        edges = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
        node, sizes, labels, side = (batch.column(k).to_numpy() for k in ("node", "n", "label", "side"))
        points = _points(batch.column("counts"))
        found = []
        lengths = np.diff(edges)
        small = np.repeat(lengths <= SMALL, lengths)
        # Tiles of two sides are always searched with a tree.
        small &= key[:, 1] == key[:, 2]
        at = np.flatnonzero(small)
        if len(at):
            own = np.concatenate([[0], np.flatnonzero((key[at][1:] != key[at][:-1]).any(axis=1)) + 1, [len(at)]])
            found += [(at[a], at[b]) for a, b in _small_blocks(own, sizes[at], points[at], labels[at])]
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if not small[low]:
                part = slice(low, high)
                tile = _large_block(
                    key[low, 1] == key[low, 2], side[part], sizes[part], points[part], labels[part]
                )
                found += [(low + a, low + b) for a, b in tile]
        a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([y for _, y in found]) if found else np.zeros(0, np.int64)
        fine = _bits(batch.column("parity"))
        keep = np.zeros(len(a), bool)
        for low in range(0, len(a), 65_536):
            part = slice(low, low + 65_536)
            keep[part] = _few_differences(fine[a[part]], fine[b[part]], sizes[a[part]] + sizes[b[part]])
        a, b = node[a[keep]], node[b[keep]]
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows >= 4 * TILE:
            last = [held.column(k)[-1].as_py() for k in ("token", "i", "j")]
            same = np.ones(held.num_rows, bool)
            for k, v in zip(("token", "i", "j"), last):
                same &= held.column(k).to_numpy() == v
            cut = held.num_rows - int(same.sum())
            if cut:
                yield pairs(held.slice(0, cut))
                held = held.slice(cut)
    if held is not None and held.num_rows:
        yield pairs(held)


def tree_candidates(postings: DataFrame, points: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): pairs of different components that survive the trees of their blocks."""
    named = postings.select("token", "node").join(labels.withColumnRenamed("component", "label"), "node", "left")
    named = named.withColumn("label", F.coalesce("label", "node"))
    # Blocks of the same nodes (by two sums of hashes) hold the same pairs; one is enough.
    sums = {k: F.sum(F.xxhash64(F.lit(k), "node").cast("decimal(38,0)")).alias(k) for k in ("s", "t")}
    blocks = (
        named.groupBy("token")
        .agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("size"), *sums.values())
        .filter(F.col("least") < F.col("most"))
        .groupBy("size", *sums).agg(F.min("token").alias("token"))
        .select("token", F.ceil(F.col("size") / F.lit(TILE)).cast("int").alias("parts"))
    )
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    tiled = (
        named.join(blocks, "token").withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "token", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
            (F.col("part") > F.col("other")).cast("int").alias("side"), "node", "label",
        )
    )
    placed = tiled.join(points, "node").select("token", "i", "j", "side", "node", "n", "label", "counts", "parity")
    spread = placed.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return spread.mapInArrow(_search, "a long, b long").distinct()


def _pass_fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with few odd differences among the finest groups."""
    for batch in batches:
        if batch.num_rows:
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            keep = pa.array(_few_differences(_bits(batch.column(4)), _bits(batch.column(5)), sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar enough, by their exact intersection.

    Long sets just below the threshold pass the coarser bounds, so two kilobytes
    of finer parities are compared before whole sets travel.
    """
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("fine").alias("fa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("fine").alias("fb"))
    likely = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "fa", "fb")
    pairs = stored(likely.mapInArrow(_pass_fine, "a long, b long").distinct(), "pairs")
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.join(y, "b").join(x, "a").select(
        "a", "b", F.size(F.array_intersect("sa", "sb")).alias("both"), (F.size("sa") + F.size("sb")).alias("sum")
    )
    return joined.filter((100 + PERCENT) * F.col("both") >= PERCENT * F.col("sum")).select("a", "b").distinct()


def node_sets(docs: DataFrame, profiled: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, shingles) of all nodes in the pairs, and a few more, recomputed from a document of each.

    Documents are picked by a bounded bitmap of hashed ids, so texts are never shuffled.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    hashed = F.xxhash64("doc_id").alias("at")
    wanted = bitmap_of(
        profiled.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select(hashed), "at"
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = (batch.filter(pa.array(wanted.holds(batch.column(1).to_numpy()))) for batch in batches)
        for _, found in _sets(chosen):
            found = [h for h in found if len(h)]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(h) for h in found], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                 pa.array([len(h) for h in found], pa.int64()), pa.array([parities(h, SET_BITS) for h in found], pa.binary())],
                names=["node", "shingles", "n", "fine"],
            )

    schema = "node long, shingles array<long>, n long, fine binary"
    return stored(docs.select("text", hashed).mapInArrow(build, schema), "sets")


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, ha, hb, n_shingles, node, component) of every row; component is a set's, null without shingles."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select("doc_id", "text")
    profiled = profiles(docs)
    postings = shared_postings(profiled)
    nodes = postings.select("node").distinct()
    points = stored(
        profiled.join(nodes, "node").groupBy("node").agg(F.first("n").alias("n"), F.first("counts").alias("counts"), F.first("parity").alias("parity")), "points"
    )
    # Each table is deleted as soon as nothing below reads it.
    wide, profiled = profiled, stored(profiled.drop("lead", "counts", "parity"), "profiles")
    discard(wide)
    pairs = stored(pivot_candidates(postings, points), "pairs")
    sets = node_sets(docs, profiled, pairs)
    near = stored(verified(pairs, sets), "links")
    discard(pairs, sets)
    labels = stored(components(near), "labels") if near.head(1) else spark.createDataFrame([], "node long, component long")
    pairs = stored(tree_candidates(postings, points, labels), "pairs")
    discard(postings, points)
    sets = node_sets(docs, profiled, pairs)
    rest = stored(verified(pairs, sets), "links")
    discard(pairs, sets)
    if rest.head(1):
        labels = stored(components(near.unionByName(rest)), "labels")
    named = profiled.select("doc_id", "ha", "hb", F.col("n").alias("n_shingles"), "node").join(labels, "node", "left")
    return named.withColumn("component", F.coalesce("component", "node"))


def document_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): the class of every document, by its smallest id."""
    rows = stored(linked(docs), "classes")
    names = rows.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return rows.join(names, "component", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the smallest id, then the smallest text hash.

    Documents without shingles are all kept. The keys of dropped documents are
    few beside the documents, and are what is joined.
    """
    key = fresh(docs, "__key")
    rows = stored(linked(docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))), "classes")
    rows = rows.filter("component is not null").select(
        "component", F.struct(F.col("doc_id").alias("id"), F.struct(F.col("ha").alias("a"), F.col("hb").alias("b")).alias("h")).alias("key")
    ).groupBy("component", "key").agg(F.count(F.lit(1)).alias("rows"))
    order = F.struct(F.col("key.id").isNull(), "key")
    best = rows.groupBy("component").agg(F.min_by("key", order).alias("best"))
    judged = stored(
        rows.join(best, "component").select("key", "rows", (F.col("key") == F.col("best")).alias("stays")), "judged"
    )
    keyed = docs.withColumn(key, document_key(doc_id, text))
    settled = judged.filter(~F.col("stays") | (F.col("rows") > 1)).select(F.col("key").alias(key))
    # Only rows that occur several times and stay need their copies dropped.
    copied = judged.filter(F.col("stays") & (F.col("rows") > 1)).select(F.col("key").alias(key))
    single = keyed.join(settled, key, "left_anti")
    return single.unionByName(keyed.join(copied, key, "left_semi").dropDuplicates([key])).select(
        *[quoted(c) for c in docs.columns]
    )
