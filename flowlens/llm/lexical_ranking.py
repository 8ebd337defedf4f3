"""Ranked lexical search of many items at once, sharing work between items (operator 13).

Items that hold the same terms share their evaluation. ``sharing_plan`` mines
term sets that two items or more have in common: the pair of terms or sets that
most items hold together becomes a node, again and again, until no pair is
shared. The nodes form a directed graph in which each one is the sum of two
others, and an item is the sum of the few nodes left to it.

Documents are read once into the counts of the items' terms. Each block of
documents then materialises the accumulator of every node once, level by level,
and items only add up accumulators. A task keeps the best documents of each
item; lists are merged in two levels, so that no window holds more than a
bounded share of them. Documents are never shuffled.

Items are taken in blocks of about ``ITEM_BLOCK``, each against all documents,
so what the driver and the workers hold of them does not grow with the table.

Terms are maximal runs of ASCII letters and digits and of characters above
U+007F, with only A-Z lowered. Texts are cut as bytes, in slices of ``SLICE``.

Defined cases: a null or empty text, or one without terms, is in no list and
does not count; an item without terms, or whose terms no document holds, has no
rows; every document row counts and is ranked by itself, also if its id repeats
or is null (null ids come after others of equal score); rows that repeat an
item id are one item with the terms of all of them; a weight of zero adds
nothing; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.plans.workspace import discard, stored

TOP = 10
B_PERCENT = 90  # how much of the length is normalised away
ITEM_BLOCK = 1024
SLICE = 1 << 20
PAIRED_NODES = 256  # most shared nodes that are tried in pairs; no effect on results
CELLS = 2_000_000  # accumulator cells of a block of documents
LIST_GROUPS = 512

_KEPT = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
_LETTERS = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in set(_KEPT) else 0x20 for b in range(256))


def terms_in(text: bytes | None) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text, slice by slice."""
    text = text or b""
    low = 0
    while low < len(text):
        # A slice ends at the next byte that is no part of a term.
        high = low + SLICE
        while high < len(text) and _LETTERS[text[high]] != 0x20:
            high += 1
        yield text[low:high].translate(_LETTERS).split()
        low = high


@dataclass
class SharingPlan:
    """Items as sums over a graph of shared term sets; leaves are terms 0 .. n_terms - 1."""

    items: list
    n_terms: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # node, its two parts
    parts: np.ndarray  # nodes of all items in a row
    edges: np.ndarray  # where each item's nodes start
    n_nodes: int

    def scores(self, leaves: np.ndarray) -> np.ndarray:
        """(item, document) sums for (term, document) contributions."""
        held = np.zeros((self.n_nodes, leaves.shape[1]), np.int64)
        held[:self.n_terms] = leaves
        for node, left, right in self.levels:
            held[node] = held[left] + held[right]
        if not len(self.items):
            return np.zeros((0, leaves.shape[1]), np.int64)
        out = np.empty((len(self.items), leaves.shape[1]), np.int64)
        for i, (a, b) in enumerate(zip(self.edges[:-1].tolist(), self.edges[1:].tolist())):
            held[self.parts[a:b]].sum(axis=0, out=out[i])
        return out

    @property
    def additions(self) -> int:
        """Sums of accumulators a document block takes."""
        return sum(len(node) for node, _, _ in self.levels) + int((np.diff(self.edges) - 1).sum())


def sharing_plan(items: dict, n_terms: int) -> SharingPlan:
    """Greedy mining of the pairs that most items share, over sets of items as bit masks."""
    names = [i for i in items if items[i]]
    masks: dict[int, int] = {}
    for k, name in enumerate(names):
        for term in items[name]:
            masks[term] = masks.get(term, 0) | 1 << k
    level = dict.fromkeys(range(n_terms), 0)
    made: list[tuple[int, int, int]] = []
    # Terms of the very same items are summed once, whatever their number.
    alike: dict[int, list[int]] = {}
    for term, mask in sorted(masks.items()):
        if mask.bit_count() > 1:
            alike.setdefault(mask, []).append(term)

    def join(a: int, b: int, mask: int) -> int:
        node = n_terms + len(made)
        made.append((node, a, b))
        level[node] = 1 + max(level[a], level[b])
        masks[node] = mask
        masks[a] &= ~mask
        masks[b] &= ~mask
        return node

    for mask, terms in alike.items():
        while len(terms) > 1:
            terms = [
                join(terms[k], terms[k + 1], mask) if k + 1 < len(terms) else terms[k] for k in range(0, len(terms), 2)
            ]
    shared = sorted((n for n, m in masks.items() if m.bit_count() > 1), key=lambda n: (-masks[n].bit_count(), n))
    active = shared[:PAIRED_NODES]
    waiting = [
        (-both, a, b) for x, a in enumerate(active) for b in active[x + 1:]
        if (both := (masks[a] & masks[b]).bit_count()) > 1
    ]
    heapq.heapify(waiting)
    while waiting:
        count, a, b = heapq.heappop(waiting)
        mask = masks[a] & masks[b]
        both = mask.bit_count()
        if both < 2:
            continue
        if both < -count:
            heapq.heappush(waiting, (-both, a, b))
            continue
        node = join(a, b, mask)
        active = [n for n in active if masks[n].bit_count() > 1]
        for other in active:
            if (both := (mask & masks[other]).bit_count()) > 1:
                heapq.heappush(waiting, (-both, other, node))
        active.append(node)
    by_level: dict[int, list[tuple[int, int, int]]] = {}
    for row in made:
        by_level.setdefault(level[row[0]], []).append(row)
    left: list[list[int]] = [[] for _ in names]
    for node, mask in masks.items():
        while mask:
            low = mask & -mask
            left[low.bit_length() - 1].append(node)
            mask ^= low
    return SharingPlan(
        names, n_terms, [tuple(np.array(by_level[k], np.int64).T) for k in sorted(by_level)],
        np.array([n for part in left for n in part], np.int64),
        np.cumsum([0, *map(len, left)]), n_terms + len(made),
    )


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: its length and counts of vocabulary terms."""
    size = len(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.get

        def report(ids: list, lengths: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
            cells, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if found:
                cells, times = np.unique(np.concatenate(found), return_counts=True)
            rows = cells // max(size, 1)
            ends = np.searchsorted(rows, np.arange(len(ids) + 1)).astype(np.int32)
            term = (cells - rows * size).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(term)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int64)))],
                names=["doc_id", "n", "terms", "tfs"],
            )

        ids: list = []
        lengths: list[int] = []
        found: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for key, raw in zip(batch.column(0), batch.column(1)):
                total = 0
                for terms in terms_in(raw.as_py()):
                    total += len(terms)
                    code = np.fromiter(map(known, terms, repeat(-1)), np.int64, len(terms))
                    found.append(code[code >= 0] + len(ids) * size)
                    held += len(found[-1])
                if total:
                    ids.append(key.as_py())
                    lengths.append(total)
                if held > SLICE or len(ids) >= 4096:
                    yield report(ids, lengths, found)
                    ids, lengths, found, held = [], [], [], 0
        if ids:
            yield report(ids, lengths, found)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(
        count, "doc_id long, n long, terms array<int>, tfs array<long>"
    )


class _Best:
    """The k best documents of each item seen so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.floor = np.ones(items, np.int64)  # scores below it are in no list
        self.rows = self.ids = self.scores = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        rows, columns = np.nonzero(scores >= self.floor[:, None])
        if not len(rows):
            return
        rows = np.concatenate([self.rows, rows])
        found = np.concatenate([self.scores, scores[rows[len(self.rows):], columns]])
        ids, null = np.concatenate([self.ids, ids[columns]]), np.concatenate([self.null, null[columns]])
        order = np.lexsort((ids, null, -found, rows))
        rows, found, ids, null = rows[order], found[order], ids[order], null[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        keep = place < self.k
        full = place == self.k - 1
        self.floor[rows[full]] = found[full]
        self.rows, self.scores, self.ids, self.null = rows[keep], found[keep], ids[keep], null[keep]


def _block_lists(counts: DataFrame, plan: SharingPlan, weights: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): every task's best documents of each item of a plan."""
    width = max(1, CELLS // max(1, plan.n_nodes + len(plan.items)))
    base = 100 - B_PERCENT

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(plan.items), k)
        for batch in batches:
            for low in range(0, batch.num_rows, width):
                part = batch.slice(low, width)
                n = part.column(1).to_numpy()
                ends = np.cumsum([0, *part.column(2).value_lengths().to_pylist()])
                of = np.repeat(np.arange(len(n)), np.diff(ends))
                term, tf = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
                m = base + (B_PERCENT * n * total) // length
                leaves = np.zeros((plan.n_terms, len(n)), np.int64)
                leaves[term, of] = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[of]))
                ids = part.column(0)
                best.add(plan.scores(leaves), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.rows), pa.array(best.ids, mask=best.null), pa.array(best.scores)],
            names=["item", "doc_id", "score"],
        )

    return counts.mapInArrow(rank, "item long, doc_id long, score long")


def _best_first(lists: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy("item", *by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _rank_block(docs: DataFrame, rows: list, doc_id: str, text: str, item_type, k: int) -> DataFrame:
    items: dict = {}
    vocabulary: dict[bytes, int] = {}
    for name, raw in rows:
        held = items.setdefault(name, set())
        for terms in terms_in(raw):
            held.update(vocabulary.setdefault(t, len(vocabulary)) for t in terms)
    spark = docs.sparkSession
    counts = stored(term_counts(docs, vocabulary, doc_id, text), "term-counts")
    total, length = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[term] = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
    plan = sharing_plan(items, len(vocabulary))
    lists = _block_lists(counts, plan, weights, total, max(length, 1), k)
    lists = _best_first(lists.withColumn("list", F.pmod(F.spark_partition_id(), F.lit(LIST_GROUPS))), k, "list")
    named = spark.createDataFrame(list(enumerate(plan.items)), f"item long, item_id {item_type}")
    ranked = _best_first(lists.drop("rank"), k).join(F.broadcast(named), "item")  # at most a block of items
    out = stored(ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")
    discard(counts)
    return out


def rank_documents(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", k: int = TOP,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("binary").alias("text"))
    item_type = asked.schema["item_id"].dataType.simpleString()
    blocks = -(-asked.count() // ITEM_BLOCK) or 1
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    out = None
    for b in range(blocks):
        rows = [tuple(r) for r in asked.filter(block == b).collect()]  # about ITEM_BLOCK rows
        ranked = _rank_block(docs, rows, doc_id, text, item_type, k)
        out = ranked if out is None else out.unionByName(ranked)
    return out
