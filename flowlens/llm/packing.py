"""Best-fit packing of documents into sequences by bin completion (operator 6).

A document's ids and end id form one piece; only documents longer than a
sequence are cut, and their first piece takes what does not fill a whole one.
Pieces of one length are alike, so what has to be packed is a histogram: how
many pieces there are of each of at most ``capacity`` lengths. That is all the
driver ever sees, whatever the number of documents.

The search works on the histogram. The largest piece left opens a sequence, the
undominated ways to fill its rest are enumerated (a filling is dominated if
another holds, item for item, at least as much), best fit first and small pieces
last, over numbers of pieces per length, and the chosen one is used as often as
the counts allow, or once. A best-fit packing is the incumbent; branches whose waste already forces as
many sequences as the incumbent are pruned. While the gap to the lower bound is
open, sequences with waste are opened again together with others; the search
ends when the bound is met or after the choices of ``ROUNDS``.

The chosen fillings are turned into ranges: the r-th piece of a length has its
sequence and offset by a look-up in a table of at most ``capacity`` rows. Pieces
are numbered within their length over hash buckets, so no length, however
common, is gathered in one task.

Defined cases: null and empty texts hold the end id only; repeated rows are
packed as often as they occur; null ids are kept; an empty table gives an empty
result; extra columns are not returned by ``pack_documents``; in ``pack_pieces`` input
columns named as the two it adds are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import fresh, quoted
from flowlens.llm.tokens import token_pieces
from flowlens.operators.ordering import number_rows
from flowlens.plans.workspace import stored

CAPACITY = 1024
ROUNDS = ((6, 1_500), (32, 1_500))  # fillings a choice, choices
REOPENED = (0, 4, 16, 64, 256)  # sequences opened again beside those that hold the waste
KEPT = 8  # fillings that later ones are compared with
SKIPPED = 16  # dominated fillings passed over in a row; one more is taken as it is
BUCKET_ROWS = 1_000


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences no packing can do without: by volume, and by pieces too large to share."""
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    over_half = sorted((s for s in counts if 2 * s > capacity), reverse=True)
    middle = [s for s in counts if 2 * s <= capacity]
    for least in [1, *middle]:
        alone = sum(counts[s] for s in over_half if s > capacity - least)
        paired = [s for s in over_half if s <= capacity - least]
        room = sum((capacity - s) * counts[s] for s in paired)
        rest = sum(s * counts[s] for s in middle if s >= least)
        best = max(best, alone + sum(counts[s] for s in paired) + max(0, -(-(rest - room) // capacity)))
    return best


def _holds(larger: tuple[int, ...], smaller: tuple[int, ...]) -> bool:
    """Whether the items of ``smaller`` fit into the items of ``larger`` taken as bins."""
    if not smaller:
        return True
    item, rest = smaller[0], smaller[1:]
    for k in range(len(larger)):
        if larger[k] >= item and (k == 0 or larger[k] != larger[k - 1]):
            left = tuple(sorted((*larger[:k], larger[k] - item, *larger[k + 1:]), reverse=True))
            if _holds(left, rest):
                return True
    return False


def _reachable(counts: dict[int, int], sizes: list[int], room: int) -> list[int]:
    """For each place in ``sizes``, the sums up to ``room`` that the sizes before it can make, as bits."""
    limit = (1 << (room + 1)) - 1
    reach = [1]
    for size in sizes:
        bits, left, step = reach[-1], min(counts[size], room // size), 1
        while left:
            step = min(step, left)
            bits |= bits << (size * step) & limit
            left -= step
            step *= 2
        reach.append(bits)
    return reach


def fillings(counts: dict[int, int], room: int) -> Iterator[tuple[int, ...]]:
    """Undominated ways to fill ``room``, least waste first, then the largest smallest item; all of them, one by one.

    So small pieces, which fill what nothing else can, are kept for the end. A
    length is taken any number of times at once, and only where larger ones can
    still reach the wanted sum, so the search meets no dead end. Where very many
    lengths are left, nearly all fillings of a sum split the items of an earlier
    one; after ``SKIPPED`` of them the next is yielded though dominated, so that
    the work between two fillings is bounded and none is lost.
    """
    sizes = sorted((s for s, n in counts.items() if n and s <= room), reverse=True)
    reach = _reachable(counts, sizes, room)

    def exact(left: int, before: int) -> Iterator[tuple[int, ...]]:
        if not left:
            yield ()
            return
        for k in range(before):
            size = sizes[k]
            for count in range(1, min(counts[size], left // size) + 1):
                if reach[k] >> (left - count * size) & 1:
                    for rest in exact(left - count * size, k):
                        yield rest + (size,) * count

    best: list[tuple[int, ...]] = []
    skipped = 0
    for total in range(room, 0, -1):
        if reach[-1] >> total & 1:
            for filling in exact(total, len(sizes)):
                if len(filling) <= 6 and skipped < SKIPPED and any(_holds(b, filling) for b in best):
                    skipped += 1
                    continue
                skipped = 0
                if len(filling) <= 6 and len(best) < KEPT:
                    best.append(filling)
                yield filling
    if not sizes:
        yield ()


def _search(
    counts: dict[int, int], capacity: int, bound: int, width: int, nodes: int,
    incumbent: list[tuple[tuple[int, ...], int]] | None,
) -> list[tuple[tuple[int, ...], int]]:
    """A packing at least as good as the incumbent: depth first, ``width`` fillings a choice.

    The first way down is free, so it ends in a packing however many lengths
    there are; then ``nodes`` choices are tried.
    """
    fewest = sum(times for _, times in incumbent) if incumbent is not None else 0
    start = {s: n for s, n in counts.items() if n > 0}
    path: list[tuple[tuple[int, ...], int]] = []
    spent, back = 0, False

    def options(left: dict[int, int]) -> Iterator[tuple[tuple[int, ...], int]]:
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1
        found = []
        for filling in islice(fillings(rest, capacity - largest), width):
            chosen = (largest, *filling)
            most = min(left[s] // n for s, n in Counter(chosen).items())
            yield chosen, most
            if most > 1:
                found.append(chosen)
        # A filling may also be used once only.
        yield from ((chosen, 1) for chosen in found)

    # A frame: counts left, volume left, sequences so far, choices still open.
    stack: list[list] = [[start, sum(s * n for s, n in start.items()), 0, None]]
    while stack:
        left, volume, used, choices = stack[-1]
        if not left:
            if incumbent is None or used < fewest:
                incumbent, fewest = list(path), used
            if fewest <= bound:
                break
        chosen = None
        if left and (incumbent is None or (used + -(-volume // capacity) < fewest and spent < nodes)):
            if choices is None:
                choices = stack[-1][3] = options(left)
            chosen = next(choices, None)
        if chosen is None:
            back = True
            stack.pop()
            if path:
                path.pop()
            continue
        spent += back
        lengths, times = chosen
        after = dict(left)
        for size, n in Counter(lengths).items():
            after[size] -= n * times
            if not after[size]:
                del after[size]
        path.append(chosen)
        stack.append([after, volume - times * sum(lengths), used + times, None])
    return incumbent or []


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The incumbent to begin with: every sequence takes the largest piece that still fits, again and again."""
    left = {s: n for s, n in counts.items() if n > 0}
    plan = []
    while left:
        room, lengths = capacity, []
        for size in sorted(left, reverse=True):
            lengths += [size] * min(left[size], room // size)
            room = capacity - sum(lengths)
        times = min(left[s] // n for s, n in Counter(lengths).items())
        for size, n in Counter(lengths).items():
            left[size] -= n * times
            if not left[size]:
                del left[size]
        plan.append((tuple(lengths), times))
    return plan


def _reopened(plan: list[tuple[tuple[int, ...], int]], capacity: int, more: int):
    """Sequences whose waste adds up to one sequence, with ``more`` of those that hold most pieces; and the rest. None without that waste."""
    taken, rest, waste = [], [], 0
    for lengths, times in sorted(plan, key=lambda r: (sum(r[0]), -len(r[0]))):
        free = capacity - sum(lengths)
        n = min(times, -(-(capacity - waste) // free)) if free and waste < capacity else 0
        waste += n * free
        taken += [(lengths, n)] if n else []
        rest += [(lengths, times - n)] if times > n else []
    if waste < capacity:
        return None
    kept = []
    for lengths, times in sorted(rest, key=lambda r: -len(r[0])):
        n = min(times, more)
        more -= n
        taken += [(lengths, n)] if n else []
        kept += [(lengths, times - n)] if times > n else []
    return taken, kept


def _used(plan: list[tuple[tuple[int, ...], int]]) -> int:
    return sum(times for _, times in plan)


def bin_completion(
    counts: dict[int, int], capacity: int = CAPACITY, rounds: Sequence[tuple[int, int]] = ROUNDS,
) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, how many such sequences), as few sequences as the search finds.

    While the gap to the lower bound is open, the sequences that hold the waste are
    opened again, with more and more others, and searched for a packing with one
    less; then the whole histogram is, with more fillings a choice.
    """
    bound, plan = lower_bound(counts, capacity), best_fit(counts, capacity)
    for width, nodes in rounds:
        if _used(plan) > bound:
            plan = _search(counts, capacity, bound, width, nodes, plan)
        for more in REOPENED:
            while _used(plan) > bound and (parts := _reopened(plan, capacity, more)) is not None:
                taken, rest = parts
                lengths: Counter = Counter()
                for sequence, times in taken:
                    for size, n in Counter(sequence).items():
                        lengths[size] += n * times
                found = _search(dict(lengths), capacity, _used(taken) - 1, width, nodes, taken)
                if _used(found) == _used(taken):
                    break
                plan = rest + found
    return plan


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """Per length: (first rank, rank after the last, first sequence, offset of the first, pieces a sequence)."""
    taken: dict[int, int] = {}
    ranges: dict[int, list[tuple[int, int, int, int, int]]] = {}
    sequence = 0
    for lengths, times in plan:
        offset = 0
        for size, n in Counter(lengths).items():
            first = taken.get(size, 0)
            ranges.setdefault(size, []).append((first, first + times * n, sequence, offset, n))
            taken[size] = first + times * n
            offset += size * n
        sequence += times
    return ranges


def pack_pieces(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``length`` is from 1 to ``capacity``."""
    spark = pieces.sparkSession
    counted = {r[0]: r[1] for r in pieces.groupBy(quoted(length)).count().collect()}
    if any(s < 1 or s > capacity for s in counted):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    ranges = slots(bin_completion(counted, capacity))
    table = spark.createDataFrame(
        [(s, [dict(zip(("low", "high", "sequence", "offset", "each"), r)) for r in rows]) for s, rows in ranges.items()],
        "__of long, __ranges array<struct<low: long, high: long, sequence: long, offset: long, each: long>>",
    )
    rank, spot = fresh(pieces, "__rank"), fresh(pieces, "__spot")
    buckets = max(counted.values(), default=0) // BUCKET_ROWS + 1
    everything = [quoted(c) for c in pieces.columns]
    numbered = number_rows(
        pieces, [length], F.pmod(F.xxhash64(*everything), F.lit(buckets)), [F.xxhash64(*everything), *everything], rank
    )
    of, held = fresh(numbered, "__of"), fresh(numbered, "__ranges")
    table = table.toDF(of, held)
    # One row per length: at most ``capacity`` rows, whatever the number of documents.
    placed = numbered.join(F.broadcast(table), quoted(length) == quoted(of)).withColumn(
        spot,
        F.element_at(F.filter(quoted(held), lambda r: (r["low"] <= quoted(rank)) & (quoted(rank) < r["high"])), 1),
    )
    place = quoted(rank) - quoted(spot)["low"]
    # An input column of either name makes way.
    kept = [quoted(c) for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    return placed.select(
        *kept,
        (quoted(spot)["sequence"] + F.floor(place / quoted(spot)["each"])).cast("long").alias("sequence_id"),
        (quoted(spot)["offset"] + F.pmod(place, quoted(spot)["each"]) * quoted(length)).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    return pack_pieces(stored(token_pieces(docs, vocabulary, capacity), "pieces"), "length", capacity)
