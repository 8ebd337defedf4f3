"""Packing: exact fits, brute force on small histograms, and token pieces."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowlens.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _fewest(items, capacity):
    """Brute force over assignments, with symmetric bins skipped."""
    best = len(items)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[k] <= capacity and bins[b] not in bins[:b]:
                place(k + 1, [*bins[:b], bins[b] + items[k], *bins[b + 1:]])
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([10, 20, 37])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 9))), reverse=True)
        counts = {s: items.count(s) for s in items}
        plan = packing.bin_completion(counts, capacity)
        packed = list(itertools.chain.from_iterable(list(lengths) * times for lengths, times in plan))
        assert sorted(packed, reverse=True) == items
        assert all(sum(lengths) <= capacity for lengths, _ in plan)
        used = sum(times for _, times in plan)
        assert used == _fewest(items, capacity)
        assert packing.lower_bound(counts, capacity) <= used


def test_large_histogram_reaches_the_volume_bound():
    rng = np.random.default_rng(5)
    sizes = np.minimum(1024, rng.geometric(0.004, 200_000))
    counts = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True))}
    used = sum(times for _, times in packing.bin_completion(counts))
    assert used <= packing.lower_bound(counts, 1024) * 1.0001 + 1


@pytest.mark.parametrize("counts,fewest", [
    ({1: 2048}, 2), ({1: 1_000_000, 1000: 5}, 982), ({2: 5000}, 10), ({323: 1, 322: 1, 162: 2, 700: 3}, 3),
    ({1: 10**9, 1024: 7}, 976_570), ({}, 0),
])
def test_many_small_pieces_meet_the_bound(counts, fewest):
    plan = packing.bin_completion(counts)
    assert sum(times for _, times in plan) == fewest == packing.lower_bound(counts, 1024)
    assert all(sum(lengths) <= 1024 for lengths, _ in plan)
    packed = {}
    for lengths, times in plan:
        for size in lengths:
            packed[size] = packed.get(size, 0) + times
    assert packed == counts


def test_planted_perfect_packings():
    """Forty full sequences cut at random are put together again."""
    rng = random.Random(1)
    for _ in range(3):
        items = []
        for _ in range(40):
            cuts = sorted(rng.sample(range(1, 1024), rng.randint(1, 5)))
            items += [b - a for a, b in zip([0, *cuts], [*cuts, 1024])]
        counts = {s: items.count(s) for s in items}
        assert sum(times for _, times in packing.bin_completion(counts)) == 40


def test_fillings_are_all_and_in_order():
    found = list(packing.fillings({7: 1, 5: 2, 3: 3, 2: 1}, 12))
    assert found[0] == (7, 5) and sum(found[0]) == 12 and (5, 5, 2) not in found  # it fits into the first
    sums = [sum(f) for f in found]
    assert sums == sorted(sums, reverse=True) and list(packing.fillings({9: 4}, 5)) == [()]


@pytest.mark.parametrize("least", [100, 200])
def test_fillings_dominated_without_end_are_not_waited_for(monkeypatch, least):
    """One piece of each length: nearly every way to fill 1,000 splits an earlier one."""
    holds, compared = packing._holds, itertools.count()

    def counted(larger, smaller):
        assert next(compared) < 20_000
        return holds(larger, smaller)

    monkeypatch.setattr(packing, "_holds", counted)
    found = list(itertools.islice(packing.fillings(dict.fromkeys(range(least, 1024), 1), 1000), 32))
    assert len(set(found)) == 32 and all(sum(f) == 1000 for f in found)


def test_first_way_down_ends_in_a_packing_however_many_choices_it_takes():
    """Small pieces are kept for the end, so thousands of choices leave almost no waste."""
    rng = np.random.default_rng(7)
    sizes = np.clip(rng.normal(260, 90, 50_000).astype(int), 1, 1024)
    counts = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True))}
    bound = packing.lower_bound(counts, 1024)
    assert sum(times for _, times in packing._search(counts, 1024, bound, 6, 0, None)) <= bound + 1


def test_clashing_column_names(spark):
    pieces = spark.createDataFrame([(k, 300, 5, 6, 7) for k in range(7)], "k int, length long, OFFSET int, `of` int, ranges int")
    packed = packing.pack_pieces(pieces)
    assert packed.columns == ["k", "length", "of", "ranges", "sequence_id", "offset"]
    assert sorted(r["offset"] for r in packed.collect()) == [0, 0, 0, 300, 300, 600, 600]


def test_dominance():
    assert packing._holds((5,), (3, 2)) and not packing._holds((3, 2), (5,))
    assert packing._holds((4, 3), (3, 3)) and not packing._holds((3, 3), (4,))


def test_pieces_match_direct_encoding(spark):
    rng = random.Random(2)
    texts = ["", None, "one two", "a  b \n c", "word " * 3000, "x" * 5000] + [
        " ".join("".join(rng.choices("abcé,.", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 900))) for _ in range(60)
    ]
    rows = [(k // 2 if k > 3 else k, t, "extra") for k, t in enumerate(texts)] + [(None, "no id", "extra"), (7, texts[9], "extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, LENGTH string").repartition(5)
    result = packing.pack_documents(docs, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for doc, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(edges, edges[1:])):
            want.append((doc, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted((tuple(r)[:5] for r in result), key=key) == sorted(want, key=key)
    sequences = {}
    for r in result:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    counts = {}
    for w in want:
        counts[w[3]] = counts.get(w[3], 0) + 1
    assert len(sequences) == sum(t for _, t in packing.bin_completion(counts))


def test_pieces_with_special_tokens(spark):
    texts = ["a <|endoftext|> b", "One.<|endoftext|>" * 700, "<|ENDOFTEXT|> c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for doc, text in enumerate(texts):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)]
        want += [(doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted(tuple(r)[:5] for r in packing.pack_documents(docs, PATH).collect()) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, PATH).count() == 0


def test_hot_length_is_numbered_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 50)
    pieces = spark.range(1000).select(F.col("id"), F.lit(300).cast("long").alias("length"))
    packed = packing.pack_pieces(pieces)
    assert packed.select("sequence_id", "offset").distinct().count() == 1000
    assert packed.select("sequence_id").distinct().count() == 334
