"""Near duplicates against brute force: links, classes, hot groups, odd rows."""

import random
import re

import numpy as np
import pytest

from flowlens.llm import bitmaps
from flowlens.llm import near_duplicates as nd
from flowlens.llm.components import components
from flowlens.llm.shingles import Hasher


def _set(text):
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    found = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in found]
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[i:i + 5]) for i in range(len(found) - 4)}


def _classes(rows):
    """(doc_id, size, smallest id reachable) by comparing every pair."""
    sets = [_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both) and both:
                parent[find(i)] = find(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(least.get(find(k), doc), doc)
    return sorted(
        ((doc, len(sets[k]), least.get(find(k), doc) if sets[k] else doc) for k, (doc, _) in enumerate(rows)), key=repr
    )


def _corpus(seed, documents, shared=True):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(500)]
    passage = " ".join(rng.choices(vocabulary, k=25))
    rows = []
    bases = []
    while len(rows) < documents:
        kind = rng.random()
        if bases and kind < 0.55:
            base = rng.choice(bases).split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            text = " ".join(base)
            if rng.random() < 0.2:
                text = text.upper().replace(" ", "\n")
        else:
            text = " ".join(rng.choices(vocabulary, k=rng.choice([2, 4, 5, 8, 60, 90, 120, 300])))
            if shared and rng.random() < 0.5:
                text = passage + " " + text
            if len(bases) < 12:
                bases.append(text)
        rows.append((len(rows) * 3 + 5, text))
    return rows


def test_shingle_sets_match_words():
    rows = _corpus(1, 60) + [(0, None), (1, ""), (2, " \n\t "), (3, "É\x0bñ  ß"), (4, "a b c d"), (5, "a b c d e")]
    found = Hasher().sets([t for _, t in rows])
    assert [len(h) for h in found] == [len(_set(t)) for _, t in rows]
    again = Hasher().sets([t for _, t in reversed(rows)])[::-1]  # place in the chunk does not matter
    assert all((a == b).all() for a, b in zip(found, again))
    a, b = Hasher().sets(["One two three four five", "one\ttwo three four FIVE"])
    assert (a == b).all()


@pytest.mark.parametrize("seed", [3, 4])
def test_classes_match_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(nd, "TILE", 7)
    monkeypatch.setattr(nd, "SMALL", 4)
    rows = _corpus(seed, 260) + [(None, "no id here at all my friend"), (2000, None), (2001, ""), (2002, "tie tie"), (2003, "Tie TIE")]
    rows += [rows[0], rows[1], (1, "no id here at all my friend")]
    docs = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, component long").repartition(6)
    found = sorted((tuple(r) for r in nd.document_classes(docs).collect()), key=repr)
    assert found == _classes(rows)


def test_trees_lose_no_pair_without_contraction(spark):
    """All links appear even when no block was contracted first."""
    rows = _corpus(9, 120, shared=False)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    profiled = nd.profiles(docs)
    postings = nd.shared_postings(profiled)
    nodes = postings.select("node").distinct()
    points = profiled.select("node", "n", "counts", "parity").dropDuplicates(["node"]).join(nodes, "node")
    labels = spark.createDataFrame([], "node long, component long")
    found = nd.tree_candidates(postings, points, labels)
    pairs = nd.verified(found, nd.node_sets(docs, profiled, found)).count()
    distinct = list({frozenset(_set(t)) for _, t in rows})
    want = sum(
        100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(distinct) for b in distinct[:i]
    )
    assert pairs == want > 20


def test_tree_search_equals_a_scan():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 9, (700, nd.GROUPS)).astype(np.uint8)
    points[350:] = points[:350]
    points[350:, :4] += 1
    sizes = points.sum(axis=1).astype(np.int64)
    tree = nd.RTree(points, sizes, np.arange(700))
    for q in range(0, 700, 13):
        found = set(tree.order[tree.search(points[q], int(sizes[q]))].tolist())
        overlap = np.minimum(points, points[q]).sum(axis=1, dtype=np.int64)
        fits = (sizes * 100 >= 80 * sizes[q]) & (sizes[q] * 100 >= 80 * sizes)
        assert found == set(np.flatnonzero(fits & (180 * overlap >= 80 * (sizes + sizes[q]))).tolist())


def test_keep_one(spark):
    rows = [(5, "a b c d e f g", "x"), (3, "a b c d e f g", "y"), (3, "a b c d e f g", "y"), (9, None, "z"), (9, None, "z"),
            (8, "quite other words in this one here", "w"), (None, "a b c d e f g", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `key` string")
    kept = sorted((tuple(r) for r in nd.keep_one(docs).collect()), key=repr)
    assert kept == sorted([rows[1], rows[3], rows[4], rows[5]], key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert nd.document_classes(docs).count() == 0
    assert nd.keep_one(docs).count() == 0


def test_bitmaps_hold_their_keys(spark, monkeypatch):
    keys = spark.range(5000).selectExpr("xxhash64(id) as h")
    values = np.array([r.h for r in keys.collect()])
    others = np.array([r.h for r in spark.range(5000, 9000).selectExpr("xxhash64(id) as h").collect()])
    small = bitmaps.bitmap_of(keys, "h")
    assert small.holds(values).all() and small.holds(others).mean() < 0.1
    monkeypatch.setattr(bitmaps, "MAX_BITS", bitmaps.MIN_BITS)
    assert bitmaps.bitmap_of(keys, "h").holds(values).all()
    assert not bitmaps.bitmap_of(keys.limit(0), "h").holds(values).any()


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(30)] + [(k, k + 1) for k in range(100, 180)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: find(x) for x in linked}
