"""Ranked search against brute force, and the sharing plan against plain sums."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from flowlens.llm import lexical_ranking as lr

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return _TERM.findall((text or "").translate(_LOWER))


def _brute(docs, items, k=10):
    counted = [(d, Counter(_terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    total, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for name, text in items:
        asked.setdefault(name, set()).update(_terms(text))
    out = []
    for name, terms in asked.items():
        found = []
        for d, c, n in counted:
            m = 10 + 90 * n * total // length
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms if t in c
            )
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(name, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=str)


def _run(spark, docs, items, **more):
    table = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n long, item_id string")
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    return sorted((tuple(r) for r in lr.rank_documents(table.repartition(5), asked, **more).collect()), key=str)


WORDS = ["The", "of", "and", "Straße", "Ünï", "x1", "ÀB", "naïve", "a", "b", "c", "d", "e", "f", "42", "zwölf", "日本", "z"]


@pytest.mark.parametrize("block,cells,slice_", [(1024, 2_000_000, 1 << 20), (3, 200, 7)])
def test_matches_brute_force(spark, monkeypatch, block, cells, slice_):
    monkeypatch.setattr(lr, "ITEM_BLOCK", block)
    monkeypatch.setattr(lr, "CELLS", cells)
    monkeypatch.setattr(lr, "SLICE", slice_)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice(WORDS) + rng.choice([" ", "-", "\x00", ". ", "_", "\n"]) for _ in range(n))
    docs = [(k, text(rng.choice([1, 3, 20, 60]))) for k in range(120)]
    docs += [(200, None), (201, ""), (202, " .\t--"), (203, docs[5][1]), (5, docs[5][1]), (None, docs[5][1]), (204, "the " * 3000)]
    items = [(k, text(12)) for k in range(9)]
    items += [(20, None), (21, ""), (22, "..."), (23, "nowhere"), (3, "Extra z"), (24, items[1][1]), (25, "the of and zwölf nowhere")]
    assert _run(spark, docs, items) == _brute(docs, items)
    assert _run(spark, docs, items, k=3) == _brute(docs, items, 3)


def test_empty_tables(spark):
    assert _run(spark, [], [(1, "a b")]) == []
    assert _run(spark, [(1, "a b")], []) == []
    assert _run(spark, [(1, None)], [(1, "a")]) == []


def test_plan_sums_every_item_with_less_work():
    rng = random.Random(5)
    common = [rng.sample(range(60), 8) for _ in range(4)]
    items = {k: set(rng.choice(common)) | set(rng.choice(common)) | set(rng.sample(range(60), 3)) for k in range(40)}
    items[99] = set()
    plan = lr.sharing_plan(items, 60)
    leaves = np.random.default_rng(1).integers(0, 1000, (60, 7))
    want = np.stack([leaves[sorted(items[i])].sum(axis=0) for i in plan.items])
    assert (plan.scores(leaves) == want).all() and 99 not in plan.items
    assert plan.additions < 0.5 * sum(len(s) - 1 for s in items.values() if s)


def test_long_text_in_slices(monkeypatch):
    text = ("Wörter und Zahlen 12, " * 2000).encode()
    whole = [t for part in lr.terms_in(text) for t in part]
    monkeypatch.setattr(lr, "SLICE", 13)
    assert [t for part in lr.terms_in(text) for t in part] == whole and len(whole) == 8000
