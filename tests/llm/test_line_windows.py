"""Line windows against brute force, and odd rows."""

import random
import re

from flowlens.llm import line_windows as lw


def _brute(rows):
    """(doc_id, text, removed): rows sorted by id; equal rows are one document."""
    seen, cleaned = {}, {}
    for doc, text in sorted({(d, t) for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (text or "").split("\n")
        filled = [i for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        trimmed = [lines[i].strip(" \t\n\x0b\x0c\r") for i in filled]
        gone = set()
        for k in range(len(filled) - 2):
            window = tuple(trimmed[k:k + 3])
            if window in seen:
                gone |= {k, k + 1, k + 2}
            else:
                seen[window] = (doc, k)
        dropped = {filled[k] for k in gone}
        cleaned[(doc, text)] = ("\n".join(x for i, x in enumerate(lines) if i not in dropped) if gone else text, len(gone))
    return sorted(((d, *cleaned[(d, t)]) for d, t in rows), key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for doc in range(120):
        lines = [rng.choice(["a", "b", "b ", "c", "", "\t", "d e"]) for _ in range(rng.randint(0, 14))]
        if rng.random() < 0.5:
            lines += ["menu", "home", "about", "contact"]
        rows.append((doc, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "a\nb"), (None, "menu\nhome\nabout\nnew"), rows[3], rows[3]]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, key string").repartition(7)
    result = lw.remove_repeats(docs, removed="gone")
    assert result.columns == ["doc_id", "text", "key", "gone"]
    assert sorted((tuple(r) for r in result.select("doc_id", "text", "gone").collect()), key=repr) == _brute(rows)


def test_overlapping_windows_merge(spark):
    text = "one\ntwo\nthree\nfour\nfive"
    docs = spark.createDataFrame([(1, text), (2, "start\n" + text + "\nend")], "doc_id long, text string")
    found = {r.doc_id: r.text for r in lw.remove_repeats(docs).collect()}
    assert found == {1: text, 2: "start\nend"}


def test_long_text_and_empty_table(spark):
    text = "\n".join(f"line {k % 3000}" for k in range(6000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = lw.remove_repeats(docs, removed="n").first()
    assert row.n == 3000 - 0 and row.text.count("\n") == 2999
    assert lw.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
