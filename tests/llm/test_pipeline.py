"""The pipeline, stage by stage, against brute force on a small corpus."""

import random

import corpus_pipeline
from test_line_windows import _brute as without_repeats
from test_near_duplicates import _classes

from flowlens.llm import quality_votes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _corpus():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(800)]
    menu = "\n".join(" ".join(rng.choices(vocabulary, k=8)) + "." for _ in range(4))
    texts = []
    for k in range(160):
        lines = [" ".join(rng.choices(vocabulary, k=12)).capitalize() + "." for _ in range(rng.randint(3, 9))]
        if k % 5 == 0:
            lines.insert(rng.randint(0, 2), menu)
        texts.append("\n".join(lines))
        if k % 4 == 0:
            words = texts[-1].split(" ")
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        if k % 9 == 0:
            texts.append(texts[-1])
    texts += ["### ||| $$$ *** " * 20, "same words again " * 40, "too short", "", None]
    rows = [(k, t, "en", "hot" if k % 3 else f"s{k % 7}", len(t or "")) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [rows[0]]


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mix_sources", "pack"]
    docs = spark.createDataFrame(_corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    verdicts = {r.doc_id: r.kept for r in quality_votes.document_quality(docs).collect()}
    before = [tuple(r) for r in docs.collect()]
    states = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "unused")
        assert name == "pack" or out.columns == COLUMNS
        after = [tuple(r) for r in out.collect()]
        states[name] = (before, after)
        if name != "pack":
            docs, before = spark.createDataFrame(after, docs.schema), after

    before, after = states["quality"]
    assert sorted(after, key=repr) == sorted((r for r in before if verdicts[r[0]]), key=repr)
    assert len(after) < len(before) and {None, ""}.isdisjoint(r[1] for r in after)

    before, after = states["line_dedup"]
    want = sorted((d, t) for d, t, _ in without_repeats([r[:2] for r in before]))
    assert sorted(r[:2] for r in after) == want and sorted(after) != sorted(before)

    before, after = states["near_dedup"]
    classes = {(d, c) for d, _, c in _classes([r[:2] for r in before])}
    firsts = {c for _, c in classes}
    assert sorted(r[0] for r in after) == sorted(firsts) and set(after) <= set(before) and len(after) < len(before)

    before, after = states["mix_sources"]
    assert set(after) == set(before)
    assert all(1 <= after.count(r) <= 2 for r in before)

    before, after = states["pack"]
    assert sorted(r[0] for r in after if r[1] == 0) == sorted(r[0] for r in before)
    places = {(r[5], r[6]) for r in after}
    assert len(places) == len(after)


def test_run_on_a_table(spark):
    result = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert result.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert result.count() > 0
