"""Quality votes: counts against brute force, the estimate, held-out labels, odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from flowlens.llm import quality_votes as qv

SAMPLE = "/root/testdata/sf0.01"


def _counts(text):
    text = text or ""
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = {}
    for i in range(len(found) - 7):
        windows.setdefault(tuple(found[i:i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    )


def _texts():
    rng = random.Random(8)
    texts = [None, "", " \n\t\x0b", "a", "one two " * 9, "x " * 40, "é ß 😀 " * 3 + "#*|", "same line here\nsame line here\n\nsame line here \n"]
    for _ in range(60):
        words = [rng.choice(["ab", "cd.", "é", "#x", "longer", "|", "a", "b", "c", "d"]) for _ in range(rng.randint(1, 120))]
        phrase = [f"p{k}" for k in range(rng.choice([7, 8, 9, 12]))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = phrase
        texts.append("".join(w + rng.choice([" ", " ", "  ", "\n", "\t"]) for w in words))
    texts.append(" ".join(f"w{k % 7000}" for k in range(20_000)))
    return texts


def test_counts_match_brute_force(spark):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in qv.document_quality(docs).collect()}
    assert len(found) == len(texts)
    for k, text in enumerate(texts):
        r, want = found[k], _counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)


def test_estimate_recovers_accuracies():
    rng = random.Random(1)
    width = len(qv.RULES)
    patterns, truth = {}, {}
    for _ in range(40_000):
        good = rng.random() < 0.85
        votes = tuple(
            0 if rng.random() < 0.1 else (1 if rng.random() < (0.9998 if good else 0.6) else -1) for _ in range(width)
        )
        patterns[votes] = patterns.get(votes, 0) + 1
        tally = truth.setdefault(votes, [0, 0])
        tally[good] += 1
    model = qv.estimate(patterns)
    assert abs(model.prior - 0.85) < 0.02
    assert all(abs(b - 0.4) < 0.05 for b in model.right_on_bad)
    right = sum(t[model.posterior(v) >= 0.5] for v, t in truth.items())
    assert right > 0.97 * 40_000
    assert qv.estimate(dict(reversed(list(patterns.items())))) == model
    assert 0 < qv.estimate({}).prior < 1


def test_labels_it_never_saw(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    labels = spark.read.parquet(f"{SAMPLE}/labels.parquet")
    judged = qv.document_quality(docs).join(labels, "doc_id").filter("n_words >= 20")
    rows = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert rows.get((1, True), 0) >= 0.97 * (rows.get((1, True), 0) + rows.get((1, False), 0))
    assert rows.get((0, False), 0) >= 0.9 * (rows.get((0, True), 0) + rows.get((0, False), 0))


def test_filter_keeps_columns_and_copies(spark):
    good = "Plain prose stands here, and it goes on for a while. " + " ".join(f"word{k}" for k in range(60)) + "."
    rows = [(1, good, 5), (1, good, 5), (None, good, 6), (2, None, 7), (3, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __counts int")
    kept = qv.filter_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(rows[:3], key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert qv.document_quality(docs).count() == 0 == qv.filter_documents(docs).count()


def test_no_python_in_the_plan(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    plan = docs.select(F.inline(qv.text_counts(F.col("text"))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _plain_em(patterns):
    """Dawid and Skene's estimate for two classes with abstentions, over documents one by one."""
    rows = [v for v, n in patterns.items() for _ in range(n)]
    good = [0.0 if -1 in v else 1.0 if 1 in v else 0.5 for v in rows]
    for _ in range(60):
        prior = (1 + sum(good)) / (2 + len(rows))
        scores = [prior / (1 - prior)] * len(rows)
        for j in range(len(rows[0])):
            keep = [2 * [0.0], 2 * [0.0]]
            for g, v in zip(good, rows):
                if v[j]:
                    keep[1][v[j] > 0] += g
                    keep[0][v[j] > 0] += 1 - g
            p, q = ((1 + k[1]) / (2 + sum(k)) for k in (keep[1], keep[0]))
            scores = [s * (p / q if v[j] > 0 else (1 - p) / (1 - q) if v[j] < 0 else 1) for s, v in zip(scores, rows)]
        good = [s / (1 + s) for s in scores]
    return {v: g for v, g in zip(rows, good)}


def test_agrees_with_a_plain_estimate():
    one = lambda *rejecting, abstaining=(): tuple(-1 if j in rejecting else 0 if j in abstaining else 1 for j in range(9))
    patterns = {one(): 700, one(0, 8): 60, one(0, 8, 7): 9, one(1): 12, one(1, abstaining=(2,)): 8, one(7): 4, one(3, 7): 3, (0,) * 9: 5}
    model, plain = qv.estimate(patterns), _plain_em(patterns)
    for votes in patterns:
        assert model.posterior(votes) == pytest.approx(plain[votes], abs=1e-6)
    # Agreeing rejections count; one that no other rule shares does not.
    assert model.posterior(one(0, 8)) < 0.5 < model.posterior(one(1))


def test_posterior_beats_all_must_pass(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    measured = docs.join(labels, "doc_id").select("quality", F.inline(F.transform(qv.text_counts(F.col("text")), lambda c: F.struct(c.alias("c")))))
    counts = {k: F.col("c")[k] for k in (*qv.COUNTS, *qv.EXTRA)}
    voted = measured.filter(~qv.base_failed(counts)).select("quality", *[v.alias(k) for k, v in qv.rule_votes(counts).items()])
    rows = [(tuple(r[k] for k in qv.RULES), r["quality"], r["count"]) for r in voted.groupBy("quality", *qv.RULES).count().collect()]
    patterns = {}
    for votes, _, n in rows:
        patterns[votes] = patterns.get(votes, 0) + n
    model = qv.estimate(patterns)

    def f1(rejects):
        hit = sum(n for v, q, n in rows if q == 0 and rejects(v))
        return 2 * hit / (sum(n for v, _, n in rows if rejects(v)) + sum(n for _, q, n in rows if q == 0))

    by_model, by_all = (lambda v: model.posterior(v) < 0.5), (lambda v: -1 in v)
    assert f1(by_model) > f1(by_all) > 0.97
    assert sum(n for v, _, n in rows if by_model(v) != by_all(v)) >= 10
    assert not any(by_model(v) for v, q, _ in rows if q == 1)
