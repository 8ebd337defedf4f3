"""Mixing: exponent against a scan, budgets, prefixes of keyed orders, odd rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flowlens.llm import mixing


def _shares(tokens, x):
    total = sum(tokens)
    powers = [(t / total) ** x for t in tokens]
    return [p / sum(powers) for p in powers]


def _repeats(tokens, x):
    weights = _shares(tokens, x)
    budget = max(t / w for t, w in zip(tokens, weights))
    return max(budget * w / t for t, w in zip(tokens, weights))


@pytest.mark.parametrize("tokens", [[900, 50, 50], [1000, 400, 300, 7], [10, 10], [5]])
def test_exponent_for_a_repetition_limit(spark, tokens):
    sizes = spark.createDataFrame(list(enumerate(tokens)), "source long, tokens long")
    x, budget = mixing.find_exponent(sizes, max_repeats=2.0)
    assert _repeats(tokens, x) <= 2.0 + 1e-6
    assert x == 0 or _repeats(tokens, x - 1e-6) > 2.0
    assert budget == pytest.approx(max(t / w for t, w in zip(tokens, _shares(tokens, x))))


def test_exponent_for_a_target_entropy(spark):
    tokens = [900, 60, 40]
    sizes = spark.createDataFrame(list(enumerate(tokens)), "source long, tokens long")
    x, _ = mixing.find_exponent(sizes, target_entropy=0.8, max_repeats=None)
    weights = _shares(tokens, x)
    assert -sum(w * math.log(w) for w in weights) / math.log(3) == pytest.approx(0.8, abs=1e-8)
    assert mixing.find_exponent(sizes, max_repeats=None)[0] == 1.0


def _docs(spark):
    rng = random.Random(5)
    rows = []
    for k in range(700):
        source = rng.choices(["big", "mid", "small", None], weights=[60, 25, 12, 3])[0]
        rows.append((k, " ".join(["w"] * rng.randint(0, 9)), source))
    rows += [rows[0]] * 3 + [(None, "some words here", "mid"), (900, None, "empty"), (901, "", "empty")]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, tokens int").repartition(5)


@pytest.mark.parametrize("block_tokens", [7, 20_000])
def test_mix_against_brute_force(spark, monkeypatch, block_tokens):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", block_tokens)
    rows, docs = _docs(spark)
    found = [tuple(r) for r in mixing.mix(docs, detail="m").select("doc_id", "text", "source", "m.epoch", "m.n_tokens", "m.block", "m.draw").collect()]
    plan = {r.source: r for r in mixing.plan_sources(docs, F.col("source"), F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != ""))).collect()}
    count = {}
    for d, t, s, epoch, n, block, draw in found:
        assert n == len((t or "").split())
        count[(d, t, s)] = count.get((d, t, s), []) + [epoch]
    for source, p in plan.items():
        own = [r for r in rows if r[2] == source]
        total = sum(len((t or "").split()) for _, t, _ in own)
        assert p.tokens == total
        if total:
            assert p.passes == math.floor(p.budget / total + 1e-9) and 0 <= p.part < total
        # Whole passes hold every row, the part pass the longest prefix of its order.
        keyed = {}
        for d, t, s, epoch, n, block, draw in found:
            if s == source and epoch == p.passes:
                keyed[(d, t)] = keyed.get((d, t), 0) + n
        for row in own:
            epochs = count[row]
            assert sum(e < p.passes for e in epochs) == p.passes * own.count(row)
        spent = sum(keyed.values())
        assert spent <= p.part
        if p.part:
            order = docs.filter(F.col("source").eqNullSafe(source)).select(
                "doc_id", "text", mixing.document_key().alias("k")
            ).withColumn("draw", mixing._order(17, F.lit(p.passes), F.col("k"))).withColumn(
                "block", F.floor(F.col("draw") * p.blocks / mixing.SCALE)
            ).orderBy("block", "draw", "k").collect()
            upto, want, groups = 0, {}, {}
            for r in order:
                groups.setdefault((r.doc_id, r.text), []).append(len((r.text or "").split()))
            for unit, sizes in groups.items():
                upto += sum(sizes)
                if upto > p.part:
                    break
                want[unit] = sum(sizes)
            assert {k: v for k, v in keyed.items() if v} == {k: v for k, v in want.items() if v}
    assert {(d, t, s) for d, t, s, *_ in found} == set(rows)  # nothing is dropped by default


def test_explicit_budget_and_empty_table(spark):
    _, docs = _docs(spark)
    half = mixing.mix(docs, budget=400, max_repeats=None, detail="m")
    spent = half.groupBy("source").agg(F.sum("m.n_tokens").alias("n")).collect()
    assert 300 < sum(r.n for r in spent if r.n) <= 400
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(docs).columns == docs.columns


def test_repeatable(spark):
    _, docs = _docs(spark)
    a, b = (sorted(map(tuple, mixing.mixed_documents(d).collect()), key=repr) for d in (docs, docs.repartition(2)))
    assert a == b
