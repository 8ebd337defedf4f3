"""Language models against a plain Kneser-Ney implementation; held-out accuracy; shards; odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import languages as lg

SAMPLE = "/root/testdata/sf0.01"


def _symbols(text):
    out = " " * (lg.ORDER - 1)
    for c in (text or "").lower():
        if c.isalpha():
            out += c
        elif out[-1] != " ":
            out += " "
    return out


def _events(text):
    s = _symbols(text)
    return [s[k:k + lg.ORDER] for k in range(len(s) - lg.ORDER + 1)]


class _Plain:
    """Interpolated Kneser-Ney straight from the definition, for one language."""

    def __init__(self, texts, alphabet):
        self.alphabet = alphabet
        self.counts = {lg.ORDER: Counter(e for t in texts for e in _events(t))}
        for k in range(lg.ORDER - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.discount, self.total, self.kinds = {}, defaultdict(int), defaultdict(int)
        for k, counts in self.counts.items():
            once, twice = (sum(n == m for n in counts.values()) for m in (1, 2))
            self.discount[k] = min(0.95, once / (once + 2 * twice)) if once else 0.5
            for g, n in counts.items():
                self.total[g[:-1]] += n
                self.kinds[g[:-1]] += 1
        self.totals = {k: self._contexts(k) for k in self.counts}

    def _contexts(self, k):
        out = defaultdict(lambda: [0, 0])
        for g, n in self.counts[k].items():
            out[g[:-1]][0] += n
            out[g[:-1]][1] += 1
        return out

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / self.alphabet
        total, kinds = self.totals[k].get(gram[:-1], (0, 0))
        if not total:
            return self.p(gram[1:])
        d = self.discount[k]
        return max(self.counts[k][gram] - d, 0) / total + d * kinds / total * self.p(gram[1:])


def _toy(seed, n=60):
    rng = random.Random(seed)
    words = {"aa": ["ba", "bo", "lé", "tri", "ma"], "bb": ["ko", "ße", "Øst", "tri", "um"], "cc": ["日本", "語ko", "ma", "xi"]}
    rows = []
    for k in range(n):
        lang = rng.choice(sorted(words))
        rows.append((k, "".join(rng.choice(words[lang]) + rng.choice([" ", "", "-- ", "1", "\n"]) for _ in range(rng.choice([1, 5, 30]))), lang))
    return rows


def _share(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4


def _table(spark, rows):
    return spark.createDataFrame([(*r, 1.0, True) for r in rows], "doc_id long, text string, lang string, score double, best boolean")


@pytest.mark.parametrize("cells,size", [(1 << 23, 1 << 19), (90, 11)])
def test_entropies_match_plain_models(spark, monkeypatch, cells, size):
    monkeypatch.setattr(lg, "SHARD_CELLS", cells)
    monkeypatch.setattr(lg, "SLICE", size)
    rows = _toy(1)
    learned = [r for r in rows if _share(r[0]) != 2]
    alphabet = len({e[-1] for r in learned for e in _events(r[1])}) + 1
    plain = {x: _Plain([t for _, t, y in learned if y == x], alphabet) for x in ("aa", "bb", "cc")}
    found = {r["doc_id"]: r for r in lg.identify(_table(spark, rows).repartition(3)).collect()}
    assert len(found) == len(rows)
    for doc_id, text, _ in rows:
        events = _events(text)
        bits = {x: -sum(math.log2(m.p(e)) for e in events) / len(events) for x, m in plain.items()}
        assert found[doc_id]["entropy"] == pytest.approx(min(bits.values()), rel=1e-4)
        assert bits[found[doc_id]["lang_pred"]] == pytest.approx(min(bits.values()), rel=1e-4)
        assert 0 <= found[doc_id]["score"] <= 1 and found[doc_id]["held_out"] == (_share(doc_id) == 2)


def test_probabilities_sum_to_one(spark):
    """Over all symbols, in seen and unseen contexts."""
    rows = [r for r in _toy(2) if r[2] != "cc"]
    counts = lg.gram_counts(_table(spark, rows).select("lang", F.lit(False).alias("calibrates"), "text")).drop("calibrates")
    model = lg.train(counts)
    shard = model.shard(0)
    symbols = sorted({e[-1] for _, t, _ in rows for e in _events(t)})
    for context in ("    ", " tri", "zzzz", "a tr"):
        codes = np.array([[ord(c) for c in context + s] for s in [*symbols, "一"]], np.uint32)
        total = 2 ** lg.log_likelihoods(codes, shard, model.alphabet)
        assert np.abs(total.sum(axis=0) - 1).max() < 1e-5


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    found = lg.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    right = found["lang"] == found["lang_pred"]
    assert len(found) > 200 and right.mean() >= 0.99 and right[found["accepted"]].mean() >= 0.995
    assert found["accepted"].mean() > 0.85
    assert abs(found["score"].mean() - right.mean()) < 0.05


def test_language_column_of_an_answer_is_not_read(spark):
    rows = _toy(3)
    wrong = [(i, t, "aa" if _share(i) == 2 else y) for i, t, y in rows]
    answer = lambda r: sorted(map(tuple, lg.identify(_table(spark, r)).collect()))
    assert answer(rows) == answer(wrong)


def test_odd_rows_and_empty_tables(spark):
    rows = _toy(4)
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "12 ?! --", "aa"), (None, "ba bo ba bo", "aa"), (903, "ko ße ko", None),
           (904, "tri " * 200_000, None), rows[5], rows[5], (905, "İß \U0001F600 ba", None)]
    found = lg.identify(_table(spark, rows + odd)).collect()
    assert len(found) == len(rows) + len(odd)
    und = {r["doc_id"] for r in found if r["lang_pred"] == "und"}
    assert und == {900, 901, 902} and all(r["score"] == 0 and not r["accepted"] for r in found if r["doc_id"] in und)
    assert {r["held_out"] for r in found if r["doc_id"] is None} == {False}
    assert sum(r["doc_id"] == rows[5][0] for r in found) == 3
    assert lg.identify(_table(spark, [])).count() == 0
    nothing = lg.identify(_table(spark, [(1, "ba bo", None), (2, "ko", None)])).collect()
    assert [r["lang_pred"] for r in nothing] == ["und", "und"]
    single = lg.identify(_table(spark, [(k, "ba bo ma", "aa") for k in range(12)])).collect()
    assert {r["lang_pred"] for r in single} == {"aa"}


def test_foreign_texts_are_rejected(spark):
    rows = [r for r in _toy(5, 300) if r[2] != "cc"]
    found = {r["doc_id"]: r for r in lg.identify(_table(spark, [*rows, (900, "zw xq vv qx " * 20, None)])).collect()}
    assert not found[900]["accepted"] and found[900]["lang_pred"] in ("aa", "bb")


def test_isotonic():
    shares = lg.isotonic(np.array([0.0, 5, 3, 0, 9]), np.array([4.0, 6, 6, 0, 9]))
    assert (np.diff(shares) >= 0).all() and shares[1] == shares[2] == pytest.approx(8.5 / 13)


def test_symbols():
    assert "".join(map(chr, np.concatenate(list(lg.symbols_in("¡Él  tenía 3 años!".encode()))))) == "    él tenía años "
    text = ("Ünï-Wörter, 12 日本 " * 50).encode()
    whole = next(lg.symbols_in(text))
    cut = list(lg.symbols_in(text, 7))
    assert np.concatenate([cut[0], *(c[lg.ORDER - 1:] for c in cut[1:])]).tolist() == whole.tolist()
    assert re.sub(r" +", " ", "".join(map(chr, whole))).strip() == " ".join(["ünï wörter 日本"] * 50)
