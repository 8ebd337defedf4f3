"""Quality rules by weak supervision (operator 7).

Each rule looks at a few counts of a text and votes keep (1), reject (-1) or
abstains (0). Expectation-maximisation estimates, from the votes alone, how
often each rule is right on good and on bad documents; the posterior
probability that a document is good then replaces "all rules must pass".

The counts and votes are DataFrame expressions. The estimate needs only how
often each combination of votes occurs, at most 3^9 rows whatever the corpus.

Defined cases: a null or empty text has no words and fails the base rule; a
null id is kept as it is; equal rows get equal verdicts; an empty table gives
an empty result; extra columns pass through ``filter_documents`` untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import NOT_SPACE, fresh, let, positions, quoted, words
from flowlens.plans.workspace import stored

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
RULES = (
    "symbols", "repeats", "line_copies", "variety", "capitals", "exclamation", "word_length", "line_ends", "symbol_density",
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_ended_lines", "n_distinct_words", "n_letters", "n_capitals", "n_exclamations")


def _repeat_words(found: Column) -> Column:
    """Words inside 8-word windows that occur at least twice in the text."""
    size = F.size(found)
    hashes = F.transform(positions(size - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(found, i + 1, WINDOW)))

    def covered(hashed: Column) -> Column:
        placed = F.array_sort(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(rows: Column) -> Column:
            twice = F.filter(
                rows,
                lambda r, i: (r["h"] == F.get(rows, i - 1)["h"]).eqNullSafe(True)
                | (r["h"] == F.get(rows, i + 1)["h"]).eqNullSafe(True),
            )
            places = F.array_sort(F.transform(twice, lambda r: r["i"]))
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
            return F.aggregate(
                places, start,
                lambda acc, i: F.struct(
                    (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")
                ),
            )["n"]

        return let(placed, repeated)

    return let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")),
    )


def text_counts(text: Column) -> Column:
    """All counts of a text as an array of one struct, for ``inline``."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(NOT_SPACE))
    parts = F.array(F.struct(whole.alias("t"), words(text).alias("w"), lines.alias("l")))

    def count(pattern: str, of: Column) -> Column:
        return F.char_length(F.regexp_replace(of, pattern, "")).cast("long")

    def measure(p: Column) -> Column:
        values = {
            "n_words": F.size(p["w"]).cast("long"),
            "word_chars": F.char_length(F.array_join(p["w"], "")).cast("long"),
            "n_symbols": count("[^#*$%&|<>]+", p["t"]),
            "n_dup_lines": (F.size(p["l"]) - F.size(F.array_distinct(p["l"]))).cast("long"),
            "n_repeat_words": _repeat_words(p["w"]),
            "n_lines": F.size(p["l"]).cast("long"),
            "n_ended_lines": F.size(F.filter(p["l"], lambda x: x.rlike(r"[.!?;:\"”»…)][\s]*$"))).cast("long"),
            "n_distinct_words": F.size(F.array_distinct(p["w"])).cast("long"),
            "n_letters": count(r"\P{L}+", p["t"]),
            "n_capitals": count(r"\P{Lu}+", p["t"]),
            "n_exclamations": count("[^!]+", p["t"]),
        }
        return F.struct(*[v.alias(k) for k, v in values.items()])

    return F.transform(parts, measure)


def _vote(reject: Column, keep: Column) -> Column:
    return F.when(reject, F.lit(-1)).when(keep, F.lit(1)).otherwise(F.lit(0))


def rule_votes(c: dict[str, Column]) -> dict[str, Column]:
    """One vote per rule, in the order of ``RULES``."""
    n, root = c["n_words"], F.sqrt(c["n_words"].cast("double"))
    return {
        "symbols": _vote(c["n_symbols"] * 10 > n, c["n_symbols"] * 50 <= n),
        "repeats": _vote(c["n_repeat_words"] * 5 > n, c["n_repeat_words"] * 20 <= n),
        "line_copies": _vote(c["n_dup_lines"] * 5 > c["n_lines"] * 2, c["n_dup_lines"] * 10 <= c["n_lines"]),
        "variety": _vote(c["n_distinct_words"] < 2 * root, c["n_distinct_words"] > 4 * root),
        "capitals": _vote(c["n_capitals"] * 2 > c["n_letters"], c["n_capitals"] * 4 <= c["n_letters"]),
        "exclamation": _vote(c["n_exclamations"] * 4 > n, c["n_exclamations"] * 20 <= n),
        "word_length": _vote(
            (c["word_chars"] < 3 * n) | (c["word_chars"] > 12 * n),
            (c["word_chars"] >= 4 * n) & (c["word_chars"] <= 7 * n),
        ),
        "line_ends": _vote(c["n_ended_lines"] * 10 < c["n_lines"], c["n_ended_lines"] * 2 >= c["n_lines"]),
        "symbol_density": _vote(c["n_symbols"] * 200 > 3 * c["word_chars"], c["n_symbols"] * 1000 <= 3 * c["word_chars"]),
    }


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents, and per rule the chance of a right vote, given that it votes."""

    prior: float
    right_on_good: tuple[float, ...]
    right_on_bad: tuple[float, ...]

    def log_odds(self, votes: tuple[int, ...]) -> float:
        total = math.log(self.prior / (1 - self.prior))
        for vote, good, bad in zip(votes, self.right_on_good, self.right_on_bad):
            if vote > 0:
                total += math.log(good / (1 - bad))
            elif vote < 0:
                total += math.log((1 - good) / bad)
        return total

    def posterior(self, votes: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.log_odds(votes)))))


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 200) -> VoteModel:
    """Expectation-maximisation over vote combinations and how often each occurs.

    It starts by taking every document that some rule rejects for a bad one,
    then lets the votes decide: a rule whose rejections no other rule shares
    turns out to reject good documents, and is outvoted from then on. Faults are
    seen by two rules where they can be (symbols per word and per character), so
    that agreement tells faults from odd but good documents. One pseudo-vote of
    each kind per rule and class keeps every probability off zero and one.
    """
    rows = sorted(patterns.items())
    width = len(RULES)
    good = [0.0 if min(v) < 0 else 1.0 if max(v) > 0 else 0.5 for v, _ in rows]
    model = VoteModel(0.5, (0.7,) * width, (0.7,) * width)
    for _ in range(rounds):
        total = sum(n for _, n in rows)
        prior = (1 + sum(g * n for g, (_, n) in zip(good, rows))) / (2 + total)
        on_good, on_bad = [], []
        for j in range(width):
            keep_good = 1 + sum(g * n for g, (v, n) in zip(good, rows) if v[j] > 0)
            any_good = 2 + sum(g * n for g, (v, n) in zip(good, rows) if v[j])
            drop_bad = 1 + sum((1 - g) * n for g, (v, n) in zip(good, rows) if v[j] < 0)
            any_bad = 2 + sum((1 - g) * n for g, (v, n) in zip(good, rows) if v[j])
            on_good.append(keep_good / any_good)
            on_bad.append(drop_bad / any_bad)
        fitted = VoteModel(prior, tuple(on_good), tuple(on_bad))
        moved = [fitted.posterior(v) for v, _ in rows]
        done = max((abs(a - b) for a, b in zip(moved, good)), default=0.0) < 1e-9
        model, good = fitted, moved
        if done:
            break
    return model


def fit(measured: DataFrame, counts: str) -> VoteModel:
    """Estimate the rules' accuracies on all documents that pass the base rule."""
    columns = _counts_of(counts)
    votes = rule_votes(columns)
    found = (
        measured.filter(~base_failed(columns))
        .select(*[v.alias(k) for k, v in votes.items()])
        .groupBy(*RULES).count().collect()
    )
    return estimate({tuple(r[k] for k in RULES): r["count"] for r in found})


def _counts_of(name: str) -> dict[str, Column]:
    return {c: quoted(name)[c] for c in (*COUNTS, *EXTRA)}


def base_failed(c: dict[str, Column]) -> Column:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def posterior(c: dict[str, Column], model: VoteModel) -> Column:
    """Probability that a document is good, given its votes."""
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for vote, good, bad in zip(rule_votes(c).values(), model.right_on_good, model.right_on_bad):
        weight = F.when(vote > 0, math.log(good / (1 - bad))).when(vote < 0, math.log((1 - good) / bad))
        odds = odds + F.coalesce(weight, F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5, keep_text: bool = True) -> DataFrame:
    """``docs`` with a struct column of counts, ``base_failed``, probability and ``kept``.

    The name of the added column is the last of the result. Texts are read
    once: rows and counts are written to the shared folder before the fit,
    without the texts where they are not asked for.
    """
    counts, verdict = fresh(docs, "__counts"), fresh(docs, "__verdict")
    kept = [quoted(c) for c in docs.columns if keep_text or c != text]
    measured = stored(
        docs.select(*kept, F.inline(F.transform(text_counts(quoted(text)), lambda c: F.struct(c.alias(counts))))),
        "quality",
    )
    model = fit(measured, counts)
    c = _counts_of(counts)
    failed = base_failed(c)
    chance = posterior(c, model)
    judged = F.struct(
        *[c[k].alias(k) for k in COUNTS],
        failed.alias("base_failed"),
        chance.alias("probability"),
        (~failed & (chance >= threshold)).alias("kept"),
    )
    return measured.withColumn(verdict, judged).drop(counts)


def filter_documents(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents kept, in the columns they came with."""
    judged = judge(docs, text, threshold)
    return judged.filter(quoted(judged.columns[-1])["kept"]).select(*[quoted(c) for c in docs.columns])


def document_quality(docs: DataFrame) -> DataFrame:
    """One row per document: id, counts, base rule, probability and verdict."""
    judged = judge(docs.select("doc_id", "text"), keep_text=False)
    return judged.select("doc_id", F.col(f"{judged.columns[-1]}.*"))
