"""Language identification by character models with Kneser-Ney smoothing (operator 11).

A text is its lower-cased letters; whatever stands between letters is one space.
Every symbol is an event with the ``ORDER - 1`` symbols before it (spaces before
the first). Tasks count the n-grams of labelled texts per language, Spark adds
the counts up, and continuation counts, discounts and back-off weights follow by
grouping. An interpolated model needs, per n-gram, its discounted share of its
context and, per context, the weight of the lower order.

These numbers are sorted hash arrays: one array of 64-bit n-gram hashes in
order, and one row of numbers per hash with a column for each language. The
model holds every n-gram of every learned text, so it grows with the corpus. It
is cut into shards by the two symbols before an event, which keeps all that an
event needs in one shard (orders one and two are in all of them). A shard is held
to about ``SHARD_CELLS`` numbers and sent to the workers; texts are scored against one
shard after another, and the sums are added up. Most corpora need one shard.

The language is that of the lowest cross-entropy per symbol. Its score is the
probability that it is right: a monotone map from the margin to the second best
language, fitted on documents that a model without them has scored. A text is
rejected (``accepted`` is false) where that probability is below ``ACCEPT``, or
where its cross-entropy exceeds what all but ``ODD_SHARE`` of the language's own
texts reach. Every count comes from all documents.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and
is not accepted; rows without a language or id teach nothing, like those of the held-out
share; without any learned language all texts are ``und``; equal entropies go to
the language first in order; repeated rows count and are answered each; very
long texts are scored in slices; bytes that are no UTF-8 count as no letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.shingles import _mix
from flowlens.operators.staging import lookup
from flowlens.plans.workspace import discard, stored

ORDER = 5
SLICE = 1 << 19  # bytes of text at a time
HELD_GRAMS = 400_000  # n-grams a task holds before it passes them on
SHARD_CELLS = 1 << 23
CHUNK_CELLS = 1 << 21  # events times languages that are summed at a time
BINS = 4096  # of margins, for the calibration
ACCEPT = 0.9
ODD_SHARE = 0.001
UNKNOWN = "und"
_SPACE = 0x20
_ODD = _mix(np.arange(11, 11 + ORDER, dtype=np.uint64)) | np.uint64(1)
_LETTER = np.zeros(0, bool)


def _letters() -> np.ndarray:
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def symbols_in(text: bytes | None, size: int = SLICE) -> Iterator[np.ndarray]:
    """Symbols of a UTF-8 text, slice by slice, each slice with the ``ORDER - 1`` symbols before it."""
    letter = _letters()
    text = text or b""
    before = np.full(ORDER - 1, _SPACE, np.uint32)
    low = 0
    while low < len(text):
        high = min(len(text), low + size)
        while high < len(text) and text[high] & 0xC0 == 0x80:
            high += 1
        raw = text[low:high].decode("utf-8", "replace").lower().encode("utf-32-le", "replace")
        low = high
        codes = np.frombuffer(raw, np.uint32)
        known = letter[codes]
        codes = np.where(known, codes, np.uint32(_SPACE))
        keep = known.copy()
        keep[1:] |= known[:-1]
        keep[:1] |= before[-1] != _SPACE
        codes = np.concatenate([before, codes[keep]])
        if len(codes) >= ORDER:
            yield codes
        before = codes[1 - ORDER:]


def _hashes(codes: np.ndarray, order: int, kind: int) -> np.ndarray:
    """Hashes of the last ``order`` columns of rows of symbols; ``kind`` tells n-grams from contexts."""
    with np.errstate(over="ignore"):
        mixed = np.full(len(codes), np.uint64(2 * order + kind))
        for k in range(order):
            mixed = mixed + _mix(codes[:, codes.shape[1] - order + k].astype(np.uint64) + np.uint64(1)) * _ODD[k]
        return _mix(mixed)


def _distinct(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct n-gram among those that start at ``at``, and the number of each one's."""
    used = np.zeros(0x110000, bool)
    used[codes] = True
    width = max(1, (int(used.sum()) - 1).bit_length())
    room = max(1, (len(at) - 1).bit_length())
    if ORDER * width + room <= 64:
        # Few symbols: n-gram and place fit one number, and a plain sort groups them.
        dense = (np.cumsum(used, dtype=np.uint64) - np.uint64(1))[codes]
        key = np.zeros(len(at), np.uint64)
        for k in range(ORDER):
            key = key << np.uint64(width) | dense[at + k]
        key = np.sort(key << np.uint64(room) | np.arange(len(at), dtype=np.uint64))
        order = (key & np.uint64((1 << room) - 1)).astype(np.int64)
        key >>= np.uint64(room)
        new = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        place = np.empty(len(at), np.int64)
        place[order] = np.cumsum(new) - 1
        return order[new], place
    rows = np.ascontiguousarray(codes[at[:, None] + np.arange(ORDER)]).view([("", codes.dtype)] * ORDER).ravel()
    _, first, place = np.unique(rows, return_index=True, return_inverse=True)
    return first, place


def _grams(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of several runs of symbols as rows, the place of each event's among them, events per run."""
    lengths = np.array([len(p) for p in parts], np.int64)
    sizes = lengths - ORDER + 1
    codes = np.concatenate(parts)
    # Windows that reach from one run into the next are left out.
    start = np.repeat(np.cumsum(lengths) - lengths, sizes)
    at = start + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first, place = _distinct(codes, at)
    return codes[at[first][:, None] + np.arange(ORDER)], place, sizes


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, calibrates, gram, n) of documents (lang, calibrates, text): n-grams of the full order."""
    schema = "lang string, calibrates boolean, gram string, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict[str, int]] = {}
        waiting: dict[tuple, list[np.ndarray]] = {}
        sizes: dict[tuple, int] = {}

        def add(key: tuple) -> None:
            grams, place, _ = _grams(waiting.pop(key))
            sizes.pop(key)
            shown = grams.astype("<u4").tobytes().decode("utf-32-le")
            known = held.setdefault(key, {})
            for k, n in enumerate(np.bincount(place).tolist()):
                gram = shown[k * ORDER:(k + 1) * ORDER]
                known[gram] = known.get(gram, 0) + n

        def report() -> Iterator[pa.RecordBatch]:
            for (lang, calibrates), known in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(known)), pa.array([calibrates] * len(known)), pa.array(list(known), pa.string()),
                     pa.array(list(known.values()), pa.int64())],
                    names=["lang", "calibrates", "gram", "n"],
                )
            held.clear()

        for batch in batches:
            for lang, calibrates, text in zip(*(batch.column(i) for i in range(3))):
                key = (lang.as_py(), calibrates.as_py())
                for part in symbols_in(text.as_py()):
                    waiting.setdefault(key, []).append(part)
                    sizes[key] = sizes.get(key, 0) + len(part)
                    if sizes[key] > SLICE:
                        add(key)
                if sum(map(len, held.values())) > HELD_GRAMS:
                    yield from report()
            if sum(sizes.values()) > 4 * SLICE:
                for key in list(waiting):
                    add(key)
        for key in list(waiting):
            add(key)
        yield from report()

    counted = docs.select("lang", "calibrates", F.col("text").cast("binary").alias("text")).mapInArrow(count, schema)
    return counted.groupBy("lang", "calibrates", "gram").agg(F.sum("n").alias("n"))


def smoothed(counts: DataFrame) -> DataFrame:
    """(lang, gram, order, kind, value) from (lang, gram, n): shares of n-grams (kind 0) and weights of contexts (kind 1).

    Below the full order an n-gram counts by the different symbols before it.
    The weight is that of the next lower order; its excess over one is kept, since contexts
    never seen have weight one.
    """
    longer = F.array(*[F.expr(f"substring(gram, {ORDER - k}, {k + 1})") for k in range(1, ORDER)])
    lower = counts.select("lang", F.explode(longer).alias("gram")).distinct().groupBy(
        "lang", F.expr("substring(gram, 2)").alias("gram")
    ).agg(F.count(F.lit(1)).alias("n"))
    every = stored(
        counts.select("lang", "gram", "n").unionByName(lower)
        .withColumn("order", F.length("gram")).withColumn("context", F.expr("substring(gram, 1, order - 1)")),
        "grams",
    )
    times = every.groupBy("lang", "order").agg(
        F.count(F.when(F.col("n") == 1, 1)).alias("once"), F.count(F.when(F.col("n") == 2, 1)).alias("twice")
    )
    # Without single n-grams there is nothing to learn a discount from; half a count is taken.
    discount = F.when(F.col("once") > 0, F.col("once") / (F.col("once") + 2 * F.col("twice"))).otherwise(F.lit(0.5))
    times = lookup(times.select("lang", "order", F.least(discount, F.lit(0.95)).alias("discount")))
    # As many rows as the context is followed by different symbols, never more than the alphabet has.
    of = Window.partitionBy("lang", "order", "context")
    held = every.withColumns({"total": F.sum("n").over(of), "kinds": F.count(F.lit(1)).over(of)}).join(times, ["lang", "order"])
    share = F.struct(F.col("gram"), F.lit(0).alias("kind"), ((F.col("n") - F.col("discount")) / F.col("total")).alias("value"))
    weight = F.struct(
        F.col("context").alias("gram"), F.lit(1).alias("kind"), (F.col("discount") * F.col("kinds") / F.col("total") - 1).alias("value")
    )
    first = F.row_number().over(of.orderBy("gram")) == 1
    rows = held.withColumn("first", first).select(
        "lang", "order", F.explode(F.when(F.col("first"), F.array(share, weight)).otherwise(F.array(share))).alias("r")
    )
    return rows.select("lang", "r.gram", "order", "r.kind", "r.value")


@dataclass
class Shard:
    """Sorted hashes and, row by row, the numbers of each language."""

    keys: np.ndarray
    values: np.ndarray

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros((len(hashes), self.values.shape[1]))
        order = np.argsort(hashes)  # neighbours are looked up one after another
        at = np.empty(len(hashes), np.int64)
        at[order] = np.minimum(np.searchsorted(self.keys, hashes[order]), len(self.keys) - 1)
        return self.values[at] * (self.keys[at] == hashes)[:, None]


def _places(codes: np.ndarray) -> np.ndarray:
    """Hash of the two symbols before each event (rows end with the event); it decides the shard."""
    return (_hashes(codes[:, -3:-1], 2, 1) >> np.uint64(1)).astype(np.int64)


def log_likelihoods(grams: np.ndarray, shard: Shard, alphabet: int) -> np.ndarray:
    """Base-2 logarithms of the probability of each row's last symbol after the ones before it, per language."""
    p = np.full((len(grams), shard.values.shape[1]), 1.0 / alphabet)
    for order in range(1, ORDER + 1):
        weight = 1.0 + shard.look_up(_hashes(grams[:, :-1], order - 1, 1))
        p = shard.look_up(_hashes(grams, order, 0)) + weight * p
    return np.log2(p)


class _Known:
    """Log-likelihoods of n-grams a task has met, since most of them come again; lookups only, no effect on results."""

    def __init__(self, compute, width: int):
        self.compute, self.width = compute, width
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, width))
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def get(self, grams: np.ndarray) -> np.ndarray:
        hashes = _hashes(grams, ORDER, 0)
        order = np.argsort(hashes)
        hashes = hashes[order]
        out = np.empty((len(grams), self.width))
        missing = np.ones(len(grams), bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            missing = self.keys[at] != hashes
            out[order] = self.values[at]
        if missing.any():
            found = self.compute(grams[order[missing]])
            out[order[missing]] = found
            self.fresh.append((hashes[missing], found))
            self.waiting += len(found)
            if self.waiting * 4 > len(self.keys):
                self._merge()
        return out

    def _merge(self) -> None:
        if (len(self.keys) + self.waiting) * self.width > CHUNK_CELLS:
            self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, self.width))
        keys = np.concatenate([self.keys, *(k for k, _ in self.fresh)])
        values = np.concatenate([self.values, *(v for _, v in self.fresh)])
        self.keys, first = np.unique(keys, return_index=True)
        self.values, self.fresh, self.waiting = values[first], [], 0


@dataclass
class Model:
    """Languages, the alphabet's size and the table (place, key, values) of all numbers."""

    langs: list[str]
    alphabet: int
    shards: int
    table: DataFrame

    def shard(self, number: int) -> Shard:
        """One shard's arrays, on the driver: about ``SHARD_CELLS`` numbers."""
        mine = F.col("place").isNull() | (F.pmod("place", F.lit(self.shards)) == number)
        rows = self.table.filter(mine).select("key", "values").toArrow()
        keys = rows.column(0).to_numpy().view(np.uint64)
        values = np.zeros((0, len(self.langs)), np.float32)
        if len(keys):
            values = rows.column(1).combine_chunks().flatten().to_numpy().reshape(len(keys), len(self.langs))
        order = np.argsort(keys)
        return Shard(keys[order], values[order])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = batch.column(0).to_pylist()
        order, kind = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        keys, places, known = np.zeros(len(grams), np.uint64), np.zeros(len(grams), np.int64), np.zeros(len(grams), bool)
        for o, k in set(zip(order.tolist(), kind.tolist())):
            some, size = np.flatnonzero((order == o) & (kind == k)), o - k
            codes = np.frombuffer("".join(grams[i] for i in some).encode("utf-32-le"), np.uint32).reshape(len(some), size)
            keys[some] = _hashes(codes, size, k)
            if size + k > 2:
                # A context ends where its events begin.
                places[some] = _places(codes if k == 0 else np.column_stack([codes, codes[:, -1:]]))
                known[some] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array(places, mask=~known), pa.array(keys.view(np.int64)), batch.column(3), batch.column(4)],
            names=["place", "key", "lang", "value"],
        )


def train(counts: DataFrame) -> Model:
    """The model of (lang, gram, n)."""
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    # One symbol more than are known stands for all others.
    alphabet = counts.select(F.expr(f"substring(gram, {ORDER}, 1)")).distinct().count() + 1
    rows = smoothed(counts).select("gram", "order", "kind", "lang", "value").mapInArrow(
        _hashed, "place long, key long, lang string, value double"
    )
    values = [F.coalesce(F.max(F.when(F.col("lang") == x, F.col("value"))), F.lit(0.0)).cast("float") for x in langs]
    table = stored(
        rows.groupBy("place", "key").agg((F.array(*values) if langs else F.array().cast("array<float>")).alias("values")),
        "language-model",
    )
    return Model(langs, alphabet, -(-table.count() * len(langs) // SHARD_CELLS) or 1, table)


def _shard_sums(texts: DataFrame, model: Model, number: int) -> DataFrame:
    """``texts`` with ``sums`` and ``events`` in place of its last column, a binary text."""
    sent = texts.sparkSession.sparkContext.broadcast(model.shard(number))
    alphabet, shards, width = model.alphabet, model.shards, len(model.langs)
    room = max(1 << 14, min(SLICE, CHUNK_CELLS // width))
    schema = T.StructType([
        *texts.schema.fields[:-1], T.StructField("sums", T.ArrayType(T.DoubleType())), T.StructField("events", T.LongType()),
    ])

    def compute(grams: np.ndarray) -> np.ndarray:
        found = log_likelihoods(grams, sent.value, alphabet)
        if shards > 1:
            found[_places(grams) % shards != number] = 0.0
        return found

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(compute, width)
        for batch in batches:
            sums, events = np.zeros((batch.num_rows, width)), np.zeros(batch.num_rows, np.int64)

            def add(parts: list[np.ndarray], rows: list[int]) -> None:
                grams, place, sizes = _grams(parts)
                np.add.at(sums, rows, np.add.reduceat(known.get(grams)[place], np.cumsum(sizes) - sizes))
                np.add.at(events, rows, sizes)

            parts, rows, held = [], [], 0
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                for part in symbols_in(text.as_py(), room):
                    parts.append(part)
                    rows.append(i)
                    held += len(part)
                    if held >= room:
                        add(parts, rows)
                        parts, rows, held = [], [], 0
            if parts:
                add(parts, rows)
            edges = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.ListArray.from_arrays(edges, pa.array(sums.ravel())), pa.array(events)],
                names=schema.fieldNames(),
            )

    return texts.mapInArrow(score, schema)


def likelihoods(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``sums`` (log-likelihood per language) and ``events`` (symbols)."""
    kept = [c for c in docs.columns if c != "text"]
    texts = docs.select(*kept, F.col("text").cast("binary").alias("text"))
    if model.shards == 1:
        return _shard_sums(texts, model, 0)
    # Rows need a number to bring the shards' sums together; it is written, so that it holds if a task runs again.
    texts = stored(texts.select(F.monotonically_increasing_id().alias("row"), *kept, "text"), "texts")
    parts = None
    for number in range(model.shards):
        part = _shard_sums(texts.select("row", "text"), model, number)
        parts = part if parts is None else parts.unionByName(part)
    added = parts.groupBy("row").agg(
        F.array(*[F.sum(F.col("sums")[i]) for i in range(len(model.langs))]).alias("sums"), F.max("events").alias("events")
    )
    return texts.drop("text").join(added, "row").drop("row")


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``lang_pred``, ``entropy`` (bits a symbol) and ``margin`` (bits of the whole text)."""
    found = likelihoods(docs, model)
    names = F.array(*[F.lit(x) for x in model.langs])
    entropies = F.transform("sums", lambda x, i: F.struct((-x / F.col("events")).alias("h"), i.alias("i")))
    found = found.withColumn("best", F.when(F.col("events") > 0, F.array_min(entropies)))
    second = F.array_min(F.filter(entropies, lambda e: e["i"] != F.col("best")["i"]))
    kept = [c for c in docs.columns if c != "text"]
    return found.select(
        *kept, F.coalesce(F.get(names, F.col("best")["i"]), F.lit(UNKNOWN)).alias("lang_pred"), F.col("best")["h"].alias("entropy"),
        F.when(F.col("events") > 0, F.coalesce((second["h"] - F.col("best")["h"]) * F.col("events"), F.lit(float("inf")))).alias("margin"),
    )


def _bin(margin: Column) -> Column:
    """Bins of equal steps in the logarithm of the margin."""
    steps = F.floor(128 * F.log2(1 + F.least(margin, F.lit(2.0**31))))
    return F.when(margin.isNotNull(), F.least(F.lit(BINS - 1), steps).cast("int"))


def isotonic(right: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Rising shares of right answers per bin, by pooling neighbours that fall; bins without answers join the one before."""
    blocks: list[list[float]] = []
    for r, n in zip(right.tolist(), seen.tolist()):
        blocks.append([r, n, 1])
        while len(blocks) > 1 and blocks[-1][0] * blocks[-2][1] <= blocks[-2][0] * blocks[-1][1]:
            r, n, width = blocks.pop()
            blocks[-1] = [blocks[-1][0] + r, blocks[-1][1] + n, blocks[-1][2] + width]
    shares = np.concatenate([np.full(int(w), (r + 0.5) / (n + 1)) for r, n, w in blocks])
    return np.maximum.accumulate(shares)


def calibrate(judged_docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bin, score) and (lang_pred, most_bits) from documents with a known ``lang`` that taught the model nothing."""
    spark = judged_docs.sparkSession
    known = stored(judged_docs.filter("margin is not null"), "judged")
    right, seen = np.zeros(BINS), np.zeros(BINS)
    counted = known.groupBy(_bin(F.col("margin")).alias("bin")).agg(
        F.count(F.lit(1)), F.sum((F.col("lang") == F.col("lang_pred")).cast("long"))
    )
    for b, n, good in counted.collect():
        seen[b], right[b] = n, good
    scores = spark.createDataFrame(list(enumerate(isotonic(right, seen).tolist())), "bin int, score double")
    limits = known.groupBy(F.col("lang").alias("lang_pred")).agg(
        F.percentile_approx("entropy", 1 - ODD_SHARE, 100_000).alias("most_bits")
    )
    limits = spark.createDataFrame(limits.collect(), "lang_pred string, most_bits double")
    discard(known)
    return scores, limits


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, entropy, accepted) of every document.

    Documents whose crc32(id as text) mod 4 is 2 are held out of everything that
    is learned; those where it is 3 calibrate the scores before they join the model.
    """
    share = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4
    table = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), share.alias("share"), F.col(text).alias("text")
    )
    learned = table.filter(F.col("lang").isNotNull() & (F.col("share") != 2))
    counts = stored(gram_counts(learned.select("lang", (F.col("share") == 3).alias("calibrates"), "text")), "gram-counts")
    added = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    model, first = train(added), train(counts.filter("not calibrates").select("lang", "gram", "n"))
    held_out = F.coalesce(F.col("share") == 2, F.lit(False))
    if not model.langs:
        return table.select(
            "doc_id", held_out.alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
            F.lit(None).cast("double").alias("entropy"), F.lit(False).alias("accepted"),
        )
    if first.langs:
        scores, limits = calibrate(judged(learned.filter("share = 3").select("lang", "text"), first))
    else:
        scores, limits = calibrate(judged(learned.select("lang", "text").limit(0), model))
    discard(counts, first.table)
    answers = judged(table.select("doc_id", held_out.alias("held_out"), "text"), model)
    # Both tables are small by construction: one row a bin, one a language.
    answers = answers.withColumn("bin", _bin(F.col("margin"))).join(F.broadcast(scores), "bin", "left").join(
        F.broadcast(limits), "lang_pred", "left"
    )
    usual = F.coalesce(F.col("entropy") <= F.col("most_bits"), F.lit(True))
    score = F.coalesce("score", F.lit(0.0))
    return answers.select(
        "doc_id", "held_out", "lang_pred", score.alias("score"), "entropy",
        (F.col("margin").isNotNull() & (score >= ACCEPT) & usual).alias("accepted"),
    )
