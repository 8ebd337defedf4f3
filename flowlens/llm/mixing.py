"""Mixing sources to target weights by temperature (operator 8).

With p the share of all tokens that a source holds, its weight is p^x over the
sum of all such powers: x = 1 keeps the mix as it is, x = 0 gives every source
the same. The exponent is found by bisection, either as the smallest that keeps
every source within a limit of repetitions, or as the one that reaches a target
share of the greatest possible entropy. A source's budget is its weight of the
token budget, which by default is the least that uses every document at least
once, so mixing drops nothing.

A budget is realised as whole passes over the source and one part pass. Each
pass has its own keyed order: documents fall into blocks of about
``BLOCK_TOKENS`` (at most ``MAX_BLOCKS``) by hash, blocks follow one another, and documents follow their
hash inside a block. The part pass takes the longest prefix of that order that
fits. Only token totals per block and the one block in which the budget ends
are put in order, so neither a hot source nor any text is ever shuffled.

Defined cases: a null source is a source of its own; null and empty texts have
no tokens and ride along with their source's whole passes; copies of a row
(same id and text) stand or fall together; a source without tokens is used
once; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import document_key, fresh, quoted, words
from flowlens.plans.workspace import stored

MAX_REPEATS = 2.0
BLOCK_TOKENS = 20_000
MAX_BLOCKS = 4096  # per source and pass, so block totals stay a small table
STEPS = 40
WAYS = 17
SCALE = 1 << 30


def source_tokens(docs: DataFrame, source: Column, tokens: Column) -> DataFrame:
    """(source, tokens) with one row per source."""
    return docs.select(source.alias("source"), tokens.cast("long").alias("n")).groupBy("source").agg(
        F.sum("n").alias("tokens")
    )


def _probe(shares: DataFrame, exponents: list[float], budget: float | None) -> list:
    """Per exponent: entropy over its maximum, and the most repetitions of a source."""
    tried = shares.select("p", "tokens", F.explode(F.array(*[F.lit(x) for x in exponents])).alias("x"))
    powered = tried.withColumn("w", F.pow("p", "x"))
    sums = powered.groupBy("x").agg(
        F.sum("w").alias("z"),
        F.sum(F.col("w") * F.log("w")).alias("wlogw"),
        F.count(F.lit(1)).alias("sources"),
        F.max(F.col("w") / F.col("tokens")).alias("most"),
        F.max(F.col("tokens") / F.col("w")).alias("least_budget"),
    )
    entropy = (F.log("z") - F.col("wlogw") / F.col("z")) / F.log("sources")
    # w / z of the budget over the tokens; the default budget is z * max(tokens / w).
    spent = F.lit(budget) / F.col("z") if budget is not None else F.col("least_budget")
    return sums.select(
        "x", F.when(F.col("sources") > 1, entropy).otherwise(F.lit(1.0)).alias("entropy"),
        (F.col("most") * spent).alias("repeats"),
        (F.lit(budget) if budget is not None else F.col("z") * F.col("least_budget")).alias("budget"),
    ).orderBy("x").collect()


def find_exponent(
    sizes: DataFrame, budget: int | None = None, max_repeats: float | None = MAX_REPEATS,
    target_entropy: float | None = None,
) -> tuple[float, float]:
    """The exponent in [0, 1] and the token budget.

    Repetitions fall and entropy falls as the exponent rises. Every pass over
    the sources tries several points of the interval at once, which narrows it
    as four halvings would. With neither limit, or if even 1 misses the limit
    of repetitions, the exponent is 1.
    """
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return 1.0, 0.0
    filled = sizes.filter(F.col("tokens") > 0)
    shares = filled.select("tokens", (F.col("tokens") / F.lit(float(total))).alias("p"))
    low, high = 0.0, 1.0
    limit = float(budget) if budget is not None else None

    def met(row) -> bool:
        """Whether the wanted exponent is at or below this one."""
        if target_entropy is not None:
            return row["entropy"] <= target_entropy
        return row["repeats"] <= max_repeats * (1 + 1e-12)

    if target_entropy is None and max_repeats is None:
        low = 1.0
    for _ in range(STEPS // 4):
        if low >= high:
            break
        tried = _probe(shares, sorted({low + (high - low) * i / (WAYS - 1) for i in range(WAYS)}), limit)
        hits = [r["x"] for r in tried if met(r)]
        if not hits:
            low = high
        elif hits[0] == low:
            high = low
        else:
            low, high = max(r["x"] for r in tried if r["x"] < hits[0]), hits[0]
    final = _probe(shares, [high], limit)[0]
    return float(high), float(final["budget"])


def plan_sources(
    docs: DataFrame, source: Column, tokens: Column, budget: int | None = None,
    max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None,
) -> DataFrame:
    """Per source: tokens, weight, budget, whole passes, tokens of the part pass, blocks."""
    sizes = stored(source_tokens(docs, source, tokens), "sources")
    exponent, spent = find_exponent(sizes, budget, max_repeats, target_entropy)
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    powers = sizes.withColumn(
        "w", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(exponent))).otherwise(0.0)
    )
    z = powers.agg(F.sum("w")).first()[0] or 1.0
    # A budget one rounding error short of a whole pass still means the whole pass.
    ratio = F.when(F.col("tokens") > 0, F.col("budget") / F.col("tokens")).otherwise(F.lit(1.0)) + F.lit(1e-9)
    return stored(
        powers.withColumn("weight", F.col("w") / F.lit(z))
        .withColumn("budget", F.col("weight") * F.lit(spent))
        .withColumn("passes", F.floor(ratio).cast("long"))
        .withColumn(
            "part", F.greatest(F.lit(0), F.floor(F.col("budget") + F.lit(1e-6)) - F.col("passes") * F.col("tokens")).cast("long")
        )
        .withColumn("blocks", F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(BLOCK_TOKENS)))).cast("long"))
        .select(F.struct("source").alias("sk"), "source", "tokens", "weight", "budget", "passes", "part", "blocks"),
        "source-plan",
    )


def _order(seed: int, epoch: Column, key: Column) -> Column:
    """A keyed draw in [0, SCALE) that gives every pass its own order."""
    return F.pmod(F.xxhash64(F.lit(seed), epoch.cast("long"), key), F.lit(SCALE))


def mix(
    docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", tokens: Column | None = None,
    seed: int = 17, budget: int | None = None, max_repeats: float | None = MAX_REPEATS,
    target_entropy: float | None = None, detail: str | None = None,
) -> DataFrame:
    """``docs``, each as often as its source's budget asks.

    ``detail`` names a struct column (tokens, epoch, block) to add: the pass a
    row belongs to and its block there. The output order of pass ``epoch`` of a
    source is by block and then by the keyed draw.
    """
    names = {k: fresh(docs, k) for k in ("__tokens", "__key", "__sk", "__plan", "__epoch")}
    count = tokens if tokens is not None else F.size(words(quoted(text))).cast("long")
    plan = plan_sources(docs, quoted(source), count, budget, max_repeats, target_entropy)

    def block(epoch: Column, key: Column, blocks: Column) -> Column:
        return F.floor(_order(seed, epoch, key) * blocks / F.lit(SCALE)).cast("long")

    narrow = docs.select(
        document_key(doc_id, text).alias("key"), F.struct(quoted(source).alias("source")).alias("sk"), count.alias("n")
    )
    light = narrow.join(plan.select("sk", "passes", "part", "blocks"), "sk").withColumn(
        "block", block(F.col("passes"), F.col("key"), F.col("blocks"))
    )
    light = stored(light.withColumn("draw", _order(seed, F.col("passes"), F.col("key"))).filter("part > 0"), "part-pass")
    totals = light.groupBy("sk", "block").agg(F.sum("n").alias("n"), F.max("part").alias("part"))
    upto = Window.partitionBy("sk").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (
        totals.withColumn("upto", F.sum("n").over(upto))
        .filter(F.col("upto") > F.col("part"))
        .groupBy("sk").agg(F.min(F.struct("block", (F.col("upto") - F.col("n")).alias("before"))).alias("e"))
        .select("sk", F.col("e.block").alias("block"), F.col("e.before").alias("before"))
    )
    ends = stored(ends, "part-ends")
    inside = Window.partitionBy("sk").orderBy("draw", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (
        light.join(ends, ["sk", "block"])
        .groupBy("sk", "key", "draw", "part", "before").agg(F.sum("n").alias("n"))
        .withColumn("upto", F.col("before") + F.sum("n").over(inside))
        .filter(F.col("upto") <= F.col("part"))
        .groupBy("sk").agg(F.max(F.struct("draw", "key")).alias("cut"))
    )
    settled = stored(
        plan.join(ends.select("sk", F.col("block").alias("last")), "sk", "left").join(cuts, "sk", "left")
        .select(F.col("sk").alias(names["__sk"]), F.struct("passes", "part", "blocks", "last", "cut").alias(names["__plan"])),
        "source-ends",
    )
    wide = docs.withColumns({
        names["__tokens"]: count, names["__key"]: document_key(doc_id, text),
        names["__sk"]: F.struct(quoted(source).alias("source")),
    }).join(settled, names["__sk"])
    p, key = quoted(names["__plan"]), quoted(names["__key"])
    here = block(p["passes"], key, p["blocks"])
    place = F.struct(_order(seed, p["passes"], key).alias("draw"), key.alias("key"))
    inside_end = p["last"].isNull() | (here < p["last"]) | ((here == p["last"]) & (place <= p["cut"]))
    copies = p["passes"] + F.when((p["part"] > 0) & inside_end, 1).otherwise(0)
    columns = [quoted(c) for c in docs.columns]
    if detail:
        epoch = quoted(names["__epoch"]).cast("long")
        columns.append(
            F.struct(
                quoted(names["__tokens"]).alias("n_tokens"), epoch.alias("epoch"),
                block(epoch, key, p["blocks"]).alias("block"), _order(seed, epoch, key).alias("draw"),
            ).alias(detail)
        )
    return wide.withColumn(
        names["__epoch"], F.explode(F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1)))
    ).select(*columns)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, block, draw) of every copy in the mix."""
    return mix(docs.select("doc_id", "text", "source"), detail="mixed").select("doc_id", "source", "mixed.*")
