"""Class-aware sampling with exact caps and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.numeric import seeded_order
from flowlens.operators.ordering import smallest_per_group
from flowlens.operators.staging import lookup


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def training_caps(counts: DataFrame, label: str, ratio: int, max_attack: int) -> DataFrame:
    """Cap table of the benign-anchored training sample: null keeps all benign rows."""
    benign = F.max(F.when(F.col(label) == "Benign", F.col("rows")))
    attack = F.max(F.when(F.col(label) == "Attack", F.col("rows")))
    target = F.least(
        F.coalesce(attack, F.lit(0)), F.coalesce(benign, F.lit(0)) * ratio, F.lit(max_attack)
    )
    wide = counts.agg(target.alias("t"))
    return wide.select(
        F.explode(F.array(
            F.struct(F.lit("Benign").alias(label), F.lit(None).cast("long").alias("cap")),
            F.struct(F.lit("Attack").alias(label), F.col("t").cast("long").alias("cap")),
        )).alias("c")
    ).select("c.*")


def target_size_caps(counts: DataFrame, label: str, target_rows: int | None) -> DataFrame:
    """Caps for a wanted total: benign first, attack rows fill the rest."""
    benign = F.coalesce(F.max(F.when(F.col(label) == "Benign", F.col("rows"))), F.lit(0))
    target = F.lit(target_rows).cast("long")
    small = target <= benign
    attack_cap = F.when(target.isNull(), F.lit(None).cast("long")).when(small, F.lit(0).cast("long")).otherwise(target - benign)
    benign_cap = F.when(small, target)
    wide = counts.agg(attack_cap.alias("a"), benign_cap.alias("b"))
    return wide.select(
        F.explode(F.array(
            F.struct(F.lit("Benign").alias(label), F.col("b").alias("cap")),
            F.struct(F.lit("Attack").alias(label), F.col("a").alias("cap")),
        )).alias("c")
    ).select("c.*")


def capped_sample(
    df: DataFrame, label: str, caps: DataFrame, seed: int, keys: Sequence[str]
) -> DataFrame:
    """At most ``cap`` rows per class, exact, in a seeded random order of ``keys``."""
    return smallest_per_group(df, label, caps, seed, keys)


def training_sample(
    df: DataFrame, label: str, seed: int, keys: Sequence[str], ratio: int, max_attack: int
) -> DataFrame:
    caps = training_caps(class_counts(df, label), label, ratio, max_attack)
    return capped_sample(df, label, caps, seed, keys)


def row_subset(df: DataFrame, max_rows: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """Exactly min(max_rows, rows) rows in a seeded random order."""
    tagged = df.withColumn("__one", F.lit("all"))
    caps = df.sparkSession.range(1).select(F.lit("all").alias("__one"), F.lit(max_rows).alias("cap"))
    return smallest_per_group(tagged, "__one", caps, seed, keys).drop("__one")


def shuffled(df: DataFrame, seed: int, keys: Sequence[str]) -> DataFrame:
    """Global seeded order; only for writing a training file in random order."""
    return df.orderBy(seeded_order(seed, *[F.col(k) for k in keys]))


def keep_probabilities(counts: DataFrame, label: str, caps: DataFrame) -> DataFrame:
    """Class totals, sampled rows and keep probability for a cap table."""
    joined = counts.join(caps, label, "left")
    cap = F.col("cap")
    return joined.select(
        label,
        F.col("rows").alias("total_rows"),
        F.coalesce(F.least(F.col("rows"), cap), F.col("rows")).alias("sampled_rows"),
        F.coalesce(
            F.least(F.lit(1.0), cap / F.greatest(F.lit(1), F.col("rows"))), F.lit(1.0)
        ).alias("keep_probability"),
    )


def class_preserving_sample(
    df: DataFrame, label: str, max_rows: int, seed: int, keys: Sequence[str]
) -> DataFrame:
    """At most ``max_rows`` rows with one row of every class guaranteed.

    The first row of each class by ``keys`` is mandatory; the rest is filled in
    seeded order. With more classes than rows, the lowest labels win.
    """
    order = F.struct(*[F.col(k) for k in keys])
    firsts = lookup(df.groupBy(label).agg(F.min(order).alias("__first")))
    # One row per class: bounded by the label space, not by the data.
    marked = df.join(firsts, label).withColumn("__mandatory", F.col("__first") == order)
    mandatory = marked.filter("__mandatory")
    rest = marked.filter(~F.col("__mandatory"))
    classes = firsts.agg(F.count(F.lit(1)).alias("n"))
    caps = classes.select(
        F.lit("rest").alias("__tier"),
        F.greatest(F.lit(max_rows) - F.col("n"), F.lit(0)).alias("cap"),
    )
    filled = smallest_per_group(
        rest.withColumn("__tier", F.lit("rest")), "__tier", caps, seed, keys
    ).drop("__tier")
    leading = mandatory.orderBy(label).limit(max_rows)
    return leading.unionByName(filled).drop("__first", "__mandatory")


def class_weights(counts: DataFrame, label: str, exponent: float = 0.5) -> DataFrame:
    """(largest class / class) ^ exponent."""
    # One row per class, so a single window over the counts is small.
    largest = F.greatest(F.lit(1), F.max("rows").over(Window.partitionBy(F.lit(1))))
    return counts.select(
        label,
        "rows",
        F.pow(largest / F.greatest(F.lit(1), F.col("rows")), F.lit(float(exponent))).alias("weight"),
    )


def balanced_weights(
    counts: DataFrame, label: str, attack_multiplier: float = 1.0
) -> DataFrame:
    """total / (2 x class rows), attack rows scaled by a multiplier."""
    total = F.sum("rows").over(Window.partitionBy(F.lit(1)))
    factor = F.when(F.col(label) == "Attack", F.lit(float(attack_multiplier))).otherwise(F.lit(1.0))
    return counts.select(
        label,
        "rows",
        (total / (F.lit(2.0) * F.greatest(F.lit(1), F.col("rows"))) * factor).alias("weight"),
    )


def with_weights(df: DataFrame, label: str, weights: DataFrame, out: str = "weight") -> DataFrame:
    return df.join(lookup(weights.select(label, F.col("weight").alias(out))), label)
