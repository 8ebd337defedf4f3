"""Ordering work that must not funnel a group through one task.

A plain window sorts a whole group in one task, so one hot group stops a job.
These helpers split a group into buckets that follow the order, total the
buckets (a small table) and finish inside each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.numeric import seeded_bucket, seeded_order
from flowlens.operators.staging import lookup

_EVERYTHING = "__all__"
PERCENTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


def _grouped(df: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if groups:
        return df, list(groups)
    return df.withColumn(_EVERYTHING, F.lit(1)), [_EVERYTHING]


def _keyed(df: DataFrame, keys: Sequence[str], bucket: str = "__bucket") -> DataFrame:
    """Add ``__g`` (group) and ``__gb`` (group and bucket) as struct keys.

    Structs with equal null fields are equal, so plain equality on them is null
    safe, and one hash partitioning serves the window, the totals and the join.
    """
    return df.withColumns({"__g": F.struct(*keys), "__gb": F.struct(*keys, bucket)})


def quantile_bounds(df: DataFrame, value: str, buckets: int) -> list[float]:
    """At most ``buckets`` increasing cut points that split ``value`` evenly."""
    shares = [i / buckets for i in range(1, buckets)]
    row = df.select(
        F.percentile_approx(F.col(value).cast("double"), shares, F.lit(10 * buckets)).alias("b")
    ).first()
    return sorted({b for b in (row["b"] or []) if b == b})


def with_value_bucket(df: DataFrame, value: str, bounds: Sequence[float], out: str) -> DataFrame:
    """Index of the interval of ``bounds`` that holds ``value`` (non-null, not NaN)."""
    if not bounds:
        return df.withColumn(out, F.lit(0))
    cuts = [float("-inf"), *bounds, float("inf")]
    widened = df.withColumn("__value", F.col(value).cast("double"))
    bucketed = Bucketizer(splits=cuts, inputCol="__value", outputCol=out).transform(widened)
    return bucketed.withColumn(out, F.col(out).cast("int")).drop("__value")


def running_totals(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    measures: dict[str, Column],
    descending: bool = False,
    buckets: int = 256,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """One row per (group, distinct value) with measures and their running sums.

    ``before_<m>`` is the sum over strictly earlier values. Rows of equal value
    are merged before any shuffle of detail, then values are cut into quantile
    buckets: each bucket is summed on its own and shifted by the total of the
    buckets before it.
    """
    source, keys = _grouped(df, groups)
    if bounds is None:
        bounds = quantile_bounds(source, value, buckets)
    counted = source.groupBy(*keys, value).agg(*[c.alias(m) for m, c in measures.items()])
    counted = _keyed(with_value_bucket(counted, value, bounds, "__bucket"), keys)
    names = list(measures)
    order = F.col("__gb.__bucket").desc() if descending else F.col("__gb.__bucket")
    totals = counted.groupBy("__g", "__gb").agg(*[F.sum(m).alias(f"__t_{m}") for m in names])
    earlier = Window.partitionBy("__g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__gb",
        *[F.coalesce(F.sum(f"__t_{m}").over(earlier), F.lit(0)).alias(f"__o_{m}") for m in names],
    )
    inner_order = F.col(value).desc() if descending else F.col(value)
    inside = (
        Window.partitionBy("__gb").orderBy(inner_order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    partial = counted.withColumns(
        {f"__i_{m}": F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in names}
    )
    joined = partial.join(offsets, "__gb")
    result = joined.withColumns(
        {f"before_{m}": F.col(f"__i_{m}") + F.col(f"__o_{m}") for m in names}
    )
    return result.select(*groups, value, *names, *[f"before_{m}" for m in names])


def number_rows(
    df: DataFrame,
    groups: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    out: str,
    sizes_from: DataFrame | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Zero-based row number per group; ``bucket`` must follow the row order.

    ``sizes_from`` may give the same rows in a cheaper form for counting buckets, and
    ``partitions`` the number of tasks where rows are too wide for Spark's own choice.
    """
    source, keys = _grouped(df, groups)
    bucketed = _keyed(source.withColumn("__bucket", bucket), keys)
    counted = bucketed
    if sizes_from is not None:
        counted = _keyed(_grouped(sizes_from, groups)[0].withColumn("__bucket", bucket), keys)
    sizes = counted.groupBy("__g", "__gb").agg(F.count(F.lit(1)).alias("__n"))
    earlier = (
        Window.partitionBy("__g").orderBy("__gb.__bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select("__gb", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__gb").orderBy(*order)
    placed = bucketed if partitions is None else bucketed.repartition(partitions, "__gb")
    numbered = placed.withColumn("__rn", F.row_number().over(inside))
    joined = numbered.join(offsets, "__gb")
    return joined.withColumn(out, F.col("__before") + F.col("__rn") - 1).drop(
        "__bucket", "__g", "__gb", "__before", "__rn", _EVERYTHING
    )


def previous_value(
    df: DataFrame,
    groups: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    value: str,
    out: str,
) -> DataFrame:
    """``lag(value)`` per group; ``bucket`` must follow the row order.

    The first row of a bucket takes the last value of the nearest earlier
    bucket, so no task ever holds more than one bucket of a group.
    """
    bucketed = _keyed(df.withColumn("__bucket", bucket), groups)
    inside = Window.partitionBy("__gb").orderBy(*order)
    tail = bucketed.groupBy("__g", "__gb").agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__last")
    )
    across = Window.partitionBy("__g").orderBy("__gb.__bucket")
    carried = tail.select("__gb", F.lag("__last").over(across).alias("__carry"))
    lagged = bucketed.withColumns({
        "__lag": F.lag(value).over(inside),
        "__rn": F.row_number().over(inside),
    })
    joined = lagged.join(carried, "__gb")
    return joined.withColumn(
        out, F.when(F.col("__rn") == 1, F.col("__carry.v")).otherwise(F.col("__lag"))
    ).drop("__bucket", "__g", "__gb", "__lag", "__rn", "__carry")


def smallest_per_group(
    df: DataFrame,
    group: str,
    caps: DataFrame,
    seed: int,
    keys: Sequence[str],
    hex_digits: int = 4,
) -> DataFrame:
    """Exactly ``cap`` rows per group, chosen by a seeded order of ``keys``.

    ``caps`` is (group, cap); a null cap keeps the whole group and an absent
    group is dropped. Only rows in the one bucket where the cap is reached are
    ranked; lower buckets are kept without being shuffled.
    """
    ordered = df.withColumn("__order", seeded_order(seed, *[F.col(k) for k in keys]))
    ordered = ordered.withColumn("__bucket", seeded_bucket(F.col("__order"), hex_digits))
    sizes = ordered.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    upto = (
        Window.partitionBy(group).orderBy("__bucket")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    cut = (
        sizes.withColumn("__upto", F.sum("__n").over(upto))
        .join(caps.select(group, F.col("cap").cast("long").alias("__cap")), group)
        .groupBy(group)
        .agg(
            F.max("__cap").alias("__cap"),
            F.min(F.when(F.col("__upto") > F.col("__cap"), F.col("__bucket"))).alias("__cut"),
            F.max(F.when(F.col("__upto") <= F.col("__cap"), F.col("__upto"))).alias("__below"),
        )
        .withColumn("__room", F.col("__cap") - F.coalesce(F.col("__below"), F.lit(0)))
    )
    placed = ordered.join(lookup(cut), group)
    below = placed.filter(F.col("__cut").isNull() | (F.col("__bucket") < F.col("__cut")))
    edge_window = Window.partitionBy(group).orderBy("__order", *keys)
    edge = (
        placed.filter(F.col("__bucket") == F.col("__cut"))
        .withColumn("__rank", F.row_number().over(edge_window))
        .filter(F.col("__rank") <= F.col("__room"))
        .drop("__rank")
    )
    return below.unionByName(edge).drop("__order", "__bucket", "__cap", "__cut", "__below", "__room")


def exact_percentiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    percentiles: dict[str, float] | None = None,
    buckets: int = 256,
) -> DataFrame:
    """Linear-interpolation percentiles per group, exact at any size.

    Counts per quantile bucket locate the buckets that hold the wanted ranks;
    only the values inside those buckets are shuffled and ordered.
    """
    percentiles = percentiles or PERCENTILES
    source, keys = _grouped(df.filter(F.col(value).isNotNull()), groups)
    bounds = quantile_bounds(source, value, buckets)
    source = _keyed(with_value_bucket(source.select(*keys, value), value, bounds, "__bucket"), keys)
    sizes = source.groupBy("__g", "__gb").agg(F.count(F.lit(1)).alias("__n"))
    group_window = Window.partitionBy("__g")
    earlier = group_window.orderBy("__gb.__bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumns({
        "__start": F.coalesce(F.sum("__n").over(earlier), F.lit(0)),
        "__total": F.sum("__n").over(group_window),
    })
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(p).alias("p")) for name, p in percentiles.items()
    ]))
    targets = (
        placed.withColumn("__w", wanted)
        .withColumn("__pos", F.col("__w.p") * (F.col("__total") - 1))
        .withColumns({"__lo": F.floor("__pos"), "__hi": F.ceil("__pos")})
        .filter(
            (F.col("__hi") >= F.col("__start")) & (F.col("__lo") < F.col("__start") + F.col("__n"))
        )
        .select("__g", "__gb", "__start", F.col("__w.name").alias("__name"), "__pos", "__lo", "__hi")
    )
    needed = targets.select("__gb", "__start").distinct()
    counted = (
        source.select("__gb", value).join(needed, "__gb")
        .groupBy("__gb", "__start", value)
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    inside = (
        Window.partitionBy("__gb").orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = counted.withColumn(
        "__first", F.col("__start") + F.coalesce(F.sum("__c").over(inside), F.lit(0))
    )
    hits = ranked.drop("__start").join(targets.drop("__start"), "__gb")
    last = F.col("__first") + F.col("__c")
    holds_lo = (F.col("__first") <= F.col("__lo")) & (F.col("__lo") < last)
    holds_hi = (F.col("__first") <= F.col("__hi")) & (F.col("__hi") < last)
    number = F.col(value).cast("double")
    points = (
        hits.groupBy("__g", "__name", "__pos", "__lo")
        .agg(F.max(F.when(holds_lo, number)).alias("__a"), F.max(F.when(holds_hi, number)).alias("__b"))
        .withColumn(
            "__q", F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col("__pos") - F.col("__lo"))
        )
    )
    return (
        points.groupBy("__g")
        .agg(*[F.max(F.when(F.col("__name") == n, F.col("__q"))).alias(n) for n in percentiles])
        .select(*[F.col("__g").getField(k).alias(k) for k in groups], *percentiles)
    )


def numeric_profile(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Count, mean, population std, min, p10..p90 and max; zeros for no rows."""
    number = F.col(value).cast("double")
    source = df.filter(number.isNotNull())
    source, keys = _grouped(source, groups)
    basics = source.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(number).alias("mean"),
        F.stddev_pop(number).alias("std"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
    )
    marks = exact_percentiles(source, keys, value).select(F.struct(*keys).alias("__g"), *PERCENTILES)
    joined = basics.withColumn("__g", F.struct(*keys)).join(marks, "__g", "left")
    names = ["mean", "std", "min", *PERCENTILES, "max"]
    if groups:
        return joined.select(*groups, "count", *names)
    # A global profile has one row even for no input.
    return joined.agg(
        F.coalesce(F.max("count"), F.lit(0)).alias("count"),
        *[F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in names],
    )
