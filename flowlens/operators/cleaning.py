"""Numeric cleaning, column pruning and output checks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.numeric import LENIENT_NUMBER, WHITESPACE, finite_or_null, is_finite, lenient_parse
from flowlens.operators.staging import compute_once
from flowlens.schemas import LEAKAGE_COLUMNS


def quoted(name: str):
    """Column reference for names with spaces, dots or slashes."""
    return F.col(f"`{name}`")


def feature_columns_of(columns: Sequence[str], leakage: Sequence[str] = LEAKAGE_COLUMNS) -> list[str]:
    return [c for c in columns if c not in leakage]


def drop_leakage(df: DataFrame, leakage: Sequence[str] = LEAKAGE_COLUMNS) -> DataFrame:
    return df.drop(*leakage)


def coerce_numeric(df: DataFrame, features: Sequence[str], flag: str = "is_clean") -> DataFrame:
    """Features as finite doubles (else null) plus a flag that all are present."""
    texts = [c for c in features if isinstance(df.schema[c].dataType, T.StringType)]
    parsed = compute_once(df, {c: lenient_parse(quoted(c)) for c in texts}) if texts else df
    coerced = parsed.withColumns({c: finite_or_null(quoted(c).cast("double")) for c in features})
    complete = F.lit(True)
    for name in features:
        complete = complete & quoted(name).isNotNull()
    return coerced.withColumn(flag, complete)


def finite_cells(text: pa.Array) -> pa.Array:
    """The finite numbers among CSV cells, else null: ``lenient_number`` on a batch of one column."""
    bare = pc.utf8_trim(text, WHITESPACE)
    bare = pc.if_else(pc.match_substring_regex(bare, LENIENT_NUMBER), bare, pa.scalar(None, pa.string()))
    try:
        numbers = bare.cast(pa.float64())
    except pa.ArrowInvalid:  # a plus sign, or beyond the range of a double
        numbers = pa.array([None if v is None else float(v) for v in bare.to_pylist()], pa.float64())
    return pc.if_else(pc.is_finite(numbers), numbers, pa.scalar(None, pa.float64()))


def coerce_cells(df: DataFrame, features: Sequence[str], keys: Sequence[str], flag: str = "is_clean") -> DataFrame:
    """``coerce_numeric`` of very many text columns, with ``keys`` beside them, a batch of a column at a time.

    Generated code for some eighty parsed columns is too long to be compiled
    and would be interpreted for each cell.
    """
    wide = df.select(*[quoted(c) for c in [*features, *keys]])
    schema = T.StructType([
        *[T.StructField(c, T.DoubleType()) for c in features],
        *[T.StructField(f.name, f.dataType) for f in wide.schema.fields[len(features):]], T.StructField(flag, T.BooleanType()),
    ])

    def coerce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [finite_cells(batch.column(i)) for i in range(len(features))]
            complete = np.ones(batch.num_rows, bool)
            for column in cells:
                complete &= column.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*cells, *batch.columns[len(features):], pa.array(complete)], names=schema.fieldNames()
            )

    return wide.mapInArrow(coerce, schema)


def sanitize_numeric(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Only rows whose features are all finite numbers."""
    return coerce_numeric(df, features, "__clean").filter("__clean").drop("__clean")


def cleaning_manifest(df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Raw, clean and dropped row counts per source, in one pass."""
    flagged = coerce_numeric(df, features, "__clean")
    return flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if("__clean").alias("clean_rows_pre_dedupe"),
        F.count_if(~F.col("__clean")).alias("dropped_rows_nan_inf"),
    )


def zero_variance_columns(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features whose minimum equals their maximum; one pass, one row to the driver."""
    aggregates = []
    for i, name in enumerate(features):
        aggregates += [F.min(quoted(name)).alias(f"lo{i}"), F.max(quoted(name)).alias(f"hi{i}")]
    row = df.agg(*aggregates).first()
    return [name for i, name in enumerate(features) if row[f"lo{i}"] is not None and row[f"lo{i}"] == row[f"hi{i}"]]


def variance_report(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per feature: min, max and whether it is constant."""
    aggregates = []
    for i, name in enumerate(features):
        value = quoted(name).cast("double")
        aggregates += [F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}")]
    wide = df.agg(*aggregates)
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("feature"), F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value"))
        for i, name in enumerate(features)
    ]))
    return wide.select(rows.alias("r")).select("r.*").withColumn(
        "is_constant", F.col("min_value") == F.col("max_value")
    )


def prune_zero_variance(df: DataFrame, features: Sequence[str], split: str | None = None, train: str = "train"):
    """Drop features that are constant on the training split; returns (df, kept, dropped)."""
    basis = df if split is None else df.filter(F.col(split) == train)
    dropped = zero_variance_columns(basis, features)
    kept = [c for c in features if c not in dropped]
    return df.drop(*dropped), kept, dropped


def ordered_output(df: DataFrame, features: Sequence[str], metadata: Sequence[str]) -> DataFrame:
    return df.select(*[quoted(c) for c in [*features, *metadata]])


def assert_no_forbidden(df: DataFrame, forbidden: Sequence[str] = LEAKAGE_COLUMNS) -> None:
    present = [c for c in forbidden if c in df.columns]
    if present:
        raise ValueError(f"forbidden columns in output: {present}")


def non_finite_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Violations per feature (null, NaN or infinite)."""
    wide = df.agg(*[
        F.count_if(~is_finite(quoted(name).cast("double"))).alias(f"v{i}") for i, name in enumerate(features)
    ])
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("feature"), F.col(f"v{i}").alias("violations"))
        for i, name in enumerate(features)
    ]))
    return wide.select(rows.alias("r")).select("r.*")


def assert_finite(df: DataFrame, features: Sequence[str]) -> None:
    bad = non_finite_counts(df, features).filter("violations > 0").orderBy("feature").collect()
    if bad:
        raise ValueError(f"non-finite values in: {[r['feature'] for r in bad]}")


def align_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Ordered single-precision features for scoring.

    A missing column fails at once. A null or non-numeric value fails the job
    while it runs, naming the column, so no extra pass over the data is needed.
    Infinities are accepted here.
    """
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError("missing required feature columns: " + ", ".join(missing))

    def aligned(name: str):
        value = quoted(name).try_cast("double")
        problem = F.concat(F.lit(f"non-numeric or missing value in column {name}"))
        checked = F.when(value.isNull() | F.isnan(value), F.raise_error(problem).cast("double")).otherwise(value)
        return checked.cast("float").alias(name)

    return df.select(*[aligned(c) for c in features])
