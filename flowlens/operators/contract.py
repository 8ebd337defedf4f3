"""Feature contract: alias renaming, validation and routing of JSON flow records.

Every record gets one ``reason``; null means valid. Checks are ordered and the
first that fails names the reason.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.numeric import finite_or_null, strict_parse, strip
from flowlens.functions.records import literal_array, picked, renamed_keys, repeated_values
from flowlens.operators.staging import compute_once
from flowlens.schemas import CONTRACT_ALIASES, FEATURE_COLUMNS

ALIAS_COLLISION = "alias_collision"
MISSING = "missing_required_features"
NON_NUMERIC = "non_numeric_required_features"

DETAIL_COLUMNS = ("alias_collisions", "missing_features", "non_numeric_features")
_NO_NAMES = "cast(array() as array<string>)"


@dataclass(frozen=True)
class FeatureContract:
    """Ordered required features and one-to-one alias names."""

    features: tuple[str, ...] = FEATURE_COLUMNS
    aliases: dict[str, str] = field(default_factory=lambda: dict(CONTRACT_ALIASES))

    def __post_init__(self) -> None:
        if not self.features:
            raise ValueError("a contract needs at least one feature")
        blank = [f for f in self.features if not str(f).strip()]
        if blank:
            raise ValueError("feature names must not be blank")
        for alias, target in self.aliases.items():
            if alias == target:
                raise ValueError(f"alias {alias!r} must not point to itself")
            if target not in self.features:
                raise ValueError(f"alias {alias!r} points to unknown feature {target!r}")


def passthrough(record: Column, contract: FeatureContract) -> Column:
    """Keys that are neither features nor aliases of features."""
    known = literal_array([*contract.features, *contract.aliases])
    return picked(record, F.array_except(F.map_keys(record), known))


def check_features(
    df: DataFrame, contract: FeatureContract, texts: dict[str, Column], missing: Column, early: Column
) -> DataFrame:
    """Shared tail of validation: numbers, missing and non-numeric features, reason.

    ``texts`` gives the text of every feature and ``early`` an earlier reason.
    Each step reads only columns of the step before.
    """
    none = F.expr(_NO_NAMES)
    numbers = [f"__n{i}" for i in range(len(contract.features))]
    staged = compute_once(df, {
        "__missing": missing, "__early": early, **{n: strip(texts[f]) for n, f in zip(numbers, contract.features)},
    })
    parsed = compute_once(staged, {n: strict_parse(F.col(n), stripped=True) for n in numbers})
    finite = parsed.withColumns({n: finite_or_null(F.col(n)) for n in numbers})
    bad = F.array_compact(F.array(*[
        F.when(F.col(n).isNull(), F.lit(f)) for n, f in zip(numbers, contract.features)
    ]))
    routed = compute_once(finite, {"__bad": F.when(F.col("__early").isNull() & (F.size("__missing") == 0), bad)})
    reason = F.coalesce(
        F.col("__early"), F.when(F.size("__missing") > 0, MISSING).when(F.size("__bad") > 0, NON_NUMERIC)
    )
    routed = compute_once(routed, {"reason": reason})
    features = F.struct(*[F.col(n).alias(f) for n, f in zip(numbers, contract.features)])
    return routed.withColumns({
        "missing_features": F.when(F.col("reason") == MISSING, F.col("__missing")).otherwise(none),
        "non_numeric_features": F.when(F.col("reason") == NON_NUMERIC, F.col("__bad")).otherwise(none),
        "features": F.when(F.col("reason").isNull(), features),
    }).drop("__missing", "__early", "__bad", *numbers)


def validate(
    df: DataFrame, contract: FeatureContract, record: str = "record", keep_reason: str | None = None
) -> DataFrame:
    """Add reason, detail arrays, ``passthrough`` and a ``features`` struct.

    ``keep_reason`` names a column with an earlier reason (a parse error, say)
    that takes precedence; such rows carry no features.
    """
    source = F.col(record)
    keyed = compute_once(df, {"__keys": renamed_keys(source, contract.aliases)})
    checked = compute_once(keyed, {
        "__collisions": F.coalesce(repeated_values(F.col("__keys")), F.expr(_NO_NAMES)),
        "passthrough": passthrough(source, contract),
    })
    clean = F.size("__collisions") == 0
    mapped = compute_once(checked, {
        "__canon": F.when(clean, F.map_from_arrays(F.col("__keys"), F.map_values(source)))
    })
    early = F.when(~clean, ALIAS_COLLISION)
    if keep_reason:
        early = F.coalesce(F.col(keep_reason), early)
    result = check_features(
        mapped, contract,
        {f: F.try_element_at("__canon", F.lit(f)) for f in contract.features},
        F.array_except(literal_array(contract.features), F.map_keys("__canon")),
        early,
    )
    return result.withColumn(
        "alias_collisions",
        F.when(F.col("reason") == ALIAS_COLLISION, F.col("__collisions")).otherwise(F.expr(_NO_NAMES)),
    ).drop("__keys", "__collisions", "__canon")


def valid_records(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reason").isNull())


def quarantined_records(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reason").isNotNull())


def reason_counts(validated: DataFrame) -> DataFrame:
    return validated.groupBy(F.coalesce("reason", F.lit("valid")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def quarantine_events(quarantined: DataFrame, index: str = "record_index", record: str = "record") -> DataFrame:
    """One JSON ``schema_anomaly`` event per quarantined record."""
    event = F.to_json(F.struct(
        F.lit("schema_anomaly").alias("event_type"),
        F.lit("schema_validation_failed").alias("anomaly_type"),
        F.col("reason"),
        F.col(index).alias("record_index"),
        *[F.col(c) for c in DETAIL_COLUMNS],
        F.col("passthrough"),
        F.col(record).alias("source_record"),
    ))
    return quarantined.select(event.alias("value"))
