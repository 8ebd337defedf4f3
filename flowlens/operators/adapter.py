"""Source-profile adapter: rename a closed set of source keys, quarantine the rest."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.numeric import strip
from flowlens.functions.records import literal_array, literal_map, repeated_values
from flowlens.operators.contract import FeatureContract, check_features
from flowlens.operators.staging import compute_once
from flowlens.schemas import (
    CONTRACT_ALIASES,
    CONTROLLED_EXTRAS,
    FEATURE_COLUMNS,
    PRIMARY_METADATA,
    PRIMARY_PROFILE_ID,
    SECONDARY_ALIASES,
    SECONDARY_METADATA,
    SECONDARY_PROFILE_ID,
)

BLANK_KEYS = "blank_source_keys"
KEY_COLLISION = "normalized_key_collision"
UNMAPPED = "unmapped_source_fields"
_NO_NAMES = "cast(array() as array<string>)"
_NO_PAIRS = "cast(map() as map<string,string>)"


@dataclass(frozen=True)
class AdapterProfile:
    """Accepted source keys: features and metadata with their targets, and extras."""

    profile_id: str
    feature_map: dict[str, str]
    metadata_map: dict[str, str] = field(default_factory=dict)
    extras: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.profile_id.strip():
            raise ValueError("profile_id must not be blank")
        for name, mapping in (("feature", self.feature_map), ("metadata", self.metadata_map)):
            if len(set(mapping.values())) != len(mapping):
                raise ValueError(f"{self.profile_id}: {name} targets must be one-to-one")
        if len(set(self.extras)) != len(self.extras):
            raise ValueError(f"{self.profile_id}: extras must not repeat")
        sources = [*self.feature_map, *self.metadata_map, *self.extras]
        if any(not key.strip() for key in sources):
            raise ValueError(f"{self.profile_id}: blank source key")
        if len(set(sources)) != len(sources):
            raise ValueError(f"{self.profile_id}: sections share source keys")
        targets = [*self.feature_map.values(), *self.metadata_map.values(), *self.extras]
        if len(set(targets)) != len(targets):
            raise ValueError(f"{self.profile_id}: sections share target names")

    def accepted_keys(self) -> tuple[str, ...]:
        return (*self.feature_map, *self.metadata_map, *self.extras)

    def check_against(self, contract: FeatureContract) -> None:
        """Feature targets must be exactly the contract's features."""
        missing = [f for f in contract.features if f not in self.feature_map.values()]
        extra = [t for t in self.feature_map.values() if t not in contract.features]
        if missing or extra:
            raise ValueError(
                f"{self.profile_id}: profile does not match contract (missing {missing}, extra {extra})"
            )


def _closed_map(aliases: dict[str, str]) -> dict[str, str]:
    renamed = set(aliases.values())
    return {**aliases, **{f: f for f in FEATURE_COLUMNS if f not in renamed}}


PRIMARY_PROFILE = AdapterProfile(
    PRIMARY_PROFILE_ID, _closed_map(CONTRACT_ALIASES), PRIMARY_METADATA, CONTROLLED_EXTRAS
)
SECONDARY_PROFILE = AdapterProfile(
    SECONDARY_PROFILE_ID, _closed_map(SECONDARY_ALIASES), SECONDARY_METADATA, CONTROLLED_EXTRAS
)
PROFILES = {p.profile_id: p for p in (PRIMARY_PROFILE, SECONDARY_PROFILE)}


def require_profile(profile_id: str, profiles: dict[str, AdapterProfile] | None = None) -> AdapterProfile:
    known = PROFILES if profiles is None else profiles
    if profile_id not in known:
        raise KeyError(f"unknown adapter profile {profile_id!r}; known: {sorted(known)}")
    return known[profile_id]


def _section(record: Column, keys: Column, mapping: dict[str, str]) -> Column:
    """Present entries of a section under their target names."""
    names = literal_map(mapping)
    present = F.array_intersect(literal_array(mapping), keys)
    return F.map_from_arrays(
        F.transform(present, lambda k: F.element_at(names, k)),
        F.transform(present, lambda k: F.element_at(record, k)),
    )


def adapt(
    df: DataFrame,
    profile: AdapterProfile,
    contract: FeatureContract | None = None,
    record: str = "record",
    keep_reason: str | None = None,
) -> DataFrame:
    """Adapt raw source records; adds reason, details, features, metadata and extras.

    A profile is one-to-one with disjoint targets, so distinct source keys can
    never meet in one target and ``alias_collisions`` stays empty.
    """
    contract = contract or FeatureContract()
    profile.check_against(contract)
    raw = F.col(record)
    raw_keys = F.map_keys(raw)
    none, pairs = F.expr(_NO_NAMES), F.expr(_NO_PAIRS)
    source_of = {target: source for source, target in profile.feature_map.items()}
    ordered = [source_of[f] for f in contract.features]
    keys = F.col("__keys")
    staged = compute_once(df, {"__keys": F.transform(raw_keys, lambda k: strip(k))})
    blank = F.array_distinct(F.sort_array(F.filter(raw_keys, lambda k: strip(k) == "")))
    staged = compute_once(staged, {
        "__blank": F.when(F.array_contains(keys, ""), blank).otherwise(none),
        "__collide": repeated_values(keys),
        "__unmapped": F.array_except(keys, literal_array(profile.accepted_keys())),
    })
    usable = (F.size("__blank") == 0) & (F.size("__collide") == 0)
    staged = compute_once(staged, {"__record": F.when(usable, F.map_from_arrays(keys, F.map_values(raw)))})
    early = (
        F.when(F.size("__blank") > 0, BLANK_KEYS)
        .when(F.size("__collide") > 0, KEY_COLLISION)
        .when(F.size("__unmapped") > 0, UNMAPPED)
    )
    if keep_reason:
        early = F.coalesce(F.col(keep_reason), early)
    absent = F.array_except(literal_array(ordered), F.map_keys("__record"))
    to_target = literal_map(profile.feature_map)
    checked = check_features(
        staged, contract,
        {f: F.try_element_at("__record", F.lit(s)) for f, s in zip(contract.features, ordered)},
        F.transform(absent, lambda k: F.element_at(to_target, k)),
        early,
    )
    trimmed = F.col("__record")
    return checked.withColumns({
        "profile": F.lit(profile.profile_id),
        "blank_source_keys": F.when(F.col("reason") == BLANK_KEYS, F.col("__blank")).otherwise(none),
        "normalized_key_collisions": F.when(F.col("reason") == KEY_COLLISION, F.col("__collide")).otherwise(none),
        "alias_collisions": none,
        "unmapped_fields": F.when(F.col("reason") == UNMAPPED, F.sort_array("__unmapped")).otherwise(none),
        "metadata": F.when(trimmed.isNotNull(), _section(trimmed, keys, profile.metadata_map)).otherwise(pairs),
        "controlled_extras": F.when(trimmed.isNotNull(), _section(trimmed, keys, {k: k for k in profile.extras})).otherwise(pairs),
    }).drop("__keys", "__blank", "__collide", "__unmapped", "__record")


def adapted_rows(adapted: DataFrame, profile: AdapterProfile, contract: FeatureContract | None = None) -> DataFrame:
    """Flat accepted records: features, profile name, metadata and extras as columns."""
    contract = contract or FeatureContract()
    good = adapted.filter(F.col("reason").isNull())
    return good.select(
        *[F.col("features").getField(f).alias(f) for f in contract.features],
        F.col("profile").alias("adapter_profile"),
        *[F.try_element_at("metadata", F.lit(t)).alias(t) for t in profile.metadata_map.values()],
        *[F.try_element_at("controlled_extras", F.lit(e)).alias(e) for e in profile.extras],
    )


def redacted_record(record: Column, raw_line: Column | None = None) -> dict[str, Column]:
    """Field count and raw length that replace a payload in a quarantine event."""
    length = F.try_element_at(record, F.lit("raw_char_count")).try_cast("long")
    raw_record = F.length(F.try_element_at(record, F.lit("raw_record"))).cast("long")
    line = F.length(F.try_element_at(record, F.lit("raw_line"))).cast("long")
    known = F.coalesce(raw_record, length, line)
    if raw_line is not None:
        known = F.coalesce(known, F.length(raw_line).cast("long"))
    return {
        "redacted": F.lit(True),
        "field_count": F.coalesce(F.size(record), F.lit(0)),
        "raw_char_count": known,
    }


def adapter_quarantine_events(
    adapted: DataFrame,
    include_source: bool = False,
    record: str = "record",
    index: str = "record_index",
) -> DataFrame:
    """JSON quarantine events; payload, metadata and extras are redacted unless asked for."""
    bad = adapted.filter(F.col("reason").isNotNull())

    def hidden(values: Column) -> Column:
        return F.when(
            F.size(values) > 0,
            F.struct(F.lit(True).alias("redacted"), F.size(values).alias("field_count")),
        )

    common = [
        F.lit("adapter_quarantine").alias("event_type"),
        F.lit("adapter_schema_validation_failed").alias("anomaly_type"),
        F.col("profile"),
        F.col("reason"),
        F.col(index).alias("record_index"),
        F.col("missing_features").alias("missing_fields"),
        F.col("non_numeric_features").alias("non_numeric_fields"),
        F.col("alias_collisions"),
        F.col("unmapped_fields"),
        F.col("blank_source_keys"),
        F.col("normalized_key_collisions"),
    ]
    if include_source:
        body = [F.col(record).alias("source_record"), F.col("metadata"), F.col("controlled_extras")]
    else:
        summary = redacted_record(F.col(record))
        body = [
            F.struct(*[c.alias(n) for n, c in summary.items()]).alias("source_record"),
            hidden(F.col("metadata")).alias("metadata"),
            hidden(F.col("controlled_extras")).alias("controlled_extras"),
            F.lit(True).alias("source_record_redacted"),
            (F.size("metadata") > 0).alias("metadata_redacted"),
            (F.size("controlled_extras") > 0).alias("controlled_extras_redacted"),
        ]
    return bad.select(F.to_json(F.struct(*common, *body)).alias("value"))


def to_source_names(flows: DataFrame, profile: AdapterProfile) -> DataFrame:
    """Canonical columns renamed to the profile's source keys, in profile order."""
    inverse = {target: source for source, target in profile.feature_map.items()}
    inverse.update({t: s for s, t in profile.metadata_map.items()})
    renamed = flows.withColumnsRenamed({c: inverse[c] for c in flows.columns if c in inverse})
    present = [k for k in profile.accepted_keys() if k in renamed.columns]
    return renamed.select(*[F.col(f"`{k}`") for k in present])
