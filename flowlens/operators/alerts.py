"""Alert extraction, storage semantics, hydration, suppression and triage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.alerting import (
    clean_flow_parts,
    family_view,
    flow_id_parts,
    flow_text,
    severity_from_score,
    shaped_flow_id,
    text_or_null,
)
from flowlens.functions.numeric import finite_or_null, lenient_int, strict_parse, strip
from flowlens.functions.records import json_text
from flowlens.operators.ordering import previous_value
from flowlens.operators.staging import compute_once
from flowlens.schemas import DEFAULT_SENSOR_ID, TRIAGE_STATES

MUTABLE = (
    "event_ts", "severity", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "fingerprint",
    "payload_json", "updated_at",
)
CLOSED_STATES = ("resolved", "false_positive")


# ---- field extraction ------------------------------------------------------

_STRICT = {"allowSingleQuotes": "false"}


class _Payload:
    """Fields of a payload that was parsed once, into columns of :func:`_parsed`."""

    def field(self, key: str) -> Column:
        return F.try_element_at("__p", F.lit(key))

    def first(self, *keys: str) -> Column:
        """First non-null of the keys in the payload, then in its ``passthrough``."""
        return F.coalesce(*[self.field(k) for k in keys], *[F.try_element_at("__pp", F.lit(k)) for k in keys])

    def text(self, *keys: str) -> Column:
        return text_or_null(self.first(*keys))

    def integer(self, *keys: str) -> Column:
        return lenient_int(self.first(*keys))

    def event_ts(self, now: Column) -> Column:
        """First non-blank of the time keys, unchanged, else the ingest time."""
        times = [self.field(k) for k in ("timestamp", "event_ts", "time", "ts")]
        return F.coalesce(*[F.when(strip(t) != "", t) for t in times], now)

    def source_event_id(self) -> Column:
        return F.coalesce(*[text_or_null(self.field(k)) for k in ("source_event_id", "event_id", "id")])


def _parsed(payloads: DataFrame, payload: str) -> DataFrame:
    """``payloads`` with the map of the payload and that of its ``passthrough``, if it is an object.

    Keys may differ only in case, hence maps; each is parsed once a row.
    """
    return compute_once(payloads, {
        "__p": F.from_json(payload, "map<string,string>", _STRICT),
        "__pp": F.from_json(payload, "passthrough map<string,string>", _STRICT)["passthrough"],
    })


def alert_rows(payloads: DataFrame, now: Column, payload: str = "payload_json",
               sensor_id: str = DEFAULT_SENSOR_ID) -> DataFrame:
    """Alert table columns from JSON payloads; other columns are kept."""
    p = _Payload()
    return compute_once(_parsed(payloads, payload), {
        "sensor_id": F.lit(sensor_id),
        "source_event_id": p.source_event_id(),
        "event_ts": p.event_ts(now),
        "severity": p.text("severity"),
        "src_ip": p.text("src_ip", "source_ip", "Src IP"),
        "dst_ip": p.text("dst_ip", "destination_ip", "Dst IP"),
        "src_port": p.integer("src_port", "source_port", "Src Port"),
        "dst_port": p.integer("dst_port", "destination_port", "Dst Port"),
        "protocol": p.text("protocol", "Protocol"),
        "fingerprint": p.text("fingerprint"),
        "triage_status": F.lit("new"),
        "triage_updated_at": now,
        "created_at": now,
        "updated_at": now,
    }).drop("__p", "__pp")


def anomaly_rows(payloads: DataFrame, now: Column, payload: str = "payload_json",
                 sensor_id: str = DEFAULT_SENSOR_ID) -> DataFrame:
    p = _Payload()
    return _parsed(payloads, payload).select(
        F.lit(sensor_id).alias("sensor_id"),
        p.source_event_id().alias("source_event_id"),
        p.event_ts(now).alias("event_ts"),
        F.coalesce(p.text("anomaly_type", "event_type"), F.lit("schema_anomaly")).alias("anomaly_type"),
        p.text("reason").alias("reason"),
        p.text("redacted_summary", "reason").alias("redacted_summary"),
        F.col(payload).alias("payload_json"),
    )


def summary_rows(payloads: DataFrame, now: Column, payload: str = "payload_json",
                 sensor_id: str = DEFAULT_SENSOR_ID) -> DataFrame:
    return _parsed(payloads, payload).select(
        F.lit(sensor_id).alias("sensor_id"), _Payload().event_ts(now).alias("summary_ts"), F.col(payload).alias("payload_json")
    )


# ---- upserts ---------------------------------------------------------------

def upsert(
    stored: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    sequence: str,
    kept_from_first: Sequence[str],
) -> DataFrame:
    """Merge rows on ``keys``: newest ``sequence`` wins, some columns keep their first value.

    Stored rows come before incoming ones. Rows with a null key never match, so
    they pass through. Copies are merged by partial aggregation, which keeps a
    hot key from growing into one task.
    """
    columns = stored.columns
    both = stored.withColumn("__gen", F.lit(0)).unionByName(incoming.withColumn("__gen", F.lit(1)))
    keyed = F.lit(True)
    for key in keys:
        keyed = keyed & F.col(key).isNotNull()
    loose = both.filter(~keyed).select(*columns)
    order = F.struct("__gen", sequence)
    first_cols = [c for c in kept_from_first if c not in keys]
    last_cols = [c for c in columns if c not in keys and c not in first_cols]
    merged = both.filter(keyed).groupBy(*keys).agg(
        F.min_by(F.struct(*first_cols), order).alias("__first"),
        F.max_by(F.struct(*last_cols), order).alias("__last"),
    )
    flat = merged.select(*[
        F.col(c) if c in keys else F.col("__first" if c in first_cols else "__last").getField(c).alias(c)
        for c in columns
    ])
    return flat.unionByName(loose)


def upsert_alerts(stored: DataFrame, incoming: DataFrame, sequence: str = "id") -> DataFrame:
    """Alert upsert on (sensor, source id); id, triage state and creation time stay."""
    kept = [c for c in stored.columns if c not in MUTABLE and c not in ("sensor_id", "source_event_id")]
    extra = [] if sequence in stored.columns else [sequence]
    if extra:
        raise ValueError(f"sequence column {sequence} missing")
    if sequence in kept:
        tagged_stored = stored.withColumn("__seq", F.col(sequence))
        tagged_incoming = incoming.withColumn("__seq", F.col(sequence))
        return upsert(tagged_stored, tagged_incoming, ("sensor_id", "source_event_id"), "__seq", kept).drop("__seq")
    return upsert(stored, incoming, ("sensor_id", "source_event_id"), sequence, kept)


def upsert_summaries(stored: DataFrame, incoming: DataFrame, sequence: str = "updated_at") -> DataFrame:
    kept = [c for c in stored.columns if c in ("id", "created_at")]
    return upsert(stored, incoming, ("sensor_id", "summary_ts"), sequence, kept)


def upsert_dimension(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Dimension merge: a non-null incoming value replaces the stored one."""
    values = [c for c in stored.columns if c != key]
    renamed = incoming.select(key, *[F.col(c).alias(f"__new_{c}") for c in values])
    return stored.join(renamed, key, "full").select(
        key, *[F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) for c in values]
    )


# ---- hydration -------------------------------------------------------------

def _nonzero(port: Column) -> Column:
    return F.when(port != 0, port)


_PAYLOAD_KEYS = (
    "src_ip", "source_ip", "Src IP", "dst_ip", "destination_ip", "Dst IP",
    "src_port", "source_port", "Src Port", "dst_port", "destination_port", "Dst Port",
    "protocol", "Protocol", "attack_score", "score", "predicted_label", "fingerprint",
    "family_status", "attack_family", "attack_family_confidence", "attack_family_margin",
    "source_flow_id", "flow_id",
)
_PORT_KEYS = tuple(k for k in _PAYLOAD_KEYS if k.lower().endswith("port"))
_NUMBER_KEYS = ("attack_score", "score", "attack_family_confidence", "attack_family_margin")


def hydrate(alerts: DataFrame, payload: str = "payload_json") -> DataFrame:
    """Fill address, score, severity and family fields from the payload.

    Columns win over payload keys, which win over the parsed flow id; a port of
    0 counts as missing unless the flow id has nothing else.

    The payload is parsed once, and each round of text work reads the columns of
    the round before, so nothing is evaluated twice. Some keys differ only in
    case ("protocol", "Protocol"), hence a map with case-sensitive lookups.
    """
    strict = {"allowSingleQuotes": "false"}
    slot = {k: f"__k{i}" for i, k in enumerate(_PAYLOAD_KEYS)}
    parsed = compute_once(alerts, {"__p": F.from_json(payload, "map<string,string>", strict)})
    # A step that parses JSON runs interpreted, so the many lookups have a step of their own.
    nested = compute_once(parsed, {"__pp": F.from_json(F.try_element_at("__p", F.lit("passthrough")), "map<string,string>", strict)})
    fields = compute_once(nested, {slot[k]: F.try_element_at("__p", F.lit(k)) for k in _PAYLOAD_KEYS})
    plain = [k for k in _PAYLOAD_KEYS if k not in _PORT_KEYS and k not in _NUMBER_KEYS]
    typed = compute_once(fields, {
        **{slot[k]: text_or_null(F.col(slot[k])) for k in plain},
        **{slot[k]: lenient_int(F.col(slot[k])) for k in _PORT_KEYS},
        "__zero": F.col(slot["attack_score"]).isin("0", "0.0", "", "false"),
        **{slot[k]: strict_parse(F.col(slot[k])) for k in _NUMBER_KEYS},
        "__flow_id": text_or_null(F.try_element_at("__pp", F.lit("source_flow_id"))),
        "__transport": text_or_null(F.try_element_at("__pp", F.lit("transport_family"))),
    })
    flow = {f"__f_{n}": c for n, c in flow_id_parts(F.col("__flow_id")).items()}
    shaped = compute_once(typed, {
        "__flow_id": shaped_flow_id(F.coalesce("__flow_id", slot["source_flow_id"], slot["flow_id"]))
    })
    split = compute_once(shaped, flow)
    parts = clean_flow_parts({n.removeprefix("__f_"): F.col(n) for n in flow})

    def texts(column: str, *keys: str) -> list[Column]:
        return [text_or_null(F.col(column)), *[F.col(slot[k]) for k in keys]]

    def ports(column: str, *keys: str) -> list[Column]:
        return [_nonzero(F.col(column)), *[_nonzero(F.col(slot[k])) for k in keys]]

    # An attack score of zero gives way to the plain score, if there is one.
    score = finite_or_null(F.coalesce(
        F.when(~F.col("__zero"), F.col(slot["attack_score"])), F.col(slot["score"]), F.col(slot["attack_score"])
    ))
    filled = compute_once(split, {
        "src_ip": F.coalesce(*texts("src_ip", "src_ip", "source_ip", "Src IP"), parts["src_ip"]),
        "dst_ip": F.coalesce(*texts("dst_ip", "dst_ip", "destination_ip", "Dst IP"), parts["dst_ip"]),
        "src_port": F.coalesce(*ports("src_port", "src_port", "source_port", "Src Port"), parts["src_port"]),
        "dst_port": F.coalesce(*ports("dst_port", "dst_port", "destination_port", "Dst Port"), parts["dst_port"]),
        "protocol": F.coalesce(*texts("protocol", "protocol", "Protocol"), F.col("__transport")),
        "attack_score": score,
        "predicted_label": F.col(slot["predicted_label"]),
        "fingerprint": F.coalesce(*texts("fingerprint", "fingerprint"), F.col("__flow_id")),
        "source_flow_id": F.col("__flow_id"),
        "flow_sequence": parts["flow_sequence"],
    })
    family = family_view(
        F.col(slot["family_status"]),
        F.col(slot["attack_family"]),
        finite_or_null(F.col(slot["attack_family_confidence"])),
        finite_or_null(F.col(slot["attack_family_margin"])),
    )
    return compute_once(filled, {
        "severity": F.coalesce(
            text_or_null(F.col("severity")), severity_from_score(F.col("attack_score")), F.lit("unknown")
        ),
        "flow_summary": flow_text(*[F.col(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port", "protocol")]),
        **family,
    }).drop("__p", "__pp", "__zero", "__flow_id", "__transport", *slot.values(), *flow)


# ---- suppression -----------------------------------------------------------

def create_rule(rules: DataFrame, rule: DataFrame) -> DataFrame:
    return rules.unionByName(rule)


def deactivate_rule(rules: DataFrame, rule_id: int, now: str) -> DataFrame:
    hit = F.col("id") == rule_id
    return rules.withColumns({
        "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at")),
        "is_active": F.when(hit, F.lit(False)).otherwise(F.col("is_active")),
    })


def active_rules(
    rules: DataFrame, applies_to: str = "model_alert", sensor_id: str = DEFAULT_SENSOR_ID
) -> DataFrame:
    """Active rules of one sensor and scope, newest first."""
    return rules.filter(
        F.col("is_active") & (F.col("applies_to") == applies_to) & (F.col("sensor_id") == sensor_id)
    ).orderBy(F.col("created_at").desc(), F.col("id").desc())


MAX_RULE_VALUES = 10_000


def flag_suppressed(
    alerts: DataFrame, rules: DataFrame, payload: str = "payload_json", max_values: int = MAX_RULE_VALUES
) -> DataFrame:
    """Add ``suppressed``: some active rule's field equals its value.

    A rule names its field; the column is compared when it exists and is not
    null, else the payload key. Rules are a hand-kept list: up to ``max_values``
    of them become one hash set per field inside the alert scan, so alerts are
    not shuffled at all. Longer lists are joined, one field after another; rows
    without the field are spread out, and Spark splits values many alerts share.
    """
    pairs = rules.select(
        strip(F.col("match_field")).alias("match_field"), strip(F.col("match_value")).alias("match_value")
    ).filter((F.col("match_field") != "") & (F.col("match_value") != "")).distinct()
    def value_of(name: str) -> Column:
        own = F.col(f"`{name}`").cast("string") if name in alerts.columns else F.lit(None).cast("string")
        return F.coalesce(own, json_text(F.col(payload), name))

    known = pairs.limit(max_values + 1).collect()
    if len(known) <= max_values:
        by_field: dict[str, list[str]] = {}
        for name, value in known:
            by_field.setdefault(name, []).append(value)
        hit = F.lit(False)
        for name in sorted(by_field):
            hit = hit | F.coalesce(value_of(name).isin(sorted(by_field[name])), F.lit(False))
        return alerts.withColumn("suppressed", hit)
    flagged = alerts.withColumn("suppressed", F.lit(False))
    for name in sorted(r[0] for r in pairs.select("match_field").distinct().collect()):
        values = pairs.filter(F.col("match_field") == name).select(
            F.col("match_value").alias("__v"), F.lit(True).alias("__hit")
        )
        # Rows without the field get keys that no rule has and that spread them out.
        spare = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(payload), F.lit(1009)).cast("string"))
        flagged = (
            flagged.withColumn("__c", F.coalesce(value_of(name), spare))
            .join(values, F.col("__c") == F.col("__v"), "left")
            .withColumn("suppressed", F.col("suppressed") | F.coalesce(F.col("__hit"), F.lit(False)))
            .drop("__c", "__v", "__hit")
        )
    return flagged


def visible_alerts(flagged: DataFrame) -> DataFrame:
    return flagged.filter(~F.col("suppressed"))


# ---- triage ----------------------------------------------------------------

def normalized_status(status: Column) -> Column:
    """Lower-case trimmed state; any other value fails the job."""
    name = F.lower(strip(status))
    return F.when(name.isin(*TRIAGE_STATES), name).otherwise(
        F.raise_error(F.concat(F.lit("invalid triage status: "), F.coalesce(status, F.lit("null")))).cast("string")
    )


def recent(df: DataFrame, limit: int, ts: str = "event_ts") -> DataFrame:
    """Newest rows by (time, id); a top-k, not a full sort."""
    if limit < 1:
        raise ValueError("limit must be >= 1")
    return df.orderBy(F.col(ts).desc(), F.col("id").desc()).limit(limit)


def triage_alerts(
    alerts: DataFrame,
    rules: DataFrame,
    limit: int | None = 100,
    triage_status: str | None = None,
    include_suppressed: bool = False,
    sensor_id: str | None = None,
    exact: bool = False,
) -> DataFrame:
    """Recent alerts, hydrated and without suppressed ones.

    The row limit applies before suppression and the sensor filter, as analysts
    are used to; ``exact`` applies it afterwards. ``limit=None`` keeps all.
    """
    source = alerts
    if triage_status is not None:
        name = triage_status.strip().lower()
        if name not in TRIAGE_STATES:
            raise ValueError(f"invalid triage status {triage_status!r}; expected one of {TRIAGE_STATES}")
        source = source.filter(F.col("triage_status") == name)
    if limit is not None and not exact:
        source = recent(source, limit)
    shown = flag_suppressed(hydrate(source), rules)
    if not include_suppressed:
        shown = visible_alerts(shown)
    if sensor_id is not None:
        shown = for_sensor(shown, sensor_id)
    return recent(shown, limit) if limit is not None and exact else shown


def for_sensor(df: DataFrame, sensor_id: str) -> DataFrame:
    """Rows of one sensor; rows without one belong to the default sensor."""
    return df.filter(F.coalesce(text_or_null(F.col("sensor_id")), F.lit(DEFAULT_SENSOR_ID)) == sensor_id)


def notification_candidates(shown: DataFrame) -> DataFrame:
    return shown.filter(~F.col("triage_status").isin(*CLOSED_STATES))


def alert_by_id(alerts: DataFrame, alert_id: int) -> DataFrame:
    return alerts.filter(F.col("id") == alert_id)


def apply_transitions(
    alerts: DataFrame, transitions: DataFrame, bucket: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Apply (alert_id, to_status, changed_by, changed_at, seq) in order.

    Returns the alerts with their last state and the history rows with
    ``from_status``. ``bucket`` (default: the day of the change) follows the
    order and keeps a hot alert from being sorted in one task.
    """
    named = transitions.withColumn("to_status", normalized_status(F.col("to_status")))
    day = F.substring("changed_at", 1, 10) if bucket is None else bucket
    order = [F.col("changed_at"), F.col("seq")]
    stepped = previous_value(named, ["alert_id"], day, order, "to_status", "previous")
    initial = alerts.select(F.col("id").alias("alert_id"), F.col("triage_status").alias("__initial"))
    history = stepped.join(initial, "alert_id").select(
        "alert_id", F.coalesce("previous", "__initial").alias("from_status"), "to_status",
        "changed_by", "changed_at", "seq",
    )
    last = named.groupBy(F.col("alert_id").alias("id")).agg(
        F.max_by(F.struct("to_status", "changed_at"), F.struct(*order)).alias("__last")
    )
    updated = alerts.join(last, "id", "left").withColumns({
        "triage_status": F.coalesce("__last.to_status", "triage_status"),
        "triage_updated_at": F.coalesce("__last.changed_at", "triage_updated_at"),
        "updated_at": F.coalesce("__last.changed_at", "updated_at"),
    }).drop("__last")
    return updated, history


def status_timeline(alerts: DataFrame, notes: DataFrame, history: DataFrame) -> DataFrame:
    """Alert x notes and alert x status changes as one list, newest first per alert."""
    base = alerts.select(F.col("id").alias("alert_id"))
    note_rows = base.join(notes, "alert_id").select(
        "alert_id", F.lit("note").alias("kind"), F.col("created_at").alias("at"),
        F.col("note_text").alias("detail"), F.col("author").alias("actor"), F.col("id").alias("entry_id"),
    )
    change_rows = base.join(history, "alert_id").select(
        "alert_id", F.lit("status").alias("kind"), F.col("changed_at").alias("at"),
        F.concat("from_status", F.lit(" -> "), "to_status").alias("detail"),
        F.col("changed_by").alias("actor"), F.col("id").alias("entry_id"),
    )
    return note_rows.unionByName(change_rows)


def newest_first(timeline: DataFrame) -> DataFrame:
    return timeline.orderBy("alert_id", F.col("at").desc(), F.col("entry_id").desc())
