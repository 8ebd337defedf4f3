"""Column builders for alert fields, texts and ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.functions.numeric import strip
from flowlens.schemas import FAMILY_STATUSES, SEVERITY_FLOORS, SEVERITY_RANKS

# Fixed value: "<ip>:<port>-<ip>:<port>-<sequence>", split from the right.
FLOW_ID_PATTERN = r"^([^-]*):([^:-]*)-(.*):([^:]*)-([^-]*)$"
INTEGER_TEXT = r"^[+-]?[0-9]+$"


def text_or_null(value: Column) -> Column:
    return F.nullif(strip(value), F.lit(""))


def integer_or_null(value: Column) -> Column:
    bare = strip(value)
    return F.when(bare.rlike(INTEGER_TEXT), bare.try_cast("int"))


def severity_from_score(score: Column) -> Column:
    ladder = None
    for name, floor in SEVERITY_FLOORS:
        step = score >= F.lit(floor)
        ladder = F.when(step, F.lit(name)) if ladder is None else ladder.when(step, F.lit(name))
    return ladder


def severity_rank(severity: Column) -> Column:
    name = F.lower(strip(F.coalesce(severity, F.lit("unknown"))))
    ladder = None
    for label, rank in SEVERITY_RANKS.items():
        hit = name == F.lit(label)
        ladder = F.when(hit, F.lit(rank)) if ladder is None else ladder.when(hit, F.lit(rank))
    return ladder.otherwise(F.lit(0))


FLOW_ID_PARTS = ("src_ip", "src_port", "dst_ip", "dst_port", "flow_sequence")


def shaped_flow_id(flow_id: Column) -> Column:
    """Trimmed flow id, null when it does not have the expected shape."""
    raw = strip(flow_id)
    return F.when(raw.rlike(FLOW_ID_PATTERN), raw)


def flow_id_parts(shaped: Column) -> dict[str, Column]:
    """Raw text parts of a shaped flow id."""
    return {
        name: F.regexp_extract(shaped, FLOW_ID_PATTERN, i + 1) for i, name in enumerate(FLOW_ID_PARTS)
    }


def clean_flow_parts(parts: dict[str, Column]) -> dict[str, Column]:
    """Parts as trimmed text and whole-number ports."""
    return {
        name: integer_or_null(part) if name.endswith("_port") else text_or_null(part)
        for name, part in parts.items()
    }


def endpoint_text(ip: Column, port: Column) -> Column:
    return F.concat(
        F.coalesce(ip, F.lit("?")),
        F.coalesce(F.concat(F.lit(":"), port.cast("string")), F.lit("")),
    )


def flow_text(src_ip, src_port, dst_ip, dst_port, protocol) -> Column:
    return F.concat(
        endpoint_text(src_ip, src_port),
        F.lit(" -> "),
        endpoint_text(dst_ip, dst_port),
        F.coalesce(F.concat(F.lit(" ("), F.upper(protocol), F.lit(")")), F.lit("")),
    )


def port_list_preview(ports: Column, shown: int) -> Column:
    head = F.array_join(F.slice(ports, 1, shown).cast("array<string>"), ", ")
    more = F.size(ports) - F.lit(shown)
    return F.concat(
        head,
        F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")),
    )


def port_summary(ip: Column, ports: Column) -> Column:
    """``ip``, ``ip:port`` or ``ip (p1, p2, p3, p4 +n more)``; null without an ip."""
    name = text_or_null(ip)
    return (
        F.when(F.size(ports) == 0, name)
        .when(F.size(ports) == 1, F.concat(name, F.lit(":"), F.get(ports, F.lit(0)).cast("string")))
        .otherwise(F.concat(name, F.lit(" ("), port_list_preview(ports, 4), F.lit(")")))
    )


def family_view(status: Column, family: Column, confidence: Column, margin: Column) -> dict[str, Column]:
    """Family fields as shown to an analyst; blank for benign and legacy rows."""
    name = F.lower(text_or_null(status))
    valid = F.when(name.isin(*FAMILY_STATUSES), name)
    shown = valid.isin("known", "unknown")
    return {
        "family_status": valid,
        "attack_family": F.when(shown, text_or_null(family)),
        "attack_family_confidence": F.when(shown, confidence),
        "attack_family_margin": F.when(shown, margin),
        "family_state": F.coalesce(valid, F.lit("legacy_unavailable")),
        "legacy_unavailable": valid.isNull(),
    }
