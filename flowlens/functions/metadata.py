"""Provenance columns derived from file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.schemas import FAMILY_ORDER, KNOWN_BAD_FOLDER


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``; URI schemes and percent escapes of either side are ignored.

    The root is cut off at the start of the path. Only where the path does not
    start with it (a relative root, a host in the path) is its first occurrence taken.
    """
    plain = F.url_decode(F.regexp_replace(F.regexp_replace(path, r"^[a-z0-9]+:/*", "/"), r"\+", "%2B"))
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    after = F.instr(plain, base) + F.lit(len(base))
    return (
        F.when(F.startswith(plain, F.lit(base)), F.substring(plain, len(base) + 1, 1 << 30))
        .when(F.instr(plain, base) > 0, F.substr(plain, after, F.lit(1 << 30)))
        .otherwise(plain)
    )


def path_labels(source_file: Column) -> dict[str, Column]:
    """Family, scenario and labels from a relative path ``family/../file.csv``."""
    parts = F.split(source_file, "/")
    family = F.get(parts, F.lit(0))
    middle = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    scenario = F.when(F.size(middle) > 0, F.array_join(middle, "/")).otherwise(family)
    return {
        "attack_family": family,
        "attack_scenario": scenario,
        "derived_label_binary": F.when(family == "Benign", "Benign").otherwise("Attack"),
        "derived_label_family": family,
    }


def is_known_family(family: Column) -> Column:
    return family.isin(*FAMILY_ORDER)


def is_known_bad(source_file: Column) -> Column:
    """Files directly inside the folder known to be broken."""
    parts = F.split(source_file, "/")
    parent = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    return parent == KNOWN_BAD_FOLDER


def binary_label(label: Column) -> Column:
    return F.when(label == "Benign", F.lit(0)).when(label == "Attack", F.lit(1))
