"""JSON text <-> map columns.

A record is a ``map<string,string>``: scalars as text, nested values as JSON text,
JSON null as a null value, so that "present but null" and "absent" stay distinct.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRICT_JSON = {"allowSingleQuotes": "false"}


def _wrapped(line: Column, element: str) -> Column:
    # Parsing "[line]" makes the reader consume the whole line, so trailing text
    # after a complete object is an error instead of being ignored.
    return F.from_json(F.concat(F.lit("["), line, F.lit("]")), f"array<{element}>", _STRICT_JSON)


def parsed_array(line: Column) -> Column:
    """``[line]`` as an array of maps; see :func:`parsed_object`."""
    return _wrapped(line, "map<string,string>")


def parsed_object(parsed: Column) -> Column:
    """The single object of a parsed line, or null unless it is exactly one object."""
    return F.when(F.size(parsed) == 1, F.get(parsed, F.lit(0)))


def is_json(line: Column) -> Column:
    """True when the line holds exactly one JSON value of any kind."""
    return F.coalesce(F.size(_wrapped(line, "string")) == 1, F.lit(False))


def last_wins(record: Column) -> Column:
    """Resolve repeated JSON keys to their last value."""
    keys = F.map_keys(record)
    entries = F.map_entries(record)
    kept = F.filter(
        entries,
        lambda entry, i: ~F.array_contains(
            F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), entry["key"]
        ),
    )
    repeated = F.size(keys) > F.size(F.array_distinct(keys))
    return F.when(repeated, F.map_from_entries(kept)).otherwise(record)


def literal_map(mapping: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")


def literal_array(values) -> Column:
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<string>)")


def renamed_keys(record: Column, mapping: dict[str, str]) -> Column:
    """Keys of ``record`` after renaming, with repeats kept."""
    if not mapping:
        return F.map_keys(record)
    names = literal_map(mapping)
    return F.transform(F.map_keys(record), lambda k: F.coalesce(F.try_element_at(names, k), k))


def has_repeats(values: Column) -> Column:
    return F.size(values) > F.size(F.array_distinct(values))


def repeated_values(values: Column) -> Column:
    """Sorted distinct values that occur more than once; only arrays with repeats are sorted."""
    ordered = F.sort_array(values)
    found = F.array_distinct(
        F.filter(ordered, lambda v, i: (i > 0) & (F.get(ordered, i - 1) == v))
    )
    return F.when(has_repeats(values), found).otherwise(F.expr("cast(array() as array<string>)"))


def picked(record: Column, keys: Column) -> Column:
    """Entries of a map for the given present keys; cost follows the number of keys."""
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(record, k)))


def json_text(payload: Column, *path: str) -> Column:
    """Nested JSON field as text; JSON null and absent both give null."""
    steps = "".join(f"['{step}']" for step in path)
    return F.get_json_object(payload, "$" + steps)
