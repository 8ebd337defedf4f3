"""Numeric column helpers: coercion, guarded ratios, hashing order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number grammars accepted by the two coercion rules.
STRICT_NUMBER = (
    r"^[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)"
    r"([eE][+-]?[0-9]+(_[0-9]+)*)?$"
)
LENIENT_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


WHITESPACE = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    """Trim every kind of ASCII white space, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def finite_or_null(value: Column) -> Column:
    return F.when(is_finite(value), value)


def strict_parse(text: Column, stripped: bool = False) -> Column:
    """JSON field as a double by the strict grammar; may overflow to infinity.

    Booleans, nulls, blanks and words give null; digit groups with underscores
    are numbers. ``stripped`` says the text is already trimmed.
    """
    bare = text if stripped else strip(text)
    digits = F.when(bare.contains("_"), F.regexp_replace(bare, "_", "")).otherwise(bare)
    return F.when(bare.rlike(STRICT_NUMBER), digits.try_cast("double"))


def lenient_parse(text: Column) -> Column:
    """CSV cell as a double; may overflow to infinity."""
    bare = strip(text)
    return F.when(bare.rlike(LENIENT_NUMBER), bare.try_cast("double"))


def strict_number(text: Column) -> Column:
    """JSON field as a finite double, else null."""
    return finite_or_null(strict_parse(text))


def lenient_number(text: Column) -> Column:
    """CSV cell as a finite double, else null (words, blanks, infinities)."""
    return finite_or_null(lenient_parse(text))


def lenient_int(text: Column) -> Column:
    """Truncate numeric text towards zero; booleans count as 0 or 1, else null."""
    bare = F.lower(strip(text))
    return (
        F.when(bare == "true", F.lit(1))
        .when(bare == "false", F.lit(0))
        .otherwise(strict_parse(text).try_cast("int"))
    )


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as double, 0 where the denominator is 0."""
    bottom = denominator.cast("double")
    return F.when(bottom != 0, numerator.cast("double") / bottom).otherwise(F.lit(0.0))


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def seeded_order(seed: int, *keys: Column) -> Column:
    """Deterministic pseudo-random text used wherever a random order is needed."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def seeded_bucket(order: Column, hex_digits: int = 4) -> Column:
    """Leading hex digits of a seeded order as an integer bucket."""
    return F.conv(F.substring(order, 1, hex_digits), 16, 10).cast("int")
