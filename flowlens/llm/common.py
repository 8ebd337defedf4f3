"""Helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"  # the characters that separate words
NOT_SPACE = rf"[^{SPACE}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def positions(count: Column) -> Column:
    """0 .. count - 1; empty for a count below one."""
    return F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def wide_hash(*values: Column) -> Column:
    """A 128-bit hash as a struct of two longs."""
    return F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(7), *values).alias("b"))


def document_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Identity of a document row: its id and a 128-bit hash of its text.

    Rows equal in both are copies of one document and share every decision. As
    a struct the key joins null safely: a null id is a value like any other.
    """
    hashed = wide_hash(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())
    return F.struct(F.col(doc_id).alias("id"), hashed.alias("h"))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use in any letter case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
