"""Line dedup over overlapping windows of three lines (operator 2).

The lines of a text that hold a character other than ASCII white space are
numbered, and every three consecutive ones are hashed together (128 bits, ends
trimmed). A window's first occurrence, by document id, text hash and position,
stays; each later one marks its three lines, and all marked lines are removed.
Runs of later occurrences overlap, so their covered positions merge.

Windows are grouped with a partial aggregate, and a window's occurrences are
joined back only where it occurs twice, so a passage that a third of all
documents share is never gathered in one task: the join is one Spark can split.

Defined cases: texts with under three lines, empty and null texts stay as they
are; blank lines are never removed; copies of a row (same id and text) are one
document, so each keeps what the first keeps; a null id sorts first; an empty
table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import NOT_SPACE, SPACE, document_key, fresh, let, positions, quoted, wide_hash

LINES = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _filled(lines: Column) -> Column:
    """Indexes of the lines that are not blank."""
    return F.filter(positions(F.size(lines)), lambda i: F.get(lines, i).rlike(NOT_SPACE))


def _windows(text: Column) -> Column:
    """(number of the first line, hash) of every window."""
    trimmed = F.transform(
        F.filter(_lines(text), lambda line: line.rlike(NOT_SPACE)),
        lambda line: F.regexp_replace(line, f"^[{SPACE}]+|[{SPACE}]+$", ""),
    )
    return let(
        trimmed,
        lambda lines: F.transform(
            positions(F.size(lines) - (LINES - 1)),
            lambda i: F.struct(i.alias("at"), wide_hash(*[F.get(lines, i + k) for k in range(LINES)]).alias("w")),
        ),
    )


def later_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(document key, first line) of each window that occurred before."""
    windows = docs.select(document_key(doc_id, text).alias("key"), F.explode(_windows(F.col(text))).alias("win"))
    windows = windows.select("key", "win.at", F.col("win.w.a").alias("wa"), F.col("win.w.b").alias("wb"))
    place = F.struct("key", "at")
    firsts = (
        windows.groupBy("wa", "wb")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .filter(F.col("first") != F.col("last"))
        .select("wa", "wb", "first")
    )
    return windows.join(firsts, ["wa", "wb"]).filter(place > F.col("first")).select("key", "at")


def _without(text: Column, starts: Column) -> tuple[Column, Column]:
    """The text without the marked lines, and their number."""
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + (LINES - 1)))))
    parts = F.struct(_lines(text).alias("l"), covered.alias("c"))

    def rest(p: Column) -> Column:
        gone = let(_filled(p["l"]), lambda filled: F.transform(p["c"], lambda k: F.get(filled, k)))
        kept = F.array_except(positions(F.size(p["l"])), gone)
        return let(p["l"], lambda lines: F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))

    return let(parts, rest), F.size(covered)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", removed: str | None = None) -> DataFrame:
    """``docs`` without lines of repeated windows; ``removed`` names a column for their number."""
    key, starts = fresh(docs, "__key"), fresh(docs, "__starts")
    narrow = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    marked = later_windows(narrow).distinct().groupBy("key").agg(F.collect_list("at").alias(starts))
    joined = docs.withColumn(key, document_key(doc_id, text)).join(
        marked.withColumnRenamed("key", key), key, "left"
    )
    cleaned, count = _without(quoted(text), quoted(starts))
    found = quoted(starts).isNotNull()
    columns = [
        F.when(found, cleaned).otherwise(quoted(text)).alias(c) if c == text else quoted(c) for c in docs.columns
    ]
    if removed:
        columns.append(F.when(found, count).otherwise(F.lit(0)).cast("long").alias(removed))
    return joined.select(*columns)
