"""Label views of the frozen splits, with label guards."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.schemas import KNOWN_ATTACK_FAMILIES, MULTICLASS_LABELS, OOD_FAMILIES, OOD_SPLIT, SPLITS


@dataclass(frozen=True)
class ViewSpec:
    """A named label space; ``predicate`` builds the row filter from (label, split)."""

    name: str
    label_space: tuple[str, ...]
    source_labels: tuple[str, ...] = MULTICLASS_LABELS
    ood_labels: tuple[str, ...] = OOD_FAMILIES
    ood_split: str = OOD_SPLIT
    predicate: Callable[[Column, Column, "ViewSpec"], Column] | None = None

    def keeps(self, label: Column, split: Column) -> Column:
        if self.predicate is not None:
            return self.predicate(label, split, self)
        return F.when(split == self.ood_split, label.isin(*self.ood_labels)).otherwise(
            label.isin(*self.label_space)
        )

    def allows(self, label: Column, split: Column) -> Column:
        return F.when(split == self.ood_split, label.isin(*self.ood_labels)).otherwise(
            label.isin(*self.source_labels)
        )


MESSAGE_LABELS = 20  # labels an error message names

ATTACK_ONLY = ViewSpec("attack_only", KNOWN_ATTACK_FAMILIES)
DIRECT_MULTICLASS = ViewSpec("direct_multiclass", MULTICLASS_LABELS)


def unexpected_labels(df: DataFrame, spec: ViewSpec, label: str = "derived_label_family", split: str = "split") -> DataFrame:
    """Distinct (split, label) pairs the view does not allow, with row counts."""
    counts = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("rows"))
    allowed = F.coalesce(spec.allows(F.col(label), F.col(split)), F.lit(False))
    return counts.filter(~allowed)


def label_view(df: DataFrame, spec: ViewSpec, label: str = "derived_label_family", split: str = "split") -> DataFrame:
    return df.filter(spec.keeps(F.col(label), F.col(split)))


def view_report(df: DataFrame, spec: ViewSpec, label: str = "derived_label_family", split: str = "split") -> DataFrame:
    """Row counts per split and label with split and grand totals (null keys)."""
    return (
        label_view(df, spec, label, split)
        .rollup(split, label)
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("view", F.lit(spec.name))
    )


def label_distribution(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    return df.groupBy(split, label).agg(F.count(F.lit(1)).alias("rows"))


def derive_view(
    df: DataFrame,
    spec: ViewSpec,
    label: str = "derived_label_family",
    split: str = "split",
    required: Sequence[str] = SPLITS,
) -> DataFrame:
    """The view's rows after both guards: no unexpected label, no empty split.

    Both guards are one aggregate row. A message names the first faulty split
    and its first labels in order.
    """
    allowed = F.coalesce(spec.allows(F.col(label), F.col(split)), F.lit(False))
    kept = F.coalesce(spec.keeps(F.col(label), F.col(split)), F.lit(False))
    needed = [name for name in required if name != spec.ood_split]
    pairs = df.groupBy(split, label).agg(F.lit(1).alias("one"))
    found = pairs.agg(
        F.count_if(~allowed).alias("bad"),
        *[F.count_if(kept & (F.col(split) == name)).alias(f"in_{i}") for i, name in enumerate(needed)],
    ).first()
    if found["bad"]:
        first = pairs.filter(~allowed).orderBy(split, label).limit(MESSAGE_LABELS).collect()
        bad = [str(r[label]) for r in first if r[split] == first[0][split]]
        raise ValueError(f"{spec.name} view saw unexpected labels in split {first[0][split]}: {bad}")
    for i, name in enumerate(needed):
        if not found[f"in_{i}"]:
            raise ValueError(f"{spec.name} view has no rows in split {name}")
    return label_view(df, spec, label, split)
