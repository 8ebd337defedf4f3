"""A model and everything it must be scored with, saved and loaded as one.

A bundle is a folder: the binary pipeline with its scoring configuration as a last
stage, the family pipeline if there is one, and a manifest with the digest of
every file. Thresholds, labels and feature lists travel inside and cannot be
given when scoring; a file that was changed, added or lost is refused on load.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.scoring import ScoringConfig, score_binary, score_two_stage

MANIFEST = "manifest"


class ConfigStage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Carries a scoring configuration through a saved pipeline; rows pass unchanged."""

    config = Param(Params._dummy(), "config", "scoring configuration as JSON", TypeConverters.toString)

    def __init__(self, config: ScoringConfig | None = None):
        super().__init__()
        if config is not None:
            self._set(config=json.dumps(asdict(config), sort_keys=True))

    def scoring(self) -> ScoringConfig:
        held = json.loads(self.getOrDefault(self.config))
        return ScoringConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in held.items()})

    def _transform(self, df: DataFrame) -> DataFrame:
        return df


@dataclass(frozen=True)
class Bundle:
    model: PipelineModel
    config: ScoringConfig
    family: PipelineModel | None = None

    def score(self, df: DataFrame, include_input: bool = True, **overrides) -> DataFrame:
        """Binary or two-stage scores under the bundle's own configuration."""
        if overrides:
            raise ValueError(f"a bundle's configuration cannot be overridden: {', '.join(sorted(overrides))}")
        missing = [c for c in self.config.features if c not in df.columns]
        if missing:
            raise ValueError(f"the input lacks features of the bundle: {', '.join(missing)}")
        if self.family is None:
            return score_binary(df, self.model, self.config, include_input)
        return score_two_stage(df, self.model, self.family, self.config, include_input)


def _digests(spark: SparkSession, folder: str) -> dict[str, str]:
    """Digest of every file of the pipelines below a folder, by relative path."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{folder}/binary", f"{folder}/family"])
        .select("path", F.sha2("content", 256).alias("digest")).collect()
    )
    # One row a model file.
    return {r["path"].split(f"{folder.rstrip('/').rsplit('/', 1)[-1]}/", 1)[-1]: r["digest"] for r in files}


def save_bundle(bundle: Bundle, folder: str) -> None:
    """Write a bundle to a new folder; the manifest comes last, so a broken save cannot be loaded."""
    if bundle.family is not None:
        bundle.config.require_family_thresholds()
    spark = SparkSession.active()
    stages = [s for s in bundle.model.stages if not isinstance(s, ConfigStage)]
    PipelineModel([*stages, ConfigStage(bundle.config)]).save(f"{folder}/binary")
    (bundle.family or PipelineModel([])).save(f"{folder}/family")
    manifest = json.dumps({"two_stage": bundle.family is not None, "files": _digests(spark, folder)}, sort_keys=True)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{folder}/{MANIFEST}")


def load_bundle(spark: SparkSession, folder: str) -> Bundle:
    """Read a bundle after checking that its files are those that were saved."""
    manifest = json.loads(spark.read.text(f"{folder}/{MANIFEST}", wholetext=True).first()[0])
    found, saved = _digests(spark, folder), manifest["files"]
    changed = sorted(p for p in {*found, *saved} if found.get(p) != saved.get(p))
    if changed:
        raise ValueError(f"files of the bundle differ from its manifest: {', '.join(changed)}")
    model = PipelineModel.load(f"{folder}/binary")
    family = PipelineModel.load(f"{folder}/family") if manifest["two_stage"] else None
    return Bundle(model, model.stages[-1].scoring(), family)
