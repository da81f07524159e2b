"""Frozen models: a fitted pipeline with a manifest that must agree, field by field, before it is loaded."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from racelab.ml.models import predict
from racelab.operators.market import race_certainty


@dataclass(frozen=True)
class Manifest:
    """What a frozen model is. ``digest`` is of the model's files and is set when they are saved."""

    model_version: str
    experiment_id: str
    numbers: tuple[str, ...]
    categories: tuple[str, ...]
    train_start: str
    train_end: str
    train_rows: int
    parameters: tuple[tuple[str, str], ...] = ()
    digest: str = ""

    @staticmethod
    def read(text: str) -> Manifest:
        raw = json.loads(text)
        known = {f.name for f in fields(Manifest)}
        if set(raw) != known:
            raise ValueError(f"manifest: fields {sorted(set(raw) ^ known)} are missing or unknown")
        for name in ("numbers", "categories"):
            raw[name] = tuple(raw[name])
        raw["parameters"] = tuple(tuple(p) for p in raw["parameters"])
        return Manifest(**raw)


class Refused(ValueError):
    """An artifact that isn't what was asked for."""


def parameters(model: PipelineModel) -> tuple[tuple[str, str], ...]:
    """The settings of all stages, as text, in order; names that Spark makes up for a stage are left out."""
    each = [(i, s, p, str(v)) for i, s in enumerate(model.stages) for p, v in sorted(s.extractParamMap().items(), key=lambda x: x[0].name)]
    return tuple((f"{i}.{type(s).__name__}.{p.name}", v) for i, s, p, v in each if not v.endswith("__output"))


def _digest(spark: SparkSession, path: str) -> str:
    """sha256 over the contents of the model's data files, in order of their checksums: names hold random
    parts. Checksums are made by the tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    one = files.select(F.sha2("content", 256).alias("h")).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("h"))), 256).alias("d"))
    return one.first().d


def _text(spark: SparkSession, path: str) -> str:
    rows = spark.read.option("wholetext", True).text(path).collect()
    if len(rows) != 1:
        raise Refused(f"no manifest at {path}")
    return rows[0].value


def save(model: PipelineModel, manifest: Manifest, path: str) -> Manifest:
    """Write the model, then its manifest: without one there is no artifact. An artifact isn't overwritten."""
    spark = SparkSession.getActiveSession()
    model.write().save(f"{path}/model")
    done = Manifest(**{**asdict(manifest), "parameters": parameters(model), "digest": _digest(spark, f"{path}/model")})
    line = json.dumps(asdict(done), ensure_ascii=False)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return done


def differences(found: Manifest, expected: Manifest, ignore: tuple[str, ...] = ()) -> list[str]:
    a, b = asdict(found), asdict(expected)
    return [f"{n}: {a[n]!r} instead of {b[n]!r}" for n in a if n not in ignore and a[n] != b[n]]


@dataclass
class Frozen:
    model: PipelineModel
    manifest: Manifest

    def predict(self, df: DataFrame) -> DataFrame:
        """Probabilities and certainties of races later than the model's training, stamped."""
        missing = [c for c in (*self.manifest.numbers, *self.manifest.categories) if c not in df.columns]
        if missing:
            raise Refused(f"missing features: {', '.join(missing)}")
        got = race_certainty(predict(self.model, df, "predicted_win_probability"), "predicted_win_probability", "confidence")
        stamp = {"model_version": self.manifest.model_version, "experiment_id": self.manifest.experiment_id, "model_train_end": self.manifest.train_end}
        return got.withColumns({c: F.lit(v) for c, v in stamp.items()})


def load(spark: SparkSession, path: str, expected: Manifest) -> Frozen:
    """The artifact, if every field of its manifest and the digest of its files are as expected."""
    found = Manifest.read(_text(spark, f"{path}/manifest"))
    if wrong := differences(found, expected):
        raise Refused("; ".join(wrong))
    if _digest(spark, f"{path}/model") != found.digest:
        raise Refused("the model's files changed")
    model = PipelineModel.load(f"{path}/model")
    if parameters(model) != found.parameters:
        raise Refused("the loaded stages have other settings")
    return Frozen(model, found)
