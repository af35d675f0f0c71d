"""Model packages: a registry, a verified artefact store, version checks and loaders."""

from __future__ import annotations

import functools
import json
import warnings
from collections.abc import Callable
from importlib import metadata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOADERS: dict[str, Callable] = {}
SCHEMA = "map<string,struct<sha256:string,models:map<string,struct<description:string,citation:string,requirements:array<string>>>>>"

DEFAULT: dict = {
    "entity_tagger_1": {"sha256": "", "models": {"ner": {"description": "IOB tagger of materials entities, trained by the user", "citation": "", "requirements": []}, "ner_simple": {"description": "the same with properties merged", "citation": "", "requirements": []}}},
    "relevance_1": {"sha256": "", "models": {"relevance": {"description": "TF-IDF and logistic regression", "citation": "", "requirements": []}}},
}


class ModelRequirementError(RuntimeError):
    """A package that a model needs is missing or has another version."""


class ArtefactError(OSError):
    """A stored artefact is missing or not the one that the registry names."""


def read_registry(path: str | None = None) -> dict:
    return DEFAULT if path is None else json.loads(Path(path).read_text(encoding="utf-8"))


def models(spark: SparkSession, registry: dict | None = None) -> DataFrame:
    """(package, model, description, citation, requirements) of all models."""
    text = spark.createDataFrame([(json.dumps(registry or DEFAULT),)], "value string")
    packages = text.select(F.explode(F.from_json("value", SCHEMA)).alias("package", "p"))
    one = packages.select("package", F.explode("p.models").alias("model", "m"))
    return one.select("package", "model", "m.description", "m.citation", "m.requirements")


def check_requirement(requirement: str, installed: Callable[[str], str] = metadata.version) -> str:
    """"ok" or "unpinned" for "name==version" or "name"; raises for missing, other and malformed ones.

    Requirements by address cannot be checked and are "unpinned".
    """
    r = requirement.strip()
    if r.startswith(("git+", "http://", "https://")) or " @ " in r:
        return "unpinned"
    parts = r.split("==")
    if len(parts) > 2 or not parts[0] or any(c in r.replace("==", "") for c in "<>!~="):
        raise ModelRequirementError(f"malformed requirement: {requirement}")
    try:
        found = installed(parts[0])
    except metadata.PackageNotFoundError as e:
        raise ModelRequirementError(f"{parts[0]} is not installed") from e
    if len(parts) == 1:
        return "unpinned"
    if found != parts[1]:
        raise ModelRequirementError(f"{parts[0]} {parts[1]} is needed; {found} is installed")
    return "ok"


def check_versions(requirements: list[str], installed: Callable[[str], str] = metadata.version) -> dict[str, str]:
    out = {r: check_requirement(r, installed) for r in requirements}
    for r, state in out.items():
        if state == "unpinned":
            warnings.warn(f"{r} has no version to check", stacklevel=2)
    return out


def verify(spark: SparkSession, folder: str, sha256: dict[str, str]) -> DataFrame:
    """(file, ok): files of a store against the digests the registry names; missing files are not ok."""
    wanted = spark.createDataFrame(sorted(sha256.items()), "file string, sha256 string")
    found = spark.read.format("binaryFile").load(f"{folder}/*").select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("_is"))
    return wanted.join(found, "file", "left").select("file", F.coalesce(F.col("_is") == F.col("sha256"), F.lit(False)).alias("ok"))


def fetch(spark: SparkSession, folder: str, sha256: dict[str, str]) -> str:
    """The folder of a package whose files are all as the registry says."""
    wrong = [r.file for r in verify(spark, folder, sha256).where("NOT ok").collect()]
    if wrong:
        raise ArtefactError(f"{folder}: {', '.join(sorted(wrong))}")
    return folder


def register_model(name: str, package: str, registry: dict | None = None) -> Callable:
    """Decorator of a loader: before it runs, the model must be of the package and its requirements met."""

    def wrap(load: Callable) -> Callable:
        @functools.wraps(load)
        def run(*args, **kwargs):
            known = (registry or DEFAULT)[package]["models"]
            if name not in known:
                raise KeyError(f"{package} has no model {name}; it has {', '.join(sorted(known))}")
            check_versions(known[name]["requirements"])
            return load(*args, **kwargs)

        _LOADERS[name] = run
        return run

    return wrap


def load(name: str, *args, **kwargs):
    if name not in _LOADERS:
        raise KeyError(f"no model {name}; there are {', '.join(sorted(_LOADERS))}")
    return _LOADERS[name](*args, **kwargs)


@register_model("ner", "entity_tagger_1")
def _tagger(folder: str):
    from assaykit.operators.tagger import TagModel
    from assaykit.plans.ner import Tagger

    return Tagger(TagModel.load(folder))


@register_model("ner_simple", "entity_tagger_1")
def _simple_tagger(folder: str):
    from assaykit.operators.tagger import TagModel
    from assaykit.plans.ner import Tagger

    return Tagger(TagModel.load(folder), simple=True)


@register_model("relevance", "relevance_1")
def _relevance(folder: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(folder)
