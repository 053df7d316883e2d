"""A fitted scoring model on disk: model folder, contract document, manifest."""

from __future__ import annotations

import json
import platform
from dataclasses import dataclass

import pyspark
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..operators.contract import Contract, NumericRule
from ..operators.features import category_domains, feature_names, numeric_features
from .files import read_text, tree_digest, write_text

# Document version and the keys a manifest must have.
VERSION = "1.0"
MANIFEST_KEYS = (
    "version", "model_type", "model_version", "production_threshold", "threshold_metadata",
    "preprocessing", "artifact_integrity", "runtime",
)


@dataclass(frozen=True)
class Manifest:
    """Everything scoring needs to know about a saved model."""

    version: str
    model_type: str
    model_version: str
    production_threshold: float
    threshold_metadata: dict
    preprocessing: dict
    artifact_integrity: dict
    runtime: dict

    def to_json(self) -> str:
        return json.dumps({k: getattr(self, k) for k in MANIFEST_KEYS}, indent=2, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        doc = json.loads(text)
        missing = [k for k in MANIFEST_KEYS if k not in doc]
        if missing:
            raise ValueError(f"manifest lacks {missing}")
        return cls(**{k: doc[k] for k in MANIFEST_KEYS})

    @property
    def model_hash(self) -> str | None:
        return self.artifact_integrity.get("pipeline_sha256")


def derive_contract(
    model: PipelineModel,
    rules: dict[str, NumericRule] | None = None,
    forbidden: tuple[str, ...] = (),
    **kw,
) -> Contract:
    """The contract of a fitted pipeline: its numeric columns and learned category domains."""
    given = rules or {}
    return Contract(
        {c: given.get(c, NumericRule()) for c in numeric_features(model)},
        {c: tuple(v) for c, v in category_domains(model).items()},
        forbidden,
        **kw,
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_artifacts(
    spark: SparkSession,
    path: str,
    model: PipelineModel,
    contract: Contract,
    threshold: float,
    selection_method: str,
    source: str,
    model_version: str = "1",
) -> Manifest:
    """Write model, contract and manifest below ``path``."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be in [0, 1]")
    save_model(model, f"{path}/model")
    write_text(spark, contract.to_json(VERSION), f"{path}/contract")
    manifest = Manifest(
        version=VERSION,
        model_type=type(model.stages[-1]).__name__,
        model_version=model_version,
        production_threshold=float(threshold),
        threshold_metadata={
            "value": float(threshold), "selection_method": selection_method, "source_phase": source,
        },
        preprocessing={
            "numeric_features": list(contract.numeric),
            "categorical_features": list(contract.categorical),
            "numeric_imputation": "median",
            "categorical_imputation": "most_frequent",
            "n_encoded_features": len(feature_names(model)),
        },
        artifact_integrity={
            "algorithm": "sha256", "pipeline_sha256": tree_digest(spark, f"{path}/model"),
        },
        runtime={"pyspark": pyspark.__version__, "python": platform.python_version()},
    )
    write_text(spark, manifest.to_json(), f"{path}/manifest")
    return manifest


def artifact_checks(
    spark: SparkSession, path: str, expected_threshold: float | None = None
) -> list[tuple[str, bool, str]]:
    """``(check, ok, note)`` for a saved model; nothing is loaded before its hash is compared."""
    out: list[tuple[str, bool, str]] = []

    def note(check: str, ok: bool, text: str = "") -> bool:
        out.append((check, bool(ok), text))
        return bool(ok)

    docs = {}
    for name in ("manifest", "contract"):
        try:
            docs[name] = json.loads(read_text(spark, f"{path}/{name}"))
            note(f"{name}_readable", True)
        except Exception as exc:
            note(f"{name}_readable", False, type(exc).__name__)
    if len(docs) < 2:
        return out
    man, con = docs["manifest"], docs["contract"]
    missing = [k for k in MANIFEST_KEYS if k not in man]
    note("manifest_keys", not missing, ",".join(missing))
    wanted = (
        "version", "numeric_features", "categorical_features", "feature_order",
        "forbidden_fields", "numeric_constraints",
    )
    lacking = [k for k in wanted if k not in con]
    note("contract_keys", not lacking, ",".join(lacking))
    if missing or lacking:
        return out
    note("version_match", man["version"] == con["version"] == VERSION, f"{man['version']}/{con['version']}")
    t = man["production_threshold"]
    note("threshold_consistent", man["threshold_metadata"].get("value") == t, str(t))
    if expected_threshold is not None:
        note("threshold_expected", t == expected_threshold, f"{t}/{expected_threshold}")
    note(
        "features_match",
        set(man["preprocessing"]["numeric_features"]) == set(con["numeric_features"])
        and set(man["preprocessing"]["categorical_features"]) == set(con["categorical_features"]),
    )
    note("domains_filled", all(con["categorical_features"].values()))
    note("constraints_complete", set(con["numeric_features"]) <= set(con["numeric_constraints"]))
    integrity = man["artifact_integrity"]
    note("hash_algorithm", integrity.get("algorithm") == "sha256", str(integrity.get("algorithm")))
    same = note(
        "hash_match", tree_digest(spark, f"{path}/model") == integrity.get("pipeline_sha256")
    )
    if same:
        model = load_model(f"{path}/model")
        note("model_type", type(model.stages[-1]).__name__ == man["model_type"], man["model_type"])
        note("model_features", numeric_features(model) == con["numeric_features"])
    return out


def artifact_report(spark: SparkSession, path: str, expected_threshold: float | None = None) -> DataFrame:
    """The checks as a table."""
    return spark.createDataFrame(
        artifact_checks(spark, path, expected_threshold), "check string, ok boolean, note string"
    )
