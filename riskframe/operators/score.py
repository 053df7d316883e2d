"""Batch scoring behind a data contract."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..failures import ArtifactMissing, ArtifactTampered, BadRequest
from ..functions.expressions import predicted
from ..sources.artifacts import Manifest, load_model
from ..sources.files import read_text, tree_digest
from .calibrate import CALIBRATED
from .contract import ERRORS, INPUT, Contract
from .models import add_score


def check_threshold(value: float) -> float:
    if not 0.0 <= value <= 1.0:
        raise BadRequest("threshold must be in [0, 1]")
    return float(value)


def with_decision(
    df: DataFrame,
    threshold: float,
    probability: str = "probability",
    prediction: str = "prediction",
    label: str = "prediction_label",
) -> DataFrame:
    """Add the predicted class and its Yes/No label."""
    t = check_threshold(threshold)
    return df.withColumn(prediction, predicted(F.col(probability), t)).withColumn(
        label, F.when(F.col(prediction) == 1, "Yes").otherwise("No")
    )


@dataclass(frozen=True)
class Scorer:
    """A fitted model with its contract and manifest."""

    model: PipelineModel
    contract: Contract
    manifest: Manifest

    @classmethod
    def load(cls, spark: SparkSession, path: str, verify: bool = True, **contract_options) -> Scorer:
        """Read saved artifacts; the model is loaded only after its hash was compared."""
        try:
            manifest = Manifest.from_json(read_text(spark, f"{path}/manifest"))
            contract = Contract.from_json(read_text(spark, f"{path}/contract"), **contract_options)
            found = tree_digest(spark, f"{path}/model") if verify else manifest.model_hash
        except Exception as exc:
            raise ArtifactMissing(f"artifacts below {path} cannot be read") from exc
        if found != manifest.model_hash:
            raise ArtifactTampered(f"integrity: the model below {path} has another sha256 than its manifest")
        try:
            return cls(load_model(f"{path}/model"), contract, manifest)
        except Exception as exc:
            raise ArtifactMissing(f"the model below {path} cannot be loaded") from exc

    def keeping(self, *columns: str) -> Scorer:
        """The same scorer letting extra columns (keys) pass through."""
        return replace(self, contract=replace(self.contract, passthrough=tuple(columns)))

    def threshold(self, override: float | None = None) -> float:
        return check_threshold(self.manifest.production_threshold if override is None else override)

    def decide(self, checked: DataFrame, threshold: float | None = None) -> DataFrame:
        """Valid rows as they arrived, with probability, prediction, label and threshold.

        A plain projection: usable on a batch, inside a micro-batch and on a stream.
        """
        t = self.threshold(threshold)
        valid = self.contract.select_valid(checked, keep_input=True)
        scored = with_decision(self.probabilities(valid), t)
        return scored.select(
            f"{INPUT}.*", "probability", "prediction", "prediction_label", F.lit(t).alias("threshold")
        )

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Input columns and probability."""
        return self.score(df).drop("prediction", "prediction_label", "threshold")

    def predict(self, df: DataFrame, threshold: float | None = None) -> DataFrame:
        """Input columns and predicted class."""
        return self.score(df, threshold).drop("probability", "prediction_label", "threshold")

    def probabilities(self, valid: DataFrame, name: str = "probability") -> DataFrame:
        """Valid rows with their (calibrated, where the model is) probability."""
        out = self.model.transform(valid)
        if CALIBRATED in out.columns:
            return out.select(*valid.columns, F.col(CALIBRATED).alias(name))
        return add_score(valid, self.model, name)

    def score(
        self, df: DataFrame, threshold: float | None = None, return_proba: bool = True, mode: str = "fail"
    ) -> DataFrame:
        """Validate and score any number of rows.

        ``mode="fail"`` rejects the whole input on any violation, ``mode="valid"`` scores
        the valid rows only (see ``quarantine`` for the others).
        """
        if mode not in ("fail", "valid"):
            raise ValueError("mode must be fail or valid")
        self.threshold(threshold)
        checked = self.contract.checked_or_fail(df) if mode == "fail" else self.contract.check(df)
        out = self.decide(checked, threshold)
        return out if return_proba else out.drop("probability")

    def quarantine(self, df: DataFrame) -> DataFrame:
        """Rejected rows with all their violations."""
        return self.contract.check(df).where(F.size(ERRORS) > 0)
