"""End-to-end jobs: cost optimisation, calibration, error report, evaluation, file scoring."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..failures import ScoringFailed
from ..operators import (
    calibrate,
    clean,
    contract,
    cost,
    errors,
    explain,
    features,
    metrics,
    models,
    split,
    telemetry,
    thresholds,
)
from ..operators.score import Scorer
from ..operators.split import SEED
from ..session import durable
from ..sources import files
from ..spec import (
    COARSE_GRID,
    COST_SCENARIOS,
    DEFAULT_COSTS,
    FINAL_CANDIDATES,
    LABEL,
    CostScenario,
    FeatureSpec,
    RetentionScenario,
    retention_grid,
    threshold_grid,
)


def prepare_dataset(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    spec: FeatureSpec,
    output: str,
    numeric_text: Sequence[str] = (),
    zero_filled: dict[str, str] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Raw file to clean, checked, labelled and split rows, written by split.

    The key is dropped after the split, which needs it.
    """
    raw = files.read_table(spark, source, schema)
    cleaned = clean.clean(raw, numeric_text, zero_filled)
    clean.assert_dataset(cleaned, spec.target, (spec.positive, spec.negative))
    labelled = clean.with_label(cleaned, spec.target, spec.positive, spec.negative)
    parts = split.stratified_split(labelled, spec.key, LABEL, seed=seed)
    files.write_splits(parts.drop(spec.key), output)
    return spark.read.parquet(output)


def run_threshold_analysis(oof: DataFrame, output: str, grid: Sequence[float] = tuple(COARSE_GRID)) -> DataFrame:
    """Coarse sweep and the usual candidate thresholds; returns the candidates."""
    sweep = durable(thresholds.threshold_sweep(oof, grid), "sweep")
    candidates = thresholds.candidate_thresholds(sweep)
    files.write_json(sweep, f"{output}/threshold_results")
    files.write_json(candidates, f"{output}/optimal_thresholds")
    return candidates


def run_tuning(
    train: DataFrame,
    val: DataFrame,
    families: dict,
    n_iter: int,
    key: str,
    output: str,
    metric: str = "roc_auc",
    **options,
) -> str:
    """Tune each family by nested search on training rows and choose on validation rows."""
    train, val = durable(train, "train"), durable(val, "val")
    tuned = models.tune_families(train, families, n_iter, key, metric, **options)
    fitted = {name: found["pipeline"].fit(train) for name, found in tuned.items()}
    table = durable(models.select_model(fitted, val, metric), "selection")
    spark = train.sparkSession
    for name, found in tuned.items():
        files.write_json(found["per_fold"], f"{output}/{name}/fold_scores")
        files.write_json(found["pooled"], f"{output}/{name}/pooled_scores")
        files.write_text(spark, json.dumps(found["chosen"], sort_keys=True), f"{output}/{name}/parameters")
    files.write_json(table, f"{output}/selection")
    return table.where("selected").first()["model"]


def evaluate_model(
    model: Transformer, test: DataFrame, output: str, threshold: float = 0.5, y: str = LABEL
) -> DataFrame:
    """Test report of a fitted model: ranking metrics, class report, confusion, curve points."""
    scored = durable(models.add_score(test, model, keep=[y]), "test")
    ranks = durable(metrics.rank_metrics(scored, y=y), "ranks")
    files.write_json(ranks, f"{output}/rank_metrics")
    files.write_json(metrics.label_metrics(scored, threshold, y=y), f"{output}/label_metrics")
    files.write_json(metrics.classification_report(scored, threshold, y=y), f"{output}/classification_report")
    metrics.roc_points(scored, y=y).write.mode("overwrite").parquet(f"{output}/roc_points")
    metrics.pr_points(scored, y=y).write.mode("overwrite").parquet(f"{output}/pr_points")
    return ranks


def run_explanations(
    model: PipelineModel,
    background: DataFrame,
    rows: DataFrame,
    key: str,
    threshold: float,
    output: str,
    y: str = LABEL,
    k: int = 5,
) -> None:
    """Global, grouped and local attributions of a fitted pipeline, with mapping and provenance.

    Linear models are explained in log-odds against the background, forests in probability.
    The local part explains the first example of each outcome.
    """
    spark = rows.sparkSession
    if isinstance(model.stages[-1], RandomForestClassificationModel):
        def attribute(df):
            return explain.forest_attribution(df, model, [key])

        space = "probability"
    else:
        def attribute(df):
            return explain.linear_model_attribution(df, model, background, [key]), None

        space = "log-odds"
    rows = durable(rows, "explained")
    attr, base = attribute(rows)
    attr = durable(attr, "attribution")
    files.write_result_csv(explain.global_importance(attr), f"{output}/global_importance")
    files.write_result_csv(
        explain.grouped_importance(attr, features.feature_origins(model)), f"{output}/grouped_importance"
    )
    scored = models.add_score(rows, model, keep=[key, y])
    chosen = durable(explain.examples(scored, threshold, key, y), "examples")
    local = explain.local_explanations(attr.join(F.broadcast(chosen.select(key)), key, "left_semi"), [key], k)
    files.write_json(chosen.join(local, key, "left"), f"{output}/local_explanations")
    files.write_json(explain.feature_mapping(model, spark), f"{output}/feature_mapping")
    provenance = {
        "model_type": type(model.stages[-1]).__name__,
        "output_space": space,
        "base_value": base,
        "threshold": threshold,
        "feature_count": len(features.feature_names(model)),
        "reference_source": "training rows",
        "reference_rows": background.count(),
        "explained_rows": rows.count(),
        "pyspark_version": spark.version,
    }
    files.write_text(spark, json.dumps(provenance, indent=2, sort_keys=True), f"{output}/provenance")


def choose_threshold(scored: DataFrame, costs: CostScenario = DEFAULT_COSTS, grid=None) -> float:
    """The cheapest threshold as a number (one row reaches the driver)."""
    best = cost.cheapest_threshold(cost.with_costs(thresholds.threshold_sweep(scored, grid), [costs]))
    return float(best.first()["threshold"])


def cost_at(scored: DataFrame, threshold: float, costs: Sequence[CostScenario] = (DEFAULT_COSTS,)) -> DataFrame:
    """A frozen threshold applied to other rows (the test split)."""
    return cost.with_costs(thresholds.confusion_at(scored, threshold), list(costs))


def run_cost_optimisation(
    oof: DataFrame,
    test: DataFrame | None,
    output: str,
    costs: CostScenario = DEFAULT_COSTS,
    scenarios: Sequence[CostScenario] = tuple(COST_SCENARIOS),
    model_metrics: dict | None = None,
) -> float:
    """Choose on out-of-fold rows, apply to test rows, vary the costs, write the artefacts.

    The test rows are never read before the threshold is fixed.
    """
    grid = threshold_grid()
    sweep = durable(thresholds.threshold_sweep(oof, grid), "sweep")
    costed = cost.with_costs(sweep, [costs])
    best = cost.cheapest_threshold(costed)
    files.write_threshold_csv(costed, f"{output}/cost_thresholds")
    files.write_json(cost.cost_summary(best, len(grid), model_metrics), f"{output}/cost_analysis")
    files.write_result_csv(
        cost.sweep_sensitivity(sweep, list(scenarios)), f"{output}/cost_sensitivity", ["scenario"]
    )
    threshold = float(best.first()["threshold"])
    if test is not None:
        files.write_json(cost_at(test, threshold, [costs]), f"{output}/cost_test")
    return threshold


def run_retention_optimisation(
    oof: DataFrame,
    test: DataFrame | None,
    output: str,
    scenario: RetentionScenario,
    grid_scenarios: Sequence[RetentionScenario] | None = None,
    model_metrics: dict | None = None,
) -> float:
    """As ``run_cost_optimisation`` with retention-aware costs and policy baselines."""
    grid = threshold_grid()
    sweep = durable(thresholds.threshold_sweep(oof, grid), "sweep")
    costed = cost.with_retention_costs(sweep, [scenario])
    best = cost.cheapest_retention_threshold(costed)
    files.write_threshold_csv(costed, f"{output}/retention_thresholds")
    files.write_json(cost.cost_summary(best, len(grid), model_metrics), f"{output}/retention_analysis")
    files.write_result_csv(
        cost.sweep_retention_sensitivity(sweep, list(grid_scenarios or retention_grid())),
        f"{output}/retention_sensitivity",
        ["scenario"],
    )
    threshold = float(best.first()["threshold"])
    if test is not None:
        chosen = cost.with_retention_costs(thresholds.confusion_at(test, threshold), [scenario])
        files.write_json(chosen, f"{output}/retention_test")
    return threshold


def run_calibration(oof: DataFrame, fold: str, k: int, output: str) -> str:
    """Cross-fit both calibrators, choose one, fit it on all rows, write comparison and model."""
    crossed = calibrate.cross_fit_calibration(oof, fold, k)
    table = durable(
        calibrate.calibration_table(calibrate.calibration_fold_metrics(crossed)), "methods"
    )
    chosen = calibrate.select_calibration(table)
    files.write_json(table, f"{output}/calibration_metrics")
    files.write_json(chosen, f"{output}/calibration_choice")
    method = chosen.first()["selected_method"]
    calibrate.fit_calibrator(oof, method).write().overwrite().save(f"{output}/calibrator")
    return method


def run_error_report(
    scored: DataFrame, threshold: float, categorical: Sequence[str], numeric: Sequence[str], output: str
) -> None:
    """Counts and rates, hard cases, slices and numeric summaries as JSON tables.

    The scored table is written once; the four reports read that.
    """
    scored = durable(scored, "scored")
    files.write_json(errors.error_rates(scored, threshold), f"{output}/error_rates")
    files.write_json(errors.hard_cases(scored, threshold), f"{output}/hard_cases")
    files.write_json(errors.error_slices(scored, threshold, categorical), f"{output}/error_slices")
    files.write_json(errors.error_numeric(scored, threshold, numeric), f"{output}/error_numeric")


def final_evaluation(
    pipeline: Estimator, train: DataFrame, test: DataFrame, y: str = LABEL, grid=FINAL_CANDIDATES
) -> tuple[Transformer, DataFrame, DataFrame]:
    """Fit once on training rows, score test rows once: model, ranking metrics, candidates."""
    model = pipeline.fit(train)
    scored = durable(models.add_score(test, model, keep=[y]), "test")
    return model, metrics.rank_metrics(scored, y=y), thresholds.threshold_sweep(scored, grid, y=y)


def score_files(
    spark: SparkSession,
    artifacts: str,
    source: str,
    output: str,
    events: str | None = None,
    threshold: float | None = None,
    verify: bool = True,
    passthrough: Sequence[str] = (),
    output_format: str = "csv",
) -> dict:
    """Score a file into files: validated input columns plus prediction and probability.

    One telemetry event is appended for the call, also for a failed one. Counts come from
    the write itself.
    """
    started = time.perf_counter()
    scorer = None

    def log(**counts) -> None:
        if events:
            event = telemetry.scoring_event(
                spark, "predict_batch", (time.perf_counter() - started) * 1000.0,
                threshold if threshold is not None
                else scorer.manifest.production_threshold if scorer else 0.0,
                model_artifact_hash=scorer.manifest.model_hash if scorer else None, **counts,
            )
            files.append_events(event, events)

    try:
        scorer = Scorer.load(spark, artifacts, verify).keeping(*passthrough)
        rows = files.read_table(spark, source)
        scored = scorer.score(rows, threshold)
        counted, watch = telemetry.observed(scored)
        out = counted.select(
            *rows.columns,
            F.col("prediction").alias("churn_prediction"),
            F.col("probability").alias("churn_probability"),
        )
        writer = out.write.mode("overwrite")
        if output_format == "csv":
            writer = writer.option("header", True)
        try:
            writer.format(output_format).save(output)
        except Exception as exc:
            raise ScoringFailed(f"scoring to {output} failed") from exc
    except Exception as exc:
        log(failure=telemetry.error_category(exc))
        raise
    n, positive = watch.get["prediction_count"], watch.get["positive_predictions"]
    log(prediction_count=n, positive_predictions=positive, batch_size=n)
    return {"rows": n, "positive": positive, "threshold": scorer.threshold(threshold)}


def validate_and_report(df: DataFrame, rules: contract.Contract, output: str, key: Sequence[str]) -> None:
    """Write every violation of every row and the counts per column and code."""
    checked = rules.require_columns(df).transform(rules.check)
    found = durable(contract.violations(checked, key), "violations")
    files.write_json(found, f"{output}/violations")
    files.write_json(
        found.groupBy("column", "code").agg(F.count(F.lit(1)).alias("n")), f"{output}/violation_counts"
    )
