"""Fitting, cross-validating and tuning binary classifiers on ``pyspark.ml``."""

from __future__ import annotations

import itertools
import random
from collections.abc import Sequence
from functools import partial

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.tuning import CrossValidator
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, run_together
from ..spec import LABEL, SCORE, FeatureSpec
from . import metrics as m
from .features import TablePreprocessor, feature_names, feature_origins
from .split import SEED, stratified_folds

SIX = ("roc_auc", "average_precision", "accuracy", "precision", "recall", "f1")

MAX_DEPTH = 30  # Spark's limit


class RiskClassifier(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """A binary classifier named by ``kind``: prior, logistic, tree or forest.

    ``C`` is the inverse L2 strength on the summed (not averaged) loss, as common in
    scikit-style libraries: ``regParam = 1 / (C * sum of weights)`` without standardisation.
    ``balanced`` weighs both classes equally. Spark limits tree depth to 30 and has no
    counterpart for a minimum split size.
    """

    kind = Param(Params._dummy(), "kind", "prior, logistic, tree or forest", TypeConverters.toString)
    C = Param(Params._dummy(), "C", "inverse L2 strength", TypeConverters.toFloat)
    balanced = Param(Params._dummy(), "balanced", "weigh classes equally", TypeConverters.toBoolean)
    maxIter = Param(Params._dummy(), "maxIter", "iterations", TypeConverters.toInt)
    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth", TypeConverters.toInt)
    minLeaf = Param(Params._dummy(), "minLeaf", "rows per leaf", TypeConverters.toInt)
    subset = Param(Params._dummy(), "subset", "features per split", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "0/1 label", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    def __init__(self, kind: str = "logistic", labelCol: str = LABEL, **params):
        super().__init__()
        self._setDefault(
            kind="logistic", C=1.0, balanced=False, maxIter=200, numTrees=100, maxDepth=10,
            minLeaf=1, subset="sqrt", labelCol=LABEL, seed=SEED,
        )
        self._set(kind=kind, labelCol=labelCol, **params)

    def _fit(self, dataset: DataFrame) -> Transformer:
        get = self.getOrDefault
        label = get(self.labelCol)
        y = F.col(label)
        stats = dataset.agg(
            F.count(F.lit(1)).alias("n"), F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
        ).first()
        if stats["n"] == 0 or stats["pos"] + stats["neg"] != stats["n"]:
            raise ValueError("training needs rows, all labelled 0 or 1")
        kind = get(self.kind)
        if kind == "prior":
            return _constant(stats["pos"] / stats["n"])
        if stats["pos"] == 0 or stats["neg"] == 0:
            raise ValueError("training needs both classes")
        common = {"featuresCol": "features", "labelCol": label}
        train = dataset
        if get(self.balanced):
            w1, w0 = stats["n"] / (2.0 * stats["pos"]), stats["n"] / (2.0 * stats["neg"])
            train = dataset.withColumn("_weight", F.when(y == 1, F.lit(w1)).otherwise(F.lit(w0)))
            common["weightCol"] = "_weight"
        if kind == "logistic":
            est = LogisticRegression(
                regParam=1.0 / (get(self.C) * stats["n"]), elasticNetParam=0.0,
                standardization=False, maxIter=get(self.maxIter), tol=1e-10, **common,
            )
        elif kind == "tree":
            est = DecisionTreeClassifier(
                maxDepth=checked_depth(get(self.maxDepth)), minInstancesPerNode=get(self.minLeaf),
                seed=get(self.seed), **common,
            )
        elif kind == "forest":
            est = RandomForestClassifier(
                numTrees=get(self.numTrees), maxDepth=checked_depth(get(self.maxDepth)),
                minInstancesPerNode=get(self.minLeaf), featureSubsetStrategy=get(self.subset),
                seed=get(self.seed), **common,
            )
        else:
            raise ValueError(f"unknown kind {kind}")
        fitted = est.fit(train)
        if hasattr(fitted, "hasSummary") and fitted.hasSummary:
            # The training summary holds the session and the training rows, and tasks that
            # score with the model would have to serialise it.
            option = dataset.sparkSession.sparkContext._jvm.scala.Option
            fitted._java_obj.setSummary(option.empty())
        return fitted


def checked_depth(depth: int) -> int:
    """A tree depth that Spark can fit; a deeper request is an error, not another model."""
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"tree depth {depth} is outside 0 to {MAX_DEPTH}")
    return depth


def _constant(rate: float) -> Transformer:
    """A fitted model that gives every row the training prevalence."""
    return SQLTransformer(statement=f"SELECT *, {rate!r}D AS constant_probability FROM __THIS__")


def risk_pipeline(spec_or_numeric, categorical: Sequence[str] | None = None, **params) -> Pipeline:
    """Preprocessing followed by a classifier, from a ``FeatureSpec`` or two column lists."""
    if isinstance(spec_or_numeric, FeatureSpec):
        numeric, categorical = spec_or_numeric.numeric, spec_or_numeric.categorical
    else:
        numeric = spec_or_numeric
    return Pipeline(
        stages=[TablePreprocessor(list(numeric), list(categorical or ())), RiskClassifier(**params)]
    )


def add_score(df: DataFrame, model: Transformer, p: str = SCORE, keep: Sequence[str] | None = None) -> DataFrame:
    """Score rows: the input columns (or ``keep``) and the positive-class probability."""
    out = model.transform(df)
    if "probability" in out.columns:
        score = vector_to_array("probability")[1]
    else:
        score = F.col("constant_probability")
    return out.select(*(keep if keep is not None else df.columns), score.alias(p))


# ------------------------------------------------------------ evaluation


class RankEvaluator(Evaluator):
    """Exact ROC-AUC or average precision, for ``CrossValidator``."""

    def __init__(self, metric: str = "roc_auc", labelCol: str = LABEL):
        super().__init__()
        if metric not in ("roc_auc", "average_precision"):
            raise ValueError(f"unknown metric {metric}")
        self.metric, self.label = metric, labelCol

    def _evaluate(self, dataset: DataFrame) -> float:
        scored = dataset.select(
            F.col(self.label).alias(LABEL), vector_to_array("probability")[1].alias(SCORE)
        )
        value = m.rank_metrics(scored).first()[self.metric]
        return float("nan") if value is None else float(value)

    def isLargerBetter(self) -> bool:
        return True

    def copy(self, extra=None):
        return self


def oof_scores(
    df: DataFrame,
    pipeline: Estimator,
    k: int,
    fold: str = "fold",
    keep: Sequence[str] | None = None,
    parallelism: int = 4,
) -> DataFrame:
    """Every row scored by the model that did not see its fold; written once.

    The folded table is written first: every fit reads it many times. The k fits are
    distributed jobs started from ``parallelism`` driver threads.
    """
    return _cross_scored(durable(df, "folds", fold), pipeline, k, fold, list(keep or df.columns), parallelism)


def _cross_scored(
    table: DataFrame, pipeline: Estimator, k: int, fold: str, columns: list[str], parallelism: int = 4
) -> DataFrame:
    """Out-of-fold scores of a table that is written by fold already."""

    def held_out(i: int) -> DataFrame:
        model = pipeline.fit(table.where(F.col(fold) != i))
        return add_score(table.where(F.col(fold) == i), model, keep=columns)

    parts = run_together(
        table.sparkSession, [partial(held_out, i) for i in range(k)], parallelism
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return durable(out, "oof")


def cv_metrics(df: DataFrame, pipeline: Estimator, k: int, fold: str = "fold", y: str = LABEL) -> DataFrame:
    """``(metric, mean, std)`` of the six metrics over the folds (population std)."""
    scored = oof_scores(df, pipeline, k, fold, keep=[y, fold])
    return m.mean_and_std(m.six_metrics(scored, [fold], y), SIX)


def compare_models(df: DataFrame, models: dict[str, Estimator], k: int, fold: str = "fold", y: str = LABEL) -> DataFrame:
    """``(model, metric, mean, std)`` for several pipelines, best ROC-AUC first."""
    table = durable(df, "folds", fold)
    parts = [
        _cross_scored(table, p, k, fold, [y, fold]).withColumn("model", F.lit(name))
        for name, p in models.items()
    ]
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    per_fold = m.six_metrics(scored, ["model", fold], y)
    return m.mean_and_std(per_fold, SIX, ["model"])


def baseline_models(spec: FeatureSpec) -> dict[str, Pipeline]:
    """Prior, balanced logistic regression, balanced tree and balanced forest."""
    return {
        "prior": risk_pipeline(spec, kind="prior"),
        "logistic": risk_pipeline(spec, kind="logistic", balanced=True),
        "tree": risk_pipeline(spec, kind="tree", balanced=True, maxDepth=30),
        "forest": risk_pipeline(spec, kind="forest", balanced=True, numTrees=100, maxDepth=30),
    }


def tuned_logistic(spec: FeatureSpec) -> Pipeline:
    return risk_pipeline(spec, kind="logistic", C=1.0)


def tuned_forest(spec: FeatureSpec, trees: int = 500) -> Pipeline:
    return risk_pipeline(
        spec, kind="forest", numTrees=trees, maxDepth=10, minLeaf=4, subset="sqrt", balanced=True
    )


# ------------------------------------------------------------ tuning

# The two search spaces. Solver choices and minimum split sizes have no
# Spark counterpart; unlimited depth and depth 50 become 30, the per-bootstrap balance
# becomes the plain one.
LOGISTIC_SPACE = {
    "C": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0],
    "balanced": [True, False],
    "maxIter": [2000, 5000],
}
FOREST_SPACE = {
    "numTrees": [100, 200, 300, 500],
    "maxDepth": [10, 20, 30],
    "minLeaf": [1, 2, 4],
    "subset": ["sqrt", "log2", "all"],
    "balanced": [True, False],
}


def draw_params(space: dict[str, list], n_iter: int, seed: int) -> list[dict]:
    """``n_iter`` distinct points of a discrete grid (all of it if it is smaller)."""
    names = sorted(space)
    grid = [dict(zip(names, values)) for values in itertools.product(*[space[n] for n in names])]
    return random.Random(seed).sample(grid, min(n_iter, len(grid)))


def random_search(
    df: DataFrame,
    pipeline: Pipeline,
    space: dict[str, list],
    n_iter: int,
    k: int,
    fold: str = "fold",
    metric: str = "roc_auc",
    seed: int = SEED,
    parallelism: int = 2,
) -> tuple[PipelineModel, list[dict]]:
    """Best model refitted on all rows, and the mean score of every drawn point."""
    classifier = pipeline.getStages()[-1]
    points = draw_params(space, n_iter, seed)
    maps = [{classifier.getParam(n): v for n, v in point.items()} for point in points]
    found = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=maps,
        evaluator=RankEvaluator(metric, classifier.getOrDefault(classifier.labelCol)),
        numFolds=k,
        foldCol=fold,
        parallelism=parallelism,
    ).fit(df)
    trials = [{**point, "score": float(s)} for point, s in zip(points, found.avgMetrics)]
    return found.bestModel, trials


def nested_cv(
    df: DataFrame,
    pipeline: Pipeline,
    space: dict[str, list],
    n_iter: int,
    key: str,
    outer: int = 5,
    inner: int = 3,
    metric: str = "roc_auc",
    seed: int = SEED,
    y: str = LABEL,
    parallelism: int = 2,
) -> tuple[DataFrame, DataFrame, list[dict]]:
    """Unbiased scores of a tuned model.

    Returns per-fold scores, the metrics of the pooled out-of-fold predictions (at 0.5 where
    a threshold is needed) and the parameters each outer fold chose. Every search runs once;
    the searches of ``parallelism`` outer folds overlap.
    """
    outer_folds = durable(
        stratified_folds(df, key, y, outer, seed, "outer_fold"), "outer", "outer_fold"
    )

    def search(i: int) -> tuple[DataFrame, dict]:
        folded = stratified_folds(
            outer_folds.where(F.col("outer_fold") != i), key, y, inner, seed + 1, "inner_fold"
        )
        # every fit and evaluation reads the folds again
        train = durable(folded, "inner", "inner_fold")
        best, trials = random_search(
            train, pipeline, space, n_iter, inner, "inner_fold", metric, seed + 10 * i, parallelism
        )
        top = max(trials, key=lambda t: t["score"])
        held_out = outer_folds.where(F.col("outer_fold") == i)
        return add_score(held_out, best, keep=[y, "outer_fold"]), {"outer_fold": i, **top}

    parts, chosen = zip(*run_together(df.sparkSession, [partial(search, i) for i in range(outer)], parallelism))
    chosen = list(chosen)
    pooled = parts[0]
    for part in parts[1:]:
        pooled = pooled.unionByName(part)
    pooled = durable(pooled, "nested")
    per_fold = m.six_metrics(pooled, ["outer_fold"], y)
    return per_fold, m.six_metrics(pooled.withColumn("model", F.lit("pooled")), ["model"], y), chosen


def best_fold_params(per_fold: DataFrame, chosen: list[dict], metric: str = "roc_auc") -> dict:
    """Parameters chosen by the outer fold with the best held-out score (the first on a tie)."""
    best = per_fold.agg(
        F.min_by("outer_fold", F.struct(-F.col(metric), "outer_fold")).alias("fold")
    ).first()["fold"]
    found = next(c for c in chosen if c["outer_fold"] == best)
    return {k: v for k, v in found.items() if k not in ("outer_fold", "score")}


def with_params(pipeline: Pipeline, params: dict) -> Pipeline:
    """The same pipeline with other classifier parameters."""
    classifier = pipeline.getStages()[-1]
    return pipeline.copy({classifier.getParam(n): v for n, v in params.items()})


def tune_families(
    df: DataFrame,
    families: dict[str, tuple[Pipeline, dict[str, list]]],
    n_iter: int,
    key: str,
    metric: str = "roc_auc",
    **options,
) -> dict[str, dict]:
    """Nested search for several model families on the same rows.

    Per family: per-fold and pooled scores, the parameters of every outer fold, and the
    pipeline with the parameters of the best fold.
    """
    out = {}
    for name, (pipeline, space) in families.items():
        per_fold, pooled, chosen = nested_cv(df, pipeline, space, n_iter, key, metric=metric, **options)
        per_fold = durable(per_fold, "per-fold")
        params = best_fold_params(per_fold, chosen, metric)
        out[name] = {
            "per_fold": per_fold,
            "pooled": pooled,
            "chosen": chosen,
            "params": params,
            "pipeline": with_params(pipeline, params),
        }
    return out


def select_model(
    models: dict[str, Transformer], val: DataFrame, metric: str = "roc_auc", y: str = LABEL
) -> DataFrame:
    """``(model, score, selected)`` on validation rows; the first of equal scores wins.

    Models are fitted on training rows beforehand; fitting on the rows they are compared on
    would measure nothing.
    """
    if metric not in ("roc_auc", "average_precision"):
        raise ValueError(f"unsupported metric {metric}")
    parts = [
        add_score(val, model, keep=[y]).select(
            F.lit(i).alias("position"), F.lit(name).alias("model"), y, SCORE
        )
        for i, (name, model) in enumerate(models.items())
    ]
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    table = m.rank_metrics(scored, ["position", "model"], y).select(
        "position", "model", F.col(metric).alias("score")
    )
    best = table.agg(F.min_by("model", F.struct(-F.col("score"), "position")).alias("m")).first()["m"]
    return table.select("model", "score", (F.col("model") == best).alias("selected"))


def coefficient_table(model: PipelineModel) -> DataFrame:
    """``(feature, original, coefficient, direction, rank)`` of a logistic model, largest first."""
    logistic = next(s for s in reversed(model.stages) if isinstance(s, LogisticRegressionModel))
    origin = feature_origins(model)
    values = list(zip(feature_names(model), [float(v) for v in logistic.coefficients]))
    values.sort(key=lambda t: -abs(t[1]))
    return SparkSession.getActiveSession().createDataFrame(
        [
            (name, origin[name], v, "increases" if v > 0 else "decreases" if v < 0 else "none", i + 1)
            for i, (name, v) in enumerate(values)
        ],
        "feature string, original string, coefficient double, direction string, rank int",
    )
