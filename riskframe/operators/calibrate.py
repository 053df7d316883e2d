"""Probability calibration: sigmoid and isotonic, cross-fitted comparison, selection."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import partial

import pandas as pd
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import checked_p, checked_y, logit
from ..functions.ranking import value_range_cuts, with_range
from ..session import durable, require_small, run_together
from ..spec import LABEL, SCORE
from . import metrics as m

# Clipping of raw probabilities, selection tolerances, method names.
CLIP_EPS = 1e-6
LOG_LOSS_TOLERANCE = 1e-4
BRIER_TOLERANCE = 1e-4
METHODS = ("sigmoid", "isotonic")
CALIBRATED = "calibrated"
FAN_IN = 16  # stretches of scores whose blocks one task pools


class PositiveScore(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Takes the positive-class probability out of the probability vector."""

    outputCol = Param(Params._dummy(), "outputCol", "score column", TypeConverters.toString)

    def __init__(self, outputCol: str = SCORE):
        super().__init__()
        self._set(outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(
            self.getOrDefault(self.outputCol), vector_to_array("probability")[1]
        )


class _ScoreCalibrator(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns a map from raw to calibrated probability from ``(y, p)`` rows.

    Fitting works on distinct scores with counts, never on single rows. The fitted model
    reads column ``p`` and adds ``calibrated``; it is made of built-in stages and can be saved.
    """

    labelCol = Param(Params._dummy(), "labelCol", "0/1 label", TypeConverters.toString)
    scoreCol = Param(Params._dummy(), "scoreCol", "raw probability", TypeConverters.toString)

    def __init__(self, labelCol: str = LABEL, scoreCol: str = SCORE):
        super().__init__()
        self._set(labelCol=labelCol, scoreCol=scoreCol)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        # Label and range checks happen while counting. Written once: the fit reads the
        # distinct scores several times, the rows behind them only here.
        table = m.score_table(
            dataset, y=self.getOrDefault(self.labelCol), p=self.getOrDefault(self.scoreCol)
        )
        return self.fit_scores(durable(table, "scores"))

    def fit_scores(self, table: DataFrame) -> PipelineModel:
        """Fit on distinct scores with their positives and negatives: ``(p, pos, neg)``."""
        raise NotImplementedError


class SigmoidCalibrator(_ScoreCalibrator):
    """L2-regularised (C = 1) logistic regression on the clipped log-odds."""

    def fit_scores(self, table: DataFrame) -> PipelineModel:
        name = self.getOrDefault(self.scoreCol)
        total = table.agg(F.sum(F.col("pos") + F.col("neg")).alias("n")).first()["n"]
        if not total:
            raise ValueError("cannot calibrate on an empty table")
        cells = table.select(
            logit(F.col("p"), CLIP_EPS).alias("z"),
            F.explode(
                F.array(
                    F.struct(F.lit(1.0).alias("label"), F.col("pos").cast("double").alias("w")),
                    F.struct(F.lit(0.0).alias("label"), F.col("neg").cast("double").alias("w")),
                )
            ).alias("c"),
        ).select("z", "c.label", "c.w").where("w > 0")
        fitted = LogisticRegression(
            featuresCol="v", labelCol="label", weightCol="w", regParam=1.0 / total,
            elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-12,
        ).fit(VectorAssembler(inputCols=["z"], outputCol="v").transform(cells))
        slope, shift = float(fitted.coefficients[0]), float(fitted.intercept)
        q = f"least(greatest(`{name}`, {CLIP_EPS!r}D), {1.0 - CLIP_EPS!r}D)"
        z = f"({slope!r}D * ln({q} / (1D - {q})) + {shift!r}D)"
        return PipelineModel(
            stages=[SQLTransformer(statement=f"SELECT *, 1D / (1D + exp(-{z})) AS {CALIBRATED} FROM __THIS__")]
        )


def _pool(rows: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring blocks of one stretch of scores, pooled until their rates increase."""
    node = rows["node"].iloc[0] // FAN_IN
    stack: list[list] = []
    for block in rows.sort_values("lo")[["lo", "hi", "pos", "n"]].itertuples(index=False, name=None):
        lo, hi, pos, n = block
        pos, n = int(pos), int(n)
        # whole numbers: rates are compared without rounding
        while stack and stack[-1][2] * n >= pos * stack[-1][3]:
            lo, _, before, size = stack.pop()
            pos, n = pos + before, n + size
        stack.append([lo, hi, pos, n])
    out = pd.DataFrame(stack, columns=["lo", "hi", "pos", "n"])
    out.insert(0, "node", node)
    return out


def pooled_blocks(table: DataFrame, ranges: int | None = None) -> DataFrame:
    """``(lo, hi, pos, n)``: the blocks of equal fitted rate that isotonic regression forms.

    ``table`` has distinct scores ``(p, pos, neg)``. Scores are cut into ranges; each task
    pools the blocks of one range, then of 16 neighbouring stretches, up a tree to all of
    them: blocks pooled in a part stay pooled in the whole, so a stretch hands on only the
    blocks it is left with. What the last step holds is the fitted function.
    """
    cuts = value_range_cuts(table, "p", ranges)
    n = (F.col("pos") + F.col("neg")).alias("n")
    blocks = with_range(table, "p", cuts, "_range").select(
        # the first step divides the number like every other
        (F.col("_range").cast("long") * FAN_IN).alias("node"), F.col("p").alias("lo"), F.col("p").alias("hi"), "pos", n
    )
    stretches = FAN_IN * (len(cuts) + 1)
    while stretches > 1:
        stretches = -(-stretches // FAN_IN)
        blocks = blocks.groupBy(F.expr(f"node div {FAN_IN}")).applyInPandas(_pool, "node long, lo double, hi double, pos long, n long")
    return blocks.drop("node")


class IsotonicCalibrator(_ScoreCalibrator):
    """Non-decreasing fit; linear between its points, constant outside them.

    The blocks are pooled up a tree of score ranges; the built-in regression, whose model is
    saved and applied, gets their two ends and finds nothing left to pool.
    """

    def fit_scores(self, table: DataFrame) -> PipelineModel:
        name = self.getOrDefault(self.scoreCol)
        if table.isEmpty():
            raise ValueError("cannot calibrate on an empty table")
        blocks = durable(pooled_blocks(table), "blocks")
        rate = (F.col("pos") / F.col("n")).alias("rate")
        ends = blocks.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias(name), rate)
        fitted = IsotonicRegression(
            featuresCol=name, labelCol="rate", predictionCol=CALIBRATED, isotonic=True
        ).fit(ends)
        return PipelineModel(stages=[fitted])


CALIBRATORS = {"sigmoid": SigmoidCalibrator, "isotonic": IsotonicCalibrator}


def build_calibrator(method: str, **kw) -> _ScoreCalibrator:
    if method not in CALIBRATORS:
        raise ValueError(f"unknown calibration method {method}")
    return CALIBRATORS[method](**kw)


def fit_calibrator(scored: DataFrame, method: str) -> PipelineModel:
    """The chosen calibrator on all out-of-fold rows."""
    return build_calibrator(method).fit(scored)


def sigmoid_parameters(model: PipelineModel) -> str:
    """The calibration expression of a fitted sigmoid model."""
    return model.stages[0].getStatement()


def calibrated_pipeline(scorer: PipelineModel, calibrator: PipelineModel, score: str = SCORE) -> PipelineModel:
    """Preprocessing, model and calibrator as one saved model that is never refitted."""
    return PipelineModel(stages=[*scorer.stages, PositiveScore(score), *calibrator.stages])


def apply_calibrator(df: DataFrame, calibrator: PipelineModel, p: str = SCORE) -> DataFrame:
    """Replace the raw probability by the calibrated one."""
    columns = df.columns
    out = calibrator.transform(df)
    return out.select(*[F.col(CALIBRATED).alias(c) if c == p else F.col(c) for c in columns])


def _counts_by_fold(base: DataFrame, k: int) -> DataFrame:
    """``(p, pos, neg, pos_0, neg_0, ...)``: the rows of each score, in all folds and in each."""
    y, folds = F.col("_y"), require_small(list(range(k)), "folds", 1_000)
    sums = [F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")]
    for i in folds:
        here = F.col("fold") == i
        sums += [F.sum(F.when(here, y).otherwise(0)).alias(f"pos_{i}"), F.sum(F.when(here, 1 - y).otherwise(0)).alias(f"neg_{i}")]
    rows = base.select("fold", checked_p(F.col(SCORE)).alias("p"), checked_y(F.col(LABEL)).cast("long").alias("_y"))
    return rows.groupBy("p").agg(*sums)


def _without_fold(counts: DataFrame, i: int) -> DataFrame:
    left = counts.select("p", (F.col("pos") - F.col(f"pos_{i}")).alias("pos"), (F.col("neg") - F.col(f"neg_{i}")).alias("neg"))
    return left.where(F.col("pos") + F.col("neg") > 0)


def cross_fit_calibration(
    scored: DataFrame, fold: str, k: int, methods: Sequence[str] = METHODS, parallelism: int = 4
) -> DataFrame:
    """Held-out calibrated rows per method: ``(method, fold, y, p)``, baseline included.

    The rows are shuffled once, into one table of distinct scores with the counts of all
    folds; what a fit learns from is the total minus its fold, a projection of that table.
    """
    base = durable(scored.select(F.col(fold).alias("fold"), LABEL, SCORE), "folds", "fold")
    counts = durable(_counts_by_fold(base, k), "fold-scores")
    parts = [base.select(F.lit("baseline").alias("method"), "fold", LABEL, SCORE)]

    def held_out(method: str, i: int) -> DataFrame:
        model = build_calibrator(method).fit_scores(_without_fold(counts, i))
        rows = apply_calibrator(base.where(F.col("fold") == i), model)
        return rows.select(F.lit(method).alias("method"), "fold", LABEL, SCORE)

    tasks = [partial(held_out, method, i) for method, i in itertools.product(methods, range(k))]
    parts += run_together(base.sparkSession, tasks, parallelism)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return durable(out, "calibration")


def calibration_fold_metrics(crossed: DataFrame) -> DataFrame:
    """``(method, fold, log_loss, brier, roc_auc, average_precision)``."""
    by = ["method", "fold"]
    losses = m.probability_losses(crossed, by).drop("n")
    return losses.join(m.rank_metrics(crossed, by), by)


def calibration_table(per_fold: DataFrame) -> DataFrame:
    """Mean of each metric per method and the fold values behind two of them."""
    ordered = F.sort_array(F.collect_list(F.struct("fold", "log_loss", "brier")))
    return per_fold.groupBy("method").agg(
        *[F.avg(c).alias(c) for c in ("log_loss", "brier", "roc_auc", "average_precision")],
        F.transform(ordered, lambda s: s["log_loss"]).alias("fold_log_loss"),
        F.transform(ordered, lambda s: s["brier"]).alias("fold_brier"),
    )


def select_calibration(
    table: DataFrame,
    log_loss_tolerance: float = LOG_LOSS_TOLERANCE,
    brier_tolerance: float = BRIER_TOLERANCE,
) -> DataFrame:
    """``(selected_method, decision_rule, ...)``: log loss, then Brier score, then sigmoid."""

    def of(method: str, metric: str):
        return F.max(F.when(F.col("method") == method, F.col(metric)))

    row = table.agg(
        *[of(a, b).alias(f"{a}_{b}") for a in METHODS for b in ("log_loss", "brier")]
    )
    ll = F.col("sigmoid_log_loss") - F.col("isotonic_log_loss")
    br = F.col("sigmoid_brier") - F.col("isotonic_brier")
    by_loss, by_brier = F.abs(ll) > log_loss_tolerance, F.abs(br) > brier_tolerance
    method = (
        F.when(by_loss, F.when(ll < 0, "sigmoid").otherwise("isotonic"))
        .when(by_brier, F.when(br < 0, "sigmoid").otherwise("isotonic"))
        .otherwise("sigmoid")
    )
    rule = F.when(by_loss, "log_loss").when(by_brier, "brier").otherwise("tie_break_prefer_sigmoid")
    return row.select(
        method.alias("selected_method"), rule.alias("decision_rule"), *row.columns
    )
