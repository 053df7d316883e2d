"""Many logistic fits at once: every fold and penalty takes its Newton step in the same pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics
from ..functions.expressions import checked_y
from ..session import durable, require_small, ship_package
from ..spec import LABEL

ROWS = 4_096  # rows whose products are held at once
NO_FOLD = -1  # leaves no fold out


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, folds: np.ndarray, beta: np.ndarray, left_out: np.ndarray) -> np.ndarray:
    """Of each point, over the rows of its training folds: gradient and Hessian, side by side.

    ``folds`` has a row's first and second fold, ``left_out`` those a point leaves out.
    """
    mu = 1 / (1 + np.exp(-np.clip(x @ beta.T, -700, 700)))
    weight = w[:, None] * (folds[:, None, :] != left_out).all(axis=2)
    gradient = (weight * (mu - y[:, None])).T @ x
    squares = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
    return np.concatenate([gradient, (weight * mu * (1 - mu)).T @ squares], axis=1)


def logistic_points(
    df: DataFrame, features: Sequence[str], penalties: Sequence[float], folds: Sequence = (NO_FOLD,),
    fold: str | None = None, label: str = LABEL, weight: str | None = None, steps: int = 50, tolerance: float = 1e-10,
    second: str | None = None,
) -> DataFrame:
    """``(fold, C, intercept, coefficients, steps)`` of an L2 logistic fit per left-out fold and ``C``.

    The loss is summed, the intercept is free, ``C`` is the inverse penalty. All points share
    the passes: a pass adds up the gradients and Hessians of all of them, task by task and
    then in Spark, and the driver solves one small system for each point. The number of jobs
    is the number of steps (under ten as a rule), whatever the number of points. A fold in
    which a class is missing from the training rows is an error, as are NULL features.

    With ``second``, another fold column, ``folds`` has pairs: a point leaves out the rows of
    its first fold and those of its second one, which the result names ``second``.
    """
    spark = df.sparkSession
    ship_package(spark)
    pairs = [(int(g[0]), int(g[1])) if second else (int(g), NO_FOLD) for g in folds]
    points = require_small([(*g, float(c)) for g in pairs for c in penalties], "points", 2_000)
    names = require_small(list(features), "features", 500)
    value = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"NULL in {c}"))).otherwise(F.col(c).cast("double"))
    rows = durable(
        df.select(
            checked_y(F.col(label)).cast("double").alias("_y"),
            (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"),
            (F.col(fold).cast("long") if fold else F.lit(NO_FOLD - 1).cast("long")).alias("_fold"),
            (F.col(second).cast("long") if second else F.lit(NO_FOLD - 1).cast("long")).alias("_second"),
            *[value(c).alias(f"_x{i}") for i, c in enumerate(names)],
        ),
        "logistic-rows",
    )
    seen = {(r["_fold"], r["_second"], int(r["_y"])) for r in rows.select("_fold", "_second", "_y").distinct().collect()}
    for g, h in set(pairs):
        if {y for f, s, y in seen if f != g and s != h} != {0, 1}:
            raise ValueError(f"a class is missing without fold {g}" + (f" and {h}" if second else ""))
    left_out = np.array([p[:2] for p in points])
    d = len(names) + 1
    ridge = np.array([[0.0] + [1 / p[2]] * (d - 1) for p in points])
    beta = np.zeros((len(points), d))
    for step in range(1, steps + 1):
        now = beta.copy()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(left_out), d + d * d))
            for batch in batches:
                for begin in range(0, batch.num_rows, ROWS):
                    y, w, f, g, *x = (c.to_numpy(zero_copy_only=False) for c in batch.slice(begin, ROWS).columns)
                    total += _sums(np.column_stack([np.ones(len(y)), *x]), y, w, np.column_stack([f, g]), now, left_out)
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel()[cell])], ["cell", "value"])

        cells = rows.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
        total = np.zeros(len(points) * (d + d * d))
        for r in cells:
            total[r["cell"]] = r["value"]
        total = total.reshape(len(points), -1)
        gradient = total[:, :d] + ridge * beta
        hessian = total[:, d:].reshape(-1, d, d) + ridge[:, :, None] * np.eye(d)
        move = np.linalg.solve(hessian, gradient[:, :, None])[:, :, 0]
        # a step of a free scale can overshoot where classes are far apart
        longest = np.abs(move).max(axis=1, keepdims=True)
        beta = beta - move * np.minimum(1.0, 10.0 / np.maximum(longest, 1e-300))
        if longest.max() < tolerance:
            break
    out = [(g, h, c, float(b[0]), [float(v) for v in b[1:]], step) for (g, h, c), b in zip(points, beta)]
    fitted = spark.createDataFrame(out, "fold long, second long, C double, intercept double, coefficients array<double>, steps int")
    return fitted if second else fitted.drop("second")


def _score(features: Sequence[str]):
    z = F.col("intercept")
    for i, c in enumerate(features):
        z = z + F.col("coefficients")[i] * F.col(c)
    return 1 / (1 + F.exp(-z))


def grid_scores(df: DataFrame, fitted: DataFrame, features: Sequence[str], fold: str, keep: Sequence[str]) -> DataFrame:
    """Out-of-fold probabilities of every ``C``: ``(*keep, C, p)``, each row by the fit without its fold."""
    lit = F.broadcast(fitted.select(F.col("fold").alias("_g"), "C", "intercept", "coefficients"))  # at most 2,000 points
    return df.join(lit, F.col(fold) == F.col("_g")).select(*keep, "C", _score(features).alias("p"))


def nested_search(
    df: DataFrame, features: Sequence[str], penalties: Sequence[float], outer: str, inner: str, folds: tuple[int, int],
    keep: Sequence[str], label: str = LABEL,
) -> tuple[DataFrame, DataFrame]:
    """Nested cross-validation of the penalty: held-out scores, and the trials behind them.

    ``outer`` and ``inner`` are two fold columns numbered from 0, ``folds`` their sizes. For each
    outer fold the penalty of the best mean ROC-AUC over the inner folds of the other rows wins
    (ties, at nine decimals: the smaller ``C``), and its fit on all of them scores the fold. All fits
    of all folds are points of one ``logistic_points`` call. Returns ``(*keep, outer, C, p)`` and
    ``(outer, C, roc_auc)``.
    """
    pairs = [(g, h) for g in range(folds[0]) for h in (NO_FOLD, *range(folds[1]))]
    fitted = logistic_points(df, features, penalties, pairs, outer, label, second=inner)
    points = fitted.withColumnsRenamed({"fold": "_g", "second": "_h"})  # at most 2,000
    # a row is tried by the points that learned neither from its inner nor from the outer fold
    met = (F.col(inner) == F.col("_h")) & (F.col(outer) != F.col("_g"))
    tried = df.join(F.broadcast(points.where(F.col("_h") != NO_FOLD)), met).select(
        "_g", "_h", "C", F.col(label).alias("y"), _score(features).alias("p")
    )
    by_fold = durable(metrics.rank_metrics(tried, ["_g", "_h", "C"]), "trials")
    trials = by_fold.groupBy(F.col("_g").alias(outer), "C").agg(F.avg("roc_auc").alias("roc_auc"))
    best = trials.groupBy(F.col(outer).alias("_o")).agg(
        F.max_by("C", F.struct(F.round("roc_auc", 9), -F.col("C"))).alias("_c")
    )
    whole = points.where(F.col("_h") == NO_FOLD)
    chosen = whole.join(best, (F.col("_g") == F.col("_o")) & (F.col("C") == F.col("_c")))
    scored = df.join(F.broadcast(chosen), F.col(outer) == F.col("_g"))
    return scored.select(*dict.fromkeys([*keep, outer]), "C", _score(features).alias("p")), trials
