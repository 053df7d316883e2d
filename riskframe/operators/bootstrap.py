"""Paired bootstrap of the cost and ROC-AUC difference between two models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import checked_p, checked_y
from ..functions.ranking import value_range_cuts, with_range
from ..session import ship_package
from ..spec import DEFAULT_COSTS, LABEL, CostScenario
from .split import SEED


def decision_cells(
    scored: DataFrame, p_a: str, p_b: str, threshold_a: float, threshold_b: float, y: str = LABEL
) -> DataFrame:
    """Rows per ``(y, prediction of a, prediction of b)``: eight cells at most."""
    return scored.groupBy(
        checked_y(F.col(y)).alias("y"),
        (checked_p(F.col(p_a)) >= F.lit(float(threshold_a))).cast("int").alias("a"),
        (checked_p(F.col(p_b)) >= F.lit(float(threshold_b))).cast("int").alias("b"),
    ).agg(F.count(F.lit(1)).alias("n"))


def _unit_cost(costs: CostScenario, y: int, pred: int) -> float:
    return {
        (0, 0): costs.cost_tn, (0, 1): costs.cost_fp, (1, 0): costs.cost_fn, (1, 1): costs.cost_tp,
    }[(y, pred)]


def cost_difference_replicates(
    scored: DataFrame,
    p_a: str,
    p_b: str,
    threshold_a: float,
    threshold_b: float,
    costs: CostScenario = DEFAULT_COSTS,
    replicates: int = 10_000,
    seed: int = SEED,
    y: str = LABEL,
) -> DataFrame:
    """``(replicate, cost_difference)`` of a minus b on resampled rows.

    Resampling n rows is one multinomial draw over the eight cells, so a replicate costs the
    same for any number of rows; replicates are spread over tasks, each with its own seed.
    """
    cells = decision_cells(scored, p_a, p_b, threshold_a, threshold_b, y).collect()
    if not cells:
        raise ValueError("nothing to resample")
    cells.sort(key=lambda r: (r["y"], r["a"], r["b"]))
    n = np.array([r["n"] for r in cells], dtype=np.int64)
    diff = np.array([_unit_cost(costs, r["y"], r["a"]) - _unit_cost(costs, r["y"], r["b"]) for r in cells])
    ship_package(scored.sparkSession)
    total, share = int(n.sum()), n / n.sum()

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [
                float(np.random.default_rng([seed, int(i)]).multinomial(total, share) @ diff)
                for i in pdf["id"]
            ]
            yield pd.DataFrame({"replicate": pdf["id"], "cost_difference": values})

    return scored.sparkSession.range(replicates).mapInPandas(
        draw, "replicate long, cost_difference double"
    )


def _bin_cells(
    scored: DataFrame, p_a: str, p_b: str, bins: int, y: str
) -> list:
    a, b = checked_p(F.col(p_a)), checked_p(F.col(p_b))
    rows = scored.select(checked_y(F.col(y)).alias("y"), a.alias("a"), b.alias("b"))
    for c in ("a", "b"):
        rows = with_range(rows, c, value_range_cuts(rows, c, bins), f"bin_{c}")
    return rows.groupBy("y", "bin_a", "bin_b").agg(F.count(F.lit(1)).alias("n")).collect()


def auc_difference_replicates(
    scored: DataFrame,
    p_a: str,
    p_b: str,
    bins: int = 100,
    replicates: int = 1_000,
    seed: int = SEED,
    y: str = LABEL,
) -> DataFrame:
    """``(replicate, auc_difference)`` of a minus b on resampled rows.

    Both scores are put in at most ``bins`` value ranges of equal size, so that resampling n
    rows is one multinomial draw over at most ``2 * bins ** 2`` cells (their number is the
    bound of what is collected and shipped). Pairs of rows in the same range count half:
    exact for scores with that few values, else off by less than one part in ``bins``.
    """
    if not 2 <= bins <= 500:
        raise ValueError("bins must be between 2 and 500")
    cells = sorted(_bin_cells(scored, p_a, p_b, bins, y))
    if len({r["y"] for r in cells}) < 2:
        raise ValueError("both classes are needed")
    n = np.array([r["n"] for r in cells], dtype=np.int64)
    label = np.array([r["y"] for r in cells])
    bin_a, bin_b = (np.array([r[c] for r in cells]) for c in ("bin_a", "bin_b"))
    total, share = int(n.sum()), n / n.sum()
    ship_package(scored.sparkSession)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = []
            for i in pdf["id"]:
                w = np.random.default_rng([seed, int(i)]).multinomial(total, share)
                values.append(binned_auc(bin_a, label, w) - binned_auc(bin_b, label, w))
            yield pd.DataFrame({"replicate": pdf["id"], "auc_difference": values})

    return scored.sparkSession.range(replicates).mapInPandas(
        draw, "replicate long, auc_difference double"
    )


def binned_auc(bins: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """Weighted ROC-AUC of ordered bins with half credit inside a bin."""
    size = int(bins.max()) + 1
    pos = np.bincount(bins, weight * (label == 1), size)
    neg = np.bincount(bins, weight * (label == 0), size)
    below = np.cumsum(neg) - neg
    pairs = pos.sum() * neg.sum()
    return float((pos * (below + neg / 2)).sum() / pairs) if pairs else float("nan")


def bootstrap_interval(
    replicates: DataFrame, value: str = "cost_difference", level: float = 0.95
) -> DataFrame:
    """``(replicates, mean, lower, upper)`` by the percentile method."""
    tail = (1.0 - level) / 2.0
    return replicates.agg(
        F.count(F.lit(1)).alias("replicates"),
        F.avg(value).alias("mean"),
        F.percentile(value, F.lit(tail)).alias("lower"),
        F.percentile(value, F.lit(1.0 - tail)).alias("upper"),
    )


def prefer_second(interval: DataFrame) -> DataFrame:
    """The pre-registered rule: take model b only if the whole interval of a - b is above zero."""
    return interval.withColumn("selected", F.when(F.col("lower") > 0, "b").otherwise("a"))
