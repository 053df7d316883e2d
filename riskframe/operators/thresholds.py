"""Threshold sweeps: confusion counts and rates for a whole grid in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import checked_p, checked_y, literal_array
from ..functions.ranking import with_range
from ..spec import LABEL, SCORE, check_grid, threshold_grid


# numerator and denominator of every rate over the four counts
_RATES = {
    "precision": ("tp", "tp + fp"),
    "recall": ("tp", "tp + fn"),
    "f1": ("2 * tp", "2 * tp + fp + fn"),
    "accuracy": ("tp + tn", "tn + fp + fn + tp"),
    "specificity": ("tn", "tn + fp"),
    "npv": ("tn", "tn + fn"),
    "fpr": ("fp", "fp + tn"),
    "fnr": ("fn", "fn + tp"),
    "positive_rate": ("tp + fp", "tn + fp + fn + tp"),
}


def with_rates(counts: DataFrame) -> DataFrame:
    """Add every rate to a table of ``tn, fp, fn, tp``; zero where the denominator is zero."""
    return counts.select(
        "*",
        *[
            F.expr(f"coalesce(try_divide({num}, {den}), 0D)").alias(name)
            for name, (num, den) in _RATES.items()
        ],
    )


def score_histogram(
    scored: DataFrame, grid: Sequence[float], by: Sequence[str] = (), y: str = LABEL, p: str = SCORE
) -> DataFrame:
    """Labels counted between neighbouring thresholds: ``(*by, k, pos, neg)``.

    ``k`` is the number of thresholds at or below the score. Aggregated map-side, so a
    task ships at most ``len(grid) + 1`` rows per group whatever its input.
    """
    checked = scored.select(*by, checked_y(F.col(y)).alias("_y"), checked_p(F.col(p)).alias("_p"))
    return (
        with_range(checked, "_p", grid, "k")
        .groupBy(*by, "k")
        .agg(
            F.sum(F.col("_y")).cast("bigint").alias("pos"),
            F.sum(1 - F.col("_y")).cast("bigint").alias("neg"),
        )
    )


def sweep_counts(
    scored: DataFrame,
    grid: Sequence[float] | None = None,
    by: Sequence[str] = (),
    y: str = LABEL,
    p: str = SCORE,
) -> DataFrame:
    """``(*by, threshold, tn, fp, fn, tp)`` for every threshold of the grid.

    One scan, one small shuffle. An empty table without groups fails.
    """
    grid = check_grid(grid if grid is not None else threshold_grid())
    by = list(by)
    hist = score_histogram(scored, grid, by, y, p)
    # at most len(grid) + 1 entries per group
    packed = hist.groupBy(*by).agg(
        F.collect_list(F.struct("k", "pos", "neg")).alias("h"),
        F.sum("pos").alias("all_pos"),
        F.sum("neg").alias("all_neg"),
    )
    total = F.when(
        F.col("all_pos").isNull(), F.raise_error(F.lit("no rows to evaluate")).cast("bigint")
    ).otherwise(F.col("all_pos"))

    def reached(field: str) -> Column:
        return F.aggregate(
            "h",
            F.lit(0).cast("bigint"),
            lambda acc, e: acc + F.when(e["k"] > F.col("i"), e[field]).otherwise(F.lit(0)),
        )

    rows = packed.withColumn("all_pos", total).select(
        *by,
        "h",
        "all_pos",
        "all_neg",
        F.posexplode(literal_array(grid)).alias("i", "threshold"),
    )
    return rows.select(
        *by, "threshold", "all_pos", "all_neg", reached("pos").alias("tp"), reached("neg").alias("fp")
    ).select(
        *by,
        "threshold",
        (F.col("all_neg") - F.col("fp")).alias("tn"),
        "fp",
        (F.col("all_pos") - F.col("tp")).alias("fn"),
        "tp",
    )


def threshold_sweep(
    scored: DataFrame,
    grid: Sequence[float] | None = None,
    by: Sequence[str] = (),
    y: str = LABEL,
    p: str = SCORE,
) -> DataFrame:
    """Counts and rates for every threshold of the grid (99 hundredths by default)."""
    return with_rates(sweep_counts(scored, grid, by, y, p))


def candidate_thresholds(
    sweep: DataFrame,
    by: Sequence[str] = (),
    default: float = 0.50,
    min_precision: float = 0.50,
    min_recall: float = 0.60,
) -> DataFrame:
    """``(*by, criterion, threshold)`` for four usual choices.

    Ties go to the lowest threshold; a criterion no threshold meets gives NULL.
    """
    t = F.col("threshold")

    def best(metric: str, keep: Column | None = None) -> Column:
        rank = F.struct(F.col(metric), -t)
        return F.max_by(t, F.when(keep, rank) if keep is not None else rank)

    picks = {
        "default": F.min(F.when(F.abs(t - F.lit(default)) < 1e-6, t)),
        "f1_optimal": best("f1"),
        "recall_oriented": best("recall", F.col("precision") >= min_precision),
        "precision_oriented": best("precision", F.col("recall") >= min_recall),
    }
    wide = sweep.groupBy(*by).agg(*[e.alias(n) for n, e in picks.items()])
    return wide.select(
        *by,
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("criterion"), F.col(n).alias("threshold")) for n in picks])
        ).alias("c"),
    ).select(*by, "c.criterion", "c.threshold")


def confusion_at(
    scored: DataFrame, threshold: float, by: Sequence[str] = (), y: str = LABEL, p: str = SCORE
) -> DataFrame:
    """Counts and rates at one threshold."""
    return threshold_sweep(scored, [threshold], by, y, p)
