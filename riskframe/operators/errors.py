"""Error analysis of a scored table at a fixed threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import checked_p, checked_y, literal_array, outcome, safe_div
from ..functions.ranking import exact_quantiles
from ..session import require_small
from ..spec import LABEL, SCORE

# Outcome labels, half width of the borderline band, confident-error limits.
OUTCOMES = ("TN", "FP", "FN", "TP")
BAND, LOW_SCORE, HIGH_SCORE = 0.10, 0.20, 0.80


def with_outcome(scored: DataFrame, threshold: float, y: str = LABEL, p: str = SCORE) -> DataFrame:
    """Add the predicted label and TN/FP/FN/TP to every row."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be in [0, 1]")
    pred = (checked_p(F.col(p)) >= F.lit(float(threshold))).cast("int")
    return scored.withColumn("prediction", pred).withColumn(
        "outcome", outcome(checked_y(F.col(y)), F.col("prediction"))
    )


def _outcome_counts():
    return [F.count_if(F.col("outcome") == o).alias(o.lower()) for o in OUTCOMES]


def error_rates(scored: DataFrame, threshold: float, by: Sequence[str] = (), y: str = LABEL, p: str = SCORE) -> DataFrame:
    """All four counts (zero when absent) and the three rates."""
    c = with_outcome(scored, threshold, y, p).groupBy(*by).agg(*_outcome_counts())
    return c.select(
        "*",
        safe_div(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_positive_rate"),
        safe_div(F.col("fn"), F.col("fn") + F.col("tp")).alias("false_negative_rate"),
        safe_div(
            F.col("tp") + F.col("fp"), F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
        ).alias("positive_prediction_rate"),
    )


def error_slices(
    scored: DataFrame, threshold: float, columns: Sequence[str], y: str = LABEL, p: str = SCORE
) -> DataFrame:
    """Counts and error rates for every value of every column: one scan, one shuffle.

    Rates without a base are NULL. Rows with a NULL value form no slice.
    """
    require_small(list(columns), "slice columns")
    long = (
        with_outcome(scored, threshold, y, p)
        .select(
            "outcome",
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                        for c in columns
                    ]
                )
            ).alias("s"),
        )
        .select("outcome", "s.column", "s.value")
        .where(F.col("value").isNotNull())
    )
    c = long.groupBy("column", "value").agg(*_outcome_counts(), F.count(F.lit(1)).alias("total"))
    return c.select(
        "*",
        safe_div(F.col("fp"), F.col("fp") + F.col("tn"), None).alias("fp_rate"),
        safe_div(F.col("fn"), F.col("fn") + F.col("tp"), None).alias("fn_rate"),
    )


def error_numeric(
    scored: DataFrame, threshold: float, columns: Sequence[str], y: str = LABEL, p: str = SCORE
) -> DataFrame:
    """Count, mean and exact median of numeric columns per outcome; NULL when empty."""
    columns = require_small(list(columns), "numeric columns", 500)
    long = (
        with_outcome(scored, threshold, y, p)
        .select(
            "outcome",
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                        for c in columns
                    ]
                )
            ).alias("s"),
        )
        .select("s.column", "outcome", "s.value")
    )
    stats = exact_quantiles(
        long, ["column", "outcome"], "value", [0.5], groups=len(columns) * len(OUTCOMES),
        extra={"mean": F.avg("_v")},
    ).select("column", "outcome", F.col("n_values").alias("n"), "mean", F.col("quantile").alias("median"))
    spine = (
        long.sparkSession.range(1)
        .select(F.explode(literal_array(columns)).alias("column"))
        .withColumn("outcome", F.explode(literal_array(OUTCOMES)))
    )
    return (
        spine.join(stats, ["column", "outcome"], "left")
        .select("column", "outcome", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "mean", "median")
    )


def hard_cases(
    scored: DataFrame,
    threshold: float,
    band: float = BAND,
    low: float = LOW_SCORE,
    high: float = HIGH_SCORE,
    by: Sequence[str] = (),
    y: str = LABEL,
    p: str = SCORE,
) -> DataFrame:
    """Rows near the threshold and confident errors, counted in one aggregation."""
    o = with_outcome(scored, threshold, y, p)
    near = (F.col(p) >= F.lit(threshold - band)) & (F.col(p) <= F.lit(threshold + band))
    wrong = F.col("outcome").isin("FP", "FN")
    c = o.groupBy(*by).agg(
        F.count_if(near).alias("borderline_count"),
        F.count_if(near & wrong).alias("borderline_error_count"),
        F.count_if((F.col("outcome") == "FP") & (F.col(p) >= high)).alias("high_confidence_fp_count"),
        F.count_if((F.col("outcome") == "FN") & (F.col(p) <= low)).alias("high_confidence_fn_count"),
    )
    return c.withColumn(
        "borderline_error_rate", safe_div(F.col("borderline_error_count"), F.col("borderline_count"))
    )
