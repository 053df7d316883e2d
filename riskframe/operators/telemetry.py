"""Scoring telemetry: one event per scoring call, summaries over event tables.

Events hold counts only - no input values and no row-level probabilities.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import value_range_cuts, with_range

# The event schema and the error categories.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_type", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("prediction_count", T.LongType()),
        T.StructField("positive_predictions", T.LongType()),
        T.StructField("negative_predictions", T.LongType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("model_artifact_hash", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("error_category", T.StringType()),
        T.StructField("batch_size", T.LongType()),
    ]
)
ERROR_CATEGORIES = (
    "validation_error",
    "inference_error",
    "artifact_integrity_error",
    "artifact_load_error",
    "unknown_error",
)
# categories with a counter of their own
COUNTED = ERROR_CATEGORIES[:4]


def error_category(exc: BaseException) -> str:
    """Category of a failed scoring call: the exception's own, or that of what caused it."""
    seen = []
    while exc is not None and exc not in seen:
        own = getattr(exc, "category", None)
        if own in ERROR_CATEGORIES:
            return own
        seen.append(exc)
        exc = exc.__cause__
    return "unknown_error"


def scoring_event(
    spark: SparkSession,
    event_type: str,
    latency_ms: float,
    threshold: float,
    prediction_count: int = 0,
    positive_predictions: int = 0,
    model_artifact_hash: str | None = None,
    failure: str | None = None,
    batch_size: int | None = None,
    timestamp: datetime | None = None,
) -> DataFrame:
    """One event row; ``failure`` names the error category of a failed call."""
    if failure is not None and failure not in ERROR_CATEGORIES:
        raise ValueError(f"unknown error category {failure}")
    row = (
        event_type,
        timestamp or datetime.now(timezone.utc),
        int(prediction_count),
        int(positive_predictions),
        int(prediction_count - positive_predictions),
        float(latency_ms),
        float(threshold),
        model_artifact_hash,
        failure is None,
        failure,
        batch_size,
    )
    return spark.createDataFrame([row], EVENT_SCHEMA)


def observed(labelled: DataFrame, prediction: str = "prediction") -> tuple[DataFrame, Observation]:
    """Count rows and positives of a scored table while it is written, without a second pass."""
    watch = Observation()
    return (
        labelled.observe(
            watch,
            F.count(F.lit(1)).alias("prediction_count"),
            F.coalesce(F.sum(F.col(prediction)), F.lit(0)).alias("positive_predictions"),
        ),
        watch,
    )


def summary_columns() -> list[Column]:
    ok = F.col("success")
    return [
        F.count(F.lit(1)).alias("invocation_count"),
        F.count_if(ok).alias("success_count"),
        F.count_if(~ok).alias("failure_count"),
        *[
            F.count_if(~ok & (F.col("error_category") == c)).alias(
                c.replace("_error", "_failure_count")
            )
            for c in COUNTED
        ],
        F.coalesce(F.sum("prediction_count"), F.lit(0)).alias("total_predictions"),
        F.coalesce(F.sum("positive_predictions"), F.lit(0)).alias("positive_predictions"),
        F.coalesce(F.sum("negative_predictions"), F.lit(0)).alias("negative_predictions"),
    ]


def telemetry_summary(
    events: DataFrame, by: Sequence[str] = (), window: str | None = None
) -> DataFrame:
    """Calls, outcomes and predictions, overall or per tumbling window of event time.

    Works on a batch table and, with a watermark set, on a stream. An unknown error counts
    as a failure but in no specific counter.
    """
    keys: list[Column] = [F.col(b) for b in by]
    if window:
        keys = [F.window("timestamp", window).alias("window"), *keys]
    out = events.groupBy(*keys).agg(*summary_columns())
    if window:
        rest = [c for c in out.columns if c != "window"]
        out = out.select(
            F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *rest
        )
    return out


def with_invocation_number(
    events: DataFrame, collector: str, time: str, tie: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Running call number per collector by event time (then the ``tie`` columns).

    A collector may hold any share of the events: time is cut into ranges of about equal
    numbers of events, a number is the offset of its range plus a rank inside it.
    """
    timed = events.withColumn("_t", F.unix_micros(time).cast("double"))
    tagged = with_range(timed, "_t", value_range_cuts(timed, "_t", ranges), "_range")
    before = Window.partitionBy(collector).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(collector, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            F.col(collector).alias("_c"),
            F.col("_range").alias("_r"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        )
    )
    w = Window.partitionBy(collector, "_range").orderBy("_t", *tie)
    numbered = tagged.withColumn("_rn", F.row_number().over(w))
    cond = F.col(collector).eqNullSafe(F.col("_c")) & F.col("_range").eqNullSafe(F.col("_r"))
    return numbered.join(offsets, cond).select(
        *events.columns, (F.col("_before") + F.col("_rn")).cast("bigint").alias("invocation_count")
    )
