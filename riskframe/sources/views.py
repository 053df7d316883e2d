"""Scored and labelled views over the generated star-schema tables.

``scored_documents`` is a document-quality risk score with pinned coefficients (they play
a saved model), ``scored_returns`` a large scored table without signal, ``accounts`` an
account table with the flaws cleaning and validation have to deal with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import sigmoid

# Pinned model (intercept, weights) and a weaker rival used for comparisons.
DOC_INTERCEPT = 9.72
DOC_WEIGHTS = {"dw": -11.06, "log_chars": -0.50}
RIVAL_INTERCEPT = 2.90
RIVAL_WEIGHTS = {"dw": -6.00, "log_chars": 0.0}
SNAPSHOT_YEAR = 1997


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def linear_score(weights: dict[str, float], intercept: float) -> Column:
    """Log-odds of a pinned linear model as a plain column expression."""
    z = F.lit(float(intercept))
    for name, w in weights.items():
        z = z + F.lit(float(w)) * F.col(name)
    return z


def documents_with_features(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """Documents with numeric features; all of them (``y`` NULL without a label) or the labelled ones.

    The text is reduced before the join.
    """
    words = F.split(F.col("text"), " ", -1)
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        (F.size(F.array_distinct(words)) / F.size(words)).alias("dw"),
        F.log(F.col("n_chars") + 1).alias("log_chars"),
    )
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", (1 - F.col("quality")).cast("int").alias("y")
    )
    return docs.join(labels, "doc_id", "inner" if labelled else "left")


def scored_documents(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """``doc_id, lang, source, n_chars, dw, log_chars, y, p`` with ``p`` at six decimals."""
    return documents_with_features(spark, sf_dir, labelled).withColumn(
        "p", F.round(sigmoid(linear_score(DOC_WEIGHTS, DOC_INTERCEPT)), 6)
    )


def two_scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``scored_documents`` with the rival's score ``p_rival``."""
    return scored_documents(spark, sf_dir).withColumn(
        "p_rival", F.round(sigmoid(linear_score(RIVAL_WEIGHTS, RIVAL_INTERCEPT)), 6)
    )


def scored_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a scored row: returned or not against a price-based score."""
    p = F.round(F.col("l_extendedprice") / F.lit(110000.0), 6)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_linestatus",
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw account table at 1997-01-01: one row per customer, with blanks and NULLs."""
    start, end = F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1998-01-01").cast("timestamp_ntz")
    day = F.col("o_orderdate")
    per_customer = (
        table(spark, sf_dir, "orders")
        .where(day < end)
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(
            F.min(F.when(day < start, day)).alias("first_order"),
            F.sum(
                F.when(day < start, F.round(F.col("o_totalprice") * 100).cast("bigint"))
            ).alias("prior_cents"),
            F.count_if(day >= start).alias("n_next"),
        )
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    joined = (
        table(spark, sf_dir, "customer")
        .join(per_customer, "c_custkey", "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    key, first = F.col("c_custkey"), F.col("first_order")
    months = (F.lit(SNAPSHOT_YEAR) - F.year(first)) * 12 + 1 - F.month(first)
    amount = (F.col("prior_cents").cast("decimal(20,0)") / F.lit(100)).cast("decimal(18,2)")
    return joined.select(
        key.alias("account_id"),
        F.coalesce(months, F.lit(0)).cast("int").alias("tenure"),
        F.when(key % 97 == 0, "  ")
        .when(F.col("prior_cents").isNull(), " ")
        .otherwise(amount.cast("string"))
        .alias("total_text"),
        F.when(key % 53 == 0, "   ")
        .when(key % 47 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" ")))
        .alias("segment_raw"),
        F.col("r_name").alias("region"),
        F.col("c_acctbal").alias("acctbal"),
        F.when(F.coalesce(F.col("n_next"), F.lit(0)) > 0, "No").otherwise("Yes").alias("lapsed"),
    )


def as_scoring_events(events: DataFrame) -> DataFrame:
    """Click-stream events read as scoring telemetry: errors are failures, purchases positives."""
    kind = F.col("event_type")
    ok = kind != "error"
    category = (
        F.when(ok, F.lit(None).cast("string"))
        .when(F.col("event_id") % 3 == 0, "validation_error")
        .when(F.col("event_id") % 3 == 1, "artifact_load_error")
        .otherwise("unknown_error")
    )
    return events.select(
        "event_id",
        F.col("user_id").alias("collector"),
        kind.alias("event_type"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        ok.cast("bigint").alias("prediction_count"),
        (kind == "purchase").cast("bigint").alias("positive_predictions"),
        (ok & (kind != "purchase")).cast("bigint").alias("negative_predictions"),
        F.col("value").alias("latency_ms"),
        F.lit(0.1).alias("threshold"),
        F.lit(None).cast("string").alias("model_artifact_hash"),
        ok.alias("success"),
        category.alias("error_category"),
        F.lit(1).cast("bigint").alias("batch_size"),
    )


def scoring_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_scoring_events(table(spark, sf_dir, "events"))
