"""Profiling of a table: shape, missing values, duplicates, distributions, correlations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import exact_quantiles
from ..session import require_small


def _long(df: DataFrame, columns: Sequence[str], cast: str) -> DataFrame:
    """``(column, value)`` for all columns: one scan feeds every per-column statistic."""
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias("value"))
        for c in require_small(list(columns), "columns", 2_000)
    ]
    return df.select(F.explode(F.array(*pairs)).alias("s")).select("s.column", "s.value")


def shape(df: DataFrame) -> DataFrame:
    """Row and column count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def missing_counts(df: DataFrame) -> DataFrame:
    """``(column, missing)`` for the columns that have any missing value."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in df.columns]
    return counts.select(F.explode(F.array(*pairs)).alias("s")).select("s.*").where("missing > 0")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows beyond the first of each set of equal rows."""
    return (
        df.groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias("_copies"))
        .agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"))
    )


def value_share(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, value, count, percent)`` with the percentage at two decimals.

    Totals are sums of the counted values, joined on as one row for each group: no window,
    so neither the table nor a group is gathered in one task.
    """
    counted = df.groupBy(*by, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    if not by:
        total = counted.agg(F.sum("count")).scalar()
        return counted.withColumn("percent", F.round(F.col("count") * 100 / total, 2))
    totals = counted.groupBy(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)]).agg(F.sum("count").alias("_total"))
    cond = F.lit(True)
    for i, b in enumerate(by):
        cond = cond & F.col(b).eqNullSafe(F.col(f"_b{i}"))
    return counted.join(totals, cond).select(
        *by, "value", "count", F.round(F.col("count") * 100 / F.col("_total"), 2).alias("percent")
    )


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, quartiles and max per numeric column."""
    long = _long(df, columns, "double")
    plain = {
        "mean": F.avg("_v"), "std": F.stddev_samp("_v"), "min": F.min("_v"), "max": F.max("_v"),
    }
    q = exact_quantiles(
        long, ["column"], "value", [0.25, 0.5, 0.75], groups=len(columns), extra=plain
    )
    return (
        q.groupBy("column", F.col("n_values").alias("count"), *plain)
        .agg(
            *[
                F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
                for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))
            ]
        )
        .select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")
    )


def categorical_values(df: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    """The most frequent values of each column, its cardinality, non-missing rows and how many
    values are not shown.

    Ties in frequency go by value. The row-number filter is pushed below the shuffle, so a
    column of any cardinality sends ``top`` rows per task.
    """
    counted = (
        _long(df, columns, "string")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    # reads the counts too, so that both branches are the same plan and share one exchange
    distinct = counted.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_values"), F.sum("count").alias("n_present")
    )
    w = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    first = counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return first.join(F.broadcast(distinct), "column").select(
        "column",
        "rank",
        "value",
        "count",
        "n_values",
        "n_present",
        F.greatest(F.col("n_values") - top, F.lit(0)).alias("n_more"),
    )


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, corr)`` for every ordered pair, over the rows where both are present."""
    pairs = list(combinations_with_replacement(require_small(list(columns), "columns", 100), 2))

    def both(a: str, b: str):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        ok = x.isNotNull() & y.isNotNull()
        return F.corr(F.when(ok, x), F.when(ok, y))

    wide = df.agg(*[both(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for left, right in {(a, b), (b, a)}:
            cells.append(
                F.struct(F.lit(left).alias("a"), F.lit(right).alias("b"), F.col(f"c{i}").alias("corr"))
            )
    return wide.select(F.explode(F.array(*cells)).alias("s")).select("s.*")


def row_percent(df: DataFrame, column: str, y: str) -> DataFrame:
    """Share of both classes per value of ``column``, in percent at two decimals."""
    rate = F.avg(F.col(y).cast("double")) * 100
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.round(100 - rate, 2).alias("negative_pct"), F.round(rate, 2).alias("positive_pct"))
    )
