"""Imputation, one-hot encoding and feature assembly, fitted on training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import sql_literal
from ..functions.ranking import exact_quantiles
from ..session import durable, require_small

ID_RANGES = 4_096  # ranges of the hash that values are numbered in
MAX_CATEGORIES = 100_000  # default of the parameter: values of one column, which become labels of the model


def _long(df: DataFrame, columns: Sequence[str], cast: str) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias("value")) for c in columns]
    return df.select(F.explode(F.array(*pairs)).alias("s")).select("s.column", "s.value")


def fit_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, fill)``: the exact median of each numeric column."""
    columns = require_small(list(columns), "numeric columns", 2_000)
    q = exact_quantiles(_long(df, columns, "double"), ["column"], "value", [0.5], groups=len(columns))
    return q.select("column", F.col("quantile").alias("fill"))


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` of all categorical columns from one scan."""
    columns = require_small(list(columns), "categorical columns", 2_000)
    return (
        _long(df, columns, "string")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fit_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, fill)``: the most frequent value, the smallest one on a tie."""
    ranked = F.struct((-F.col("n")).alias("a"), F.col("value").alias("b"))
    return category_counts(df, columns).groupBy("column").agg(
        F.min_by("value", ranked).alias("fill")
    )


def imputed(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    """Fill NULL (and NaN) with fitted values in one projection."""

    def fill(name: str, dtype: str) -> Column:
        if name not in fills:
            return F.col(name)
        c = F.col(name)
        if dtype in ("double", "float"):
            c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        return F.coalesce(c, F.lit(fills[name])).alias(name)

    return df.select(*[fill(n, t) for n, t in df.dtypes])


def class_weights(df: DataFrame, label: str) -> dict[int, float]:
    """Balanced weights ``n / (2 * n_class)``."""
    rows = {r["y"]: r["count"] for r in df.groupBy(F.col(label).alias("y")).count().collect()}
    if not set(rows) <= {0, 1}:
        raise ValueError("label must be 0 or 1")
    n = sum(rows.values())
    return {c: n / (2.0 * k) for c, k in rows.items()}


def with_class_weight(df: DataFrame, label: str, weights: dict[int, float], name: str = "weight") -> DataFrame:
    out = F.lit(None).cast("double")
    for c, w in weights.items():
        out = F.when(F.col(label) == c, F.lit(w)).otherwise(out)
    return df.withColumn(name, out)


def _long_categories(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """``(*keep, column, value)`` of the non-NULL categories."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(*keep, F.explode(F.array(*cells)).alias("s")).select(*keep, "s.*").where("value IS NOT NULL")


def category_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, id)``: the categories of each column, numbered from 0 without gaps.

    For columns of any number of values: distinct values are cut into ranges of their hash,
    ranges are counted and the counts accumulated (4,096 rows for each column), and values
    are numbered inside their range. No value reaches the driver and no task holds a column.
    The numbers follow hash and value, the same ones every time. NULL is no category.
    """
    values = durable(_long_categories(df, columns).distinct().withColumn("_range", F.pmod(F.xxhash64("value"), F.lit(ID_RANGES))), "categories")
    upto = Window.partitionBy("column").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = values.groupBy("column", "_range").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("column").alias("_column"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before")
    )
    inside = F.row_number().over(Window.partitionBy("column", "_range").orderBy("value")) - 1
    numbered = values.withColumn("_inside", inside).join(before, (F.col("column") == F.col("_column")) & (F.col("_range") == F.col("_r")))
    return durable(numbered.select("column", "value", (F.col("_before") + F.col("_inside")).alias("id")), "dictionary")


def dictionary_sizes(dictionary: DataFrame) -> dict[str, int]:
    """Categories of each column: one number for each."""
    return {r["column"]: r["count"] for r in dictionary.groupBy("column").count().collect()}


def with_category_ids(df: DataFrame, dictionary: DataFrame, columns: Sequence[str], sizes: dict[str, int]) -> DataFrame:
    """Add ``idx__<column>``: the category's number, or the number of categories if it is unknown or NULL."""
    out = df
    for c in columns:
        if not sizes.get(c):
            raise ValueError(f"no category of {c} is known")
        own = dictionary.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("id").alias("_id"))
        nominal = {"ml_attr": {"type": "nominal", "num_vals": sizes[c] + 1}}
        number = F.coalesce("_id", F.lit(sizes[c])).cast("double").alias(f"idx__{c}", metadata=nominal)
        out = out.join(own, F.col(c).cast("string") == F.col("_value"), "left").select(*out.columns, number)
    return out


def wide_one_hot(df: DataFrame, columns: Sequence[str], sizes: dict[str, int]) -> DataFrame:
    """Add the sparse vector ``cat__<column>`` for each column with an ``idx__<column>``.

    The slot of unknown values is the last one, which is dropped: they are all zero.
    """
    hot = OneHotEncoder(
        inputCols=[f"idx__{c}" for c in columns], outputCols=[f"cat__{c}" for c in columns], dropLast=True
    )
    return hot.fit(df).transform(df)


def vector_sum(vector: str) -> Column:
    """Sum of a vector's entries; of a sparse one only the stored entries are read, whatever its size."""
    return F.aggregate(F.unwrap_udt(vector)["values"], F.lit(0.0), lambda a, x: a + x)


def one_hot_long(df: DataFrame, key: str, columns: Sequence[str], dictionary: DataFrame) -> DataFrame:
    """``(key, feature, value)`` of the encoded categories, ones only.

    Rows meet the dictionary by column and value, so it may hold any number of categories;
    an unknown value has none.
    """
    known = dictionary.select(F.col("column").alias("_c"), F.col("value").alias("_v"))
    hits = _long_categories(df, columns, key).join(known, (F.col("column") == F.col("_c")) & (F.col("value") == F.col("_v")), "left_semi")
    return hits.select(key, F.concat(F.lit("cat__"), "column", F.lit("_"), "value").alias("feature"), F.lit(1.0).alias("value"))


class TablePreprocessor(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Median and mode imputation, one-hot encoding and assembly into ``features``.

    The fitted model is a ``PipelineModel`` of built-in stages, so it runs inside the JVM and
    can be saved. Output names are ``num__<column>`` and ``cat__<column>_<value>``.
    """

    numeric = Param(Params._dummy(), "numeric", "numeric columns", TypeConverters.toListString)
    categorical = Param(
        Params._dummy(), "categorical", "categorical columns", TypeConverters.toListString
    )

    maxCategories = Param(
        Params._dummy(), "maxCategories", "most values of one categorical column", TypeConverters.toInt
    )

    def __init__(
        self, numeric: Sequence[str] = (), categorical: Sequence[str] = (), maxCategories: int = MAX_CATEGORIES
    ):
        super().__init__()
        self._setDefault(maxCategories=MAX_CATEGORIES)
        self._set(numeric=list(numeric), categorical=list(categorical), maxCategories=maxCategories)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        num, cat = self.getOrDefault(self.numeric), self.getOrDefault(self.categorical)
        stages = []
        fills, labels = {}, {}
        if num:
            found = {r["column"]: r["fill"] for r in fit_medians(dataset, num).collect()}
            lost = [c for c in num if c not in found]
            if lost:
                raise ValueError(f"no values to impute from in {lost}")
            fills.update(found)
        if cat:
            most = self.getOrDefault(self.maxCategories)
            counted = durable(category_counts(dataset, cat), "categories")
            sizes = {r["column"]: r["count"] for r in counted.groupBy("column").count().collect()}
            if large := {c: n for c, n in sizes.items() if n > most}:
                raise ValueError(f"columns with more than {most} categories: {large}")
            domain: dict[str, dict[str, int]] = {c: {} for c in cat}
            for r in counted.collect():
                domain[r["column"]][r["value"]] = r["n"]
            for c in cat:
                values = domain[c]
                labels[c] = require_small(sorted(values), f"domain of {c}", most)
                fills[c] = min(values, key=lambda v: (-values[v], v))
        parts = [
            f"coalesce(nanvl(cast(`{c}` AS double), cast(NULL AS double)), {fills[c]!r}D) AS `num__{c}`"
            for c in num
        ] + [f"coalesce(`{c}`, {sql_literal(fills[c])}) AS `imp__{c}`" for c in cat]
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__"))
        step = stages[0].transform(dataset)
        if cat:
            # one model per column: label arrays of unequal length would be padded with NULL
            index = [
                StringIndexerModel.from_labels(
                    labels[c], inputCol=f"imp__{c}", outputCol=f"idx__{c}", handleInvalid="keep"
                )
                for c in cat
            ]
            for one in index:
                step = one.transform(step)
            # the extra slot for unknown values is the dropped one
            hot = OneHotEncoder(
                inputCols=[f"idx__{c}" for c in cat],
                outputCols=[f"cat__{c}" for c in cat],
                dropLast=True,
            ).fit(step)
            stages += [*index, hot]
        stages.append(
            VectorAssembler(
                inputCols=[f"num__{c}" for c in num] + [f"cat__{c}" for c in cat],
                outputCol="features",
            )
        )
        return PipelineModel(stages=stages)


def category_domains(model: PipelineModel) -> dict[str, list[str]]:
    """Categories of each column as learned at fit time."""
    return {
        s.getInputCol().removeprefix("imp__"): list(s.labels)
        for s in _stages(model)
        if isinstance(s, StringIndexerModel)
    }


def _stages(model: PipelineModel) -> list:
    out = []
    for s in model.stages:
        out += _stages(s) if isinstance(s, PipelineModel) else [s]
    return out


def numeric_features(model: PipelineModel) -> list[str]:
    for stage in _stages(model):
        if isinstance(stage, VectorAssembler):
            return [
                c.removeprefix("num__") for c in stage.getInputCols() if c.startswith("num__")
            ]
    return []


def feature_names(model: PipelineModel) -> list[str]:
    """Names of the assembled vector slots, in order."""
    domains = category_domains(model)
    return [f"num__{c}" for c in numeric_features(model)] + [
        f"cat__{c}_{v}" for c, values in domains.items() for v in values
    ]


def feature_origins(model: PipelineModel) -> dict[str, str]:
    """Vector slot name to the original column it comes from."""
    out = {f"num__{c}": c for c in numeric_features(model)}
    for c, values in category_domains(model).items():
        out.update({f"cat__{c}_{v}": c for v in values})
    return out
