"""A dictionary of any number of categories, and vectors made from it."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from riskframe.operators import features


def test_ids_are_dense_and_complete(spark):
    df = spark.range(30_000).select((F.col("id") % 9_001).cast("string").alias("a"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("v"), F.col("id") % 7)).alias("b"))
    got = features.category_dictionary(df, ["a", "b"])
    by = {c: {r["value"]: r["id"] for r in got.where(F.col("column") == c).collect()} for c in ("a", "b")}
    assert set(by["a"]) == {str(i) for i in range(9_001)} and sorted(by["a"].values()) == list(range(9_001))
    assert set(by["b"]) == {f"v{i}" for i in range(7)} and sorted(by["b"].values()) == list(range(7))
    assert features.dictionary_sizes(got) == {"a": 9_001, "b": 7}


def test_one_hot_from_the_dictionary(spark):
    train = spark.createDataFrame([("x", "1"), ("y", "1"), ("y", None)], "a string, b string")
    rows = spark.createDataFrame([(1, "x", "1"), (2, "y", "new"), (3, "z", None), (4, None, "1")], "id int, a string, b string")
    dictionary = features.category_dictionary(train, ["a", "b"])
    sizes = features.dictionary_sizes(dictionary)
    ids = {(r["column"], r["value"]): r["id"] for r in dictionary.collect()}
    out = features.wide_one_hot(features.with_category_ids(rows, dictionary, ["a", "b"], sizes), ["a", "b"], sizes)
    got = {r["id"]: (r["a"], r["b"]) for r in out.select("id", vector_to_array("cat__a").alias("a"), vector_to_array("cat__b").alias("b")).collect()}
    hot = lambda c, v: [1.0 if ids.get((c, v)) == i else 0.0 for i in range(sizes[c])]
    assert got == {1: (hot("a", "x"), hot("b", "1")), 2: (hot("a", "y"), hot("b", "new")), 3: (hot("a", "z"), [0.0]), 4: ([0.0, 0.0], [1.0])}
    long = features.one_hot_long(rows, "id", ["a", "b"], dictionary)
    assert sorted(tuple(r) for r in long.collect()) == [(1, "cat__a_x", 1.0), (1, "cat__b_1", 1.0), (2, "cat__a_y", 1.0), (4, "cat__b_1", 1.0)]


def test_empty_dictionary(spark):
    none = spark.createDataFrame([], "a string")
    dictionary = features.category_dictionary(none, ["a"])
    assert dictionary.collect() == [] and features.dictionary_sizes(dictionary) == {}
    rows = spark.createDataFrame([(1, "x")], "id int, a string")
    with pytest.raises(ValueError, match="no category"):
        features.with_category_ids(rows, dictionary, ["a"], {})


def test_sum_of_a_vector_of_any_size(spark):
    """A dense array of these sizes fits no task."""
    rows = [(1, Vectors.sparse(2_000_000_000, [7, 1_999_999_999], [1.0, 2.0])), (2, Vectors.sparse(2_000_000_000, [], [])), (3, Vectors.dense([0.5, 1.0])), (4, None)]
    out = spark.createDataFrame(rows, StructType([StructField("id", LongType()), StructField("v", VectorUDT())]))
    assert {r["id"]: r["s"] for r in out.select("id", features.vector_sum("v").alias("s")).collect()} == {1: 3.0, 2: 0.0, 3: 1.5, 4: None}
