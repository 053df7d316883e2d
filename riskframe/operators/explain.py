"""Feature attributions of fitted models and their aggregation.

Attributions live in a long table ``(key, feature, value, contribution)``.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable, require_small, shared_dir, ship_package
from ..spec import LABEL, SCORE
from .errors import OUTCOMES, with_outcome
from .features import feature_names, feature_origins

BLOCK_NODES = 200_000  # tree nodes that a task holds at once
CHAIN = 4  # blocks of trees that rows meet in one pass
MAX_TABLE_BITS = 8  # features on a leaf's path up to which all patterns are tabulated


def _to_long(df: DataFrame, keep: Sequence[str], cells: dict[str, tuple[Column, Column]]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(name).alias("feature"),
            value.cast("double").alias("value"),
            phi.cast("double").alias("contribution"),
        )
        for name, (value, phi) in cells.items()
    ]
    return df.select(*keep, F.explode(F.array(*rows)).alias("a")).select(*keep, "a.*")


def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Mean of each column over the background rows (one row reaches the driver)."""
    row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return {c: float(row[c]) for c in columns}


def linear_attribution(
    df: DataFrame, key: Sequence[str], weights: dict[str, float], means: dict[str, float]
) -> DataFrame:
    """``w * (x - E[x])`` in log-odds for a linear model over plain columns."""
    return _to_long(
        df,
        key,
        {
            c: (F.col(c), F.lit(float(w)) * (F.col(c) - F.lit(float(means[c]))))
            for c, w in weights.items()
        },
    )


def _encoded(df: DataFrame, model: PipelineModel, key: Sequence[str]) -> tuple[DataFrame, list[str]]:
    names = require_small(feature_names(model), "features")
    out = model.transform(df).select(*key, vector_to_array("features").alias("x"))
    return out, names


def linear_model_attribution(
    df: DataFrame, model: PipelineModel, background: DataFrame, key: Sequence[str]
) -> DataFrame:
    """Log-odds attribution of a fitted logistic pipeline against background means."""
    logistic = next(s for s in reversed(model.stages) if isinstance(s, LogisticRegressionModel))
    back, names = _encoded(background, model, [])
    weights = [float(w) for w in logistic.coefficients]
    if len(weights) != len(names):
        raise ValueError(f"model has {len(weights)} weights for {len(names)} features")
    row = back.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(names))]).first()
    rows, _ = _encoded(df, model, key)
    x = F.col("x")
    return _to_long(
        rows,
        key,
        {
            n: (x[i], F.lit(weights[i]) * (x[i] - F.lit(float(row[f"m{i}"]))))
            for i, n in enumerate(names)
        },
    )


# ------------------------------------------------------------ forests


def forest_nodes(forest: RandomForestClassificationModel, spark) -> DataFrame:
    """All tree nodes of a fitted forest as a table, from its saved form."""
    path = f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"
    forest.write().save(path)
    return spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").select(
        "treeID", "id", "leftChild", "rightChild", "impurityStats",
        F.col("split.featureIndex").alias("feature"),
        F.col("split.leftCategoriesOrThreshold").alias("left"),
        F.col("split.numCategories").alias("n_categories"),
    )


def tree_blocks(nodes: DataFrame, most: int = BLOCK_NODES) -> list[list[int]]:
    """Tree numbers in blocks of at most ``most`` nodes; a larger tree is a block of its own."""
    blocks, size = [], most + 1
    for tree, n in sorted(tuple(r) for r in nodes.groupBy("treeID").count().collect()):
        if size + n > most:
            blocks.append([])
            size = 0
        blocks[-1].append(tree)
        size += n
    return blocks


def leaf_games(nodes: list[dict]) -> tuple[list[list[tuple]], float]:
    """Per tree: its splits and its leaves as small games over the features on the path.

    A leaf is ``(value, features, absent, tests)``: ``absent[j]`` is the share of training
    weight that follows the path at the splits on feature j when j is unknown, ``tests[j]``
    the splits (and sides) a row must satisfy on feature j. The base value is the mean
    training prediction.
    """
    by_tree: dict[int, dict[int, dict]] = {}
    for n in nodes:
        by_tree.setdefault(n["treeID"], {})[n["id"]] = n
    trees, base = [], 0.0
    for tree in by_tree.values():
        cover = {i: float(sum(n["impurityStats"])) for i, n in tree.items()}
        splits, leaves = [], []
        todo = [(0, {})]
        while todo:
            i, path = todo.pop()
            n = tree[i]
            if n["leftChild"] < 0:
                value = n["impurityStats"][1] / cover[i]
                base += value * cover[i] / cover[0] / len(by_tree)
                leaves.append(
                    (
                        value,
                        np.array(list(path), dtype=int),
                        np.array([z for z, _ in path.values()]),
                        [tests for _, tests in path.values()],
                    )
                )
                continue
            j = len(splits)
            f = n["feature"]
            splits.append((f, n["n_categories"] > 0, list(n["left"])))
            for child, side in ((n["leftChild"], True), (n["rightChild"], False)):
                z, tests = path.get(f, (1.0, []))
                todo.append((child, {**path, f: (z * cover[child] / cover[i], [*tests, (j, side)])}))
        trees.append((splits, leaves))
    return trees, base


def _shapley_table(patterns: np.ndarray, absent: np.ndarray) -> np.ndarray:
    """Shapley values of the product game ``prod(present or absent share)`` per 0/1 pattern."""
    m = len(absent)
    size_weight = np.array(
        [math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)]
    )
    out = np.empty((len(patterns), m))
    for j in range(m):
        # coefficients by number of known features among the others
        poly = np.zeros((len(patterns), m))
        poly[:, 0] = 1.0
        for k in range(m):
            if k != j:
                shifted = np.zeros_like(poly)
                shifted[:, 1:] = poly[:, :-1] * patterns[:, [k]]
                poly = poly * absent[k] + shifted
        out[:, j] = (patterns[:, j] - absent[j]) * (poly @ size_weight)
    return out


def _pattern_values(codes: np.ndarray, absent: np.ndarray) -> np.ndarray:
    """Shapley values of the patterns whose bits are the numbers ``codes``."""
    bits = (codes[:, None] >> np.arange(len(absent))) & 1
    return _shapley_table(bits.astype(float), absent)


def forest_contributions(x: np.ndarray, trees: list, n_trees: int, tables: dict | None = None) -> np.ndarray:
    """Additive contributions of every feature to the forest probability, for a batch.

    A row meets a leaf as one number: a bit for each feature on the leaf's path, set if the
    row passes all its splits on that feature. Values of all numbers of a short path are
    tabulated once (in ``tables``, which a task keeps between batches); a longer path
    tabulates the numbers that occur.
    """
    tables = {} if tables is None else tables
    phi = np.zeros_like(x, dtype=float)
    for t, (splits, leaves) in enumerate(trees):
        goes_left = np.empty((len(splits), len(x)), dtype=bool)
        for j, (f, categorical, left) in enumerate(splits):
            goes_left[j] = np.isin(x[:, f], left) if categorical else x[:, f] <= left[0]
        sides = {True: goes_left, False: ~goes_left}
        for leaf, (value, features, absent, tests) in enumerate(leaves):
            if len(features) == 0 or value == 0.0:
                continue
            codes = np.zeros(len(x), dtype=np.int64)
            for c, conditions in enumerate(tests):
                passed = sides[conditions[0][1]][conditions[0][0]]
                for j, side in conditions[1:]:
                    passed = passed & sides[side][j]
                codes += passed.astype(np.int64) << c
            if len(features) <= MAX_TABLE_BITS:
                if (t, leaf) not in tables:
                    tables[t, leaf] = _pattern_values(np.arange(1 << len(features)), absent) * (value / n_trees)
                values = tables[t, leaf]
            else:
                met, codes = np.unique(codes, return_inverse=True)
                values = _pattern_values(met, absent) * (value / n_trees)
            phi[:, features] += values[codes]
    return phi


def _adding(shared, n_trees: int):
    """Adds the contributions of a block of trees to those a row has already."""

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict = {}
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x, phi = (np.array(pdf[c].tolist(), dtype=float).reshape(len(pdf), -1) for c in ("x", "phi"))
            yield pdf.assign(phi=list(phi + forest_contributions(x, shared.value, n_trees, tables)))

    return explain


def node_attribution(
    rows: DataFrame, nodes: DataFrame, names: Sequence[str], key: Sequence[str], block_nodes: int = BLOCK_NODES
) -> tuple[DataFrame, float]:
    """Path-dependent attribution of the trees in a node table, and the base value.

    ``rows`` has the key columns and the features as array ``x``; ``nodes`` the columns of
    ``forest_nodes``. Rows stay where they are and meet one block of trees after the other,
    four in a pass; contributions add up in the row. A block is all that the driver or a
    task holds of the trees, so a forest may have any number of them.
    """
    spark = rows.sparkSession
    ship_package(spark)
    names = require_small(list(names), "features")
    blocks = tree_blocks(nodes, block_nodes)
    n_trees = sum(map(len, blocks))
    if not n_trees:
        raise ValueError("no trees to explain")
    explained = rows.select(*key, "x", F.array_repeat(F.lit(0.0), len(names)).alias("phi"))
    base = 0.0
    for i, block in enumerate(blocks):
        if i and i % CHAIN == 0:
            explained = durable(explained, "attribution")
        held = nodes.where(F.col("treeID").between(block[0], block[-1])).collect()
        trees, mean = leaf_games([r.asDict() for r in held])
        base += mean * len(block) / n_trees
        explained = explained.mapInPandas(_adding(spark.sparkContext.broadcast(trees), n_trees), explained.schema)
    cells = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("f"), F.col("x"), F.col("phi"))
    return (
        explained.select(*key, F.explode(cells).alias("a")).select(
            *key,
            F.col("a")["f"].alias("feature"),
            F.col("a")["x"].alias("value"),
            F.col("a")["phi"].alias("contribution"),
        ),
        base,
    )


def forest_attribution(
    df: DataFrame, model: PipelineModel, key: Sequence[str], block_nodes: int = BLOCK_NODES
) -> tuple[DataFrame, float]:
    """Path-dependent attribution of a forest in probability space, and the base value.

    ``base + sum of contributions = probability`` for every row.
    """
    forest = next(s for s in reversed(model.stages) if isinstance(s, RandomForestClassificationModel))
    rows, names = _encoded(df, model, key)
    if forest.numFeatures != len(names):
        raise ValueError(f"forest expects {forest.numFeatures} features, input has {len(names)}")
    return node_attribution(rows, forest_nodes(forest, df.sparkSession), names, key, block_nodes)


def feature_mapping(model: PipelineModel, spark) -> DataFrame:
    """``(position, feature, original)``: which column each slot of the vector comes from."""
    origins = feature_origins(model)
    rows = [(i, n, origins[n]) for i, n in enumerate(feature_names(model))]
    return spark.createDataFrame(rows, "position int, feature string, original string")


# ------------------------------------------------------------ aggregation


def global_importance(attr: DataFrame) -> DataFrame:
    """``(feature, mean_abs, mean_signed)``, most important first."""
    return (
        attr.groupBy("feature")
        .agg(
            F.avg(F.abs("contribution")).alias("mean_abs"),
            F.avg("contribution").alias("mean_signed"),
        )
        .orderBy(F.desc("mean_abs"), "feature")
    )


def grouped_importance(attr: DataFrame, origins: dict[str, str]) -> DataFrame:
    """Importance per original column: per-row sums over its features, averaged over rows.

    Every row carries every feature, so sums over features of the per-feature means equal
    the means of per-row sums; the table shrinks to one row per feature first.
    """
    pairs = require_small(list(origins.items()), "features")
    origin = F.element_at(
        F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[F.lit(v) for _, v in pairs])),
        F.col("feature"),
    )
    per_feature = attr.groupBy("feature").agg(
        F.avg(F.abs("contribution")).alias("a"), F.avg("contribution").alias("s")
    )
    return (
        per_feature.groupBy(origin.alias("original_feature"))
        .agg(
            F.sum("a").alias("mean_abs"),
            F.sum("s").alias("mean_signed"),
            F.count(F.lit(1)).alias("n_columns"),
        )
        .orderBy(F.desc("mean_abs"), "original_feature")
    )


def examples(
    scored: DataFrame, threshold: float, key: str, y: str = LABEL, p: str = SCORE
) -> DataFrame:
    """``(outcome, key, p)``: the first row by key of each outcome, NULL where there is none."""
    o = with_outcome(scored, threshold, y, p)
    row = o.agg(
        *[F.min(F.when(F.col("outcome") == n, F.struct(key, p))).alias(n) for n in OUTCOMES]
    )
    return row.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("outcome"), F.col(n).alias("first")) for n in OUTCOMES])
        ).alias("e")
    ).select("e.outcome", F.col("e.first")[key].alias(key), F.col("e.first")[p].alias(p))


def top_contributors(attr: DataFrame, key: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` strongest features per row and direction: ``(*key, direction, rank, ...)``.

    Zero contributions belong to neither direction. Windows span the features of one row.
    """
    direction = F.when(F.col("contribution") > 0, "positive").when(
        F.col("contribution") < 0, "negative"
    )
    signed = attr.withColumn("direction", direction).where(F.col("direction").isNotNull())
    w = Window.partitionBy(*key, "direction").orderBy(F.desc(F.abs("contribution")), "feature")
    return (
        signed.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select(*key, "direction", "rank", "feature", "value", "contribution")
    )


def local_explanations(attr: DataFrame, key: Sequence[str], k: int = 5) -> DataFrame:
    """One nested row per explained row: top positive and negative features, all contributions."""
    item = F.struct("rank", "feature", "contribution", "value")
    top = top_contributors(attr, key, k).groupBy(*key).agg(
        F.sort_array(F.collect_list(F.when(F.col("direction") == "positive", item))).alias("top_positive"),
        F.sort_array(F.collect_list(F.when(F.col("direction") == "negative", item))).alias("top_negative"),
    )
    everything = attr.groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "contribution"))).alias("contributions")
    )
    return everything.join(top, list(key), "left")
