import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import bootstrap, errors, explain, models
from riskframe.spec import DEFAULT_COSTS


def test_outcomes(scored):
    o = errors.with_outcome(scored([0, 0, 1, 1], [0.1, 0.9, 0.6, 0.8]), 0.5).orderBy("key").collect()
    assert [r["outcome"] for r in o] == ["TN", "FP", "TP", "TP"]


def test_absent_outcomes_count_zero(scored):
    r = errors.error_rates(scored([0, 1], [0.1, 0.9]), 0.5).first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (1, 0, 0, 1)
    assert r["false_negative_rate"] == 0.0 and r["positive_prediction_rate"] == 0.5


def test_slices_keep_undefined_rates_null(frame):
    s = frame("c string, y int, p double", ("a", 0, 0.1), ("a", 0, 0.9), ("b", 1, 0.1), (None, 1, 0.5))
    got = {r["value"]: r for r in errors.error_slices(s, 0.5, ["c"]).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["fp_rate"] == 0.5 and got["a"]["fn_rate"] is None and got["b"]["fn_rate"] == 1.0


def test_numeric_summary(frame):
    s = frame("v double, y int, p double", (1.0, 0, 0.1), (2.0, 0, 0.2), (4.0, 0, 0.3), (None, 0, 0.1), (9.0, 1, 0.9))
    got = {r["outcome"]: r for r in errors.error_numeric(s, 0.5, ["v"]).collect()}
    assert (got["TN"]["n"], got["TN"]["median"]) == (3, 2.0) and got["TN"]["mean"] == pytest.approx(7 / 3)
    assert (got["FN"]["n"], got["FN"]["mean"], got["FN"]["median"]) == (0, None, None)


def test_hard_cases(scored):
    r = errors.hard_cases(scored([0, 1, 0, 1, 1], [0.45, 0.55, 0.85, 0.15, 0.45]), 0.5).first()
    assert (r["borderline_count"], r["borderline_error_count"]) == (3, 1)
    assert (r["high_confidence_fp_count"], r["high_confidence_fn_count"]) == (1, 1)
    assert r["borderline_error_rate"] == pytest.approx(1 / 3)


def test_examples(scored):
    got = {r["outcome"]: r["key"] for r in explain.examples(scored([1, 0, 1, 0], [0.9, 0.1, 0.8, 0.2]), 0.5, "key").collect()}
    assert got == {"TP": 0, "TN": 1, "FP": None, "FN": None}


def test_top_contributors(frame):
    attr = frame(
        "key int, feature string, value double, contribution double",
        (1, "a", 1.0, 0.5), (1, "b", 1.0, 0.7), (1, "c", 1.0, -0.2), (1, "d", 0.0, 0.0), (1, "e", 1.0, 0.1),
    )
    got = [(r["direction"], r["rank"], r["feature"]) for r in explain.top_contributors(attr, ["key"], 2).orderBy("direction", "rank").collect()]
    assert got == [("negative", 1, "c"), ("positive", 1, "b"), ("positive", 2, "a")]
    doc = explain.local_explanations(attr, ["key"], 2).first()
    assert [t["feature"] for t in doc["top_positive"]] == ["b", "a"] and doc["contributions"]["d"] == 0.0


def test_grouped_importance_uses_the_mapping(frame):
    attr = frame(
        "key int, feature string, value double, contribution double",
        (1, "cat__a_b_x", 1.0, 0.5), (1, "cat__a_b_y", 0.0, -0.5), (2, "cat__a_b_x", 0.0, -0.1), (2, "cat__a_b_y", 1.0, 0.3),
    )
    r = explain.grouped_importance(attr, {"cat__a_b_x": "a_b", "cat__a_b_y": "a_b"}).first()
    assert (r["original_feature"], r["n_columns"]) == ("a_b", 2)
    assert r["mean_abs"] == pytest.approx(0.7) and r["mean_signed"] == pytest.approx(0.1)


def training_table(spark, n=400):
    u = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    t = spark.range(n).select("id", u("a").alias("x1"), u("b").alias("x2"), F.when(u("c") < 0.4, "u").otherwise("v").alias("c"), u("d").alias("r"))
    z = -2.0 + 3.0 * F.col("x1") + F.when(F.col("c") == "u", 1.5).otherwise(0.0)
    return t.withColumn("y", (F.col("r") < 1 / (1 + F.exp(-z))).cast("int"))


def brute_force(leaf_trees, x):
    """Shapley values straight from the definition, for one row."""
    features = sorted({f for splits, _ in leaf_trees for f, _, _ in splits})
    sides = []
    for splits, _ in leaf_trees:
        sides.append([(np.isin(x[f], left) if cat else x[f] <= left[0]) for f, cat, left in splits])

    def value(known):
        total = 0.0
        for (splits, leaves), side in zip(leaf_trees, sides):
            for v, fs, absent, tests in leaves:
                w = 1.0
                for f, z, conditions in zip(fs, absent, tests):
                    w *= all(side[j] == s for j, s in conditions) if f in known else z
                total += v * w
        return total / len(leaf_trees)

    phi = {}
    for f in features:
        others = [g for g in features if g != f]
        phi[f] = sum(
            math.factorial(k) * math.factorial(len(others) - k) / math.factorial(len(features))
            * (value({*s, f}) - value(set(s)))
            for k in range(len(others) + 1) for s in itertools.combinations(others, k)
        )
    return phi


def test_forest_attribution_is_shapley_and_additive(spark):
    t = training_table(spark).cache()
    model = models.risk_pipeline(["x1", "x2"], ["c"], kind="forest", numTrees=4, maxDepth=3).fit(t)
    attr, base = explain.forest_attribution(t, model, ["id"])
    total = attr.groupBy("id").agg(F.sum("contribution").alias("s"))
    worst = models.add_score(t, model, keep=["id"]).join(total, "id").agg(F.max(F.abs(F.col("p") - F.col("s") - base))).first()[0]
    assert worst < 1e-12
    trees, again = explain.leaf_games([r.asDict() for r in explain.forest_nodes(model.stages[-1], spark).collect()])
    assert again == pytest.approx(base)
    rows = attr.where("id < 5").collect()
    names = explain.feature_names(model)
    for i in range(5):
        x = np.array([next(r["value"] for r in rows if r["id"] == i and r["feature"] == n) for n in names])
        want = brute_force(trees, x)
        for r in rows:
            if r["id"] == i:
                assert r["contribution"] == pytest.approx(want.get(names.index(r["feature"]), 0.0), abs=1e-12)


def test_blocks_of_trees_give_the_same_attribution(spark, monkeypatch):
    monkeypatch.setattr(explain, "CHAIN", 2)
    t = training_table(spark).cache()
    model = models.risk_pipeline(["x1", "x2"], ["c"], kind="forest", numTrees=5, maxDepth=3).fit(t)
    nodes = explain.forest_nodes(model.stages[-1], spark)
    assert explain.tree_blocks(nodes) == [[0, 1, 2, 3, 4]]
    assert explain.tree_blocks(nodes, 1) == [[0], [1], [2], [3], [4]]
    whole, base = explain.forest_attribution(t, model, ["id"])
    parts, same = explain.forest_attribution(t, model, ["id"], block_nodes=1)
    assert same == pytest.approx(base)
    both = whole.join(parts.withColumnRenamed("contribution", "other"), ["id", "feature"])
    r = both.agg(F.count("*").alias("n"), F.max(F.abs(F.col("contribution") - F.col("other"))).alias("worst")).first()
    assert r["n"] == whole.count() and r["worst"] < 1e-12
    none, _ = explain.forest_attribution(t.where("id < 0"), model, ["id"])
    assert none.count() == 0
    with pytest.raises(ValueError, match="no trees"):
        explain.node_attribution(t, nodes.where("treeID < 0"), ["x1"], ["id"])


def test_linear_attribution_adds_up(spark):
    t = training_table(spark).cache()
    model = models.risk_pipeline(["x1", "x2"], ["c"], kind="logistic").fit(t)
    attr = explain.linear_model_attribution(t, model, t, ["id"])
    total = attr.groupBy("id").agg(F.sum("contribution").alias("s"))
    odds = models.add_score(t, model, keep=["id"]).join(total, "id").select(
        (F.log(F.col("p") / (1 - F.col("p"))) - F.col("s")).alias("d")
    )
    r = odds.agg(F.max("d").alias("hi"), F.min("d").alias("lo")).first()
    assert r["hi"] - r["lo"] < 1e-9
    top = models.coefficient_table(model).first()
    assert top["rank"] == 1 and top["original"] in ("x1", "c")


def test_bootstrap(frame):
    rows = [(1, 0.9, 0.2)] * 30 + [(0, 0.9, 0.2)] * 50 + [(0, 0.1, 0.1)] * 120
    s = frame("y int, a double, b double", *rows)
    draws = bootstrap.cost_difference_replicates(s, "a", "b", 0.5, 0.5, replicates=2000)
    r = bootstrap.prefer_second(bootstrap.bootstrap_interval(draws)).first()
    exact = 30 * (DEFAULT_COSTS.cost_tp - DEFAULT_COSTS.cost_fn) + 50 * DEFAULT_COSTS.cost_fp
    assert r["mean"] == pytest.approx(exact, abs=60) and r["lower"] < exact < r["upper"]
    assert r["selected"] == "a"
    again = bootstrap.bootstrap_interval(bootstrap.cost_difference_replicates(s.repartition(3), "a", "b", 0.5, 0.5, replicates=2000)).first()
    assert (again["lower"], again["upper"]) == (r["lower"], r["upper"])


def test_auc_bootstrap(frame):
    rng = np.random.default_rng(4)
    y = (rng.random(600) < 0.3).astype(int)
    a, b = (np.clip(0.3 * y + rng.random(600) * 0.7, 0, 1).round(2) for _ in range(2))
    b = rng.permutation(b)
    s = frame("y int, a double, b double", *[(int(i), float(j), float(k)) for i, j, k in zip(y, a, b)])
    draws = bootstrap.auc_difference_replicates(s, "a", "b", bins=200, replicates=400)
    r = bootstrap.bootstrap_interval(draws, "auc_difference").first()

    def auc(p):
        d = p[y == 1][:, None] - p[y == 0][None, :]
        return ((d > 0) + 0.5 * (d == 0)).mean()

    assert r["mean"] == pytest.approx(auc(a) - auc(b), abs=0.02)
    assert 0 < r["lower"] < auc(a) - auc(b) < r["upper"]
    assert bootstrap.binned_auc((a * 100).round().astype(int), y, np.ones(600)) == pytest.approx(auc(a))
