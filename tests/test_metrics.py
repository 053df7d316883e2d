import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.functions import ranking
from riskframe.operators import metrics


def naive_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    d = pos[:, None] - neg[None, :]
    return ((d > 0).sum() + 0.5 * (d == 0).sum()) / (len(pos) * len(neg))


def naive_ap(y, p):
    total, out, last = y.sum(), 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall, precision = y[hit].sum() / total, y[hit].sum() / hit.sum()
        out += (recall - last) * precision
        last = recall
    return out


def test_small_exact(scored):
    r = metrics.rank_metrics(scored([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])).first()
    assert r["roc_auc"] == pytest.approx(0.75) and r["average_precision"] == pytest.approx(5 / 6)


def test_single_class_is_null(scored):
    r = metrics.rank_metrics(scored([1, 1], [0.2, 0.7])).first()
    assert r["roc_auc"] is None and r["average_precision"] == pytest.approx(1.0)
    assert metrics.rank_metrics(scored([0], [0.2])).first()["average_precision"] is None


@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_skewed_ties_and_groups(spark, ranges):
    """A third of all rows share one score, another third one group."""
    rng = np.random.default_rng(5)
    n = 3000
    p = np.round(rng.random(n) ** 6, 4)
    p[: n // 3] = 0.37
    y = (rng.random(n) < 0.2 + 0.5 * p).astype(int)
    g = np.where(rng.random(n) < 0.4, "hot", np.char.add("g", rng.integers(0, 9, n).astype(str)))
    df = spark.createDataFrame([(str(a), int(b), float(c)) for a, b, c in zip(g, y, p)], "g string, y int, p double")
    r = metrics.rank_metrics(df, ranges=ranges).first()
    assert r["roc_auc"] == pytest.approx(naive_auc(y, p), abs=1e-12)
    assert r["average_precision"] == pytest.approx(naive_ap(y, p), abs=1e-12)
    for r in metrics.rank_metrics(df, ["g"], ranges=ranges).collect():
        m = g == r["g"]
        assert r["roc_auc"] == pytest.approx(naive_auc(y[m], p[m]), abs=1e-12)


def test_null_group(spark):
    df = spark.createDataFrame([(None, 0, 0.1), (None, 1, 0.9), ("a", 1, 0.1), ("a", 0, 0.9)], "g string, y int, p double")
    got = {r["g"]: r["roc_auc"] for r in metrics.rank_metrics(df, ["g"]).collect()}
    assert got == {None: 1.0, "a": 0.0}


def test_curves_end_at_one(scored):
    s = scored([0, 0, 1, 1, 1], [0.1, 0.4, 0.35, 0.8, 0.8])
    roc = metrics.roc_points(s).orderBy("threshold").collect()
    assert len(roc) == 4 and (roc[0]["fpr"], roc[0]["tpr"]) == (1.0, 1.0)
    pr = metrics.pr_points(s).orderBy(F.desc("threshold")).collect()
    assert (pr[0]["precision"], pr[0]["recall"]) == (1.0, pytest.approx(2 / 3))


def test_no_window_over_the_whole_table(spark):
    s = spark.range(1000).selectExpr("int(id % 3 = 0) AS y", "id / 1000D AS p")
    plan = metrics.rank_metrics(s)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    windows = re.findall(r"\+- Window .*", plan) or re.findall(r"Window \[.*", plan)
    over_rows = [w for w in windows if "_in_pos" in w]
    assert over_rows and all("windowspecdefinition(_range" in w for w in over_rows)
    # the distinct-score table is hashed once by score and once by range
    assert plan.count("Exchange hashpartitioning(p#") == 2 and "CartesianProduct" not in plan


def test_losses(scored):
    r = metrics.probability_losses(scored([1, 0], [0.8, 0.4])).first()
    assert r["log_loss"] == pytest.approx(-(math.log(0.8) + math.log(0.6)) / 2)
    assert r["brier"] == pytest.approx((0.04 + 0.16) / 2)
    worst = metrics.probability_losses(scored([1], [0.0])).first()["log_loss"]
    assert worst == pytest.approx(52 * math.log(2))


def test_report(scored):
    rows = {r["label"]: r for r in metrics.classification_report(scored([0, 0, 0, 1, 1, 1], [0, 0, 1, 0, 1, 1])).collect()}
    assert rows["0"]["support"] == rows["1"]["support"] == 3
    assert rows["macro avg"]["f1"] == pytest.approx(2 / 3) and rows["accuracy"]["precision"] == pytest.approx(4 / 6)


def test_mean_and_population_std(frame):
    r = metrics.mean_and_std(frame("fold int, f1 double", (0, 1.0), (1, 3.0)), ["f1"]).first()
    assert (r["mean"], r["std"]) == (2.0, 1.0)


@pytest.mark.parametrize("cells", [16, 4096])
def test_exact_quantiles(spark, cells):
    rng = np.random.default_rng(3)
    v = np.concatenate([np.full(700, 5.0), rng.normal(5, 2, 1300).round(3)])
    rows = [("a", float(x)) for x in v] + [("b", 1.0), ("b", None), ("b", float("nan")), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    out = ranking.exact_quantiles(df, ["g"], "v", probs, groups=3, cells=cells, extra={"top": F.max("_v")}).collect()
    got = {(r["g"], r["prob"]): r["quantile"] for r in out}
    for q in probs:
        assert got["a", q] == pytest.approx(np.quantile(v, q), abs=1e-12)
        assert got["b", q] == 1.0 and got[None, q] == pytest.approx(2 + 2 * q)
    assert {(r["g"], r["n_values"], r["top"]) for r in out} == {("a", 2000, v.max()), ("b", 1, 1.0), (None, 2, 4.0)}


def test_exact_quantiles_far_apart(spark):
    """Values of every order of magnitude, both signs, infinities, and near neighbours beside them."""
    rng = np.random.default_rng(9)
    inf = float("inf")
    near = [1.0 + i * 2.0**-52 for i in range(300)]
    v = np.array([*(rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500)), *near, 5e-324, -5e-324, 0.0, 1.7e308, -1.7e308, inf, -inf, inf])
    df = spark.createDataFrame([("a", float(x)) for x in v], "g string, v double").repartition(3)
    ranks = [0, 1, 2, 200, 400, 401, 402, 550, 551, 700, len(v) - 3, len(v) - 1]
    probs = [r / (len(v) - 1) for r in ranks]
    got = {r["prob"]: r["quantile"] for r in ranking.exact_quantiles(df, ["g"], "v", probs, groups=1, cells=64).collect()}
    for q in probs:
        at = (len(v) - 1) * q
        low, high = np.sort(v)[[int(np.floor(at)), int(np.ceil(at))]]
        assert got[q] == low or low < got[q] <= high


def test_exact_quantiles_check_their_groups(spark):
    df = spark.createDataFrame([(str(i), 1.0) for i in range(4)], "g string, v double")
    with pytest.raises(ValueError, match="more than 3 groups"):
        ranking.exact_quantiles(df, ["g"], "v", [0.5], groups=3)
    assert ranking.exact_quantiles(df.where("false"), ["g"], "v", [0.5], groups=3).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 10, 149, 150, 151, 1000])
def test_exact_quantiles_of_small_groups(spark, n):
    v = np.random.default_rng(n).normal(size=n).round(2)
    df = spark.createDataFrame([("a", float(x)) for x in v], "g string, v double")
    probs = [0.01, 0.25, 0.5, 0.75, 0.9, 0.999]
    got = {r["prob"]: r["quantile"] for r in ranking.exact_quantiles(df, ["g"], "v", probs, groups=1).collect()}
    assert [got[q] for q in probs] == pytest.approx([np.quantile(v, q) for q in probs], abs=1e-12)


def test_checks_table(spark):
    bad = spark.createDataFrame([(2, 0.5), (1, 1.5), (None, None)], "y int, p double")
    got = {r["check"]: (r["ok"], r["bad_rows"]) for r in metrics.scored_checks(bad).collect()}
    assert got == {"not_empty": (True, 0), "label_binary": (False, 2), "probability_range": (False, 2)}


def delong(y, a, b):
    """AUCs and the variance of their difference, from all pairs."""
    y, scores = np.array(y), [np.array(a), np.array(b)]
    wins = [(s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0]) for s in scores]
    d10, d01 = (wins[0] - wins[1]).mean(axis=1), (wins[0] - wins[1]).mean(axis=0)
    return wins[0].mean(), wins[1].mean(), d10.var(ddof=1) / len(d10) + d01.var(ddof=1) / len(d01)


@pytest.mark.parametrize("places", [1, 6])
def test_auc_difference(spark, places):
    rng = np.random.default_rng(places)
    y = rng.integers(0, 2, 400)
    a = (0.3 * y + 0.7 * rng.random(400)).round(places)
    b = (0.5 * a + 0.5 * rng.random(400)).round(places)
    df = spark.createDataFrame([(int(c), float(p), float(q)) for c, p, q in zip(y, a, b)], "y int, p double, q double")
    row = metrics.auc_difference(df, "p", "q").first()
    auc_a, auc_b, variance = delong(y, a, b)
    assert row["auc_a"] == pytest.approx(auc_a) and row["auc_b"] == pytest.approx(auc_b)
    assert row["std_error"] == pytest.approx(variance**0.5)
    assert row["high"] - row["low"] == pytest.approx(2 * 1.959963984540054 * variance**0.5)
    one = metrics.auc_difference(df.where("y = 1"), "p", "q").first()
    assert set(one) == {None}
    same = metrics.auc_difference(df, "p", "p").first()
    assert (same["auc_difference"], same["std_error"], same["z"]) == (0.0, 0.0, None)
