"""Fits of all points at once against one at a time."""

import numpy as np
import pytest

from riskframe.operators import newton


def table(spark, seed=1, n=400):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2)) * [1.0, 3.0] + [0.0, 2.0]
    y = (r.random(n) < 1 / (1 + np.exp(-(0.8 * x[:, 0] - 0.4 * x[:, 1])))).astype(int)
    rows = [(i % 5, int(b), float(1 + i % 3), float(v[0]), float(v[1])) for i, (b, v) in enumerate(zip(y, x))]
    return rows, spark.createDataFrame(rows, "fold int, y int, w double, a double, b double").repartition(3)


def single(rows, left_out, c):
    data = [r for r in rows if r[0] != left_out]
    x = np.array([[1.0, r[3], r[4]] for r in data])
    y, w = np.array([r[1] for r in data]), np.array([r[2] for r in data])
    beta, ridge = np.zeros(3), np.diag([0, 1 / c, 1 / c])
    for _ in range(40):
        mu = 1 / (1 + np.exp(-x @ beta))
        hessian = (x * (w * mu * (1 - mu))[:, None]).T @ x + ridge
        beta -= np.linalg.solve(hessian, x.T @ (w * (mu - y)) + ridge @ beta)
    return beta


def test_every_point_is_its_own_fit(spark):
    rows, df = table(spark)
    grid = [0.001, 0.1, 10.0]
    got = newton.logistic_points(df, ["a", "b"], grid, [newton.NO_FOLD, *range(5)], "fold", weight="w").collect()
    assert len(got) == 18 and max(r["steps"] for r in got) < 12
    for r in got:
        want = single(rows, r["fold"], r["C"])
        assert [r["intercept"], *r["coefficients"]] == pytest.approx(want.tolist(), abs=1e-8)


def test_nested_search_equals_one_fit_at_a_time(spark):
    rows, df = table(spark)
    rows = [(*r, i % 7 % 3) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "fold int, y int, w double, a double, b double, inner int").repartition(3)
    grid, held = [0.001, 0.1, 10.0], {}
    scored, trials = newton.nested_search(df, ["a", "b"], grid, "fold", "inner", (5, 3), ["y", "a", "b"])

    def fit(data, c):
        return single([(0, r[1], 1.0, r[3], r[4]) for r in data], None, c)

    def p(beta, r):
        return 1 / (1 + np.exp(-(beta[0] + beta[1] * r[3] + beta[2] * r[4])))

    def auc(beta, data):
        hit = [p(beta, r) for r in data if r[1] == 1]
        miss = [p(beta, r) for r in data if r[1] == 0]
        return np.mean([(h > m) + 0.5 * (h == m) for h in hit for m in miss])

    want = {}
    for g in range(5):
        rest = [r for r in rows if r[0] != g]
        for c in grid:
            inner = [auc(fit([r for r in rest if r[5] != h], c), [r for r in rest if r[5] == h]) for h in range(3)]
            want[g, c] = float(np.mean(inner))
        best = max(grid, key=lambda c: (round(want[g, c], 9), -c))
        beta = fit(rest, best)
        held.update({(r[3], r[4]): (g, best, p(beta, r)) for r in rows if r[0] == g})
    assert {(r["fold"], r["C"]): r["roc_auc"] for r in trials.collect()} == pytest.approx(want, abs=1e-9)
    got = scored.collect()
    assert len(got) == len(rows)
    for r in got:
        fold, c, score = held[r["a"], r["b"]]
        assert (r["fold"], r["C"]) == (fold, c) and r["p"] == pytest.approx(score, abs=1e-8)


def test_jobs_do_not_grow_with_the_points(spark):
    _, df = table(spark, 2)
    jobs = []
    for i, grid in enumerate([[1.0], [10.0 ** (k / 4) for k in range(-8, 9)]]):
        spark.sparkContext.setJobGroup(f"points-{i}", "")
        steps = newton.logistic_points(df, ["a", "b"], grid, range(5), "fold").first()["steps"]
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"points-{i}")) / steps)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= 1.5 * jobs[0]


def test_grid_scores_are_out_of_fold(spark):
    rows, df = table(spark, 3, 60)
    fitted = newton.logistic_points(df, ["a", "b"], [0.5, 5.0], range(5), "fold")
    for r in newton.grid_scores(df, fitted, ["a", "b"], "fold", ["fold", "a", "b"]).collect():
        b0, b1, b2 = single([(f, y, 1.0, a, b) for f, y, _, a, b in rows], r["fold"], r["C"])
        assert r["p"] == pytest.approx(1 / (1 + np.exp(-(b0 + b1 * r["a"] + b2 * r["b"]))), abs=1e-8)


def test_what_cannot_be_fitted(spark):
    rows, df = table(spark)
    with pytest.raises(ValueError, match="class is missing"):
        newton.logistic_points(df.where("y = 1"), ["a"], [1.0])
    with pytest.raises(ValueError, match="must not be empty"):
        newton.logistic_points(df, ["a"], [])
    with pytest.raises(Exception, match="NULL in a"):
        newton.logistic_points(df.selectExpr("y", "nullif(a, a) AS a"), ["a"], [1.0])
