import math
import threading

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from riskframe.operators import calibrate, features, metrics, models, split
from test_errors_explain import training_table


@pytest.fixture(scope="module")
def table(spark):
    return split.stratified_folds(training_table(spark, 900), "id", "y", 3).cache()


def newton(x, y, c, w=None):
    """Independent solve of the penalised logistic objective (free intercept)."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.ones(len(y)) if w is None else w
    pen = np.array([0.0] + [1.0 / c] * x.shape[1])
    b = np.zeros(a.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-a @ b))
        b -= np.linalg.solve((a * (w * mu * (1 - mu))[:, None]).T @ a + np.diag(pen), a.T @ (w * (mu - y)) + pen * b)
    return b


def test_median_mode_and_ties(frame):
    df = frame("v double, c string", (1.0, "b"), (2.0, "a"), (3.0, "a"), (4.0, "b"), (None, None))
    assert features.fit_medians(df, ["v"]).first()["fill"] == 2.5
    assert features.fit_modes(df, ["c"]).first()["fill"] == "a"


def test_encoding(frame):
    df = frame("v double, n int, c string", (1.0, 1, "it's"), (None, 2, "b"), (4.0, None, None), (float("nan"), 2, "b"))
    pre = features.TablePreprocessor(["v", "n"], ["c"]).fit(df)
    assert features.feature_names(pre) == ["num__v", "num__n", "cat__c_b", "cat__c_it's"]
    rows = [list(r["features"]) for r in pre.transform(df).collect()]
    assert rows == [[1.0, 1.0, 0.0, 1.0], [2.5, 2.0, 1.0, 0.0], [4.0, 2.0, 1.0, 0.0], [2.5, 2.0, 1.0, 0.0]]
    unknown = pre.transform(frame("v double, n int, c string", (1.0, 1, "B"))).first()["features"]
    assert list(unknown) == [1.0, 1.0, 0.0, 0.0]
    assert features.feature_origins(pre)["cat__c_it's"] == "c"


def test_class_weights(frame):
    assert features.class_weights(frame("y int", (0,), (0,), (0,), (1,)), "y") == {0: 4 / 6, 1: 2.0}


@pytest.mark.parametrize("balanced", [False, True])
@pytest.mark.parametrize("c", [0.1, 1.0])
def test_logistic_matches_newton(table, c, balanced):
    fitted = models.risk_pipeline(["x1", "x2"], kind="logistic", C=c, balanced=balanced).fit(table)
    rows = table.select("x1", "x2", "y").collect()
    x, y = np.array([[r["x1"], r["x2"]] for r in rows]), np.array([r["y"] for r in rows], dtype=float)
    w = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum())) if balanced else None
    lr = fitted.stages[-1]
    assert np.allclose([lr.intercept, *lr.coefficients], newton(x, y, c, w), atol=2e-4)


def test_planted_model_is_recovered(spark):
    big = training_table(spark, 20_000)
    lr = models.risk_pipeline(["x1", "x2"], ["c"], kind="logistic", C=1000.0).fit(big).stages[-1]
    x1, x2, u, v = lr.coefficients
    assert x1 == pytest.approx(3.0, abs=0.25) and x2 == pytest.approx(0.0, abs=0.25) and u - v == pytest.approx(1.5, abs=0.15)


def test_oof_never_sees_its_fold(table):
    scored = models.oof_scores(table, models.risk_pipeline(["x1"], kind="prior"), 3, keep=["id", "y", "fold"])
    assert scored.count() == table.count()
    for i in range(3):
        outside = table.where(F.col("fold") != i).agg(F.avg("y")).first()[0]
        assert {r["p"] for r in scored.where(F.col("fold") == i).select("p").distinct().collect()} == {outside}


def test_cv_and_comparison(table):
    pipes = {"prior": models.risk_pipeline(["x1"], ["c"], kind="prior"), "tree": models.risk_pipeline(["x1"], ["c"], kind="tree", maxDepth=3)}
    got = {(r["model"], r["metric"]): r["mean"] for r in models.compare_models(table, pipes, 3).collect()}
    assert len(got) == 12 and got[("prior", "roc_auc")] == pytest.approx(0.5)
    assert got[("tree", "roc_auc")] > 0.6


def test_random_search_draws_and_repeats(table):
    space = {"C": [0.001, 1.0, 10.0], "balanced": [True, False]}
    points = models.draw_params(space, 4, 1)
    assert points == models.draw_params(space, 4, 1) and len({str(p) for p in points}) == 4
    assert len(models.draw_params(space, 99, 1)) == 6
    pipe = models.risk_pipeline(["x1", "x2"], ["c"], kind="logistic")
    best, trials = models.random_search(table, pipe, space, 2, 3, seed=1)
    oof = models.oof_scores(table, models.risk_pipeline(["x1", "x2"], ["c"], kind="logistic", **points[0]), 3, keep=["y", "fold"])
    mean = metrics.rank_metrics(oof, ["fold"]).agg(F.avg("roc_auc")).first()[0]
    assert trials[0]["score"] == pytest.approx(mean, abs=1e-4)
    assert isinstance(best, PipelineModel)


def test_selection_prefers_the_first_of_equals(table):
    m = models.risk_pipeline(["x1"], kind="logistic").fit(table)
    got = {r["model"]: r["selected"] for r in models.select_model({"b": m, "a": m}, table).collect()}
    assert got == {"b": True, "a": False}
    with pytest.raises(ValueError):
        models.select_model({"a": m}, table, "f1")


def test_bad_training_data(table):
    with pytest.raises(ValueError):
        models.risk_pipeline(["x1"], kind="logistic").fit(table.where("y = 1"))
    with pytest.raises(ValueError):
        models.risk_pipeline(["x1"], kind="logistic").fit(table.withColumn("y", F.lit(None).cast("int")))


# ------------------------------------------------------------ calibration


def test_sigmoid_matches_newton(scored):
    rng = np.random.default_rng(1)
    p = rng.random(500).round(3)
    y = (rng.random(500) < p**2).astype(int)
    s = scored(y.tolist(), p.tolist())
    fitted = calibrate.SigmoidCalibrator().fit(s)
    q = np.clip(p, 1e-6, 1 - 1e-6)
    z = np.log(q / (1 - q))
    b = newton(z[:, None], y.astype(float), 1.0)
    got = [r["p"] for r in calibrate.apply_calibrator(s, fitted).orderBy("key").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-(b[0] + b[1] * z))), atol=1e-4)


def test_isotonic_is_monotone_and_clamps(scored):
    s = scored([0, 1, 0, 1, 1, 0, 1], [0.2, 0.3, 0.4, 0.5, 0.5, 0.6, 0.8])
    fitted = calibrate.IsotonicCalibrator().fit(s)
    grid = scored([0] * 11, [i / 10 for i in range(11)])
    got = [r["p"] for r in calibrate.apply_calibrator(grid, fitted).orderBy("key").collect()]
    assert all(a <= b for a, b in zip(got, got[1:])) and 0 <= got[0] and got[-1] <= 1
    assert got[0] == got[2] == 0.0 and got[8] == got[10] == 1.0
    assert got[3] == pytest.approx(0.5) and got[5] == pytest.approx(2 / 3)


@pytest.mark.parametrize("method", calibrate.METHODS)
def test_calibration_checks(scored, method):
    for ys, ps in (([0, 3], [0.1, 0.2]), ([0, 1], [0.1, 1.1])):
        with pytest.raises(Exception, match="must be"):
            calibrate.fit_calibrator(scored(ys, ps), method)
    with pytest.raises(ValueError, match="empty"):
        calibrate.fit_calibrator(scored([0], [0.5]).where("false"), method)
    with pytest.raises(ValueError):
        calibrate.build_calibrator("platt")


@pytest.mark.parametrize(
    "sig,iso,want",
    [
        ((0.4, 0.14), (0.5, 0.13), ("sigmoid", "log_loss")),
        ((0.5, 0.14), (0.4, 0.15), ("isotonic", "log_loss")),
        ((0.4135, 0.1343), (0.4135, 0.1343), ("sigmoid", "tie_break_prefer_sigmoid")),
        ((0.4135, 0.13), (0.4135, 0.14), ("sigmoid", "brier")),
        ((0.4135, 0.14), (0.4135, 0.13), ("isotonic", "brier")),
    ],
)
def test_method_choice(frame, sig, iso, want):
    table = frame("method string, log_loss double, brier double", ("sigmoid", *sig), ("isotonic", *iso), ("baseline", 0.1, 0.1))
    r = calibrate.select_calibration(table).first()
    assert (r["selected_method"], r["decision_rule"]) == want


def test_calibrated_pipeline_is_saved_and_keeps_order(table, tmp_path):
    base = models.risk_pipeline(["x1", "x2"], ["c"], kind="logistic").fit(table)
    raw = models.add_score(table, base, keep=["id", "y"])
    whole = calibrate.calibrated_pipeline(base, calibrate.fit_calibrator(raw, "sigmoid"))
    whole.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    got = again.transform(table).select("id", "calibrated").join(raw, "id").orderBy("p").collect()
    values = [r["calibrated"] for r in got]
    assert all(a <= b + 1e-12 for a, b in zip(values, values[1:]))
    assert metrics.rank_metrics(raw).first()[0] == pytest.approx(
        metrics.rank_metrics(again.transform(table).selectExpr("y", "calibrated AS p")).first()[0]
    )


def test_cross_fit(table):
    raw = table.select("id", "y", "fold", F.round(F.col("x1") * 0.8 + 0.1, 2).alias("p"))
    crossed = calibrate.cross_fit_calibration(raw, "fold", 3)
    n = table.count()
    assert {r["method"]: r["count"] for r in crossed.groupBy("method").count().collect()} == {"baseline": n, "sigmoid": n, "isotonic": n}
    t = {r["method"]: r for r in calibrate.calibration_table(calibrate.calibration_fold_metrics(crossed)).collect()}
    assert t["sigmoid"]["log_loss"] < t["baseline"]["log_loss"] and len(t["isotonic"]["fold_brier"]) == 3
    assert t["sigmoid"]["roc_auc"] == pytest.approx(t["baseline"]["roc_auc"], abs=1e-9)
    assert math.isfinite(t["isotonic"]["brier"])


def test_columns_with_many_categories(spark):
    """More than 5,000 values of one column beside few of another; the limit counts each column."""
    df = spark.range(6_500).select(
        F.concat(F.lit("v"), (F.col("id") % 6_000).cast("string")).alias("many"),
        F.concat(F.lit("w"), (F.col("id") % 3).cast("string")).alias("few"),
    )
    fitted = features.TablePreprocessor(categorical=["many", "few"]).fit(df)
    domains = features.category_domains(fitted)
    assert (len(domains["many"]), domains["few"]) == (6_000, ["w0", "w1", "w2"])
    assert fitted.transform(df).select("features").first()[0].size == 6_003
    with pytest.raises(ValueError, match="many"):
        features.TablePreprocessor(categorical=["many", "few"], maxCategories=5_000).fit(df)


def test_depth_beyond_the_limit_is_refused(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(20)], "x1 double, y int")
    with pytest.raises(ValueError, match="depth 50"):
        models.risk_pipeline(["x1"], kind="tree", maxDepth=50).fit(df)


def pooled(ps, pos, n):
    """Isotonic rates by pooling from left to right."""
    stack = []
    for p, a, b in zip(ps, pos, n):
        stack.append([a, b, 1])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            a, b, k = stack.pop()
            stack[-1] = [stack[-1][0] + a, stack[-1][1] + b, stack[-1][2] + k]
    return [a / b for a, b, k in stack for _ in range(k)]


@pytest.mark.parametrize("shape", ["noisy", "rising", "falling"])
@pytest.mark.parametrize("ranges", [1, 7, 300])
def test_isotonic_blocks_of_a_tree(spark, shape, ranges):
    r = np.random.default_rng(ranges)
    size = 3_000
    ps = np.sort(r.random(size).round(9))
    rate = {"noisy": ps, "rising": ps, "falling": 1 - ps}[shape]
    n = r.integers(1, 4, size) if shape == "noisy" else np.full(size, 1000)
    pos = r.binomial(n, rate) if shape == "noisy" else (1000 * rate).astype(int)
    rows = [(float(p), int(a), int(b - a)) for p, a, b in zip(ps, pos, n)]
    table = spark.createDataFrame(rows, "p double, pos long, neg long").repartition(5)
    blocks = sorted(calibrate.pooled_blocks(table, ranges).collect())
    want = pooled(ps, pos.tolist(), n.tolist())
    got = {}
    for b in blocks:
        inside = (ps >= b["lo"]) & (ps <= b["hi"])
        assert n[inside].sum() == b["n"] and pos[inside].sum() == b["pos"]
        got.update((float(p), b["pos"] / b["n"]) for p in ps[inside])
    assert [got[float(p)] for p in ps] == want


def test_folds_are_subtracted(spark):
    r = np.random.default_rng(4)
    rows = [(i % 3, int(r.integers(2)), float(r.integers(40) / 50)) for i in range(500)]
    base = spark.createDataFrame(rows, "fold int, y int, p double")
    counts = calibrate._counts_by_fold(base, 3)
    for i in range(3):
        want = metrics.score_table(base.where(F.col("fold") != i))
        assert sorted(calibrate._without_fold(counts, i).collect()) == sorted(want.collect())


def test_searches_of_outer_folds_overlap(spark, monkeypatch):
    """Two searches are under way at once, each on a written table; order and choices stay."""
    met, plain = threading.Barrier(2, timeout=60), models.random_search
    names = []

    def search(train, *args, **options):
        met.wait()
        names.append(len(train.inputFiles()))
        return plain(train, *args, **options)

    monkeypatch.setattr(models, "random_search", search)
    df = training_table(spark, 300).select("id", "y", "x1")
    pipeline = models.risk_pipeline(["x1"], kind="logistic")
    per_fold, pooled, chosen = models.nested_cv(df, pipeline, {"C": [1.0]}, 1, "id", outer=2, inner=2)
    assert [c["outer_fold"] for c in chosen] == [0, 1] and all(names)
    assert per_fold.count() == 2 and pooled.count() == 1
