import pytest
from pyspark.sql import functions as F

from riskframe.operators import thresholds as t
from riskframe.operators.metrics import label_metrics
from riskframe.spec import COARSE_GRID, threshold_grid


def one(df):
    return df.first().asDict()


def test_perfect_scores(scored):
    r = one(t.confusion_at(scored([0, 0, 0, 1, 1, 1], [0.1, 0.2, 0.3, 0.6, 0.7, 0.8]), 0.5))
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (3, 0, 0, 3)
    assert r["precision"] == r["recall"] == r["f1"] == r["accuracy"] == 1.0
    assert r["fpr"] == r["fnr"] == 0.0 and r["positive_rate"] == 0.5


def test_two_thresholds(scored):
    s = scored([0, 0, 0, 0, 1, 1, 1, 1], [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8])
    rows = {r["threshold"]: r for r in t.threshold_sweep(s, [0.45, 0.65]).collect()}
    assert (rows[0.45]["tp"], rows[0.45]["tn"]) == (4, 4)
    assert (rows[0.65]["tp"], rows[0.65]["fn"], rows[0.65]["fnr"]) == (2, 2, 0.5)


def test_thirds(scored):
    r = one(t.confusion_at(scored([0, 0, 0, 1, 1, 1], [0, 0, 1, 0, 1, 1]), 0.5))
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (2, 1, 1, 2)
    for m in ("precision", "recall", "f1", "accuracy"):
        assert r[m] == pytest.approx(2 / 3)
    assert r["fpr"] == r["fnr"] == pytest.approx(1 / 3)


def test_boundaries_are_inclusive(scored):
    s = scored([0, 1], [0.5, 0.5])
    assert one(t.confusion_at(s, 0.5))["tp"] == 1
    everyone = one(t.confusion_at(s, 0.0))
    assert (everyone["tp"], everyone["fp"]) == (1, 1)
    nobody = one(t.confusion_at(s, 1.0))
    assert (nobody["tn"], nobody["fn"], nobody["precision"], nobody["f1"]) == (1, 1, 0.0, 0.0)
    assert one(t.confusion_at(scored([1], [1.0]), 1.0))["tp"] == 1


@pytest.mark.parametrize("ys,ps", [([0, 2], [0.1, 0.2]), ([0, 1], [0.1, 1.2]), ([0, 1], [-0.1, 0.2])])
def test_bad_rows_fail(scored, ys, ps):
    with pytest.raises(Exception, match="must be"):
        t.threshold_sweep(scored(ys, ps)).collect()


def test_null_nan_and_empty_fail(spark):
    for p in (None, float("nan")):
        s = spark.createDataFrame([(1, p)], "y int, p double")
        with pytest.raises(Exception, match="probability"):
            t.threshold_sweep(s).collect()
    with pytest.raises(Exception, match="no rows"):
        t.threshold_sweep(spark.createDataFrame([], "y int, p double")).collect()


def test_grid():
    grid = threshold_grid()
    assert len(grid) == 99 and grid[0] == 0.01 and grid[-1] == 0.99 and grid == sorted(grid)
    assert grid == [i / 100 for i in range(1, 100)]
    fine = threshold_grid(0.01, 0.99, 0.001)
    assert len(fine) == 981 and fine[1] == 0.011 and fine[-1] == 0.99
    assert threshold_grid(0.06, 0.96, 0.1) == [0.06, 0.16, 0.26, 0.36, 0.46, 0.56, 0.66, 0.76, 0.86, 0.96]
    assert threshold_grid(0.0, 0.95, 0.1)[-1] == 0.9
    assert len(COARSE_GRID) == 17 and COARSE_GRID[-1] == 0.9
    for bad in ((-0.1, 0.5, 0.1), (0.1, 1.5, 0.1), (0.1, 0.5, 0.0), (0.5, 0.5, 0.1), (0.6, 0.5, 0.1)):
        with pytest.raises(ValueError):
            threshold_grid(*bad)
    with pytest.raises(ValueError):
        t.check_grid([0.5, 1.5])


def test_one_pass_equals_single_thresholds(spark):
    s = spark.range(3000).select(
        (F.xxhash64("id") % 3 == 0).cast("int").alias("y"),
        F.round(F.pmod(F.xxhash64(F.col("id") + 7), F.lit(1001)) / 1000, 3).alias("p"),
    )
    rows = {r["threshold"]: r for r in t.threshold_sweep(s).collect()}
    n = s.count()
    last = None
    for i in range(1, 100):
        r = rows[i / 100]
        assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == n
        assert last is None or r["recall"] <= last
        last = r["recall"]
    for x in (0.01, 0.07, 0.29, 0.5, 0.58, 0.99):
        single = label_metrics(s, x).first()
        assert all(single[c] == rows[x][c] for c in ("tn", "fp", "fn", "tp", "f1", "npv"))


def test_groups_with_null(spark):
    s = spark.createDataFrame([("a", 1, 0.9), (None, 0, 0.2), (None, 1, 0.8)], "g string, y int, p double")
    rows = {r["g"]: r for r in t.threshold_sweep(s, [0.5], ["g"]).collect()}
    assert rows["a"]["tp"] == 1 and (rows[None]["tp"], rows[None]["tn"]) == (1, 1)


def test_candidates(spark):
    sweep = spark.createDataFrame(
        [(0.3, 0.40, 0.9, 0.55), (0.4, 0.55, 0.7, 0.62), (0.5, 0.60, 0.7, 0.62), (0.6, 0.80, 0.5, 0.60)],
        "threshold double, precision double, recall double, f1 double",
    )
    got = {r["criterion"]: r["threshold"] for r in t.candidate_thresholds(sweep).collect()}
    assert got == {"default": 0.5, "f1_optimal": 0.4, "recall_oriented": 0.4, "precision_oriented": 0.5}
    weak = sweep.where("threshold = 0.3").withColumn("recall", F.lit(0.1))
    got = {r["criterion"]: r["threshold"] for r in t.candidate_thresholds(weak).collect()}
    assert got == {"default": None, "f1_optimal": 0.3, "recall_oriented": None, "precision_oriented": None}


def test_sweep_scans_once_and_shuffles_small(spark):
    path = "/root/testdata/sf0.001/lineitem.parquet"
    s = spark.read.parquet(path).selectExpr(
        "int(l_returnflag = 'R') AS y", "least(l_extendedprice / 110000, 1D) AS p"
    )
    plan = t.threshold_sweep(s)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("== Initial Plan ==")[-1]
    assert initial.count("FileScan") == 1 and "Join" not in initial and "Window" not in initial
    assert "partial_sum" in initial and "ReadSchema: struct<l_extendedprice:double,l_returnflag:string>" in initial
