import json
import os
import sys

import pytest

from riskframe.operators import split
from riskframe.plans import jobs
from riskframe.sources import files, views
from riskframe.spec import FeatureSpec, RetentionScenario

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
SF = "/root/testdata/sf0.001"


def documents(spark, path):
    text = spark.read.text(path)
    return [json.loads(r["value"]) for r in text.collect()]


def test_entry(spark):
    import __spark_entry__ as e

    r = e.entry(spark).first()
    assert (r["threshold"], r["total_cost"]) == (0.14, 290.0)
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize(
    "name",
    [
        "cost_sensitivity", "retention_sensitivity", "rank_metrics", "error_slices", "error_numeric", "clean_accounts",
        "profile_numeric", "stratified_split", "stratified_folds", "contract_violations", "telemetry_daily",
        "grouped_importance", "isotonic_calibration", "sigmoid_calibration", "threshold_sweep_returns",
    ],
)
def test_queries_match_sql(spark, name):
    import check_oracle as c

    import __spark_entry__ as e

    state, note, _ = c.compare(spark, c.connect(SF), name, e.queries()[name], e.oracle_sql()[name], SF)
    assert state == "OK", note


def test_cost_job(spark, tmp_path):
    s = split.stratified_split(views.scored_documents(spark, SF), "doc_id", "y").cache()
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    t = jobs.run_cost_optimisation(train, test, str(tmp_path))
    doc = documents(spark, f"{tmp_path}/cost_analysis")[0]
    assert doc["selected_threshold"] == t and doc["optimization_summary"]["n_thresholds_evaluated"] == 99
    lines = spark.read.text(f"{tmp_path}/cost_thresholds").collect()
    assert len(lines) == 100 and lines[0]["value"].startswith("threshold,tn,fp,fn,tp,precision,")
    assert lines[1]["value"].startswith("0.01,")
    assert len(spark.read.option("header", True).csv(f"{tmp_path}/cost_sensitivity").collect()) == 5
    r = jobs.run_retention_optimisation(train, test, str(tmp_path), RetentionScenario(10.0, 100.0, 0.6, label="x"))
    assert documents(spark, f"{tmp_path}/retention_analysis")[0]["selected_threshold"] == r
    assert documents(spark, f"{tmp_path}/retention_test")[0]["threshold"] == r
    policies = documents(spark, f"{tmp_path}/retention_analysis")[0]["baseline_comparison"]
    assert policies["value_vs_no_contact"] >= 0 and doc["optimization_data"]["test_set_used_for_optimization"] is False


def test_threshold_choice_never_reads_test_rows(spark, tmp_path):
    s = split.stratified_split(views.scored_documents(spark, SF), "doc_id", "y").cache()
    train = s.where("split = 'train'")
    poisoned = s.where("split = 'test'").selectExpr("y", "CAST(raise_error('test rows read') AS DOUBLE) AS p")
    with pytest.raises(Exception, match="test rows read"):
        jobs.run_cost_optimisation(train, poisoned, str(tmp_path))
    assert documents(spark, f"{tmp_path}/cost_analysis")[0]["selected_threshold"] == jobs.choose_threshold(train)


def test_error_and_calibration_jobs(spark, tmp_path):
    s = split.stratified_folds(views.scored_documents(spark, SF), "doc_id", "y", 3).cache()
    jobs.run_error_report(s, 0.2, ["lang"], ["n_chars"], str(tmp_path))
    assert len(documents(spark, f"{tmp_path}/error_numeric")) == 4
    assert jobs.run_calibration(s, "fold", 3, str(tmp_path)) in ("sigmoid", "isotonic")
    assert len(documents(spark, f"{tmp_path}/calibration_metrics")) == 3


def test_prepare_tune_evaluate_explain(spark, tmp_path):
    from pyspark.sql import functions as F

    from riskframe.operators import models
    from test_errors_explain import training_table

    raw = training_table(spark, 500).select(
        "id", F.col("x1").cast("string").alias("x1"), "x2", F.concat(F.lit(" "), "c").alias("c"),
        F.when(F.col("y") == 1, "Yes").otherwise("No").alias("t"),
    )
    raw.write.option("header", True).csv(str(tmp_path / "raw.csv"))
    spec = FeatureSpec.from_schema(raw.schema, "id", "t", ("x1", "x2"))
    assert spec.categorical == ("c",)
    data = jobs.prepare_dataset(spark, str(tmp_path / "raw.csv"), raw.schema, spec, str(tmp_path / "data"), ["x1"])
    assert set(data.columns) == {"c", "x1", "x2", "y", "split"} and dict(data.dtypes)["x1"] == "double"
    assert {r["split"]: r["count"] for r in data.groupBy("split").count().collect()} == {"test": 150, "val": 105, "train": 245}
    keyed = data.withColumn("id", F.monotonically_increasing_id()).cache()
    train, val, test = (keyed.where(F.col("split") == n) for n in ("train", "val", "test"))

    families = {
        "logistic": (models.risk_pipeline(spec, kind="logistic"), {"C": [0.01, 1.0]}),
        "tree": (models.risk_pipeline(spec, kind="tree"), {"maxDepth": [1, 3]}),
    }
    out = str(tmp_path / "out")
    chosen = jobs.run_tuning(train, val, families, 2, "id", out, outer=2, inner=2)
    assert chosen in families
    table = {r["model"]: r for r in documents(spark, f"{out}/selection")}
    assert table[chosen]["score"] == max(r["score"] for r in table.values())
    params = json.loads(files.read_text(spark, f"{out}/tree/parameters"))
    assert [p["outer_fold"] for p in params] == [0, 1] and all(p["maxDepth"] in (1, 3) for p in params)

    for kind in ("logistic", "forest"):
        model = models.risk_pipeline(spec, kind=kind, numTrees=3, maxDepth=3).fit(train)
        auc = jobs.evaluate_model(model, test, f"{out}/{kind}").first()["roc_auc"]
        assert 0.5 < auc < 1 and len(documents(spark, f"{out}/{kind}/classification_report")) == 5
        jobs.run_explanations(model, train, test, "id", 0.4, f"{out}/{kind}/why", k=2)
        local = documents(spark, f"{out}/{kind}/why/local_explanations")
        assert {d["outcome"] for d in local} == {"TN", "FP", "FN", "TP"}
        assert all(len(d["top_positive"]) <= 2 for d in local if "top_positive" in d and d["top_positive"])
        doc = json.loads(files.read_text(spark, f"{out}/{kind}/why/provenance"))
        assert doc["feature_count"] == 4 and doc["explained_rows"] == 150
        grouped = spark.read.option("header", True).csv(f"{out}/{kind}/why/grouped_importance")
        assert {r["original_feature"] for r in grouped.collect()} == {"x1", "x2", "c"}


def test_threshold_job(spark, tmp_path):
    got = jobs.run_threshold_analysis(views.scored_documents(spark, SF), str(tmp_path))
    assert got.count() == 4 and len(documents(spark, f"{tmp_path}/threshold_results")) == 17


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a"), (2, None, "b")], "k int, v double, s string")
    df.write.option("header", True).csv(str(tmp_path / "t.csv"))
    assert files.read_table(spark, str(tmp_path / "t.csv"), df.schema).exceptAll(df).isEmpty()
    bad = str(tmp_path / "bad.csv")
    with open(bad, "w") as f:
        f.write("k,v\n1,2.5\nx,3\n")
    rows = files.read_csv(spark, bad, spark.createDataFrame([], "k int, v double").schema, "_bad").cache().collect()
    assert [r["_bad"] for r in rows] == [None, "x,3"]
    df.write.parquet(str(tmp_path / "p"))
    assert files.schema_columns(spark, str(tmp_path / "p"), ["v"], ["k"]) == ["s"]
    digest = files.file_digests(spark, bad).first()
    import hashlib

    assert digest["sha256"] == hashlib.sha256(open(bad, "rb").read()).hexdigest()
    report = {r["check"]: r["ok"] for r in files.manifest_report(df, 2, 4, "a", "a").collect()}
    assert report == {"row_count": True, "column_count": False, "sha256": True}


def test_splits_prune_partitions(spark, tmp_path):
    s = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train")], "k int, split string")
    files.write_splits(s, str(tmp_path / "s"))
    train = files.read_split(spark, str(tmp_path / "s"), "train")
    assert sorted(r["k"] for r in train.collect()) == [1, 3]
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
