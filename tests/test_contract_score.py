import json

import pytest
from pyspark.sql import functions as F

from riskframe import failures
from riskframe.operators import contract as ct
from riskframe.operators import models, score, telemetry
from riskframe.plans import jobs
from riskframe.sources import artifacts, files
from riskframe.sources.files import tree_digest
from riskframe.streaming import scoring as stream_scoring
from riskframe.streaming import telemetry as stream_telemetry
from test_errors_explain import training_table

RULES = ct.Contract(
    numeric={
        "senior": ct.NumericRule("int", allowed=(0, 1)),
        "tenure": ct.NumericRule("int", 0, 72),
        "monthly": ct.NumericRule("float", 0.0),
    },
    categorical={"net": ("DSL", "Fiber optic", "No")},
    forbidden=("customerID", "Churn"),
)
SCHEMA = "senior double, tenure double, monthly double, net string"
GOOD = (0.0, 12.0, 75.5, "DSL")


def codes(df, rules=RULES):
    return sorted((e["column"], e["code"]) for r in rules.check(df).collect() for e in r[ct.ERRORS])


def fault(frame, **change):
    row = dict(zip(("senior", "tenure", "monthly", "net"), GOOD)) | change
    return frame(SCHEMA, tuple(row.values()))


def test_valid_row(frame):
    assert codes(frame(SCHEMA, GOOD)) == []
    assert RULES.require_valid(frame(SCHEMA, GOOD)).columns == ["senior", "tenure", "monthly", "net"]


@pytest.mark.parametrize(
    "change,code",
    [
        ({"monthly": None}, "missing"), ({"monthly": float("nan")}, "missing"),
        ({"monthly": float("inf")}, "non_finite"), ({"monthly": float("-inf")}, "non_finite"),
        ({"monthly": -1.0}, "below_minimum"), ({"tenure": -1.0}, "below_minimum"),
        ({"tenure": 73.0}, "above_maximum"), ({"tenure": 1.5}, "not_integer"), ({"tenure": float("inf")}, "not_integer"),
        ({"senior": 2.0}, "not_allowed"), ({"net": "dsl"}, "unknown_category"), ({"net": "Cable"}, "unknown_category"),
        ({"net": None}, "missing"), ({"net": ""}, "missing"), ({"net": "  "}, "missing"),
    ],
)
def test_single_faults(frame, change, code):
    assert codes(fault(frame, **change)) == [(next(iter(change)), code)]


def test_boundaries_and_trim(frame):
    assert codes(frame(SCHEMA, (1.0, 0.0, 0.0, " DSL "), (0.0, 72.0, 1e9, "No"))) == []
    assert RULES.split(frame(SCHEMA, (1.0, 0.0, 0.0, " DSL ")))[0].first()["net"] == "DSL"


def test_text_numbers(frame):
    text = lambda *v: frame("senior string, tenure string, monthly string, net string", v)
    assert codes(text("0", " 12 ", "75.5", "DSL")) == []
    assert codes(text("0", "12.0", "abc", "DSL")) == [("monthly", "invalid"), ("tenure", "invalid")]
    assert codes(text("0", "12", "nan", "DSL")) == [("monthly", "non_finite")]
    assert codes(text("0", "12", "-Infinity", "DSL")) == [("monthly", "non_finite")]
    assert codes(text(None, "", "1", "DSL")) == [("senior", "missing"), ("tenure", "invalid")]


def test_lenient_mode(frame):
    lenient = ct.Contract(RULES.numeric, RULES.categorical, allow_unknown=True)
    assert codes(fault(frame, net="Cable"), lenient) == []
    assert codes(fault(frame, net=" "), lenient) == [("net", "missing")]


def test_columns(frame):
    df = frame(SCHEMA, GOOD)
    for bad, text in (
        (df.drop("tenure"), "Missing"), (df.withColumn("customerID", F.lit("1")), "Forbidden"),
        (df.withColumn("Churn", F.lit("No")), "Forbidden"), (df.withColumn("extra", F.lit(1)), "Unexpected"),
    ):
        with pytest.raises(ct.ContractError, match=text):
            RULES.check(bad)
    with pytest.raises(ct.ContractError, match="[Ee]mpty"):
        RULES.require_valid(df.where("false"))


def test_all_violations_of_all_rows(frame):
    df = frame(SCHEMA, (2.0, -1.0, None, "x"), GOOD, (0.0, 100.0, 1.0, "DSL"))
    assert len(codes(df)) == 5
    with pytest.raises(ct.ContractError) as e:
        RULES.require_valid(df)
    assert len(e.value.errors) == 5
    valid, rejected = RULES.split(df)
    assert (valid.count(), rejected.count()) == (1, 2)
    assert RULES.check(df)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_contract_document():
    text = RULES.to_json()
    again = ct.Contract.from_json(text)
    assert again == RULES and json.loads(text)["numeric_constraints"]["tenure"] == {"type": "int", "min": 0, "max": 72}


# ------------------------------------------------------------ scoring


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    table = training_table(spark, 300).cache()
    model = models.risk_pipeline(["x1", "x2"], ["c"], kind="logistic").fit(table)
    path = str(tmp_path_factory.mktemp("model"))
    rules = artifacts.derive_contract(model, {"x1": ct.NumericRule("float", 0.0, 1.0)}, ("y",))
    artifacts.save_artifacts(spark, path, model, rules, 0.4, "cost", "test")
    return path, table.select("id", "x1", "x2", "c")


def test_derived_contract(spark, saved):
    scorer = score.Scorer.load(spark, saved[0])
    assert scorer.contract.feature_order == ["x1", "x2", "c"] and scorer.contract.categorical == {"c": ("u", "v")}
    assert scorer.threshold() == 0.4 and scorer.threshold(0.9) == 0.9
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError):
            scorer.threshold(bad)


def test_scores(spark, saved):
    path, rows = saved
    scorer = score.Scorer.load(spark, path).keeping("id")
    out = scorer.score(rows).cache()
    assert out.count() == rows.count()
    assert out.where((F.col("probability") >= 0.4) != (F.col("prediction") == 1)).isEmpty()
    assert out.where((F.col("prediction_label") == "Yes") != (F.col("prediction") == 1)).isEmpty()
    assert out.columns[:4] == rows.columns
    assert scorer.predict(rows).columns == [*rows.columns, "prediction"]
    assert scorer.predict_proba(rows).columns == [*rows.columns, "probability"]
    assert "probability" not in scorer.score(rows, return_proba=False).columns
    assert scorer.score(rows, threshold=0.0).where("prediction = 0").isEmpty()
    with pytest.raises(ct.ContractError):
        scorer.score(rows.withColumn("c", F.lit("w")))


def test_quarantine_mode(spark, saved):
    path, rows = saved
    scorer = score.Scorer.load(spark, path).keeping("id")
    mixed = rows.withColumn("c", F.when(F.col("id") % 10 == 0, "w").otherwise(F.col("c")))
    n, bad = rows.count(), rows.where("id % 10 = 0").count()
    assert scorer.score(mixed, mode="valid").count() == n - bad and scorer.quarantine(mixed).count() == bad


def broken_copy(saved, tmp_path, edit):
    import shutil

    target = str(tmp_path / "copy")
    shutil.copytree(saved[0], target)
    edit(target)
    return target


def edit_manifest(spark, change):
    def edit(path):
        doc = json.loads(files.read_text(spark, f"{path}/manifest"))
        change(doc)
        files.write_text(spark, json.dumps(doc), f"{path}/manifest")

    return edit


def failed(spark, path, **kw):
    return {c for c, ok, _ in artifacts.artifact_checks(spark, path, **kw) if not ok}


def test_artifact_checks(spark, saved, tmp_path):
    assert failed(spark, saved[0], expected_threshold=0.4) == set()
    assert failed(spark, saved[0], expected_threshold=0.5) == {"threshold_expected"}
    assert "manifest_readable" in failed(spark, str(tmp_path / "nowhere"))


@pytest.mark.parametrize(
    "change,check",
    [
        (lambda d: d.pop("runtime"), "manifest_keys"),
        (lambda d: d.update(version="9"), "version_match"),
        (lambda d: d["threshold_metadata"].update(value=0.9), "threshold_consistent"),
        (lambda d: d["artifact_integrity"].update(algorithm="md5"), "hash_algorithm"),
        (lambda d: d["artifact_integrity"].update(pipeline_sha256="0"), "hash_match"),
        (lambda d: d["preprocessing"].update(numeric_features=["z"]), "features_match"),
    ],
)
def test_broken_manifests(spark, saved, tmp_path, change, check):
    assert check in failed(spark, broken_copy(saved, tmp_path, edit_manifest(spark, change)))


def test_tampered_model_is_not_loaded(spark, saved, tmp_path):
    def edit(path):
        with open(f"{path}/model/extra", "w") as f:
            f.write("x")

    path = broken_copy(saved, tmp_path, edit)
    with pytest.raises(ValueError, match="integrity"):
        score.Scorer.load(spark, path)
    assert failed(spark, path) == {"hash_match"}
    score.Scorer.load(spark, path, verify=False)


def test_file_scoring_and_events(spark, saved, tmp_path):
    path, rows = saved
    source, out, events = (str(tmp_path / n) for n in ("in.csv", "out.csv", "events"))
    rows.write.option("header", True).csv(source)
    got = jobs.score_files(spark, path, source, out, events, passthrough=["id"])
    written = spark.read.option("header", True).csv(out)
    assert got["rows"] == rows.count() == written.count()
    assert {"churn_prediction", "churn_probability"} <= set(written.columns)
    assert got["positive"] == written.where("churn_prediction = '1'").count()
    assert written.columns == [*rows.columns, "churn_prediction", "churn_probability"]
    text = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])
    assert written.select(*rows.columns).exceptAll(text).isEmpty()
    with pytest.raises(ct.ContractError):
        jobs.score_files(spark, path, source, out, events)
    log = files.read_events(spark, events).orderBy("timestamp").collect()
    assert [r["success"] for r in log] == [True, False] and log[1]["error_category"] == "validation_error"
    assert log[0]["positive_predictions"] + log[0]["negative_predictions"] == log[0]["prediction_count"]
    assert log[0]["model_artifact_hash"] and log[0]["latency_ms"] > 0


def test_stream_equals_batch(spark, saved, tmp_path):
    path, rows = saved
    source = str(tmp_path / "in")
    mixed = rows.withColumn("c", F.when(F.col("id") % 50 == 0, "w").otherwise(F.col("c")))
    mixed.repartition(4).write.parquet(source)
    scorer = score.Scorer.load(spark, path).keeping("id")
    stream = spark.readStream.schema(mixed.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda: stream_scoring.start_scoring(stream, scorer, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "ck")).awaitTermination()
    run()
    run()
    out = spark.read.parquet(str(tmp_path / "out")).select("id", "probability", "prediction")
    batch = scorer.score(mixed, mode="valid").select("id", "probability", "prediction")
    assert out.exceptAll(batch).isEmpty() and batch.exceptAll(out).isEmpty()
    assert spark.read.parquet(str(tmp_path / "bad")).count() == scorer.quarantine(mixed).count()


# ------------------------------------------------------------ telemetry


def test_counters(spark):
    e = telemetry.scoring_event(spark, "predict_batch", 5.0, 0.1, 10, 4)
    for c in telemetry.ERROR_CATEGORIES:
        e = e.unionByName(telemetry.scoring_event(spark, "predict_batch", 1.0, 0.1, failure=c))
    r = telemetry.telemetry_summary(e).first()
    assert (r["invocation_count"], r["success_count"], r["failure_count"]) == (6, 1, 5)
    for c in ("validation", "inference", "artifact_integrity", "artifact_load"):
        assert r[f"{c}_failure_count"] == 1
    assert (r["total_predictions"], r["positive_predictions"], r["negative_predictions"]) == (10, 4, 6)
    with pytest.raises(ValueError):
        telemetry.scoring_event(spark, "x", 1.0, 0.1, failure="odd")


def test_categories(spark, tmp_path):
    c = telemetry.error_category
    assert c(ct.ContractError("x", [])) == "validation_error"
    assert c(failures.ArtifactTampered("x")) == "artifact_integrity_error"
    assert c(failures.ScoringFailed("x")) == "inference_error"
    assert c(RuntimeError("sha256 integrity")) == c(ValueError("other")) == "unknown_error"
    wrapped = RuntimeError("outer")
    wrapped.__cause__ = failures.ArtifactMissing("inner")
    assert c(wrapped) == "artifact_load_error"
    with pytest.raises(failures.ArtifactMissing) as missing:
        score.Scorer.load(spark, f"{tmp_path}/nowhere")
    assert c(missing.value) == "artifact_load_error"
    with pytest.raises(ValueError) as wrong:
        score.check_threshold(1.5)
    assert c(wrong.value) == "validation_error"


def test_digest_sees_moved_and_swapped_files(spark, tmp_path):
    def digest(files):
        root = tmp_path / f"m{len(list(tmp_path.iterdir()))}" / "model"
        for name, text in files.items():
            (root / name).parent.mkdir(parents=True, exist_ok=True)
            (root / name).write_text(text)
        return tree_digest(spark, str(root))

    plain = digest({"a/part": "1", "b/part": "2"})
    assert plain == digest({"a/part": "1", "b/part": "2"})
    assert plain != digest({"a/part": "2", "b/part": "1"})
    assert plain != digest({"a/part": "1", "c/part": "2"})


def test_events_hold_no_row_data():
    allowed = {
        "event_type", "timestamp", "prediction_count", "positive_predictions", "negative_predictions", "latency_ms",
        "threshold", "model_artifact_hash", "success", "error_category", "batch_size",
    }
    assert set(telemetry.EVENT_SCHEMA.fieldNames()) == allowed


def test_invocation_numbers(frame):
    e = frame("c string, t string", ("a", "2024-01-01 10:00:00"), ("a", "2024-01-03 09:00:00"), ("a", "2024-01-01 11:00:00"), ("b", "2024-01-02 00:00:00"))
    e = e.withColumn("t", F.to_timestamp("t"))
    got = [tuple(r)[0:1] + (r["invocation_count"],) for r in telemetry.with_invocation_number(e, "c", "t", ranges=2).orderBy("c", "t").collect()]
    assert got == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]


def test_late_events_are_dropped(spark, tmp_path):
    source = str(tmp_path / "events")

    def put(*stamps):
        rows = [("predict", t, 1, 1, 0, 1.0, 0.1, None, True, None, 1) for t in stamps]
        names = telemetry.EVENT_SCHEMA.fieldNames()
        df = spark.createDataFrame(
            rows,
            "event_type string, timestamp string, prediction_count long, positive_predictions long, negative_predictions long, "
            "latency_ms double, threshold double, model_artifact_hash string, success boolean, error_category string, batch_size long",
        ).withColumn("timestamp", F.to_timestamp("timestamp")).select(*names)
        df.coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(telemetry.EVENT_SCHEMA).parquet(source)
        stream_telemetry.run_windowed_telemetry(stream, str(tmp_path / "out"), str(tmp_path / "ck"), mode="append")

    put("2024-01-01 10:00:00")
    run()
    put("2024-01-03 10:00:00")
    run()
    put("2024-01-01 12:00:00", "2024-01-05 00:00:00")
    run()
    rows = {str(r["window_start"])[:10]: r["invocation_count"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {"2024-01-01": 1, "2024-01-03": 1}


def test_inputs_and_rules_are_evaluated_once(spark):
    rules = ct.Contract({"words": ct.NumericRule("float", minimum=1.0, maximum=50.0)}, {"first": ("a", "b")}, passthrough=("id",))
    texts = spark.createDataFrame([(1, "a b c"), (2, "c d"), (3, " "), (4, None)], "id long, text string")
    words = F.size(F.array_distinct(F.split("text", "[a-c]"))).cast("double")
    rows = texts.select("id", words.alias("words"), F.substring("text", 1, 1).alias("first"))
    valid, rejected = rules.split(rows)
    for out in (valid, rejected, rules.select_valid(rules.check(rows), keep_input=True)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("array_distinct") == 1 and plan.count("unknown_category") == 1
    assert [r["id"] for r in valid.collect()] == [1]
    assert {r["id"] for r in rejected.collect()} == {2, 3, 4}
