"""Every operator as a query over the driver's tables: ``name -> f(spark, sf_dir)``.

Each query reads whole tables. Doubles are rounded at the end so that results can be
compared with another engine; the rounding is not part of any operator.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import round_doubles
from ..operators import (
    bootstrap,
    calibrate,
    clean,
    contract,
    cost,
    errors,
    explain,
    features,
    metrics,
    models,
    newton,
    profile,
    score,
    split,
    telemetry,
    thresholds,
)
from ..session import durable, shared_dir
from ..sources import artifacts, files, views
from ..streaming import scoring as stream_scoring
from ..streaming import telemetry as stream_telemetry
from . import jobs
from ..spec import (
    GRID_C,
    COARSE_GRID,
    COST_SCENARIOS,
    DEFAULT_COSTS,
    FINAL_CANDIDATES,
    FeatureSpec,
    RetentionScenario,
    retention_grid,
    threshold_grid,
)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
DOC_THRESHOLD = 0.19
SLICES = ["lang", "source"]
NUMERICS = ["n_chars", "dw", "log_chars"]
RETENTION = RetentionScenario(10.0, 100.0, 0.6, cost_fp=10.0, cost_fn=100.0, label="r=0.6")


def query(f: Query) -> Query:
    """Register a query under its function name."""
    REGISTRY[f.__name__] = lambda spark, sf_dir: round_doubles(f(spark, sf_dir))
    return f


# ------------------------------------------------------------ thresholds and costs


@query
def threshold_sweep(spark, sf):
    return thresholds.threshold_sweep(views.scored_documents(spark, sf))


@query
def threshold_sweep_returns(spark, sf):
    return thresholds.threshold_sweep(views.scored_returns(spark, sf))


@query
def threshold_grid_fine(spark, sf):
    return thresholds.threshold_sweep(views.scored_returns(spark, sf), threshold_grid(0.01, 0.99, 0.001))


@query
def threshold_sweep_by_lang(spark, sf):
    return thresholds.threshold_sweep(views.scored_documents(spark, sf), COARSE_GRID, ["lang"])


@query
def threshold_candidates(spark, sf):
    return thresholds.candidate_thresholds(
        thresholds.threshold_sweep(views.scored_documents(spark, sf), COARSE_GRID)
    )


@query
def fixed_thresholds(spark, sf):
    return thresholds.threshold_sweep(views.scored_documents(spark, sf), FINAL_CANDIDATES)


@query
def confusion_at_threshold(spark, sf):
    return thresholds.confusion_at(views.scored_documents(spark, sf), DOC_THRESHOLD, ["lang"])


@query
def cost_sweep(spark, sf):
    return cost.with_costs(
        thresholds.threshold_sweep(views.scored_documents(spark, sf)), [DEFAULT_COSTS]
    )


@query
def cost_optimal(spark, sf):
    return cost.cheapest_threshold(
        cost.with_costs(
            thresholds.threshold_sweep(views.scored_documents(spark, sf)), [DEFAULT_COSTS]
        )
    )


@query
def cost_sensitivity(spark, sf):
    return cost.cost_sensitivity(views.scored_documents(spark, sf), COST_SCENARIOS)


@query
def cost_sensitivity_returns(spark, sf):
    return cost.cost_sensitivity(views.scored_returns(spark, sf), COST_SCENARIOS)


@query
def cost_optimal_by_source(spark, sf):
    sweep = thresholds.threshold_sweep(views.scored_documents(spark, sf), by=["source"])
    best = cost.cheapest_threshold(cost.with_costs(sweep, [DEFAULT_COSTS]), ["source"])
    return best.select("source", "threshold", "tn", "fp", "fn", "tp", "total_cost", "average_cost")


@query
def retention_cost_sweep(spark, sf):
    return cost.with_retention_costs(
        thresholds.threshold_sweep(views.scored_documents(spark, sf)), [RETENTION]
    )


@query
def retention_cost_optimal(spark, sf):
    return cost.cheapest_retention_threshold(
        cost.with_retention_costs(
            thresholds.threshold_sweep(views.scored_documents(spark, sf)), [RETENTION]
        )
    )


@query
def retention_sensitivity(spark, sf):
    grid = retention_grid(clvs=(100.0, 200.0), interventions=(10.0, 150.0))
    return cost.retention_sensitivity(views.scored_documents(spark, sf), grid)


@query
def policy_baselines(spark, sf):
    return cost.policy_baselines(views.scored_documents(spark, sf), retention_grid())


@query
def retention_savings(spark, sf):
    found = cost.retention_sensitivity(views.scored_documents(spark, sf), retention_grid())
    return cost.savings(found).select(
        "retention_success_rate", "optimal_threshold", "optimal_total_cost",
        "best_baseline", "best_baseline_cost", "savings_pct",
    )


@query
def cost_summary(spark, sf):
    scored = views.scored_documents(spark, sf)
    best = cost.cheapest_threshold(
        cost.with_costs(thresholds.threshold_sweep(scored), [DEFAULT_COSTS])
    )
    doc = cost.cost_summary(best, len(threshold_grid()))
    return doc.select(
        "objective", "selected_threshold", "cost_assumptions.*",
        "optimization_summary.n_thresholds_evaluated", "business_metrics.*", "confusion_matrix.*",
    )


@query
def model_robustness(spark, sf):
    scored = views.two_scored_documents(spark, sf)
    models = F.explode(
        F.array(
            F.struct(F.lit("pinned").alias("model"), F.col("p").alias("p")),
            F.struct(F.lit("rival").alias("model"), F.col("p_rival").alias("p")),
        )
    )
    long = scored.select("y", models.alias("m")).select("m.model", "y", "m.p")
    sweep = thresholds.threshold_sweep(long, [0.05, 0.10, 0.15, 0.20, 0.30, 0.40], ["model"])
    return cost.with_costs(sweep, [DEFAULT_COSTS]).select(
        "model", "threshold", "total_cost", "tn", "fp", "fn", "tp"
    )


# ------------------------------------------------------------ model-level metrics


@query
def rank_metrics(spark, sf):
    return metrics.rank_metrics(views.scored_documents(spark, sf))


@query
def rank_metrics_by_lang(spark, sf):
    return metrics.rank_metrics(views.scored_documents(spark, sf), ["lang"])


@query
def rank_metrics_returns(spark, sf):
    return metrics.rank_metrics(views.scored_returns(spark, sf))


@query
def roc_points(spark, sf):
    return metrics.roc_points(views.scored_documents(spark, sf))


@query
def pr_points(spark, sf):
    return metrics.pr_points(views.scored_returns(spark, sf))


@query
def probability_losses(spark, sf):
    return metrics.probability_losses(views.scored_documents(spark, sf), ["lang"])


@query
def classification_report(spark, sf):
    return metrics.classification_report(views.scored_documents(spark, sf), 0.3)


@query
def positive_share(spark, sf):
    return metrics.positive_share(views.scored_documents(spark, sf, labelled=False), DOC_THRESHOLD, ["lang"])


@query
def scored_checks(spark, sf):
    return metrics.scored_checks(views.scored_documents(spark, sf))


# ------------------------------------------------------------ error analysis


@query
def error_rates(spark, sf):
    return errors.error_rates(views.scored_documents(spark, sf), DOC_THRESHOLD)


@query
def error_slices(spark, sf):
    return errors.error_slices(views.scored_documents(spark, sf), DOC_THRESHOLD, SLICES)


@query
def error_numeric(spark, sf):
    return errors.error_numeric(views.scored_documents(spark, sf), DOC_THRESHOLD, NUMERICS)


@query
def hard_cases(spark, sf):
    return errors.hard_cases(views.scored_documents(spark, sf), DOC_THRESHOLD)


# ------------------------------------------------------------ cleaning and profiling

RAW_NUMERIC = ["acctbal", "tenure"]
ACCOUNT_CATEGORIES = ["region", "segment_raw"]


def clean_table(spark, sf, drop=()):
    return clean.clean(
        views.accounts(spark, sf), ["total_text"], {"total_text": "tenure"}, drop=drop
    )


def labelled_accounts(spark, sf):
    return clean.with_label(clean_table(spark, sf), "lapsed")


@query
def accounts_raw(spark, sf):
    return views.accounts(spark, sf)


@query
def clean_accounts(spark, sf):
    return clean_table(spark, sf)


@query
def dataset_checks(spark, sf):
    return clean.dataset_checks(clean_table(spark, sf), "lapsed")


@query
def label_encode(spark, sf):
    return labelled_accounts(spark, sf).select("account_id", "y")


@query
def complete_rows(spark, sf):
    return clean.complete_rows(clean_table(spark, sf))


@query
def profile_shape(spark, sf):
    return profile.shape(clean_table(spark, sf))


@query
def profile_missing(spark, sf):
    return profile.missing_counts(clean_table(spark, sf))


@query
def profile_duplicates(spark, sf):
    return profile.duplicate_rows(clean_table(spark, sf, drop=["account_id", "acctbal"]))


@query
def profile_target(spark, sf):
    return profile.value_share(clean_table(spark, sf), "lapsed")


@query
def profile_numeric(spark, sf):
    return profile.describe_numeric(clean_table(spark, sf), ["acctbal", "tenure", "total_text"])


@query
def profile_categorical(spark, sf):
    return profile.categorical_values(
        views.documents_with_features(spark, sf, labelled=False).withColumn("n_chars", F.col("n_chars").cast("string")),
        ["lang", "source", "n_chars"],
    )


@query
def profile_correlation(spark, sf):
    return profile.correlation(clean_table(spark, sf), ["acctbal", "tenure", "total_text"])


@query
def profile_crosstab(spark, sf):
    return profile.row_percent(labelled_accounts(spark, sf), "segment_raw", "y")


# ------------------------------------------------------------ splits, folds, samples


def split_accounts(spark, sf):
    return split.stratified_split(labelled_accounts(spark, sf), "account_id", "y")


def folded_documents(spark, sf, k=5):
    # the texts are read once; cuts, folds and fits read the written features
    table = durable(views.scored_documents(spark, sf), "features")
    return split.stratified_folds(table, "doc_id", "y", k)


@query
def stratified_split(spark, sf):
    return split_accounts(spark, sf).select("account_id", "y", "split")


@query
def split_report(spark, sf):
    return split.split_report(split_accounts(spark, sf), "y")


@query
def stratified_folds(spark, sf):
    return folded_documents(spark, sf).select("doc_id", "y", "fold")


@query
def leakage_audit(spark, sf):
    return split.leakage_audit(split_accounts(spark, sf), "account_id")


@query
def sample_rows(spark, sf):
    return split.sample_rows(labelled_accounts(spark, sf).select("account_id", "tenure", "y"), "account_id", 500)


@query
def first_rows(spark, sf):
    return split.first_rows(views.scored_documents(spark, sf).select("doc_id", "p", "y"), ["doc_id"], 200)


@query
def fold_metrics(spark, sf):
    folded = folded_documents(spark, sf)
    return metrics.mean_and_std(metrics.six_metrics(folded, ["fold"]), models.SIX)


@query
def generalisation_gap(spark, sf):
    scored = split.stratified_split(views.scored_documents(spark, sf), "doc_id", "y")
    found = metrics.rank_metrics(scored, ["split"])
    return metrics.metric_gap(found, "split", "train", "test", ["roc_auc", "average_precision"])


@query
def cost_on_test(spark, sf):
    scored = split.stratified_split(views.scored_documents(spark, sf), "doc_id", "y")
    threshold = jobs.choose_threshold(scored.where(F.col("split") == "train"))
    return jobs.cost_at(scored.where(F.col("split") == "test"), threshold).select(
        "threshold", "tn", "fp", "fn", "tp", "total_cost", "average_cost"
    )


# ------------------------------------------------------------ feature preparation


@query
def impute_median(spark, sf):
    return features.fit_medians(clean_table(spark, sf), ["acctbal", "tenure", "total_text"])


@query
def impute_mode(spark, sf):
    return features.fit_modes(clean_table(spark, sf), ACCOUNT_CATEGORIES)


@query
def imputed_accounts(spark, sf):
    table = split_accounts(spark, sf)
    train = table.where(F.col("split") == "train")
    fills = {r["column"]: r["fill"] for r in features.fit_medians(train, ["total_text"]).collect()}
    fills |= {r["column"]: r["fill"] for r in features.fit_modes(train, ["segment_raw"]).collect()}
    return features.imputed(table, fills).select("account_id", "split", "total_text", "segment_raw")


@query
def one_hot_long(spark, sf):
    table = split_accounts(spark, sf)
    dictionary = features.category_dictionary(table.where(F.col("split") == "train"), ACCOUNT_CATEGORIES)
    return features.one_hot_long(table, "account_id", ACCOUNT_CATEGORIES, dictionary)


@query
def wide_categories(spark, sf):
    """Dictionary and vectors of a column with many values: size, and rows by what their vectors hold."""
    table = split_accounts(spark, sf).withColumn("spent", F.round("total_text", 0).cast("long").cast("string"))
    dictionary = features.category_dictionary(table.where(F.col("split") == "train"), ["spent", "region"])
    sizes = features.dictionary_sizes(dictionary)
    hot = features.wide_one_hot(features.with_category_ids(table, dictionary, ["spent", "region"], sizes), ["spent", "region"], sizes)
    ones = [features.vector_sum(f"cat__{c}").cast("int").alias(c) for c in ("region", "spent")]
    counted = hot.select("split", *ones).groupBy("split", "region", "spent").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("split", "region", "spent", "n", F.lit(sizes["spent"]).cast("long").alias("spent_values"))


@query
def encoded_means(spark, sf):
    table = split_accounts(spark, sf)
    fitted = features.TablePreprocessor(["tenure", "total_text"], ACCOUNT_CATEGORIES).fit(
        table.where(F.col("split") == "train")
    )
    names = features.feature_names(fitted)
    vectors = fitted.transform(table).select("split", vector_to_array("features").alias("x"))
    cells = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("x"))
    return (
        vectors.select("split", F.explode(cells).alias("c"))
        .groupBy("split", F.col("c")["feature"].alias("feature"))
        .agg(F.round(F.avg(F.col("c")["x"]), 4).alias("mean"))
    )


@query
def class_weights(spark, sf):
    table = labelled_accounts(spark, sf)
    weighted = features.with_class_weight(table, "y", features.class_weights(table, "y"))
    return weighted.groupBy("y").agg(
        F.max("weight").alias("weight"), F.round(F.sum("weight"), 4).alias("total_weight")
    )


# ------------------------------------------------------------ data contract

ACCOUNT_CONTRACT = contract.Contract(
    numeric={
        "tenure": contract.NumericRule("int", 0, 20),
        "acctbal": contract.NumericRule("float", 0.0),
        "total_text": contract.NumericRule("float", 0.0),
    },
    categorical={
        "region": ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"),
        "segment_raw": ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"),
    },
    forbidden=("lapsed",),
    passthrough=("account_id",),
)


def contract_input(spark, sf):
    return views.accounts(spark, sf).drop("lapsed")


@query
def contract_violations(spark, sf):
    checked = ACCOUNT_CONTRACT.check(contract_input(spark, sf))
    return contract.violations(checked, ["account_id"])


@query
def contract_summary(spark, sf):
    return contract.violation_summary(ACCOUNT_CONTRACT.check(contract_input(spark, sf)))


@query
def contract_lenient(spark, sf):
    lenient = replace(ACCOUNT_CONTRACT, allow_unknown=True)
    return contract.violation_summary(lenient.check(contract_input(spark, sf)))


@query
def contract_valid_rows(spark, sf):
    return ACCOUNT_CONTRACT.split(contract_input(spark, sf))[0]


@query
def contract_quarantine(spark, sf):
    rejected = ACCOUNT_CONTRACT.split(contract_input(spark, sf))[1]
    return rejected.select("account_id", F.size(contract.ERRORS).alias("n_errors"))


@query
def contract_columns(spark, sf):
    return ACCOUNT_CONTRACT.column_report(views.accounts(spark, sf).drop("region"))


# ------------------------------------------------------------ telemetry


@query
def telemetry_summary(spark, sf):
    return telemetry.telemetry_summary(views.scoring_events(spark, sf))


@query
def telemetry_by_type(spark, sf):
    return telemetry.telemetry_summary(views.scoring_events(spark, sf), ["event_type"])


@query
def telemetry_daily(spark, sf):
    out = telemetry.telemetry_summary(views.scoring_events(spark, sf), ["event_type"], "1 day")
    return out.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).drop("window_start", "window_end")


@query
def telemetry_hourly(spark, sf):
    out = telemetry.telemetry_summary(views.scoring_events(spark, sf), window="1 hour")
    return out.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"),
        "invocation_count", "failure_count", "total_predictions",
    )


@query
def telemetry_stream(spark, sf):
    run = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    events = views.as_scoring_events(arriving)
    stream_telemetry.run_windowed_telemetry(events, f"{run}/out", f"{run}/checkpoint")
    out = stream_telemetry.latest_windows(spark.read.parquet(f"{run}/out"))
    return out.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).drop("window_start", "window_end")


@query
def invocation_numbers(spark, sf):
    events = views.scoring_events(spark, sf).select("event_id", "collector", "timestamp")
    return telemetry.with_invocation_number(events, "collector", "timestamp", ["event_id"]).drop("timestamp")


@query
def numbered_stream(spark, sf):
    """Calls numbered on a stream whose events arrive out of order, some of them a week late.

    Every week is a run of its own that goes on from the checkpoint; the last one brings a
    heartbeat for each collector.
    """
    run = f"{shared_dir(spark)}/numbering-{uuid.uuid4().hex}"
    events = views.scoring_events(spark, sf).select("event_id", "collector", "timestamp")
    shifted = F.unix_seconds("timestamp") + F.col("event_id") % 7 * 3600
    week = F.floor(shifted / 604800) + (F.col("event_id") % 50 == 0).cast("long")
    events.withColumn("week", week).write.partitionBy("week").parquet(f"{run}/weeks")
    arrived = spark.read.parquet(f"{run}/weeks")
    beat = F.max("timestamp") + F.expr("INTERVAL 2 HOURS")
    parts = [arrived.where(F.col("week") == w["week"]) for w in arrived.select("week").distinct().orderBy("week").collect()]
    parts.append(events.groupBy("collector").agg(F.lit(None).cast("long").alias("event_id"), beat.alias("timestamp")))
    for part in parts:
        part.select(*events.columns).write.mode("append").parquet(f"{run}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{run}/in")
        stream_telemetry.run_numbering(
            stream, f"{run}/out", f"{run}/checkpoint", collector="collector", time="timestamp", event_id="event_id"
        )
    return spark.read.parquet(f"{run}/out").select("event_id", "collector", "invocation_count", "late")


@query
def events_json_lines(spark, sf):
    path = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    names = telemetry.EVENT_SCHEMA.fieldNames()
    files.append_events(views.scoring_events(spark, sf).select(*names), path)
    return telemetry.telemetry_summary(files.read_events(spark, path), ["event_type", "error_category"])


# ------------------------------------------------------------ sources and sinks


@query
def threshold_csv(spark, sf):
    path = f"{shared_dir(spark)}/thresholds-{uuid.uuid4().hex}"
    costed = cost.with_costs(thresholds.threshold_sweep(views.scored_documents(spark, sf)), [DEFAULT_COSTS])
    files.write_threshold_csv(costed, path)
    schema = ", ".join(
        f"{c} {'bigint' if d is None else 'double'}" for c, d in files.THRESHOLD_COLUMNS.items()
    )
    return files.read_csv(spark, path, spark.createDataFrame([], schema).schema)


@query
def retention_csv(spark, sf):
    """The threshold table with the retention columns, written as CSV and read back."""
    path = f"{shared_dir(spark)}/thresholds-{uuid.uuid4().hex}"
    swept = thresholds.threshold_sweep(views.scored_documents(spark, sf))
    files.write_threshold_csv(cost.with_retention_costs(swept, [RETENTION]), path)
    schema = ", ".join(f"{c} {'bigint' if d is None else 'double'}" for c, d in files.RETENTION_COLUMNS.items())
    return files.read_csv(spark, path, spark.createDataFrame([], schema).schema)


def read_json_documents(spark, path, schema):
    """JSON documents read back with the schema of the table that was written."""
    return spark.read.schema(schema).json(path)


@query
def sensitivity_csv(spark, sf):
    """The cost run end to end: its sensitivity CSV read back."""
    run = f"{shared_dir(spark)}/costs-{uuid.uuid4().hex}"
    scored = views.scored_documents(spark, sf)
    jobs.run_cost_optimisation(scored, None, run)
    schema = cost.cost_sensitivity(scored, COST_SCENARIOS).schema
    return files.read_csv(spark, f"{run}/cost_sensitivity", schema)


@query
def error_report_files(spark, sf):
    """The error report end to end: its slices read back."""
    run = f"{shared_dir(spark)}/errors-{uuid.uuid4().hex}"
    scored = views.scored_documents(spark, sf)
    jobs.run_error_report(scored, DOC_THRESHOLD, SLICES, NUMERICS, run)
    schema = errors.error_slices(scored, DOC_THRESHOLD, SLICES).schema
    return read_json_documents(spark, f"{run}/error_slices", schema)


@query
def error_rates_json(spark, sf):
    """A JSON document written and read back."""
    path = f"{shared_dir(spark)}/rates-{uuid.uuid4().hex}"
    rates = errors.error_rates(views.scored_documents(spark, sf), DOC_THRESHOLD)
    files.write_json(rates, path)
    return read_json_documents(spark, path, rates.schema)


@query
def csv_roundtrip(spark, sf):
    path = f"{shared_dir(spark)}/accounts-{uuid.uuid4().hex}.csv"
    raw = views.accounts(spark, sf).select("account_id", "tenure", "region", "acctbal", "lapsed")
    raw.write.option("header", True).csv(path)
    return files.read_table(spark, path, raw.schema)


@query
def split_tables(spark, sf):
    path = f"{shared_dir(spark)}/splits-{uuid.uuid4().hex}"
    files.write_splits(split_accounts(spark, sf).select("account_id", "y", "split"), path)
    return files.read_split(spark, path, "val").select("account_id", "y")


@query
def dataset_manifest(spark, sf):
    """Record counts and hash of a stored table, then check it and a copy that lost one row."""
    run = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    table = views.table(spark, sf, "customer")
    table.write.parquet(f"{run}/intact/data")
    table.where("c_custkey <> 1").write.parquet(f"{run}/changed/data")
    recorded = files.tree_digest(spark, f"{run}/intact/data")
    rows, columns = table.count(), len(table.columns)
    reports = []
    for name in ("intact", "changed"):
        stored = f"{run}/{name}/data"
        report = files.manifest_report(
            spark.read.parquet(stored), rows, columns, files.tree_digest(spark, stored), expected_digest=recorded
        )
        reports.append(report.select(F.lit(name).alias("copy"), "check", "ok"))
    return reports[0].unionByName(reports[1])


# ------------------------------------------------------------ attribution

SPREAD = {"dw": "words", "log_chars": "length"}


def pinned_attribution(spark, sf):
    scored = views.scored_documents(spark, sf, labelled=False)
    means = explain.column_means(scored, list(views.DOC_WEIGHTS))
    return explain.linear_attribution(scored, ["doc_id"], views.DOC_WEIGHTS, means)


@query
def linear_attribution(spark, sf):
    return pinned_attribution(spark, sf)


@query
def global_importance(spark, sf):
    return explain.global_importance(pinned_attribution(spark, sf))


@query
def grouped_importance(spark, sf):
    scored = views.scored_documents(spark, sf, labelled=False)
    weights = {"dw": -11.06, "log_chars": -0.50, "n_chars": 0.0001}
    attr = explain.linear_attribution(
        scored, ["doc_id"], weights, explain.column_means(scored, list(weights))
    )
    return explain.grouped_importance(attr, {"dw": "words", "log_chars": "length", "n_chars": "length"})


@query
def local_top_contributors(spark, sf):
    return explain.top_contributors(pinned_attribution(spark, sf), ["doc_id"], 1).select(
        "doc_id", "direction", "rank", "feature", "contribution"
    )


@query
def outcome_examples(spark, sf):
    return explain.examples(views.scored_documents(spark, sf), DOC_THRESHOLD, "doc_id")


# ------------------------------------------------------------ models and calibration

MODEL_NUMERIC = ["dw", "log_chars"]


@query
def prior_baseline(spark, sf):
    folded = folded_documents(spark, sf)
    scored = models.oof_scores(folded, models.risk_pipeline(MODEL_NUMERIC, kind="prior"), 5, keep=["y", "fold"])
    return scored.groupBy("fold").agg(F.max("p").alias("p"), F.min("p").alias("p_min"))


def pinned_logistic(spark, sf):
    """A logistic model on the numeric features and the table it was fitted on."""
    table = durable(views.scored_documents(spark, sf), "train")
    return models.risk_pipeline(MODEL_NUMERIC, kind="logistic", C=10.0).fit(table), table


@query
def logistic_coefficients(spark, sf):
    table = models.coefficient_table(pinned_logistic(spark, sf)[0])
    return table.select("feature", F.round("coefficient", 3).alias("coefficient"), "direction", "rank")


@query
def oof_logistic(spark, sf):
    folded = folded_documents(spark, sf)
    scored = models.oof_scores(
        folded, models.risk_pipeline(MODEL_NUMERIC, kind="logistic", C=10.0), 5, keep=["doc_id", "y", "fold"]
    )
    return scored.withColumn("p", F.round("p", 4))


@query
def logistic_grid(spark, sf):
    """All points of five folds and the grid of C at once."""
    folded = folded_documents(spark, sf)
    fitted = newton.logistic_points(folded, MODEL_NUMERIC, GRID_C, range(5), "fold")
    return fitted.select(
        "fold", "C", *[F.round(c, 4).alias(n) for n, c in zip(("b0", "b1", "b2"), ("intercept", F.col("coefficients")[0], F.col("coefficients")[1]))]
    )


@query
def sigmoid_calibration(spark, sf):
    scored = views.scored_documents(spark, sf, labelled=False).select("doc_id", "p")
    fitted = calibrate.fit_calibrator(views.scored_documents(spark, sf), "sigmoid")
    return calibrate.apply_calibrator(scored, fitted).withColumn("p", F.round("p", 4))


@query
def isotonic_calibration(spark, sf):
    scored = folded_documents(spark, sf).select("doc_id", "y", "p")
    fitted = calibrate.fit_calibrator(scored, "isotonic")
    return calibrate.apply_calibrator(scored, fitted)


@query
def calibration_metrics(spark, sf):
    crossed = calibrate.cross_fit_calibration(folded_documents(spark, sf), "fold", 5)
    # nine decimals so that equal block means stay equal in every engine
    per_fold = calibrate.calibration_fold_metrics(crossed.withColumn("p", F.round("p", 9)))
    table = calibrate.calibration_table(per_fold)
    return table.select(
        "method", *[F.round(c, 3).alias(c) for c in ("log_loss", "brier", "roc_auc", "average_precision")]
    )


@query
def calibration_choice(spark, sf):
    crossed = calibrate.cross_fit_calibration(folded_documents(spark, sf), "fold", 5)
    table = calibrate.calibration_table(calibrate.calibration_fold_metrics(crossed))
    return calibrate.select_calibration(table).select("selected_method", "decision_rule")


@query
def calibrated_threshold(spark, sf):
    scored = folded_documents(spark, sf).select("doc_id", "y", "p")
    fitted = calibrate.fit_calibrator(scored, "isotonic")
    calibrated = calibrate.apply_calibrator(scored, fitted).withColumn("p", F.round("p", 9))
    best = cost.cheapest_threshold(
        cost.with_costs(thresholds.threshold_sweep(calibrated), [DEFAULT_COSTS])
    )
    return best.select("threshold", "total_cost", "tn", "fp", "fn", "tp")


@query
def calibration_run(spark, sf):
    """The calibration job end to end: the choice it wrote, read back."""
    run = f"{shared_dir(spark)}/calibration-{uuid.uuid4().hex}"
    jobs.run_calibration(folded_documents(spark, sf), "fold", 5, run)
    schema = "selected_method string, decision_rule string"
    return read_json_documents(spark, f"{run}/calibration_choice", schema)


# ------------------------------------------------------------ a model with gaps and categories


def gappy_documents(spark, sf, labelled=True):
    """Documents of which some lack the language or the share of distinct words."""
    table = views.documents_with_features(spark, sf, labelled=labelled)
    return table.withColumn("lang", F.when(F.col("doc_id") % 11 != 0, F.col("lang"))).withColumn(
        "dw", F.when(F.col("doc_id") % 13 != 0, F.col("dw"))
    )


def categorical_model(spark, sf):
    """Balanced logistic model on imputed numbers and an imputed, one-hot category."""
    table = durable(gappy_documents(spark, sf), "train")
    return models.risk_pipeline(MODEL_NUMERIC, ["lang"], kind="logistic", balanced=True, C=10.0).fit(table)


@query
def categorical_coefficients(spark, sf):
    table = models.coefficient_table(categorical_model(spark, sf))
    return table.select("feature", F.round("coefficient", 3).alias("coefficient"), "direction")


@query
def feature_mapping(spark, sf):
    """The slots of the fitted model's vector with the columns they come from and how often they are set."""
    model = categorical_model(spark, sf)
    slots = explain.feature_mapping(model, spark)
    vectors = model.transform(gappy_documents(spark, sf)).select(vector_to_array("features").alias("x"))
    used = vectors.select(F.posexplode("x").alias("position", "v")).groupBy("position").agg(F.count_if(F.col("v") != 0).alias("n_set"))
    return slots.join(used, "position", "left")


def saved_categorical_scorer(spark, sf):
    path = f"{shared_dir(spark)}/artifacts-{uuid.uuid4().hex}"
    fitted = categorical_model(spark, sf)
    rules = {"dw": contract.NumericRule("float", 0.0, 1.0), "log_chars": contract.NumericRule("float", 0.0)}
    artifacts.save_artifacts(
        spark, path, fitted, artifacts.derive_contract(fitted, rules, ("y",)), 0.5, "balanced classes", "final fit"
    )
    return score.Scorer.load(spark, path).keeping("doc_id")


@query
def categorical_scorer(spark, sf):
    """The saved model over all documents its contract accepts."""
    rows = gappy_documents(spark, sf, labelled=False).select("doc_id", *MODEL_NUMERIC, "lang")
    scored = saved_categorical_scorer(spark, sf).score(rows, mode="valid")
    return scored.select("doc_id", F.round("probability", 4).alias("probability"))


@query
def contract_from_model(spark, sf):
    """Violations of the contract that a fitted model implies, by its learned categories."""
    rows = gappy_documents(spark, sf, labelled=False).select("doc_id", *MODEL_NUMERIC, "lang")
    other = F.when(F.col("doc_id") % 7 == 0, F.upper("lang")).otherwise(F.concat(F.lit(" "), "lang"))
    scorer = saved_categorical_scorer(spark, sf)
    return contract.violations(scorer.contract.check(rows.withColumn("lang", other)), ["doc_id"]).select("doc_id", "column", "code")


@query
def calibrated_scorer(spark, sf):
    """Model and calibrator of its out-of-fold scores as one saved scorer, reloaded, over all documents."""
    spec = models.risk_pipeline(MODEL_NUMERIC, kind="logistic", C=10.0)
    table = durable(folded_documents(spark, sf), "train")
    oof = models.oof_scores(table, spec, 5, keep=["y"])
    whole = calibrate.calibrated_pipeline(spec.fit(table), calibrate.fit_calibrator(oof, "sigmoid"))
    path = f"{shared_dir(spark)}/artifacts-{uuid.uuid4().hex}"
    artifacts.save_artifacts(spark, path, whole, artifacts.derive_contract(whole), 0.3, "calibrated", "calibration")
    rows = views.documents_with_features(spark, sf, labelled=False).select("doc_id", *MODEL_NUMERIC)
    scored = score.Scorer.load(spark, path).keeping("doc_id").score(rows)
    return scored.select("doc_id", F.round("probability", 4).alias("probability"))


# ------------------------------------------------------------ scoring


def saved_scorer(spark, sf):
    """Fit on labelled documents and write the model; the second value is the table to score: all documents."""
    fitted, _ = pinned_logistic(spark, sf)
    path = f"{shared_dir(spark)}/artifacts-{uuid.uuid4().hex}"
    rules = {"dw": contract.NumericRule("float", 0.0, 1.0), "log_chars": contract.NumericRule("float", 0.0)}
    artifacts.save_artifacts(
        spark, path, fitted, artifacts.derive_contract(fitted, rules, ("y",)), 0.19,
        "Business cost optimization on OOF probabilities", "threshold optimisation",
    )
    return path, views.documents_with_features(spark, sf, labelled=False).select("doc_id", *MODEL_NUMERIC)


@query
def score_batch(spark, sf):
    path, rows = saved_scorer(spark, sf)
    scored = score.Scorer.load(spark, path).keeping("doc_id").score(rows)
    return scored.select(
        "doc_id", F.round("probability", 4).alias("probability"), "prediction", "prediction_label", "threshold"
    )


@query
def predict_classes(spark, sf):
    path, rows = saved_scorer(spark, sf)
    return score.Scorer.load(spark, path).keeping("doc_id").predict(rows, 0.3).select("doc_id", "prediction")


@query
def predict_probabilities(spark, sf):
    path, rows = saved_scorer(spark, sf)
    scored = score.Scorer.load(spark, path).keeping("doc_id").predict_proba(rows)
    return scored.select("doc_id", F.round("probability", 4).alias("probability"))


@query
def scored_file_rows(spark, sf):
    """File in, file out: the rows of the scored file."""
    path, rows = saved_scorer(spark, sf)
    run = f"{shared_dir(spark)}/scored-{uuid.uuid4().hex}"
    rows.write.parquet(f"{run}/in")
    jobs.score_files(spark, path, f"{run}/in", f"{run}/out.csv", f"{run}/events", threshold=0.3, passthrough=["doc_id"])
    out = spark.read.option("header", True).csv(f"{run}/out.csv")
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("churn_prediction").cast("int").alias("prediction"),
        F.round(F.col("churn_probability").cast("double"), 4).alias("probability"),
    )


@query
def score_files(spark, sf):
    path, rows = saved_scorer(spark, sf)
    run = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    rows.write.parquet(f"{run}/in")
    jobs.score_files(
        spark, path, f"{run}/in", f"{run}/out.csv", f"{run}/events", threshold=0.3, passthrough=["doc_id"]
    )
    return files.read_events(spark, f"{run}/events").select(
        "event_type", "prediction_count", "positive_predictions", "negative_predictions",
        "threshold", "success", "batch_size",
    )


@query
def score_stream(spark, sf):
    path, rows = saved_scorer(spark, sf)
    run = f"{shared_dir(spark)}/scoring-{uuid.uuid4().hex}"
    rows.write.parquet(f"{run}/in")
    scorer = score.Scorer.load(spark, path).keeping("doc_id")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{run}/in")
    started = stream_scoring.start_scoring(
        arriving, scorer, f"{run}/out", f"{run}/rejected", f"{run}/checkpoint"
    )
    started.awaitTermination()
    return spark.read.parquet(f"{run}/out").select(
        "doc_id", F.round("probability", 4).alias("probability"), "prediction", "prediction_label"
    )


@query
def failure_events(spark, sf):
    """Events of four calls: a good one, rows the contract rejects, a changed model, no model."""
    path, rows = saved_scorer(spark, sf)
    run = f"{shared_dir(spark)}/failures-{uuid.uuid4().hex}"
    rows.write.parquet(f"{run}/in")
    rows.withColumn("dw", F.when(F.col("doc_id") % 13 != 0, F.col("dw"))).write.parquet(f"{run}/gaps")

    def call(artifacts_path: str, source: str) -> None:
        out = f"{run}/out-{uuid.uuid4().hex}"
        jobs.score_files(spark, artifacts_path, source, out, f"{run}/events", threshold=0.3, passthrough=["doc_id"])

    def fails(artifacts_path: str, source: str) -> None:
        try:
            call(artifacts_path, source)
        except Exception:
            return
        raise AssertionError("the call should have failed")

    call(path, f"{run}/in")
    fails(path, f"{run}/gaps")
    spark.range(1).write.parquet(f"{path}/model/added")  # the hash of the model folder changes
    fails(path, f"{run}/in")
    fails(f"{run}/nowhere", f"{run}/in")
    names = ["success", "error_category", "prediction_count", "positive_predictions", "negative_predictions"]
    return files.read_events(spark, f"{run}/events").select("event_type", *names)


@query
def rejected_stream(spark, sf):
    """The rejected rows of a scoring stream in which some documents lack a share or exceed it."""
    path, rows = saved_scorer(spark, sf)
    run = f"{shared_dir(spark)}/scoring-{uuid.uuid4().hex}"
    key = F.col("doc_id")
    broken = F.when(key % 13 == 0, F.lit(None)).when(key % 17 == 0, F.col("dw") + 1).otherwise(F.col("dw"))
    rows.withColumn("dw", broken).write.parquet(f"{run}/in")
    scorer = score.Scorer.load(spark, path).keeping("doc_id")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{run}/in")
    stream_scoring.start_scoring(arriving, scorer, f"{run}/out", f"{run}/rejected", f"{run}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{run}/out").select("doc_id", F.lit(None).cast("string").alias("code"))
    return out.unionByName(contract.violations(spark.read.parquet(f"{run}/rejected"), ["doc_id"]).select("doc_id", "code"))


@query
def artifact_report(spark, sf):
    path, _ = saved_scorer(spark, sf)
    return artifacts.artifact_report(spark, path, 0.19).select("check", "ok")


# ------------------------------------------------------------ model comparison


def documents_spec():
    return FeatureSpec("doc_id", "y", ("dw", "log_chars"), ("lang", "source"))


@query
def model_comparison(spark, sf):
    spec = documents_spec()
    candidates = {
        "prior": models.risk_pipeline(spec, kind="prior"),
        "logistic": models.risk_pipeline(spec, kind="logistic", balanced=True),
        "tree": models.risk_pipeline(spec, kind="tree", balanced=True, maxDepth=5),
        "forest": models.risk_pipeline(spec, kind="forest", balanced=True, numTrees=20, maxDepth=5),
    }
    folded = folded_documents(spark, sf, 3).select("doc_id", *spec.features, "y", "fold")
    return models.compare_models(folded, candidates, 3)


def numeric_documents(spark, sf, k=5):
    return folded_documents(spark, sf, k).select("doc_id", *MODEL_NUMERIC, "y", "fold")


@query
def cv_metrics(spark, sf):
    return models.cv_metrics(
        numeric_documents(spark, sf), models.risk_pipeline(MODEL_NUMERIC, kind="logistic", C=10.0), 5
    )


@query
def random_search(spark, sf):
    folded = durable(numeric_documents(spark, sf), "folds")
    pipeline = models.risk_pipeline(MODEL_NUMERIC, kind="logistic")
    _, trials = models.random_search(folded, pipeline, {"C": [0.02, 10.0]}, 5, 5, parallelism=2)
    return spark.createDataFrame([(t["C"], t["score"]) for t in trials], "C double, score double")


@query
def nested_cv(spark, sf):
    table = durable(views.scored_documents(spark, sf), "train")
    pipeline = models.risk_pipeline(MODEL_NUMERIC, kind="logistic")
    per_fold, pooled, _ = models.nested_cv(
        table, pipeline, {"C": [0.01, 1.0, 100.0]}, 2, "doc_id", outer=3, inner=2, parallelism=2
    )
    return per_fold.select(F.col("outer_fold").cast("string").alias("part"), *models.SIX).unionByName(
        pooled.select(F.col("model").alias("part"), *models.SIX)
    )


@query
def nested_search(spark, sf):
    """Nested search of C: five outer and three inner folds, the whole grid."""
    folded = durable(split.stratified_folds(folded_documents(spark, sf), "doc_id", "y", 3, 43, "inner"), "folds")
    scored, _ = newton.nested_search(folded, MODEL_NUMERIC, GRID_C, "fold", "inner", (5, 3), ["y"])
    scored = durable(scored, "nested")
    chosen = scored.groupBy("fold").agg(F.max("C").alias("C"))
    return metrics.six_metrics(scored, ["fold"]).join(chosen, "fold")


def split_documents(spark, sf):
    return durable(split.stratified_split(views.scored_documents(spark, sf), "doc_id", "y"), "split")


@query
def model_selection(spark, sf):
    table = split_documents(spark, sf)
    train, val = table.where("split = 'train'"), table.where("split = 'val'")
    fitted = {
        name: models.risk_pipeline(MODEL_NUMERIC, kind="logistic", C=c).fit(train)
        for name, c in (("tight", 0.02), ("loose", 10.0))
    }
    return models.select_model(fitted, val, "average_precision")


@query
def final_evaluation(spark, sf):
    table = split_documents(spark, sf)
    _, ranks, sweep = jobs.final_evaluation(
        models.risk_pipeline(MODEL_NUMERIC, kind="logistic", C=10.0),
        table.where("split = 'train'"),
        table.where("split = 'test'"),
    )
    quality = ranks.first()
    return sweep.withColumns(
        {"roc_auc": F.lit(quality["roc_auc"]), "average_precision": F.lit(quality["average_precision"])}
    )


@query
def forest_evaluation(spark, sf):
    table = split_documents(spark, sf)
    _, ranks, _ = jobs.final_evaluation(
        models.tuned_forest(documents_spec(), trees=20),
        table.where("split = 'train'"),
        table.where("split = 'test'"),
    )
    return ranks


@query
def forest_attribution(spark, sf):
    table = durable(views.scored_documents(spark, sf), "train")
    fitted = models.tuned_forest(documents_spec(), trees=20).fit(table)
    attr, base = explain.forest_attribution(table, fitted, ["doc_id"])
    total = attr.groupBy("doc_id").agg((F.sum("contribution") + F.lit(base)).alias("explained"))
    scored = models.add_score(table, fitted, "probability", keep=["doc_id"])
    return scored.join(total, "doc_id").withColumn(
        "additive", F.abs(F.col("explained") - F.col("probability")) < 1e-9
    )


# per tree: node -> (feature of MODEL_NUMERIC, threshold, left child, right child)
PINNED_TREES = (
    {0: (0, 0.79, 1, 2), 1: (1, 7.3, 3, 4), 2: (1, 7.3, 5, 6)},
    {0: (1, 7.0, 1, 2), 2: (0, 0.7, 3, 4)},
    {0: (0, 0.8, 1, 2), 1: (0, 0.6, 3, 4), 2: (0, 0.9, 5, 6)},
)


@query
def tree_attribution(spark, sf):
    """All documents explained by three trees of depth two whose nodes count the labelled documents."""
    reached, counted = [], []
    for tree, splits in enumerate(PINNED_TREES):
        todo = [(0, F.lit(True))]
        while todo:
            node, here = todo.pop()
            i = len(reached)
            counted += [F.count_if(here & (F.col("y") == y)).cast("double").alias(f"n{i}_{y}") for y in (0, 1)]
            f, t, left, right = splits.get(node, (-1, None, -1, -1))
            reached.append((tree, node, left, right, f, [] if t is None else [t]))
            if t is not None:
                goes = F.col(MODEL_NUMERIC[f]) <= t
                todo += [(left, here & goes), (right, here & ~goes)]
    counts = views.documents_with_features(spark, sf).agg(*counted).first()
    nodes = spark.createDataFrame(
        [(*r[:4], [counts[f"n{i}_0"], counts[f"n{i}_1"]], *r[4:], -1) for i, r in enumerate(reached)],
        "treeID int, id int, leftChild int, rightChild int, impurityStats array<double>, feature int, left array<double>, n_categories int",
    )
    rows = views.documents_with_features(spark, sf, labelled=False).select("doc_id", F.array(*MODEL_NUMERIC).alias("x"))
    return explain.node_attribution(rows, nodes, MODEL_NUMERIC, ["doc_id"])[0]


@query
def bootstrap_cost(spark, sf):
    draws = bootstrap.cost_difference_replicates(
        views.two_scored_documents(spark, sf), "p", "p_rival", DOC_THRESHOLD, DOC_THRESHOLD
    )
    return bootstrap.prefer_second(bootstrap.bootstrap_interval(draws))


@query
def bootstrap_auc(spark, sf):
    draws = bootstrap.auc_difference_replicates(views.two_scored_documents(spark, sf), "p", "p_rival")
    return bootstrap.bootstrap_interval(draws, "auc_difference")


@query
def auc_difference(spark, sf):
    row = metrics.auc_difference(views.two_scored_documents(spark, sf), "p", "p_rival")
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns])


@query
def decision_cells(spark, sf):
    return bootstrap.decision_cells(
        views.two_scored_documents(spark, sf), "p", "p_rival", DOC_THRESHOLD, DOC_THRESHOLD
    )
