"""Expected business cost of a decision threshold, and the cheapest threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import checked_y, safe_div, struct_array
from ..session import require_small
from ..spec import COST_TOLERANCE, LABEL, SCORE, CostScenario, RetentionScenario
from .thresholds import threshold_sweep

_COUNTS = ("tn", "fp", "fn", "tp")
# Texts of the result document.
OBJECTIVE = "minimize_expected_business_cost"
TIE_RULE = (
    "1. minimum total_cost; 2. if tied and FP cost > FN cost: higher threshold; "
    "3. if tied and FP cost <= FN cost: higher recall; 4. lower threshold"
)
_ASSUMPTIONS = (
    "cost_tn", "cost_fp", "cost_fn", "cost_tp", "cost_intervention", "retention_success_rate", "clv",
)
_BUSINESS = (
    "total_cost", "average_cost", "cost_per_predicted", "net_business_value", "expected_churn_loss",
    "expected_intervention_cost", "expected_retained_value", "precision", "recall", "f1",
    "accuracy", "specificity", "npv",
)


def _checked_counts() -> list[Column]:
    return [
        F.when(F.col(c) >= 0, F.col(c)).otherwise(
            F.raise_error(F.lit(f"count {c} must not be negative")).cast("bigint")
        )
        for c in _COUNTS
    ]


def _with_scenarios(df: DataFrame, scenarios: Sequence) -> DataFrame:
    rows = require_small([s.row() for s in scenarios], "scenarios", 2_000)
    if len({r["scenario"] for r in rows}) != len(rows):
        raise ValueError("scenario labels must be distinct")
    spread = df.withColumn("_s", F.explode(struct_array(rows)))
    return spread.select(*df.columns, "_s.*")


def with_costs(counts: DataFrame, scenarios: Sequence[CostScenario]) -> DataFrame:
    """Every row of ``tn, fp, fn, tp`` under every scenario, with three cost figures."""
    tn, fp, fn, tp = _checked_counts()
    c = {k: F.col(f"cost_{k}") for k in _COUNTS}
    total = tn * c["tn"] + fp * c["fp"] + fn * c["fn"] + tp * c["tp"]
    return (
        _with_scenarios(counts, scenarios)
        .withColumn("total_cost", total)
        .withColumn("average_cost", safe_div(F.col("total_cost"), tn + fp + fn + tp))
        .withColumn(
            "cost_per_predicted", safe_div(fp * c["fp"] + tp * c["tp"], fp + tp)
        )
    )


def with_retention_costs(counts: DataFrame, scenarios: Sequence[RetentionScenario]) -> DataFrame:
    """As ``with_costs`` for contacts that keep a churner only with some probability."""
    tn, fp, fn, tp = _checked_counts()
    r, clv, contact = F.col("retention_success_rate"), F.col("clv"), F.col("cost_intervention")
    lost = F.lit(1.0) - r
    total = tn * F.col("cost_tn") + fp * contact + fn * clv + tp * (contact + lost * clv)
    return (
        _with_scenarios(counts, scenarios)
        .withColumn("total_cost", total)
        .withColumn("average_cost", safe_div(F.col("total_cost"), tn + fp + fn + tp))
        .withColumn("cost_per_predicted", safe_div((fp + tp) * contact, fp + tp))
        .withColumn("net_business_value", -F.col("total_cost"))
        .withColumn("expected_churn_loss", fn * clv + tp * lost * clv)
        .withColumn("expected_intervention_cost", (fp + tp) * contact)
        .withColumn("expected_retained_value", tp * r * clv)
    )


def cheapest_threshold(
    costed: DataFrame,
    by: Sequence[str] = (),
    false_alarm: str = "cost_fp",
    miss: str = "cost_fn",
    tolerance: float = COST_TOLERANCE,
) -> DataFrame:
    """The row with the lowest total cost per group and scenario.

    Costs within the tolerance tie. If a false alarm costs more than a miss the highest
    tied threshold wins, else the best recall (same tolerance), then the lowest threshold.
    Windows run over the thresholds of one group and scenario only.
    """
    group = [*by, "scenario"]
    w = Window.partitionBy(*group)
    high_first = F.col(false_alarm) > F.col(miss)
    order = F.when(high_first, -F.col("threshold")).otherwise(F.col("threshold"))
    tied = costed.withColumn("_min", F.min("total_cost").over(w)).where(
        F.col("total_cost") - F.col("_min") < tolerance
    )
    kept = tied.withColumn("_recall", F.max("recall").over(w)).where(
        high_first | (F.col("_recall") - F.col("recall") < tolerance)
    )
    first = kept.withColumn("_rn", F.row_number().over(w.orderBy(order)))
    return first.where(F.col("_rn") == 1).drop("_min", "_recall", "_rn")


def cost_sensitivity(
    scored: DataFrame, scenarios: Sequence[CostScenario], grid=None, by: Sequence[str] = ()
) -> DataFrame:
    """Cheapest threshold of each scenario from a single sweep."""
    return sweep_sensitivity(threshold_sweep(scored, grid, by), scenarios, by)


def sweep_sensitivity(sweep: DataFrame, scenarios: Sequence[CostScenario], by: Sequence[str] = ()) -> DataFrame:
    """``cost_sensitivity`` of a sweep that is there already."""
    best = cheapest_threshold(with_costs(sweep, scenarios), by)
    ratio = F.when(F.col("cost_fp") > 0, F.col("cost_fn") / F.col("cost_fp")).otherwise(
        F.lit(float("inf"))
    )
    return best.select(
        *by,
        "scenario",
        *[f"cost_{c}" for c in _COUNTS],
        ratio.alias("fn_to_fp_ratio"),
        F.col("threshold").alias("optimal_threshold"),
        F.col("total_cost").alias("optimal_total_cost"),
        F.col("average_cost").alias("optimal_average_cost"),
        F.col("recall").alias("optimal_recall"),
        F.col("precision").alias("optimal_precision"),
        F.col("f1").alias("optimal_f1"),
    )


def cheapest_retention_threshold(costed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return cheapest_threshold(costed, by, "cost_intervention", "clv")


def _class_totals(df: DataFrame, by: Sequence[str], y: str) -> DataFrame:
    label = checked_y(F.col(y))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("population_size"),
        F.coalesce(F.sum(label), F.lit(0)).cast("bigint").alias("n_churn"),
    ).withColumn("n_no_churn", F.col("population_size") - F.col("n_churn"))


def with_baselines(totals: DataFrame) -> DataFrame:
    """Cost of contacting nobody and everybody, from population and class counts."""
    n, churn = F.col("population_size"), F.col("n_churn")
    lost = F.lit(1.0) - F.col("retention_success_rate")
    return (
        totals.withColumn("contact_no_one_total_cost", churn * F.col("clv"))
        .withColumn(
            "contact_everyone_total_cost",
            n * F.col("cost_intervention") + churn * lost * F.col("clv"),
        )
        .withColumn("contact_no_one_avg_cost", safe_div(F.col("contact_no_one_total_cost"), n))
        .withColumn("contact_everyone_avg_cost", safe_div(F.col("contact_everyone_total_cost"), n))
    )


def policy_baselines(
    labelled: DataFrame,
    scenarios: Sequence[RetentionScenario],
    by: Sequence[str] = (),
    y: str = LABEL,
) -> DataFrame:
    """The two policies without a model, on the same population."""
    return with_baselines(_with_scenarios(_class_totals(labelled, by, y), scenarios))


def retention_sensitivity(
    scored: DataFrame,
    scenarios: Sequence[RetentionScenario],
    grid=None,
    by: Sequence[str] = (),
    y: str = LABEL,
    p: str = SCORE,
) -> DataFrame:
    """Cheapest threshold of each retention scenario and its value against both policies.

    Population and class counts come from the chosen row, so the table is read once.
    """
    return sweep_retention_sensitivity(threshold_sweep(scored, grid, by, y, p), scenarios, by)


def sweep_retention_sensitivity(
    sweep: DataFrame, scenarios: Sequence[RetentionScenario], by: Sequence[str] = ()
) -> DataFrame:
    """``retention_sensitivity`` of a sweep that is there already."""
    costed = with_retention_costs(sweep, scenarios)
    best = cheapest_retention_threshold(costed, by)
    full = with_baselines(
        best.withColumn("population_size", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
        .withColumn("n_churn", F.col("fn") + F.col("tp"))
    )
    none, everyone = F.col("contact_no_one_total_cost"), F.col("contact_everyone_total_cost")
    optimal = ["total_cost", "average_cost", "precision", "recall", "f1", "accuracy", *_COUNTS]
    return full.select(
        *by,
        "scenario",
        "retention_success_rate",
        "clv",
        "cost_intervention",
        "cost_tn",
        "cost_fp",
        "cost_fn",
        F.col("threshold").alias("optimal_threshold"),
        *[F.col(c).alias(f"optimal_{c}") for c in optimal],
        (none - F.col("total_cost")).alias("value_vs_no_contact"),
        (everyone - F.col("total_cost")).alias("value_vs_contact_all"),
        none.alias("contact_no_one_cost"),
        everyone.alias("contact_everyone_cost"),
    )


def savings(sensitivity: DataFrame) -> DataFrame:
    """Saving of each optimum against the better of the two policies, in percent."""
    none, everyone = F.col("contact_no_one_cost"), F.col("contact_everyone_cost")
    best = F.least(none, everyone)
    return sensitivity.withColumn("best_baseline_cost", best).withColumn(
        "best_baseline", F.when(none <= everyone, "no_contact").otherwise("contact_all")
    ).withColumn(
        "savings_pct", safe_div((best - F.col("optimal_total_cost")) * 100, best)
    )


def cost_summary(
    optimum: DataFrame,
    n_thresholds: int,
    metrics: dict | None = None,
    source: str = "out-of-fold predictions of the training rows",
    folds: int = 5,
    seed: int = 42,
) -> DataFrame:
    """The chosen row as one nested document per scenario, ready for a JSON sink."""
    cols = set(optimum.columns)
    retention = "retention_success_rate" in cols

    def part(names: Sequence[str]) -> Column:
        return F.struct(*[c for c in names if c in cols])

    given = metrics or {}
    quality = F.struct(
        *[F.lit(given.get(m)).cast("double").alias(m) for m in ("roc_auc", "average_precision")]
    )
    document = [
        F.lit(OBJECTIVE + ("_with_retention" if retention else "")).alias("objective"),
        F.col("threshold").alias("selected_threshold"),
        F.struct(
            F.col("scenario").alias("label"), *[c for c in _ASSUMPTIONS if c in cols]
        ).alias("cost_assumptions"),
        F.struct(
            F.lit(TIE_RULE).alias("tie_breaking_rule"),
            F.lit(n_thresholds).alias("n_thresholds_evaluated"),
        ).alias("optimization_summary"),
        part(_BUSINESS).alias("business_metrics"),
        quality.alias("model_level_metrics"),
        F.struct(*_COUNTS).alias("confusion_matrix"),
        F.struct(
            F.lit(source).alias("data_source"),
            F.lit(False).alias("test_set_used_for_optimization"),
            F.struct(
                F.lit(folds).alias("n_splits"), F.lit(True).alias("shuffle"), F.lit(seed).alias("random_state")
            ).alias("cv_config"),
        ).alias("optimization_data"),
    ]
    if retention:
        n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
        optimum = with_baselines(
            optimum.withColumns({"population_size": n, "n_churn": F.col("fn") + F.col("tp")})
        )
        none, everyone = F.col("contact_no_one_total_cost"), F.col("contact_everyone_total_cost")
        document.append(
            F.struct(
                none,
                F.col("contact_no_one_avg_cost"),
                everyone,
                F.col("contact_everyone_avg_cost"),
                (none - F.col("total_cost")).alias("value_vs_no_contact"),
                (everyone - F.col("total_cost")).alias("value_vs_contact_all"),
            ).alias("baseline_comparison")
        )
    return optimum.select(*document)
