import random

import pytest

from riskframe.operators import cost
from riskframe.operators.thresholds import threshold_sweep, with_rates
from riskframe.spec import COST_SCENARIOS, DEFAULT_COSTS, CostScenario, RetentionScenario, retention_grid

# Published counts of a forest model at some thresholds: threshold, tn, fp, fn, tp.
COUNTS = [
    (0.10, 795, 1740, 11, 905), (0.12, 872, 1663, 14, 902), (0.13, 913, 1622, 18, 898),
    (0.26, 1346, 1189, 63, 853), (0.27, 1379, 1156, 65, 851), (0.28, 1413, 1122, 69, 847),
    (0.34, 1577, 958, 97, 819), (0.35, 1598, 937, 101, 815), (0.36, 1613, 922, 110, 806),
    (0.40, 1716, 819, 136, 780), (0.41, 1737, 798, 140, 776), (0.42, 1758, 777, 147, 769),
    (0.69, 2284, 251, 427, 489), (0.70, 2301, 234, 440, 476), (0.71, 2306, 229, 456, 460),
    (0.94, 2534, 1, 907, 9), (0.95, 2535, 0, 913, 3), (0.96, 2535, 0, 916, 0),
]
Y6, P6 = [0, 0, 0, 1, 1, 1], [0.2, 0.4, 0.6, 0.3, 0.5, 0.7]
Y8, P8 = [0, 0, 0, 1, 1, 1, 0, 1], [0.1, 0.2, 0.3, 0.6, 0.7, 0.8, 0.4, 0.9]


@pytest.fixture(scope="module")
def counts(spark):
    return with_rates(
        spark.createDataFrame(COUNTS, "threshold double, tn long, fp long, fn long, tp long")
    )


def best(scored, costs, grid=None):
    row = cost.cheapest_threshold(cost.with_costs(threshold_sweep(scored, grid), [costs])).collect()
    assert len(row) == 1
    return row[0]["threshold"], row[0]["total_cost"]


def test_scenario_optima(counts):
    got = {
        r["scenario"][9]: (r["threshold"], r["total_cost"])
        for r in cost.cheapest_threshold(cost.with_costs(counts, COST_SCENARIOS)).collect()
    }
    assert got == {
        "A": (0.95, 9160.0), "B": (0.35, 22570.0), "C": (0.27, 26570.0), "D": (0.12, 28450.0), "E": (0.7, 79500.0),
    }


def test_published_row(counts):
    r = cost.with_costs(counts, [DEFAULT_COSTS]).where("threshold = 0.27").first()
    assert r["average_cost"] == pytest.approx(7.699217618081716)
    assert r["cost_per_predicted"] == 10.0
    assert r["precision"] == pytest.approx(0.4240159441953164) and r["npv"] == pytest.approx(0.9549861495844876)
    assert r["specificity"] == pytest.approx(0.5439842209072978) and r["f1"] == pytest.approx(0.5822784810126582)


def test_retention_optima(counts):
    costed = cost.with_retention_costs(counts, retention_grid())
    got = {
        r["retention_success_rate"]: (r["threshold"], round(r["total_cost"], 6))
        for r in cost.cheapest_retention_threshold(costed).collect()
    }
    assert got == {0.2: (0.70, 89180.0), 0.4: (0.41, 76300.0), 0.6: (0.35, 60220.0), 0.8: (0.28, 43530.0)}
    full = cost.with_retention_costs(counts, [RetentionScenario(10.0, 100.0, 1.0, label="all")])
    r = cost.cheapest_retention_threshold(full).first()
    assert (r["threshold"], r["total_cost"]) == (0.27, 26570.0)


def test_tie_rules(scored):
    assert best(scored(Y6, P6), CostScenario(0, 20, 10, 0), [0.25, 0.55]) == (0.55, 40.0)
    assert best(scored(Y6, P6), CostScenario(0, 10, 20, 0), [0.35, 0.65]) == (0.35, 40.0)
    assert best(scored([0, 1, 0, 1], [0.1, 0.9, 0.2, 0.8]), CostScenario(0, 10, 10, 10), [0.3, 0.5, 0.7]) == (0.3, 20.0)


def test_default_grid_optima(scored):
    s = scored(Y8, P8)
    assert best(s, DEFAULT_COSTS) == (0.41, 40.0)
    assert best(s, CostScenario(0, 10, 10, 10)) == (0.41, 40.0)
    assert best(s, CostScenario(0, 200, 10, 200)) == (0.99, 40.0)


def brute_force_choice(points, costs, grid):
    """The choice rule written out for one list of (y, p)."""
    rows = []
    for t in grid:
        tn = sum(1 for y, p in points if y == 0 and p < t)
        fp = sum(1 for y, p in points if y == 0 and p >= t)
        fn = sum(1 for y, p in points if y == 1 and p < t)
        tp = sum(1 for y, p in points if y == 1 and p >= t)
        total = tn * costs.cost_tn + fp * costs.cost_fp + fn * costs.cost_fn + tp * costs.cost_tp
        rows.append((total, tp / (tp + fn) if tp + fn else 0.0, t))
    low = min(r[0] for r in rows)
    tied = [r for r in rows if r[0] == low]
    if costs.cost_fp > costs.cost_fn:
        return low, max(t for _, _, t in tied)
    top = max(r[1] for r in tied)
    return low, min(t for _, recall, t in tied if recall == top)


def test_choice_equals_brute_force(spark):
    """Many small groups with small whole costs, so that most optima are tied."""
    rng = random.Random(11)
    grid = [0.1, 0.25, 0.4, 0.5, 0.75, 0.9]
    groups = {
        g: [(rng.randint(0, 1), rng.choice([0.0, 0.1, 0.2, 0.4, 0.5, 0.6, 0.9, 1.0])) for _ in range(rng.randint(1, 6))]
        for g in range(150)
    }
    scenarios = [
        CostScenario(*[rng.randint(0, 3) for _ in range(4)], label=f"s{i}") for i in range(8)
    ]
    table = spark.createDataFrame(
        [(g, y, p) for g, points in groups.items() for y, p in points], "g int, y int, p double"
    )
    costed = cost.with_costs(threshold_sweep(table, grid, ["g"]), scenarios)
    got = {
        (r["g"], r["scenario"]): (r["total_cost"], r["threshold"])
        for r in cost.cheapest_threshold(costed, ["g"]).collect()
    }
    want = {
        (g, s.label): brute_force_choice(points, s, grid) for g, points in groups.items() for s in scenarios
    }
    assert got == want


def test_invalid_costs():
    for bad in ((-1, 0, 0, 0), (0, -1, 0, 0), (0, 0, float("nan"), 0), (0, 0, 0, float("inf"))):
        with pytest.raises(ValueError):
            CostScenario(*bad)
    for r in (-0.1, 1.1):
        with pytest.raises(ValueError):
            RetentionScenario(10, 100, r)
    with pytest.raises(ValueError):
        RetentionScenario(-10, 100, 0.5)


def test_negative_counts_fail(spark):
    bad = with_rates(spark.createDataFrame([(0.5, 1, -1, 0, 1)], "threshold double, tn long, fp long, fn long, tp long"))
    with pytest.raises(Exception, match="negative"):
        cost.with_costs(bad, [DEFAULT_COSTS]).collect()


def test_zero_denominators(spark):
    none = with_rates(spark.createDataFrame([(0.5, 0, 0, 0, 0)], "threshold double, tn long, fp long, fn long, tp long"))
    r = cost.with_costs(none, [DEFAULT_COSTS]).first()
    assert r["total_cost"] == r["average_cost"] == r["cost_per_predicted"] == 0.0


def test_decomposition(scored):
    s = scored([0, 0, 1, 1], [0.1, 0.2, 0.9, 0.8])
    r = cost.with_retention_costs(threshold_sweep(s, [0.5]), [RetentionScenario(10, 100, 0.5, label="x")]).first()
    assert (r["expected_intervention_cost"], r["expected_churn_loss"], r["expected_retained_value"]) == (20, 100, 100)
    assert (r["net_business_value"], r["total_cost"]) == (-120, 120)


def test_full_retention_total(spark):
    c = with_rates(spark.createDataFrame([(0.5, 10, 5, 3, 7)], "threshold double, tn long, fp long, fn long, tp long"))
    assert cost.with_retention_costs(c, [RetentionScenario(10, 100, 1.0, label="x")]).first()["total_cost"] == 420.0


def test_policies(scored):
    s = scored([0, 0, 0, 1, 1, 1], [0.1, 0.2, 0.3, 0.6, 0.7, 0.8])
    r = cost.policy_baselines(s, [RetentionScenario(10, 100, 0.5, label="x")]).first()
    assert (r["contact_no_one_total_cost"], r["contact_everyone_total_cost"]) == (300, 210)
    assert (r["population_size"], r["n_churn"], r["n_no_churn"]) == (6, 3, 3)


def test_sensitivity_grid_and_savings(scored):
    s = scored(Y8, P8)
    grid = retention_grid((0.2, 0.8), (100.0, 200.0), (10.0, 20.0))
    rows = cost.savings(cost.retention_sensitivity(s, grid)).collect()
    assert len(rows) == 8
    for r in rows:
        assert r["value_vs_no_contact"] == pytest.approx(r["contact_no_one_cost"] - r["optimal_total_cost"])
        assert r["optimal_tn"] + r["optimal_fp"] + r["optimal_fn"] + r["optimal_tp"] == 8
        assert r["savings_pct"] <= 100


def test_free_false_alarms_give_infinite_ratio(scored):
    r = cost.cost_sensitivity(scored(Y8, P8), [CostScenario(0, 0, 10, 0, "free")]).first()
    assert r["fn_to_fp_ratio"] == float("inf")


def test_labels_with_quotes_and_duplicates(counts):
    odd = [CostScenario(0, 1, 2, 1, "it's a \\ test")]
    assert cost.with_costs(counts, odd).first()["scenario"] == "it's a \\ test"
    with pytest.raises(ValueError):
        cost.with_costs(counts, [DEFAULT_COSTS, DEFAULT_COSTS])
