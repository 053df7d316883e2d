"""The registered queries in plain SQL, written independently of the DataFrame code."""

from __future__ import annotations

from ..sources.views import DOC_INTERCEPT, DOC_WEIGHTS, RIVAL_INTERCEPT, RIVAL_WEIGHTS
from ..spec import COST_SCENARIOS, DEFAULT_COSTS, GRID_C, retention_grid

ORACLE: dict[str, str] = {}
T = 0.19

SCORED = f"""
feat AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, 1 - l.quality AS y,
         CAST(len(list_distinct(string_split(d.text, ' '))) AS DOUBLE) / len(string_split(d.text, ' ')) AS dw,
         ln(CAST(d.n_chars + 1 AS DOUBLE)) AS log_chars
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
scored AS (
  SELECT *, round(1 / (1 + exp(-({DOC_INTERCEPT} + ({DOC_WEIGHTS['dw']}) * dw + ({DOC_WEIGHTS['log_chars']}) * log_chars))), 6) AS p,
         round(1 / (1 + exp(-({RIVAL_INTERCEPT} + ({RIVAL_WEIGHTS['dw']}) * dw))), 6) AS p_rival
  FROM feat)"""

# the same for all documents; y is NULL without a label
SCORED_ALL = SCORED.replace("JOIN labels", "LEFT JOIN labels")

RETURNS = """
scored AS (
  SELECT l_orderkey, l_linenumber, l_linestatus, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
         least(greatest(round(l_extendedprice / 110000.0, 6), 0.0), 1.0) AS p
  FROM lineitem)"""


def div(a: str, b: str, other: str = "0") -> str:
    return f"CASE WHEN ({b}) > 0 THEN CAST(({a}) AS DOUBLE) / ({b}) ELSE {other} END"


RATES = {
    "precision": div("tp", "tp + fp"),
    "recall": div("tp", "tp + fn"),
    "f1": div("2 * tp", "2 * tp + fp + fn"),
    "accuracy": div("tp + tn", "tn + fp + fn + tp"),
    "specificity": div("tn", "tn + fp"),
    "npv": div("tn", "tn + fn"),
    "fpr": div("fp", "fp + tn"),
    "fnr": div("fn", "fn + tp"),
    "positive_rate": div("tp + fp", "tn + fp + fn + tp"),
}


def counts(by: str, p: str = "p", t: str = "threshold", src: str = "scored, grid") -> str:
    return f"""SELECT {by},
      CAST(count(*) FILTER (y = 0 AND {p} < {t}) AS BIGINT) AS tn,
      CAST(count(*) FILTER (y = 0 AND {p} >= {t}) AS BIGINT) AS fp,
      CAST(count(*) FILTER (y = 1 AND {p} < {t}) AS BIGINT) AS fn,
      CAST(count(*) FILTER (y = 1 AND {p} >= {t}) AS BIGINT) AS tp
    FROM {src} GROUP BY {by}"""


def sweep(view: str = SCORED, by: str = "threshold", grid: str | None = None) -> str:
    """CTEs up to ``sweep``: counts and unrounded rates per threshold."""
    grid = grid or "SELECT CAST(i AS DOUBLE) / 100 AS threshold FROM range(1, 100) r(i)"
    rates = ", ".join(f"{e} AS {n}" for n, e in RATES.items())
    return f"""WITH {view},
grid AS ({grid}),
counts AS ({counts(by)}),
sweep AS (SELECT *, {rates} FROM counts)"""


def rounded(names, places: int = 6) -> str:
    return ", ".join(f"round({n}, {places}) AS {n}" for n in names)


COARSE = "SELECT CAST(10 + 5 * i AS DOUBLE) / 100 AS threshold FROM range(0, 17) r(i)"


def values_grid(*cents: int) -> str:
    return "SELECT CAST(i AS DOUBLE) / 100 AS threshold FROM (VALUES " + ", ".join(f"({c})" for c in cents) + ") v(i)"


SWEEP_OUT = f"threshold, tn, fp, fn, tp, {rounded(RATES)}"
ORACLE["threshold_sweep"] = f"{sweep()} SELECT {SWEEP_OUT} FROM sweep"
ORACLE["threshold_sweep_returns"] = f"{sweep(RETURNS)} SELECT {SWEEP_OUT} FROM sweep"
FINE = "SELECT CAST(i AS DOUBLE) / 1000 AS threshold FROM range(10, 991) r(i)"
ORACLE["threshold_grid_fine"] = f"{sweep(RETURNS, grid=FINE)} SELECT {SWEEP_OUT} FROM sweep"
ORACLE["threshold_sweep_by_lang"] = (
    f"{sweep(by='lang, threshold', grid=COARSE)} SELECT lang, {SWEEP_OUT} FROM sweep"
)
ORACLE["threshold_candidates"] = f"""{sweep(grid=COARSE)}
SELECT 'default' AS criterion, (SELECT min(threshold) FROM sweep WHERE abs(threshold - 0.5) < 1e-6) AS threshold
UNION ALL SELECT 'f1_optimal', (SELECT threshold FROM sweep ORDER BY f1 DESC, threshold LIMIT 1)
UNION ALL SELECT 'recall_oriented', (SELECT threshold FROM sweep WHERE precision >= 0.5 ORDER BY recall DESC, threshold LIMIT 1)
UNION ALL SELECT 'precision_oriented', (SELECT threshold FROM sweep WHERE recall >= 0.6 ORDER BY precision DESC, threshold LIMIT 1)"""
ORACLE["fixed_thresholds"] = f"{sweep(grid=values_grid(45, 50, 55, 60))} SELECT {SWEEP_OUT} FROM sweep"
ORACLE["confusion_at_threshold"] = (
    f"{sweep(by='lang, threshold', grid=values_grid(19))} SELECT lang, {SWEEP_OUT} FROM sweep"
)


def cost_scenarios(rows) -> str:
    vals = ", ".join(
        f"('{s.label}', CAST({s.cost_tn} AS DOUBLE), CAST({s.cost_fp} AS DOUBLE), CAST({s.cost_fn} AS DOUBLE), CAST({s.cost_tp} AS DOUBLE))"
        for s in rows
    )
    return f"scen AS (SELECT * FROM (VALUES {vals}) v(scenario, cost_tn, cost_fp, cost_fn, cost_tp))"


COSTED = """costed AS (
  SELECT *, tn * cost_tn + fp * cost_fp + fn * cost_fn + tp * cost_tp AS total_cost,
         CASE WHEN fp + tp > 0 THEN (fp * cost_fp + tp * cost_tp) / (fp + tp) ELSE 0 END AS cost_per_predicted
  FROM sweep, scen),
costs AS (SELECT *, total_cost / (tn + fp + fn + tp) AS average_cost FROM costed)"""


def best(group: str, false_alarm: str = "cost_fp", miss: str = "cost_fn") -> str:
    return f"""tied AS (
  SELECT *, max(recall) OVER (PARTITION BY {group}) AS best_recall FROM (
    SELECT *, min(total_cost) OVER (PARTITION BY {group}) AS best_cost FROM costs)
  WHERE total_cost - best_cost < 1e-6),
best AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY {group}
      ORDER BY CASE WHEN {false_alarm} > {miss} THEN -threshold ELSE threshold END) AS rn
    FROM tied WHERE {false_alarm} > {miss} OR best_recall - recall < 1e-6)
  WHERE rn = 1)"""


COST_COLS = "scenario, cost_tn, cost_fp, cost_fn, cost_tp, " + rounded(
    ["total_cost", "average_cost", "cost_per_predicted"]
)
ORACLE["cost_sweep"] = (
    f"{sweep()}, {cost_scenarios([DEFAULT_COSTS])}, {COSTED} SELECT {SWEEP_OUT}, {COST_COLS} FROM costs"
)
ORACLE["cost_optimal"] = (
    f"{sweep()}, {cost_scenarios([DEFAULT_COSTS])}, {COSTED}, {best('scenario')} "
    f"SELECT {SWEEP_OUT}, {COST_COLS} FROM best"
)
SENS = """SELECT scenario, cost_tn, cost_fp, cost_fn, cost_tp, round(cost_fn / cost_fp, 6) AS fn_to_fp_ratio,
  threshold AS optimal_threshold, round(total_cost, 6) AS optimal_total_cost,
  round(average_cost, 6) AS optimal_average_cost, round(recall, 6) AS optimal_recall,
  round(precision, 6) AS optimal_precision, round(f1, 6) AS optimal_f1 FROM best"""
ORACLE["cost_sensitivity"] = (
    f"{sweep()}, {cost_scenarios(COST_SCENARIOS)}, {COSTED}, {best('scenario')} {SENS}"
)
ORACLE["cost_sensitivity_returns"] = (
    f"{sweep(RETURNS)}, {cost_scenarios(COST_SCENARIOS)}, {COSTED}, {best('scenario')} {SENS}"
)
ORACLE["cost_optimal_by_source"] = (
    f"{sweep(by='source, threshold')}, {cost_scenarios([DEFAULT_COSTS])}, {COSTED}, {best('source, scenario')} "
    "SELECT source, threshold, tn, fp, fn, tp, round(total_cost, 6) AS total_cost, "
    "round(average_cost, 6) AS average_cost FROM best"
)
ORACLE["cost_summary"] = (
    f"{sweep()}, {cost_scenarios([DEFAULT_COSTS])}, {COSTED}, {best('scenario')} "
    "SELECT 'minimize_expected_business_cost' AS objective, threshold AS selected_threshold, scenario AS label, "
    "cost_tn, cost_fp, cost_fn, cost_tp, 99 AS n_thresholds_evaluated, "
    + rounded(["total_cost", "average_cost", "cost_per_predicted", "precision", "recall", "f1", "accuracy", "specificity", "npv"])
    + ", tn, fp, fn, tp FROM best"
)


def retention_scenarios(rows) -> str:
    names = ["cost_intervention", "clv", "retention_success_rate", "cost_tn", "cost_fp", "cost_fn"]
    vals = ", ".join(
        "('" + s.label + "', " + ", ".join(f"CAST({getattr(s, n)} AS DOUBLE)" for n in names) + ")"
        for s in rows
    )
    return f"scen AS (SELECT * FROM (VALUES {vals}) v(scenario, {', '.join(names)}))"


R_COSTED = """costed AS (
  SELECT *, tn * cost_tn + fp * cost_intervention + fn * clv
            + tp * (cost_intervention + (1 - retention_success_rate) * clv) AS total_cost,
         CASE WHEN fp + tp > 0 THEN cost_intervention ELSE 0 END AS cost_per_predicted,
         fn * clv + tp * (1 - retention_success_rate) * clv AS expected_churn_loss,
         (fp + tp) * cost_intervention AS expected_intervention_cost,
         tp * retention_success_rate * clv AS expected_retained_value
  FROM sweep, scen),
costs AS (SELECT *, -total_cost AS net_business_value, total_cost / (tn + fp + fn + tp) AS average_cost,
            (fn + tp) * clv AS none_cost,
            (tn + fp + fn + tp) * cost_intervention + (fn + tp) * (1 - retention_success_rate) * clv AS all_cost
          FROM costed)"""
ONE_R = retention_scenarios(
    [type(retention_grid()[0])(10.0, 100.0, 0.6, cost_fp=10.0, cost_fn=100.0, label="r=0.6")]
)
R_COLS = (
    "scenario, cost_intervention, clv, retention_success_rate, cost_tn, cost_fp, cost_fn, "
    + rounded([
        "total_cost", "average_cost", "cost_per_predicted", "net_business_value",
        "expected_churn_loss", "expected_intervention_cost", "expected_retained_value",
    ])
)
R_BEST = best("scenario", "cost_intervention", "clv")
ORACLE["retention_cost_sweep"] = f"{sweep()}, {ONE_R}, {R_COSTED} SELECT {SWEEP_OUT}, {R_COLS} FROM costs"
ORACLE["retention_cost_optimal"] = f"{sweep()}, {ONE_R}, {R_COSTED}, {R_BEST} SELECT {SWEEP_OUT}, {R_COLS} FROM best"
ORACLE["retention_sensitivity"] = (
    f"{sweep()}, {retention_scenarios(retention_grid(clvs=(100.0, 200.0), interventions=(10.0, 150.0)))}, {R_COSTED}, {R_BEST} "
    "SELECT scenario, retention_success_rate, clv, cost_intervention, cost_tn, cost_fp, cost_fn, threshold AS optimal_threshold, "
    + ", ".join(f"round({c}, 6) AS optimal_{c}" for c in ["total_cost", "average_cost", "precision", "recall", "f1", "accuracy"])
    + ", " + ", ".join(f"{c} AS optimal_{c}" for c in ["tn", "fp", "fn", "tp"])
    + ", round(none_cost - total_cost, 6) AS value_vs_no_contact, round(all_cost - total_cost, 6) AS value_vs_contact_all, "
    "round(none_cost, 6) AS contact_no_one_cost, round(all_cost, 6) AS contact_everyone_cost FROM best"
)
ORACLE["policy_baselines"] = (
    f"WITH {SCORED}, {retention_scenarios(retention_grid())}, "
    "tot AS (SELECT CAST(count(*) AS BIGINT) AS population_size, CAST(sum(y) AS BIGINT) AS n_churn FROM scored), "
    "b AS (SELECT *, population_size - n_churn AS n_no_churn, n_churn * clv AS none_cost, "
    "population_size * cost_intervention + n_churn * (1 - retention_success_rate) * clv AS all_cost FROM tot, scen) "
    "SELECT population_size, n_churn, n_no_churn, scenario, cost_intervention, clv, retention_success_rate, cost_tn, cost_fp, cost_fn, "
    "round(none_cost, 6) AS contact_no_one_total_cost, round(all_cost, 6) AS contact_everyone_total_cost, "
    "round(none_cost / population_size, 6) AS contact_no_one_avg_cost, "
    "round(all_cost / population_size, 6) AS contact_everyone_avg_cost FROM b"
)
ORACLE["retention_savings"] = (
    f"{sweep()}, {retention_scenarios(retention_grid())}, {R_COSTED}, {R_BEST} "
    "SELECT retention_success_rate, threshold AS optimal_threshold, round(total_cost, 6) AS optimal_total_cost, "
    "CASE WHEN none_cost <= all_cost THEN 'no_contact' ELSE 'contact_all' END AS best_baseline, "
    "round(least(none_cost, all_cost), 6) AS best_baseline_cost, "
    "round((least(none_cost, all_cost) - total_cost) * 100 / least(none_cost, all_cost), 6) AS savings_pct FROM best"
)
ORACLE["model_robustness"] = f"""WITH {SCORED},
long AS (SELECT 'pinned' AS model, y, p FROM scored UNION ALL SELECT 'rival', y, p_rival FROM scored),
grid AS ({values_grid(5, 10, 15, 20, 30, 40)}),
c AS ({counts('model, threshold', src='long, grid')})
SELECT model, threshold, CAST(fp * 10 + fn * 100 + tp * 10 AS DOUBLE) AS total_cost, tn, fp, fn, tp FROM c"""

# ------------------------------------------------------------ model-level metrics


def ranked(view: str, by: str = "") -> str:
    """CTEs up to ``cum``: distinct scores with counts at or above each of them."""
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    return f"""WITH {view},
d AS (SELECT {cols}p, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM scored GROUP BY {cols}p),
cum AS (SELECT *, CAST(sum(pos) OVER ({part} ORDER BY p DESC) AS DOUBLE) AS cp, CAST(sum(neg) OVER ({part} ORDER BY p DESC) AS DOUBLE) AS cn,
          CAST(sum(pos) OVER ({part}) AS DOUBLE) AS np, CAST(sum(neg) OVER ({part}) AS DOUBLE) AS nn FROM d)"""


def rank_sql(view: str, by: str = "") -> str:
    cols = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""{ranked(view, by)}
SELECT {cols}CASE WHEN max(np) * max(nn) > 0 THEN round(sum(pos * (nn - cn + neg / 2.0)) / (max(np) * max(nn)), 6) END AS roc_auc,
  CASE WHEN max(np) > 0 THEN round(sum(pos / np * cp / (cp + cn)), 6) END AS average_precision
FROM cum {group}"""


ORACLE["rank_metrics"] = rank_sql(SCORED)
ORACLE["rank_metrics_by_lang"] = rank_sql(SCORED, "lang")
ORACLE["rank_metrics_returns"] = rank_sql(RETURNS)
ORACLE["roc_points"] = (
    f"{ranked(SCORED)} SELECT p AS threshold, round(cn / nn, 6) AS fpr, round(cp / np, 6) AS tpr FROM cum"
)
ORACLE["pr_points"] = (
    f"{ranked(RETURNS)} SELECT p AS threshold, round(cp / (cp + cn), 6) AS precision, round(cp / np, 6) AS recall FROM cum"
)
ORACLE["probability_losses"] = f"""WITH {SCORED}
SELECT lang, count(*) AS n,
  round(avg(CASE WHEN y = 1 THEN -ln(greatest(least(p, 1 - pow(2.0, -52)), pow(2.0, -52)))
                 ELSE -ln(1 - greatest(least(p, 1 - pow(2.0, -52)), pow(2.0, -52))) END), 6) AS log_loss,
  round(avg((p - y) * (p - y)), 6) AS brier FROM scored GROUP BY lang"""
ORACLE["classification_report"] = f"""WITH {SCORED},
c AS (SELECT CAST(count(*) FILTER (y = 0 AND p < 0.3) AS DOUBLE) AS tn, CAST(count(*) FILTER (y = 0 AND p >= 0.3) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (y = 1 AND p < 0.3) AS DOUBLE) AS fn, CAST(count(*) FILTER (y = 1 AND p >= 0.3) AS DOUBLE) AS tp FROM scored),
m AS (SELECT *, {div('tn', 'tn + fn')} AS p0, {div('tn', 'tn + fp')} AS r0, {div('2 * tn', '2 * tn + fn + fp')} AS f0,
  {div('tp', 'tp + fp')} AS p1, {div('tp', 'tp + fn')} AS r1, {div('2 * tp', '2 * tp + fp + fn')} AS f1,
  tn + fp AS s0, fn + tp AS s1, tn + fp + fn + tp AS n FROM c),
r AS (SELECT '0' AS label, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM m
 UNION ALL SELECT '1', p1, r1, f1, s1 FROM m
 UNION ALL SELECT 'accuracy', (tp + tn) / n, (tp + tn) / n, (tp + tn) / n, n FROM m
 UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM m
 UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n FROM m)
SELECT label, {rounded(['precision', 'recall', 'f1'])}, CAST(support AS BIGINT) AS support FROM r"""
ORACLE["positive_share"] = f"""WITH {SCORED_ALL}
SELECT lang, count(*) AS n, count(*) FILTER (p >= {T}) AS positive,
  round(avg(CASE WHEN p >= {T} THEN 1.0 ELSE 0.0 END), 6) AS positive_share FROM scored GROUP BY lang"""
ORACLE["scored_checks"] = f"""WITH {SCORED},
c AS (SELECT count(*) AS n, count(*) FILTER (y IS NULL OR y NOT IN (0, 1)) AS bad_y,
  count(*) FILTER (p IS NULL OR p < 0 OR p > 1 OR isnan(p)) AS bad_p FROM scored)
SELECT 'not_empty' AS "check", n > 0 AS ok, CAST(0 AS BIGINT) AS bad_rows FROM c
UNION ALL SELECT 'label_binary', bad_y = 0, bad_y FROM c UNION ALL SELECT 'probability_range', bad_p = 0, bad_p FROM c"""

# ------------------------------------------------------------ error analysis

OUT = f"""{SCORED},
o AS (SELECT *, CASE WHEN y = 0 AND p < {T} THEN 'TN' WHEN y = 0 THEN 'FP' WHEN p < {T} THEN 'FN' ELSE 'TP' END AS outcome FROM scored)"""
FOUR = ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o.lower()}" for o in ("TN", "FP", "FN", "TP"))
ORACLE["error_rates"] = f"""WITH {OUT}, c AS (SELECT {FOUR} FROM o)
SELECT tn, fp, fn, tp, round({div('fp', 'fp + tn')}, 6) AS false_positive_rate, round({div('fn', 'fn + tp')}, 6) AS false_negative_rate,
  round({div('tp + fp', 'tn + fp + fn + tp')}, 6) AS positive_prediction_rate FROM c"""
ORACLE["error_slices"] = f"""WITH {OUT},
l AS (SELECT 'lang' AS "column", lang AS value, outcome FROM o UNION ALL SELECT 'source', source, outcome FROM o),
c AS (SELECT "column", value, {FOUR}, count(*) AS total FROM l WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT "column", value, tn, fp, fn, tp, total, round({div('fp', 'fp + tn', 'NULL')}, 6) AS fp_rate,
  round({div('fn', 'fn + tp', 'NULL')}, 6) AS fn_rate FROM c"""
ORACLE["error_numeric"] = f"""WITH {OUT},
l AS (SELECT 'n_chars' AS "column", outcome, CAST(n_chars AS DOUBLE) AS value FROM o
  UNION ALL SELECT 'dw', outcome, dw FROM o UNION ALL SELECT 'log_chars', outcome, log_chars FROM o),
spine AS (SELECT * FROM (VALUES ('n_chars'), ('dw'), ('log_chars')) a("column"), (VALUES ('TN'), ('FP'), ('FN'), ('TP')) b(outcome))
SELECT s."column", s.outcome, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median
FROM spine s LEFT JOIN l ON l."column" = s."column" AND l.outcome = s.outcome GROUP BY 1, 2"""
ORACLE["hard_cases"] = f"""WITH {OUT},
c AS (SELECT count(*) FILTER (p >= {T} - 0.1 AND p <= {T} + 0.1) AS borderline_count,
 count(*) FILTER (p >= {T} - 0.1 AND p <= {T} + 0.1 AND outcome IN ('FP', 'FN')) AS borderline_error_count,
 count(*) FILTER (outcome = 'FP' AND p >= 0.8) AS high_confidence_fp_count,
 count(*) FILTER (outcome = 'FN' AND p <= 0.2) AS high_confidence_fn_count FROM o)
SELECT *, round({div('borderline_error_count', 'borderline_count')}, 6) AS borderline_error_rate FROM c"""

# ------------------------------------------------------------ accounts

RAW = """
per AS (
  SELECT o_custkey AS c_custkey, min(o_orderdate) FILTER (o_orderdate < TIMESTAMP '1997-01-01') AS first_order,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderdate < TIMESTAMP '1997-01-01') AS BIGINT) AS cents,
    count(*) FILTER (o_orderdate >= TIMESTAMP '1997-01-01') AS n_next
  FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1),
raw AS (
  SELECT c.c_custkey AS account_id,
    CAST(coalesce((1997 - year(first_order)) * 12 + 1 - month(first_order), 0) AS INTEGER) AS tenure,
    CASE WHEN c.c_custkey % 97 = 0 THEN '  ' WHEN cents IS NULL THEN ' '
      ELSE concat(CAST(cents // 100 AS VARCHAR), '.', lpad(CAST(cents % 100 AS VARCHAR), 2, '0')) END AS total_text,
    CASE WHEN c.c_custkey % 53 = 0 THEN '   ' WHEN c.c_custkey % 47 = 0 THEN NULL
      ELSE concat(' ', c_mktsegment, ' ') END AS segment_raw,
    r_name AS region, c_acctbal AS acctbal,
    CASE WHEN coalesce(n_next, 0) > 0 THEN 'No' ELSE 'Yes' END AS lapsed
  FROM customer c LEFT JOIN per ON per.c_custkey = c.c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
CLEAN = RAW + """,
clean AS (
  SELECT account_id, acctbal, nullif(trim(lapsed), '') AS lapsed, nullif(trim(region), '') AS region,
    nullif(trim(segment_raw), '') AS segment_raw, tenure,
    CASE WHEN trim(total_text) <> '' THEN CAST(trim(total_text) AS DOUBLE) WHEN tenure = 0 THEN 0.0 END AS total_text,
    CASE lapsed WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS y
  FROM raw)"""
ORACLE["accounts_raw"] = f"WITH {RAW} SELECT * FROM raw"
CLEAN_COLS = "account_id, acctbal, lapsed, region, segment_raw, tenure, total_text"
ORACLE["clean_accounts"] = f"WITH {CLEAN} SELECT {CLEAN_COLS} FROM clean"
ORACLE["dataset_checks"] = f"""WITH {CLEAN},
c AS (SELECT count(*) AS n, count(*) FILTER (lapsed IS NULL) AS missing, count(*) FILTER (lapsed NOT IN ('Yes', 'No')) AS odd FROM clean)
SELECT 'not_empty' AS "check", n > 0 AS ok, CAST(0 AS BIGINT) AS bad_rows FROM c
UNION ALL SELECT 'target_present', missing = 0, missing FROM c UNION ALL SELECT 'target_expected', odd = 0, odd FROM c"""
ORACLE["label_encode"] = f"WITH {CLEAN} SELECT account_id, y FROM clean"
ORACLE["complete_rows"] = (
    f"WITH {CLEAN} SELECT {CLEAN_COLS} FROM clean WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in CLEAN_COLS.split(", "))
)
ORACLE["profile_shape"] = f"WITH {CLEAN} SELECT count(*) AS n_rows, 7 AS n_columns FROM clean"
ORACLE["profile_missing"] = f"""WITH {CLEAN}, m AS (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS missing FROM clean""" for c in CLEAN_COLS.split(", ")
) + ') SELECT * FROM m WHERE missing > 0'
ORACLE["profile_duplicates"] = f"""WITH {CLEAN},
g AS (SELECT count(*) AS n FROM clean GROUP BY lapsed, region, segment_raw, tenure, total_text)
SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM g"""
ORACLE["profile_target"] = f"""WITH {CLEAN}
SELECT lapsed AS value, count(*) AS "count", round(count(*) * 100.0 / (SELECT count(*) FROM clean), 2) AS percent FROM clean GROUP BY 1"""


def numeric_line(c: str) -> str:
    q = ", ".join(f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), 6) AS {n}" for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")))
    return (
        f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, """
        f"CAST(min({c}) AS DOUBLE) AS min, {q}, CAST(max({c}) AS DOUBLE) AS max FROM clean"
    )


THREE = ["acctbal", "tenure", "total_text"]
ORACLE["profile_numeric"] = f"WITH {CLEAN} " + " UNION ALL ".join(numeric_line(c) for c in THREE)
ORACLE["profile_categorical"] = f"""WITH {SCORED_ALL},
l AS (SELECT 'lang' AS "column", lang AS value FROM feat UNION ALL SELECT 'source', source FROM feat
  UNION ALL SELECT 'n_chars', CAST(n_chars AS VARCHAR) FROM feat),
c AS (SELECT "column", value, count(*) AS "count" FROM l WHERE value IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY "count" DESC, value) AS INTEGER) AS rank,
  count(*) OVER (PARTITION BY "column") AS n_values, CAST(sum("count") OVER (PARTITION BY "column") AS BIGINT) AS n_present FROM c)
SELECT "column", rank, value, "count", n_values, n_present, greatest(n_values - 10, 0) AS n_more FROM r WHERE rank <= 10"""
ORACLE["profile_correlation"] = f"WITH {CLEAN} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM clean"
    for a in THREE for b in THREE
)
ORACLE["profile_crosstab"] = f"""WITH {CLEAN}
SELECT segment_raw AS value, round(100 - avg(y) * 100, 2) AS negative_pct, round(avg(y) * 100, 2) AS positive_pct
FROM clean WHERE segment_raw IS NOT NULL GROUP BY 1"""

# ------------------------------------------------------------ splits and folds


def split_ctes(src: str, key: str) -> str:
    """Exact two-stage stratified split by rank of the seeded key hash."""

    def share(total: str, part: str, name: str, src_cte: str) -> str:
        return f"""{name}_e AS (SELECT y, {part} AS k, floor({total} * CAST({part} AS DOUBLE) / nn) AS f,
    {total} * CAST({part} AS DOUBLE) / nn - floor({total} * CAST({part} AS DOUBLE) / nn) AS r, {total} AS tt FROM {src_cte}),
{name} AS (SELECT y, k, CAST(f + CASE WHEN row_number() OVER (ORDER BY r DESC, y) <= tt - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS m FROM {name}_e)"""

    return f"""cls AS (SELECT y, count(*) AS k FROM {src} GROUP BY y),
c1 AS (SELECT *, sum(k) OVER () AS nn, ceil(0.3 * sum(k) OVER ()) AS nt FROM cls),
{share('nt', 'k', 'te', 'c1')},
c2 AS (SELECT y, k - m AS k, sum(k - m) OVER () AS nn, ceil(0.3 * sum(k - m) OVER ()) AS nt FROM te),
{share('nt', 'k', 'va', 'c2')},
rk AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42-' || {key})) AS rn FROM {src}),
splits AS (SELECT rk.*, CASE WHEN rn <= te.m THEN 'test' WHEN rn <= te.m + va.m THEN 'val' ELSE 'train' END AS split
  FROM rk JOIN te ON te.y = rk.y JOIN va ON va.y = rk.y)"""


A_SPLIT = f"{CLEAN}, {split_ctes('clean', 'account_id')}"
D_SPLIT = f"{SCORED}, {split_ctes('scored', 'doc_id')}"
FOLDS = f"""{SCORED},
folds AS (SELECT *, CAST(ntile(5) OVER (PARTITION BY y ORDER BY md5('42-' || doc_id)) - 1 AS INTEGER) AS fold FROM scored)"""
ORACLE["stratified_split"] = f"WITH {A_SPLIT} SELECT account_id, y, split FROM splits"
ORACLE["split_report"] = f"""WITH {A_SPLIT}
SELECT split, y, count(*) AS "count", round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY split), 2) AS percent FROM splits GROUP BY split, y"""
ORACLE["stratified_folds"] = f"WITH {FOLDS} SELECT doc_id, y, fold FROM folds"
ORACLE["leakage_audit"] = f"""WITH {A_SPLIT},
k AS (SELECT account_id, count(*) AS n, min(split) AS lo, max(split) AS hi FROM splits GROUP BY 1),
c AS (SELECT count(*) FILTER (n > 1) AS a, count(*) FILTER (lo <> hi) AS b, count(*) FILTER (lo IS NULL) AS c FROM k)
SELECT 'repeated' AS "check", a = 0 AS ok, a AS bad_keys FROM c UNION ALL SELECT 'overlap', b = 0, b FROM c UNION ALL SELECT 'unassigned', c = 0, c FROM c"""
ORACLE["sample_rows"] = f"WITH {CLEAN} SELECT account_id, tenure, y FROM clean ORDER BY md5('42-' || account_id) LIMIT 500"
ORACLE["first_rows"] = f"WITH {SCORED} SELECT doc_id, p, y FROM scored ORDER BY doc_id LIMIT 200"


def ranked_by(src: str, by: str) -> str:
    return f"""d AS (SELECT {by}, p, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM {src} GROUP BY {by}, p),
cum AS (SELECT *, CAST(sum(pos) OVER (PARTITION BY {by} ORDER BY p DESC) AS DOUBLE) AS cp, CAST(sum(neg) OVER (PARTITION BY {by} ORDER BY p DESC) AS DOUBLE) AS cn,
  CAST(sum(pos) OVER (PARTITION BY {by}) AS DOUBLE) AS np, CAST(sum(neg) OVER (PARTITION BY {by}) AS DOUBLE) AS nn FROM d),
ranks AS (SELECT {by}, sum(pos * (nn - cn + neg / 2.0)) / (max(np) * max(nn)) AS roc_auc, sum(pos / np * cp / (cp + cn)) AS average_precision FROM cum GROUP BY {by})"""


ORACLE["fold_metrics"] = f"""WITH {FOLDS}, {ranked_by('folds', 'fold')},
c AS (SELECT fold, count(*) FILTER (y = 0 AND p < 0.5) AS tn, count(*) FILTER (y = 0 AND p >= 0.5) AS fp,
  count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 1 AND p >= 0.5) AS tp FROM folds GROUP BY fold),
m AS (SELECT r.*, {RATES['accuracy']} AS accuracy, {RATES['precision']} AS precision, {RATES['recall']} AS recall, {RATES['f1']} AS f1
  FROM ranks r JOIN c ON c.fold = r.fold)
""" + " UNION ALL ".join(
    f"SELECT '{x}' AS metric, round(avg({x}), 6) AS mean, round(stddev_pop({x}), 6) AS std FROM m"
    for x in ("roc_auc", "average_precision", "accuracy", "precision", "recall", "f1")
)
ORACLE["generalisation_gap"] = f"WITH {D_SPLIT}, {ranked_by('splits', 'split')} " + " UNION ALL ".join(
    f"""SELECT '{x}' AS metric, round(a.{x}, 6) AS train, round(b.{x}, 6) AS test, round(b.{x} - a.{x}, 6) AS gap
FROM (SELECT * FROM ranks WHERE split = 'train') a, (SELECT * FROM ranks WHERE split = 'test') b"""
    for x in ("roc_auc", "average_precision")
)
ORACLE["cost_on_test"] = f"""WITH {D_SPLIT},
grid AS (SELECT CAST(i AS DOUBLE) / 100 AS threshold FROM range(1, 100) r(i)),
counts AS ({counts('split, threshold', src='splits, grid')}),
costs AS (SELECT *, CAST(fp * 10 + fn * 100 + tp * 10 AS DOUBLE) AS total_cost FROM counts),
pick AS (SELECT threshold FROM costs WHERE split = 'train' ORDER BY total_cost, tp DESC, threshold LIMIT 1)
SELECT threshold, tn, fp, fn, tp, total_cost, round(total_cost / (tn + fp + fn + tp), 6) AS average_cost
FROM costs WHERE split = 'test' AND threshold = (SELECT threshold FROM pick)"""

# ------------------------------------------------------------ feature preparation

ORACLE["impute_median"] = f"WITH {CLEAN} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(median(CAST({c} AS DOUBLE)), 6) AS fill FROM clean""" for c in THREE
)
MODE = "(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
ORACLE["impute_mode"] = f"WITH {CLEAN} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {MODE.format(c=c, src='clean')} AS fill""" for c in ("region", "segment_raw")
)
IMPUTED = f"""{A_SPLIT},
train AS (SELECT * FROM splits WHERE split = 'train'),
imp AS (SELECT account_id, split, coalesce(total_text, (SELECT median(total_text) FROM train)) AS total_text,
  coalesce(tenure, (SELECT median(tenure) FROM train)) AS tenure,
  coalesce(segment_raw, {MODE.format(c='segment_raw', src='train')}) AS segment_raw,
  coalesce(region, {MODE.format(c='region', src='train')}) AS region FROM splits)"""
ORACLE["imputed_accounts"] = (
    f"WITH {IMPUTED} SELECT account_id, split, round(total_text, 6) AS total_text, segment_raw FROM imp"
)
ORACLE["one_hot_long"] = f"""WITH {A_SPLIT}
SELECT account_id, 'cat__region_' || region AS feature, CAST(1 AS DOUBLE) AS value FROM splits
  WHERE region IN (SELECT region FROM splits WHERE split = 'train')
UNION ALL SELECT account_id, 'cat__segment_raw_' || segment_raw, CAST(1 AS DOUBLE) FROM splits
  WHERE segment_raw IN (SELECT segment_raw FROM splits WHERE split = 'train')"""
ORACLE["wide_categories"] = f"""WITH {A_SPLIT},
t AS (SELECT split, region, CAST(CAST(round(total_text) AS BIGINT) AS VARCHAR) AS spent FROM splits),
k AS (SELECT split, CAST(region IS NOT NULL AND region IN (SELECT region FROM t WHERE split = 'train' AND region IS NOT NULL) AS INTEGER) AS region,
  CAST(spent IS NOT NULL AND spent IN (SELECT spent FROM t WHERE split = 'train' AND spent IS NOT NULL) AS INTEGER) AS spent FROM t)
SELECT split, region, spent, count(*) AS n, (SELECT count(DISTINCT spent) FROM t WHERE split = 'train') AS spent_values FROM k GROUP BY ALL"""
ORACLE["encoded_means"] = f"""WITH {IMPUTED},
n AS (SELECT split, count(*) AS n FROM imp GROUP BY 1),
v AS (SELECT 'cat__region_' || region AS feature, 'region' AS c, region AS v FROM (SELECT DISTINCT region FROM splits WHERE split = 'train' AND region IS NOT NULL)
  UNION ALL SELECT 'cat__segment_raw_' || segment_raw, 'segment_raw', segment_raw FROM (SELECT DISTINCT segment_raw FROM splits WHERE split = 'train' AND segment_raw IS NOT NULL))
SELECT split, 'num__tenure' AS feature, round(avg(CAST(tenure AS DOUBLE)), 4) AS mean FROM imp GROUP BY 1
UNION ALL SELECT split, 'num__total_text', round(avg(total_text), 4) FROM imp GROUP BY 1
UNION ALL SELECT i.split, v.feature, round(avg(CASE WHEN CASE v.c WHEN 'region' THEN i.region ELSE i.segment_raw END = v.v THEN 1.0 ELSE 0.0 END), 4)
  FROM imp i, v GROUP BY 1, 2"""
ORACLE["class_weights"] = f"""WITH {CLEAN}
SELECT y, round((SELECT count(*) FROM clean) / (2.0 * count(*)), 6) AS weight, round((SELECT count(*) FROM clean) / 2.0, 4) AS total_weight FROM clean GROUP BY y"""

# ------------------------------------------------------------ data contract

DOMAINS = {"region": ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"), "segment_raw": ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY")}


def violation_union(lenient: bool = False) -> str:
    parts = [
        ("tenure", "missing", "CAST(tenure AS VARCHAR)", "tenure IS NULL"),
        ("tenure", "below_minimum", "CAST(tenure AS VARCHAR)", "tenure < 0"),
        ("tenure", "above_maximum", "CAST(tenure AS VARCHAR)", "tenure > 20"),
        ("acctbal", "missing", "CAST(acctbal AS VARCHAR)", "acctbal IS NULL"),
        ("acctbal", "below_minimum", "CAST(acctbal AS VARCHAR)", "acctbal < 0"),
        ("total_text", "missing", "total_text", "total_text IS NULL"),
        ("total_text", "invalid", "total_text", "TRY_CAST(trim(total_text) AS DOUBLE) IS NULL"),
        ("total_text", "below_minimum", "total_text", "TRY_CAST(trim(total_text) AS DOUBLE) < 0"),
    ]
    for c, domain in DOMAINS.items():
        parts.append((c, "missing", f"trim({c})", f"{c} IS NULL OR trim({c}) = ''"))
        if not lenient:
            listed = ", ".join(f"'{d}'" for d in domain)
            parts.append((c, "unknown_category", f"trim({c})", f"trim({c}) <> '' AND trim({c}) NOT IN ({listed})"))
    body = " UNION ALL ".join(
        f"""SELECT account_id, '{c}' AS "column", '{code}' AS code, {v} AS value FROM raw WHERE {cond}""" for c, code, v, cond in parts
    )
    return f"WITH {RAW}, v AS ({body})"


ORACLE["contract_violations"] = f"{violation_union()} SELECT * FROM v"
ORACLE["contract_summary"] = f'{violation_union()} SELECT "column", code, count(*) AS n FROM v GROUP BY 1, 2'
ORACLE["contract_lenient"] = f'{violation_union(True)} SELECT "column", code, count(*) AS n FROM v GROUP BY 1, 2'
ORACLE["contract_valid_rows"] = f"""{violation_union()}
SELECT account_id, CAST(tenure AS DOUBLE) AS tenure, acctbal, CAST(trim(total_text) AS DOUBLE) AS total_text, trim(region) AS region, trim(segment_raw) AS segment_raw
FROM raw WHERE account_id NOT IN (SELECT account_id FROM v)"""
ORACLE["contract_quarantine"] = (
    f"{violation_union()} SELECT account_id, CAST(count(*) AS INTEGER) AS n_errors FROM v GROUP BY 1"
)
ORACLE["contract_columns"] = """SELECT * FROM (VALUES ('account_id', 'passthrough'), ('tenure', 'ok'), ('total_text', 'ok'),
  ('segment_raw', 'ok'), ('acctbal', 'ok'), ('lapsed', 'forbidden'), ('region', 'missing')) v("column", status)"""

# ------------------------------------------------------------ telemetry

EV = """ev AS (SELECT event_id, user_id, event_type, ts, event_type <> 'error' AS success, event_type = 'purchase' AS positive,
  CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 3 = 0 THEN 'validation_error' WHEN event_id % 3 = 1 THEN 'artifact_load_error' ELSE 'unknown_error' END AS error_category FROM events)"""
SUMMARY = """count(*) AS invocation_count, count(*) FILTER (success) AS success_count, count(*) FILTER (NOT success) AS failure_count,
  count(*) FILTER (error_category = 'validation_error') AS validation_failure_count,
  count(*) FILTER (error_category = 'inference_error') AS inference_failure_count,
  count(*) FILTER (error_category = 'artifact_integrity_error') AS artifact_integrity_failure_count,
  count(*) FILTER (error_category = 'artifact_load_error') AS artifact_load_failure_count,
  count(*) FILTER (success) AS total_predictions, count(*) FILTER (positive) AS positive_predictions,
  count(*) FILTER (success AND NOT positive) AS negative_predictions"""
ORACLE["telemetry_summary"] = f"WITH {EV} SELECT {SUMMARY} FROM ev"
ORACLE["telemetry_by_type"] = f"WITH {EV} SELECT event_type, {SUMMARY} FROM ev GROUP BY event_type"
ORACLE["telemetry_daily"] = f"WITH {EV} SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, {SUMMARY} FROM ev GROUP BY 1, 2"
ORACLE["telemetry_stream"] = ORACLE["telemetry_daily"]
ORACLE["telemetry_hourly"] = f"""WITH {EV} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, count(*) AS invocation_count,
  count(*) FILTER (NOT success) AS failure_count, count(*) FILTER (success) AS total_predictions FROM ev GROUP BY 1"""
ORACLE["invocation_numbers"] = (
    "SELECT event_id, user_id AS collector, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS invocation_count FROM events"
)
ORACLE["numbered_stream"] = """WITH a AS (SELECT event_id, user_id AS collector, ts,
  floor((epoch(ts) + event_id % 7 * 3600) / 604800) + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS week FROM events),
seen AS (SELECT collector, week, max(max(ts)) OVER (PARTITION BY collector ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM a GROUP BY 1, 2),
marked AS (SELECT event_id, a.collector, ts, coalesce(latest - INTERVAL 1 HOUR >= ts, false) AS late FROM a JOIN seen USING (collector, week))
SELECT event_id, collector, late, CASE WHEN NOT late THEN row_number() OVER (PARTITION BY collector, late ORDER BY ts, event_id) END AS invocation_count FROM marked"""
ORACLE["events_json_lines"] = f"WITH {EV} SELECT event_type, error_category, {SUMMARY} FROM ev GROUP BY 1, 2"

# ------------------------------------------------------------ sources and sinks

ORACLE["threshold_csv"] = (
    f"{sweep()}, {cost_scenarios([DEFAULT_COSTS])}, {COSTED} SELECT threshold, tn, fp, fn, tp, "
    + rounded(["precision", "recall", "f1", "accuracy", "specificity", "npv", "total_cost", "average_cost", "cost_per_predicted"])
    + " FROM costs"
)
ORACLE["retention_csv"] = (
    f"{sweep()}, {ONE_R}, {R_COSTED} SELECT threshold, tn, fp, fn, tp, "
    + rounded(["precision", "recall", "f1", "accuracy", "specificity", "npv", "average_cost", "cost_per_predicted"])
    + ", " + rounded(["total_cost", "net_business_value", "expected_churn_loss", "expected_intervention_cost", "expected_retained_value"], 2)
    + " FROM costs"
)
ORACLE["csv_roundtrip"] = f"WITH {RAW} SELECT account_id, tenure, region, acctbal, lapsed FROM raw"
ORACLE["split_tables"] = f"WITH {A_SPLIT} SELECT account_id, y FROM splits WHERE split = 'val'"
ORACLE["dataset_manifest"] = """WITH lost AS (SELECT count(*) FILTER (c_custkey = 1) = 0 AS same FROM customer)
SELECT copy, "check", copy = 'intact' OR "check" = 'column_count' OR same AS ok
FROM (VALUES ('intact'), ('changed')) a(copy), (VALUES ('row_count'), ('column_count'), ('sha256')) b("check"), lost"""

# ------------------------------------------------------------ attribution


def attribution(weights: dict[str, float]) -> str:
    body = " UNION ALL ".join(
        f"SELECT doc_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value, ({w}) * ({c} - (SELECT avg({c}) FROM scored)) AS contribution FROM scored"
        for c, w in weights.items()
    )
    return f"WITH {SCORED_ALL}, attr AS ({body})"


PINNED = attribution(DOC_WEIGHTS)
ORACLE["linear_attribution"] = (
    f"{PINNED} SELECT doc_id, feature, round(value, 6) AS value, round(contribution, 6) AS contribution FROM attr"
)
ORACLE["global_importance"] = (
    f"{PINNED} SELECT feature, round(avg(abs(contribution)), 6) AS mean_abs, round(avg(contribution), 6) + 0.0 AS mean_signed FROM attr GROUP BY 1"
)
ORACLE["grouped_importance"] = f"""{attribution({'dw': -11.06, 'log_chars': -0.50, 'n_chars': 0.0001})},
r AS (SELECT doc_id, CASE feature WHEN 'dw' THEN 'words' ELSE 'length' END AS original_feature, sum(abs(contribution)) AS a, sum(contribution) AS s,
  count(*) AS c FROM attr GROUP BY 1, 2)
SELECT original_feature, round(avg(a), 6) AS mean_abs, round(avg(s), 6) + 0.0 AS mean_signed, max(c) AS n_columns FROM r GROUP BY 1"""
ORACLE["local_top_contributors"] = f"""{PINNED},
s AS (SELECT *, CASE WHEN contribution > 0 THEN 'positive' ELSE 'negative' END AS direction FROM attr WHERE contribution <> 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, direction ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS rank FROM s)
SELECT doc_id, direction, rank, feature, round(contribution, 6) AS contribution FROM r WHERE rank = 1"""
ORACLE["outcome_examples"] = f"""WITH {OUT},
k AS (SELECT outcome, min(doc_id) AS doc_id FROM o GROUP BY 1)
SELECT n.outcome, k.doc_id, scored.p FROM (VALUES ('TN'), ('FP'), ('FN'), ('TP')) n(outcome)
LEFT JOIN k ON k.outcome = n.outcome LEFT JOIN scored ON scored.doc_id = k.doc_id"""

# ------------------------------------------------------------ models and calibration

ORACLE["prior_baseline"] = f"""WITH {FOLDS}
SELECT f.fold, round(avg(CAST(t.y AS DOUBLE)), 6) AS p, round(avg(CAST(t.y AS DOUBLE)), 6) AS p_min
FROM (SELECT DISTINCT fold FROM folds) f JOIN folds t ON t.fold <> f.fold GROUP BY 1"""


def newton(
    features: list[str], penalty: float, groups: str, cells: str = "cells", steps: int = 14, tag: str = "",
    trains: str = "c.fold <> p.g",
) -> str:
    """CTEs of an L2-penalised logistic fit (free intercept) per left-out group, by Newton steps.

    ``groups`` has column g; ``cells`` has columns fold, y, w and the features.
    """
    f = ["1.0", *[f"c.{x}" for x in features]]
    k = len(f)
    z = " + ".join(f"b{a} * {f[a]}" for a in range(k))
    out = [f"{tag}n0 AS (SELECT g, {', '.join(f'CAST(0 AS DOUBLE) AS b{a}' for a in range(k))} FROM ({groups}))"]
    beta = ", ".join(f"b{a}" for a in range(k))
    for t in range(steps):
        mu = f"1 / (1 + exp(-({z})))"
        grad = ", ".join(
            f"sum(w * (mu - y) * x{a}) + {penalty if a else 0.0} * b{a} AS g{a}" for a in range(k)
        )
        hess = ", ".join(
            f"sum(w * mu * (1 - mu) * x{a} * x{b}) + {penalty if a == b and a else 0.0} AS h{a}{b}"
            for a in range(k) for b in range(a, k)
        )
        xs = ", ".join(f"{f[a]} AS x{a}" for a in range(k))
        out.append(
            f"{tag}s{t} AS (SELECT g, {beta}, {grad}, {hess} FROM (SELECT p.*, c.y, c.w, {xs}, {mu} AS mu "
            f"FROM {tag}n{t} p JOIN {cells} c ON {trains}) GROUP BY g, {beta})"
        )
        if k == 2:
            det = "(h00 * h11 - h01 * h01)"
            step = [f"(h11 * g0 - h01 * g1) / {det}", f"(h00 * g1 - h01 * g0) / {det}"]
        else:
            det = "(h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02))"
            inv = {
                "00": "(h11 * h22 - h12 * h12)", "01": "(h02 * h12 - h01 * h22)", "02": "(h01 * h12 - h02 * h11)",
                "11": "(h00 * h22 - h02 * h02)", "12": "(h01 * h02 - h00 * h12)", "22": "(h00 * h11 - h01 * h01)",
            }
            step = [
                "(" + " + ".join(f"{inv[''.join(sorted(f'{a}{b}'))]} * g{b}" for b in range(3)) + f") / {det}"
                for a in range(3)
            ]
        out.append(f"{tag}n{t + 1} AS (SELECT g, {', '.join(f'b{a} - {step[a]} AS b{a}' for a in range(k))} FROM {tag}s{t})")
    out.append(f"{tag}fit AS (SELECT * FROM {tag}n{steps})")
    return ", ".join(out)


TWO_FEATURES = "cells AS (SELECT fold, y, 1.0 AS w, dw, log_chars FROM folds)"
ORACLE["logistic_coefficients"] = f"""WITH {FOLDS}, {TWO_FEATURES}, {newton(['dw', 'log_chars'], 0.1, 'SELECT -1 AS g')},
c AS (SELECT 'num__dw' AS feature, b1 AS v FROM fit UNION ALL SELECT 'num__log_chars', b2 FROM fit)
SELECT feature, round(v, 3) AS coefficient, CASE WHEN v > 0 THEN 'increases' ELSE 'decreases' END AS direction,
  CAST(row_number() OVER (ORDER BY abs(v) DESC) AS INTEGER) AS rank FROM c"""
ORACLE["oof_logistic"] = f"""WITH {FOLDS}, {TWO_FEATURES}, {newton(['dw', 'log_chars'], 0.1, 'SELECT DISTINCT fold AS g FROM folds')}
SELECT doc_id, y, fold, round(1 / (1 + exp(-(b0 + b1 * dw + b2 * log_chars))), 4) AS p FROM folds JOIN fit ON g = fold"""
ORACLE["logistic_grid"] = f"""WITH {FOLDS}, {TWO_FEATURES}, {', '.join(
    newton(['dw', 'log_chars'], 1 / c, 'SELECT DISTINCT fold AS g FROM folds', tag=f'c{i}_') for i, c in enumerate(GRID_C))},
points AS ({' UNION ALL '.join(f'SELECT *, CAST({c} AS DOUBLE) AS C FROM c{i}_fit' for i, c in enumerate(GRID_C))})
SELECT CAST(g AS BIGINT) AS fold, C, round(b0, 4) AS b0, round(b1, 4) AS b1, round(b2, 4) AS b2 FROM points"""
Z = "ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6)))"
LOGITS = f"cells AS (SELECT fold, y, 1.0 AS w, {Z} AS z FROM folds)"
ORACLE["sigmoid_calibration"] = f"""WITH {FOLDS}, {LOGITS}, {newton(['z'], 1.0, 'SELECT -1 AS g')}
SELECT doc_id, round(1 / (1 + exp(-(b0 + b1 * {Z}))), 4) AS p FROM (WITH {SCORED_ALL} SELECT doc_id, p FROM scored), fit"""


def isotonic(groups: str) -> str:
    """CTEs of the min-max form of isotonic regression per left-out group."""
    return f"""pts AS (SELECT g, p, CAST(sum(y) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM ({groups}) JOIN folds ON fold <> g GROUP BY g, p),
pre AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p) AS i, sum(s) OVER (PARTITION BY g ORDER BY p) AS cs, sum(n) OVER (PARTITION BY g ORDER BY p) AS cn FROM pts),
blk AS (SELECT a.g, a.i AS j, b.i AS k, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS m FROM pre a JOIN pre b ON a.g = b.g AND b.i >= a.i),
low AS (SELECT x.g, x.i, b.j, min(b.m) AS m FROM pre x JOIN blk b ON b.g = x.g AND b.j <= x.i AND b.k >= x.i GROUP BY 1, 2, 3),
iso AS (SELECT l.g, pre.p, max(l.m) AS v FROM low l JOIN pre ON pre.g = l.g AND pre.i = l.i GROUP BY 1, 2)"""


ORACLE["isotonic_calibration"] = f"""WITH {FOLDS}, {isotonic('SELECT -1 AS g')}
SELECT doc_id, y, round(v, 6) AS p FROM folds JOIN iso ON iso.p = folds.p"""
CROSSED = f"""{FOLDS}, {isotonic('SELECT DISTINCT fold AS g FROM folds')},
{LOGITS}, {newton(['z'], 1.0, 'SELECT DISTINCT fold AS g FROM folds')},
near AS (SELECT f.doc_id, f.fold, f.y, f.p, max(i.p) FILTER (i.p <= f.p) AS lo, min(i.p) FILTER (i.p >= f.p) AS hi
  FROM folds f JOIN iso i ON i.g = f.fold GROUP BY 1, 2, 3, 4),
held AS (SELECT n.fold, n.y, CASE WHEN n.lo IS NULL THEN b.v WHEN n.hi IS NULL OR n.hi = n.lo THEN a.v
    ELSE a.v + (b.v - a.v) * (n.p - n.lo) / (n.hi - n.lo) END AS p
  FROM near n LEFT JOIN iso a ON a.g = n.fold AND a.p = n.lo LEFT JOIN iso b ON b.g = n.fold AND b.p = n.hi),
crossed AS (SELECT 'baseline' AS method, fold, y, p FROM folds
  UNION ALL SELECT 'isotonic', fold, y, round(p, 9) FROM held
  UNION ALL SELECT 'sigmoid', fold, y, round(1 / (1 + exp(-(b0 + b1 * {Z}))), 9) FROM folds JOIN fit ON g = fold),
{ranked_by('crossed', 'method, fold')},
losses AS (SELECT method, fold, avg(CASE WHEN y = 1 THEN -ln(greatest(least(p, 1 - pow(2.0, -52)), pow(2.0, -52)))
    ELSE -ln(1 - greatest(least(p, 1 - pow(2.0, -52)), pow(2.0, -52))) END) AS log_loss, avg((p - y) * (p - y)) AS brier FROM crossed GROUP BY 1, 2),
tab AS (SELECT l.method, avg(log_loss) AS log_loss, avg(brier) AS brier, avg(roc_auc) AS roc_auc, avg(average_precision) AS average_precision
  FROM losses l JOIN ranks r ON r.method = l.method AND r.fold = l.fold GROUP BY 1)"""
ORACLE["calibration_metrics"] = f"WITH {CROSSED} SELECT method, {rounded(['log_loss', 'brier', 'roc_auc', 'average_precision'], 3)} FROM tab"
ORACLE["calibration_choice"] = f"""WITH {CROSSED},
w AS (SELECT s.log_loss - i.log_loss AS ll, s.brier - i.brier AS br FROM (SELECT * FROM tab WHERE method = 'sigmoid') s, (SELECT * FROM tab WHERE method = 'isotonic') i)
SELECT CASE WHEN abs(ll) > 1e-4 THEN CASE WHEN ll < 0 THEN 'sigmoid' ELSE 'isotonic' END
  WHEN abs(br) > 1e-4 THEN CASE WHEN br < 0 THEN 'sigmoid' ELSE 'isotonic' END ELSE 'sigmoid' END AS selected_method,
  CASE WHEN abs(ll) > 1e-4 THEN 'log_loss' WHEN abs(br) > 1e-4 THEN 'brier' ELSE 'tie_break_prefer_sigmoid' END AS decision_rule FROM w"""
ORACLE["calibrated_threshold"] = f"""WITH {FOLDS}, {isotonic('SELECT -1 AS g')},
cal AS (SELECT folds.y, round(iso.v, 9) AS q FROM folds JOIN iso ON iso.p = folds.p),
grid AS (SELECT CAST(i AS DOUBLE) / 100 AS threshold FROM range(1, 100) r(i)),
c AS ({counts('threshold', p='q', src='cal, grid')})
SELECT threshold, CAST(fp * 10 + fn * 100 + tp * 10 AS DOUBLE) AS total_cost, tn, fp, fn, tp FROM c
ORDER BY total_cost, tp DESC, threshold LIMIT 1"""

ORACLE["calibration_run"] = ORACLE["calibration_choice"]

# ------------------------------------------------------------ a model with gaps and categories


def category_newton(penalty: float, steps: int = 14) -> str:
    """CTEs of an L2-penalised logistic fit on dw, log_chars and a one-hot category.

    ``cells`` has y, w, cat, dw, log_chars. The Hessian of the categories is diagonal: their
    coefficients (bc) are eliminated, which leaves three unknowns b0 (free), b1, b2.
    """
    pairs = [f"{a}{b}" for a in range(3) for b in range(a, 3)]
    out = ["n0 AS (SELECT DISTINCT cat, CAST(0 AS DOUBLE) AS bc, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2 FROM cells)"]
    for t in range(steps):
        mu = "1 / (1 + exp(-(b0 + bc + b1 * dw + b2 * log_chars)))"
        sums = [f"sum(w * (mu - y) * x{a}) AS g{a}" for a in range(3)]
        sums += [f"sum(w * mu * (1 - mu) * x{p[0]} * x{p[1]}) AS h{p}" for p in pairs]
        out.append(
            f"s{t} AS (SELECT cat, bc, b0, b1, b2, {', '.join(sums)}, h00 + {penalty} AS hc, g0 + {penalty} * bc AS gc FROM "
            f"(SELECT p.*, y, w, 1.0 AS x0, dw AS x1, log_chars AS x2, {mu} AS mu FROM n{t} p JOIN cells USING (cat)) GROUP BY cat, bc, b0, b1, b2)"
        )
        rest = [f"sum(g{a} - h0{a} * gc / hc) + {penalty if a else 0.0} * max(b{a}) AS g{a}" for a in range(3)]
        rest += [
            f"sum(h{p} - h0{p[0]} * h0{p[1]} / hc) + {penalty if p in ('11', '22') else 0.0} AS h{p}" for p in pairs
        ]
        out.append(f"r{t} AS (SELECT {', '.join(rest)} FROM s{t})")
        inv = {
            "00": "h11 * h22 - h12 * h12", "01": "h02 * h12 - h01 * h22", "02": "h01 * h12 - h02 * h11",
            "11": "h00 * h22 - h02 * h02", "12": "h01 * h02 - h00 * h12", "22": "h00 * h11 - h01 * h01",
        }
        det = f"(h00 * ({inv['00']}) + h01 * ({inv['01']}) + h02 * ({inv['02']}))"
        step = [
            "(" + " + ".join(f"({inv[''.join(sorted(f'{a}{b}'))]}) * g{b}" for b in range(3)) + f") / {det} AS d{a}"
            for a in range(3)
        ]
        out.append(f"d{t} AS (SELECT {', '.join(step)} FROM r{t})")
        out.append(
            f"n{t + 1} AS (SELECT cat, bc - (gc - h00 * d0 - h01 * d1 - h02 * d2) / hc AS bc, "
            f"b0 - d0 AS b0, b1 - d1 AS b1, b2 - d2 AS b2 FROM s{t}, d{t})"
        )
    return ", ".join([*out, f"fit AS (SELECT * FROM n{steps})"])


GAPPY = f"""gappy AS (WITH {SCORED_ALL} SELECT doc_id, y, CASE WHEN doc_id % 11 <> 0 THEN lang END AS lang,
  CASE WHEN doc_id % 13 <> 0 THEN dw END AS dw, log_chars FROM feat),
train AS (SELECT * FROM gappy WHERE y IS NOT NULL),
fill AS (SELECT quantile_cont(dw, 0.5) AS dw FROM train),
most AS (SELECT lang FROM train WHERE lang IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, lang LIMIT 1),
sizes AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(y) AS pos FROM train),
cells AS (SELECT y, CASE WHEN y = 1 THEN n / (2 * pos) ELSE n / (2 * (n - pos)) END AS w, coalesce(train.lang, most.lang) AS cat,
  coalesce(train.dw, fill.dw) AS dw, log_chars FROM train, fill, most, sizes)"""
ORACLE["categorical_coefficients"] = f"""WITH {GAPPY}, {category_newton(0.1)},
c AS (SELECT 'cat__lang_' || cat AS feature, bc AS v FROM fit UNION SELECT 'num__dw', b1 FROM fit UNION SELECT 'num__log_chars', b2 FROM fit)
SELECT feature, round(v, 3) AS coefficient, CASE WHEN v > 0 THEN 'increases' ELSE 'decreases' END AS direction FROM c"""
ORACLE["categorical_scorer"] = f"""WITH {GAPPY}, {category_newton(0.1)}
SELECT doc_id, round(1 / (1 + exp(-(b0 + bc + b1 * dw + b2 * log_chars))), 4) AS probability FROM gappy JOIN fit ON cat = lang WHERE dw IS NOT NULL"""
ORACLE["contract_from_model"] = f"""WITH {GAPPY}
SELECT doc_id, 'dw' AS "column", 'missing' AS code FROM gappy WHERE dw IS NULL
UNION ALL SELECT doc_id, 'lang', 'missing' FROM gappy WHERE lang IS NULL
UNION ALL SELECT doc_id, 'lang', 'unknown_category' FROM gappy WHERE lang IS NOT NULL
  AND CASE WHEN doc_id % 7 = 0 THEN upper(lang) ELSE lang END NOT IN (SELECT lang FROM train WHERE lang IS NOT NULL)"""
ORACLE["feature_mapping"] = f"""WITH {GAPPY},
slots AS (SELECT 0 AS position, 'num__dw' AS feature, 'dw' AS original, count(*) FILTER (dw <> 0) AS n_set FROM cells
  UNION ALL SELECT 1, 'num__log_chars', 'log_chars', count(*) FILTER (log_chars <> 0) FROM cells
  UNION ALL SELECT 1 + row_number() OVER (ORDER BY k.lang), 'cat__lang_' || k.lang, 'lang', (SELECT count(*) FROM cells WHERE cat = k.lang)
  FROM (SELECT DISTINCT lang FROM train WHERE lang IS NOT NULL) k)
SELECT CAST(position AS INTEGER) AS position, feature, original, n_set FROM slots"""
ORACLE["calibrated_scorer"] = f"""WITH {FOLDS}, {TWO_FEATURES}, {newton(['dw', 'log_chars'], 0.1, 'SELECT DISTINCT fold AS g FROM folds', tag='o_')},
{newton(['dw', 'log_chars'], 0.1, 'SELECT -1 AS g', tag='m_')},
held AS (SELECT fold, y, 1.0 AS w, 1 / (1 + exp(-(b0 + b1 * dw + b2 * log_chars))) AS p FROM folds JOIN o_fit ON g = fold),
held_z AS (SELECT fold, y, w, {Z} AS z FROM held), {newton(['z'], 1.0, 'SELECT -1 AS g', cells='held_z', tag='k_')},
sc AS (SELECT doc_id, 1 / (1 + exp(-(b0 + b1 * dw + b2 * log_chars))) AS p FROM (WITH {SCORED_ALL} SELECT doc_id, dw, log_chars FROM feat), m_fit)
SELECT doc_id, round(1 / (1 + exp(-(b0 + b1 * {Z}))), 4) AS probability FROM sc, k_fit"""

# ------------------------------------------------------------ scoring

SCORES = f"""WITH {FOLDS}, {TWO_FEATURES}, {newton(['dw', 'log_chars'], 0.1, 'SELECT -1 AS g')},
sc AS (SELECT doc_id, 1 / (1 + exp(-(b0 + b1 * dw + b2 * log_chars))) AS q
  FROM (WITH {SCORED_ALL} SELECT doc_id, dw, log_chars FROM feat), fit)"""
ORACLE["score_batch"] = f"""{SCORES}
SELECT doc_id, round(q, 4) AS probability, CAST(q >= 0.19 AS INTEGER) AS prediction, CASE WHEN q >= 0.19 THEN 'Yes' ELSE 'No' END AS prediction_label,
  CAST(0.19 AS DOUBLE) AS threshold FROM sc"""
ORACLE["score_stream"] = f"""{SCORES}
SELECT doc_id, round(q, 4) AS probability, CAST(q >= 0.19 AS INTEGER) AS prediction, CASE WHEN q >= 0.19 THEN 'Yes' ELSE 'No' END AS prediction_label FROM sc"""
ORACLE["failure_events"] = f"""{SCORES},
calls AS (SELECT true AS success, NULL AS error_category, count(*) AS n, count(*) FILTER (q >= 0.3) AS pos FROM sc
  UNION ALL SELECT count(*) FILTER (doc_id % 13 = 0) = 0, 'validation_error', 0, 0 FROM sc
  UNION ALL SELECT count(*) < 0, 'artifact_integrity_error', 0, 0 FROM sc UNION ALL SELECT count(*) < 0, 'artifact_load_error', 0, 0 FROM sc)
SELECT 'predict_batch' AS event_type, success, error_category, n AS prediction_count, pos AS positive_predictions, n - pos AS negative_predictions FROM calls"""
ORACLE["rejected_stream"] = f"""WITH {SCORED_ALL}
SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 17 = 0 THEN 'above_maximum' END AS code FROM feat"""
ORACLE["score_files"] = f"""{SCORES}
SELECT 'predict_batch' AS event_type, count(*) AS prediction_count, count(*) FILTER (q >= 0.3) AS positive_predictions,
  count(*) FILTER (q < 0.3) AS negative_predictions, CAST(0.3 AS DOUBLE) AS threshold, true AS success, count(*) AS batch_size FROM sc"""
ORACLE["predict_classes"] = f"{SCORES} SELECT doc_id, CAST(q >= 0.3 AS INTEGER) AS prediction FROM sc"
ORACLE["predict_probabilities"] = f"{SCORES} SELECT doc_id, round(q, 4) AS probability FROM sc"
ORACLE["scored_file_rows"] = (
    f"{SCORES} SELECT doc_id, CAST(q >= 0.3 AS INTEGER) AS prediction, round(q, 4) AS probability FROM sc"
)
ORACLE["sensitivity_csv"] = ORACLE["cost_sensitivity"]
ORACLE["error_report_files"] = ORACLE["error_slices"]
ORACLE["error_rates_json"] = ORACLE["error_rates"]
ORACLE["decision_cells"] = f"""WITH {SCORED}
SELECT y, CAST(p >= {T} AS INTEGER) AS a, CAST(p_rival >= {T} AS INTEGER) AS b, count(*) AS n FROM scored GROUP BY 1, 2, 3"""

ORACLE["auc_difference"] = f"""WITH {SCORED},
seen AS (SELECT y, p, p_rival, CAST(sum(y) OVER () AS DOUBLE) AS np, CAST(sum(1 - y) OVER () AS DOUBLE) AS nn,
  sum(1 - y) OVER (ORDER BY p) - sum(1 - y) OVER (PARTITION BY p) / 2.0 AS neg_a, sum(1 - y) OVER (ORDER BY p_rival) - sum(1 - y) OVER (PARTITION BY p_rival) / 2.0 AS neg_b,
  sum(y) OVER (ORDER BY p) - sum(y) OVER (PARTITION BY p) / 2.0 AS pos_a, sum(y) OVER (ORDER BY p_rival) - sum(y) OVER (PARTITION BY p_rival) / 2.0 AS pos_b
  FROM scored),
placed AS (SELECT y, CASE WHEN y = 1 THEN neg_a / nn ELSE 1 - pos_a / np END AS a, CASE WHEN y = 1 THEN neg_b / nn ELSE 1 - pos_b / np END AS b FROM seen),
c AS (SELECT y, avg(a) AS a, avg(b) AS b, var_samp(a - b) / count(*) AS v FROM placed GROUP BY y),
one AS (SELECT max(a) FILTER (y = 1) AS auc_a, max(b) FILTER (y = 1) AS auc_b, sqrt(sum(v)) AS std_error FROM c),
d AS (SELECT *, auc_a - auc_b AS auc_difference FROM one)
SELECT round(auc_a, 6) AS auc_a, round(auc_b, 6) AS auc_b, round(auc_difference, 6) AS auc_difference, round(std_error, 6) AS std_error,
  round(auc_difference / std_error, 6) AS z, round(auc_difference - 1.959963984540054 * std_error, 6) AS low,
  round(auc_difference + 1.959963984540054 * std_error, 6) AS high FROM d"""

# ------------------------------------------------------------ model comparison

PER_FOLD = "SELECT DISTINCT fold AS g FROM folds"


def at_half(src: str, by: str) -> str:
    return f"""c AS (SELECT {by}, count(*) FILTER (y = 0 AND p < 0.5) AS tn, count(*) FILTER (y = 0 AND p >= 0.5) AS fp,
  count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 1 AND p >= 0.5) AS tp FROM {src} GROUP BY {by}),
m AS (SELECT r.*, {RATES['accuracy']} AS accuracy, {RATES['precision']} AS precision, {RATES['recall']} AS recall, {RATES['f1']} AS f1
  FROM ranks r JOIN c ON c.{by} = r.{by})"""


ORACLE["cv_metrics"] = f"""WITH {FOLDS}, {TWO_FEATURES}, {newton(['dw', 'log_chars'], 0.1, PER_FOLD)},
held AS (SELECT fold, y, 1 / (1 + exp(-(b0 + b1 * dw + b2 * log_chars))) AS p FROM folds JOIN fit ON g = fold),
{ranked_by('held', 'fold')}, {at_half('held', 'fold')}
""" + " UNION ALL ".join(
    f"SELECT '{x}' AS metric, round(avg({x}), 6) AS mean, round(stddev_pop({x}), 6) AS std FROM m"
    for x in ("roc_auc", "average_precision", "accuracy", "precision", "recall", "f1")
)
ORACLE["random_search"] = f"""WITH {FOLDS}, {TWO_FEATURES},
{newton(['dw', 'log_chars'], 50.0, PER_FOLD, tag='t')}, {newton(['dw', 'log_chars'], 0.1, PER_FOLD, tag='l')},
fits AS (SELECT 0.02 AS c, * FROM tfit UNION ALL SELECT 10.0, * FROM lfit),
held AS (SELECT c, fold, y, 1 / (1 + exp(-(b0 + b1 * dw + b2 * log_chars))) AS p FROM folds JOIN fits ON g = fold),
{ranked_by('held', 'c, fold')}
SELECT CAST(c AS DOUBLE) AS "C", round(avg(roc_auc), 6) AS score FROM ranks GROUP BY 1"""
TRAIN_CELLS = "cells AS (SELECT 0 AS fold, y, 1.0 AS w, dw, log_chars FROM splits WHERE split = 'train')"
ORACLE["model_selection"] = f"""WITH {D_SPLIT}, {TRAIN_CELLS},
{newton(['dw', 'log_chars'], 50.0, 'SELECT -1 AS g', tag='t')}, {newton(['dw', 'log_chars'], 0.1, 'SELECT -1 AS g', tag='l')},
fits AS (SELECT 'tight' AS model, * FROM tfit UNION ALL SELECT 'loose', * FROM lfit),
held AS (SELECT model, y, 1 / (1 + exp(-(b0 + b1 * dw + b2 * log_chars))) AS p FROM splits, fits WHERE split = 'val'),
{ranked_by('held', 'model')}
SELECT model, round(average_precision, 6) AS score,
  row_number() OVER (ORDER BY average_precision DESC, CASE model WHEN 'tight' THEN 0 ELSE 1 END) = 1 AS selected FROM ranks"""
ORACLE["final_evaluation"] = f"""WITH {D_SPLIT}, {TRAIN_CELLS}, {newton(['dw', 'log_chars'], 0.1, 'SELECT -1 AS g')},
held AS (SELECT 1 AS one, y, 1 / (1 + exp(-(b0 + b1 * dw + b2 * log_chars))) AS p FROM splits, fit WHERE split = 'test'),
{ranked_by('held', 'one')}, grid AS ({values_grid(45, 50, 55, 60)}), counts AS ({counts('threshold', src='held, grid')}),
sweep AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in RATES.items())} FROM counts)
SELECT {SWEEP_OUT}, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision FROM sweep, ranks"""

# Shapley values of two features: means over the orders in which a tree learns them. What a tree
# does not know it averages by the counts of its branches.
ORACLE["tree_attribution"] = f"""WITH {SCORED_ALL},
g AS (SELECT doc_id, y, dw, log_chars, dw <= 0.79 AS a, log_chars <= 7.3 AS b, log_chars <= 7.0 AS c, dw <= 0.7 AS d,
  CASE WHEN dw <= 0.6 THEN 0 WHEN dw <= 0.8 THEN 1 WHEN dw <= 0.9 THEN 2 ELSE 3 END AS leaf FROM feat),
t AS (SELECT * FROM g WHERE y IS NOT NULL),
m AS (SELECT avg(y) AS v0, CAST(count(*) AS DOUBLE) AS n FROM t),
ta AS (SELECT a, avg(y) AS va, count(*) AS na FROM t GROUP BY 1), tab AS (SELECT a, b, avg(y) AS vab FROM t GROUP BY 1, 2),
tb AS (SELECT b, sum(na * vab) / max(n) AS vb FROM tab JOIN ta USING (a), m GROUP BY b),
tc AS (SELECT c, avg(y) AS vc, count(*) AS nc FROM t GROUP BY 1),
td AS (SELECT r.d, max(r.v) AS right_v, max(tc.nc * tc.vc / m.n) FILTER (tc.c) + max(tc.nc / m.n) FILTER (NOT tc.c) * max(r.v) AS vd
  FROM (SELECT d, avg(y) AS v FROM t WHERE NOT c GROUP BY 1) r, tc, m GROUP BY r.d),
tl AS (SELECT leaf, avg(y) AS vl FROM t GROUP BY 1),
j AS (SELECT g.*, v0, va, vb, vab, vc, vd, CASE WHEN c THEN vc ELSE right_v END AS vcd, vl
  FROM g JOIN ta USING (a) JOIN tab USING (a, b) JOIN tb USING (b) JOIN tc USING (c) JOIN td USING (d) JOIN tl USING (leaf), m)
SELECT doc_id, 'dw' AS feature, round(dw, 6) AS value, round(((va - v0 + vab - vb) / 2 + (vd - v0 + vcd - vc) / 2 + vl - v0) / 3, 6) AS contribution FROM j
UNION ALL SELECT doc_id, 'log_chars', round(log_chars, 6), round(((vb - v0 + vab - va) / 2 + (vc - v0 + vcd - vd) / 2) / 3, 6) FROM j"""

# a point is numbered 10 * outer fold + inner fold; 9 leaves no inner fold out
NESTED_POINTS = "SELECT 10 * o.i + h.i AS g FROM range(5) o(i), (VALUES (0), (1), (2), (9)) h(i)"
NESTED_FITS = ", ".join(
    newton(["dw", "log_chars"], 1 / c, NESTED_POINTS, tag=f"c{i}_", trains="c.fold <> p.g // 10 AND c.inner_fold <> p.g % 10")
    for i, c in enumerate(GRID_C)
)
ORACLE["nested_search"] = f"""WITH {FOLDS},
crossed AS (SELECT *, ntile(3) OVER (PARTITION BY y ORDER BY md5('43-' || doc_id)) - 1 AS inner_fold FROM folds),
cells AS (SELECT fold, inner_fold, y, 1.0 AS w, dw, log_chars FROM crossed), {NESTED_FITS},
points AS ({' UNION ALL '.join(f'SELECT g // 10 AS o, g % 10 AS h, b0, b1, b2, CAST({c} AS DOUBLE) AS pen FROM c{i}_fit' for i, c in enumerate(GRID_C))}),
tried AS (SELECT o, h, pen, y, 1 / (1 + exp(-(b0 + b1 * dw + b2 * log_chars))) AS p FROM crossed JOIN points ON h = inner_fold AND o <> fold),
trials AS (WITH {ranked_by('tried', 'o, h, pen')} SELECT o, pen, avg(roc_auc) AS auc FROM ranks GROUP BY 1, 2),
best AS (SELECT o, pen FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY round(auc, 9) DESC, pen) AS r FROM trials) WHERE r = 1),
held AS (SELECT fold, y, 1 / (1 + exp(-(b0 + b1 * dw + b2 * log_chars))) AS p FROM crossed JOIN best ON best.o = fold JOIN points ON points.o = best.o AND points.pen = best.pen AND h = 9),
{ranked_by('held', 'fold')}, {at_half('held', 'fold')}
SELECT m.fold, pen AS "C", {rounded(['roc_auc', 'average_precision', 'accuracy', 'precision', 'recall', 'f1'])} FROM m JOIN best ON o = m.fold"""
