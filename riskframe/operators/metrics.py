"""Model-level metrics: exact ranking metrics, log loss, Brier score, class report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import checked_p, checked_y, safe_div
from ..functions.ranking import running_totals
from ..session import durable
from ..spec import LABEL, SCORE
from .thresholds import with_rates

# Fixed value: the spacing of doubles at one, used to clip probabilities in the log loss.
CLIP = 2.0**-52


def score_table(
    scored: DataFrame, by: Sequence[str] = (), y: str = LABEL, p: str = SCORE
) -> DataFrame:
    """Positives and negatives per distinct score (counted map-side before the shuffle)."""
    label = checked_y(F.col(y))
    return (
        scored.select(*by, checked_p(F.col(p)).alias("p"), label.alias("_y"))
        .groupBy(*by, "p")
        .agg(
            F.sum("_y").cast("bigint").alias("pos"),
            F.sum(1 - F.col("_y")).cast("bigint").alias("neg"),
        )
    )


def ranked_scores(
    scored: DataFrame,
    by: Sequence[str] = (),
    y: str = LABEL,
    p: str = SCORE,
    ranges: int | None = None,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Distinct scores with the positives and negatives at or above each one."""
    return running_totals(
        score_table(scored, by, y, p), "p", ["pos", "neg"], by, descending=True,
        ranges=ranges, cuts=cuts,
    )


def rank_metrics(
    scored: DataFrame,
    by: Sequence[str] = (),
    y: str = LABEL,
    p: str = SCORE,
    ranges: int | None = None,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """``(*by, roc_auc, average_precision)``, exact with ties; NULL if a class is absent.

    ROC-AUC is the rank statistic with half credit for ties, average precision the step
    sum of precision over recall gains (no interpolation).
    """
    table = ranked_scores(scored, by, y, p, ranges, cuts)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    n_pos, n_neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    return (
        table.groupBy(*by)
        .agg(
            n_pos.alias("_np"),
            n_neg.alias("_nn"),
            F.sum(pos * (neg / 2 - F.col("cum_neg"))).alias("_rank"),
            F.sum(pos * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("_step"),
        )
        .select(
            *by,
            safe_div(
                F.col("_np") * F.col("_nn") + F.col("_rank"), F.col("_np") * F.col("_nn"), None
            ).alias("roc_auc"),
            safe_div(F.col("_step"), F.col("_np"), None).alias("average_precision"),
        )
    )


def _placements(scored: DataFrame, y: str, p: str, name: str) -> DataFrame:
    """Of each distinct score the share of the other class that it is on the right side of.

    ``_pos_<name>`` for a positive: negatives below; ``_neg_<name>`` for a negative:
    positives above; half credit for ties. Their means over a class are the ROC-AUC.
    """
    t = ranked_scores(scored, y=y, p=p)
    return t.select(
        F.col("p").alias(f"_p_{name}"),
        safe_div(F.col("tot_neg") - F.col("cum_neg") + F.col("neg") / 2, F.col("tot_neg"), None).alias(f"_pos_{name}"),
        safe_div(F.col("cum_pos") - F.col("pos") / 2, F.col("tot_pos"), None).alias(f"_neg_{name}"),
    )


def auc_difference(scored: DataFrame, p_a: str, p_b: str, y: str = LABEL, z: float = 1.959963984540054) -> DataFrame:
    """``(auc_a, auc_b, auc_difference, std_error, z, low, high)`` of two scores of the same rows.

    DeLong's closed form: the variance of the difference from the covariances of both
    scores' placements within each class, exact with ties. Placements come from running
    totals over ranges of distinct scores; rows meet them as counted pairs of scores, so no
    row is drawn, sorted or gathered. ``z`` scales the interval (95 % by default). NULL
    where a class has no rows, and for the error where one has fewer than two.
    """
    cells = durable(
        scored.groupBy(checked_y(F.col(y)).alias("_y"), checked_p(F.col(p_a)).alias("_p_a"), checked_p(F.col(p_b)).alias("_p_b"))
        .agg(F.count(F.lit(1)).alias("_n")),
        "score-pairs",
    )
    flat = cells.join(_placements(scored, y, p_a, "a"), "_p_a").join(_placements(scored, y, p_b, "b"), "_p_b")
    side = lambda name: F.when(F.col("_y") == 1, F.col(f"_pos_{name}")).otherwise(F.col(f"_neg_{name}")).alias(name)
    placed = durable(flat.select("_y", "_n", side("a"), side("b")), "placements")
    n = F.col("_n")
    means = {
        r["_y"]: r
        for r in placed.groupBy("_y").agg(F.sum(n).alias("n"), (F.sum(n * F.col("a")) / F.sum(n)).alias("a"), (F.sum(n * F.col("b")) / F.sum(n)).alias("b")).collect()
    }
    kind = "auc_a double, auc_b double, auc_difference double, std_error double, z double, low double, high double"
    if set(means) != {0, 1}:
        return scored.sparkSession.createDataFrame([(None,) * 7], kind)
    centre = lambda name: F.col(name) - F.when(F.col("_y") == 1, means[1][name]).otherwise(means[0][name])
    # placements are centred before they are multiplied
    difference = centre("a") - centre("b")
    spread = {r["_y"]: r["s"] for r in placed.groupBy("_y").agg(F.sum(n * difference * difference).alias("s")).collect()}
    gap, error = means[1]["a"] - means[1]["b"], None
    if min(r["n"] for r in means.values()) > 1:
        error = sum(spread[c] / (means[c]["n"] - 1) / means[c]["n"] for c in (0, 1)) ** 0.5
    row = (
        means[1]["a"], means[1]["b"], gap, error, gap / error if error else None,
        None if error is None else gap - z * error, None if error is None else gap + z * error,
    )
    return scored.sparkSession.createDataFrame([row], kind)


def roc_points(scored: DataFrame, by: Sequence[str] = (), y: str = LABEL, p: str = SCORE, **kw) -> DataFrame:
    """``(*by, threshold, fpr, tpr)`` at every distinct score."""
    t = ranked_scores(scored, by, y, p, **kw)
    return t.select(
        *by,
        F.col("p").alias("threshold"),
        safe_div(F.col("cum_neg"), F.col("tot_neg"), None).alias("fpr"),
        safe_div(F.col("cum_pos"), F.col("tot_pos"), None).alias("tpr"),
    )


def pr_points(scored: DataFrame, by: Sequence[str] = (), y: str = LABEL, p: str = SCORE, **kw) -> DataFrame:
    """``(*by, threshold, precision, recall)`` at every distinct score."""
    t = ranked_scores(scored, by, y, p, **kw)
    return t.select(
        *by,
        F.col("p").alias("threshold"),
        safe_div(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        safe_div(F.col("cum_pos"), F.col("tot_pos"), None).alias("recall"),
    )


def log_loss_term(y: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1.0 - CLIP))
    return -F.when(y == 1, F.log(q)).otherwise(F.log(F.lit(1.0) - q))


def probability_losses(
    scored: DataFrame, by: Sequence[str] = (), y: str = LABEL, p: str = SCORE
) -> DataFrame:
    """``(*by, n, log_loss, brier)``."""
    label, prob = checked_y(F.col(y)), checked_p(F.col(p))
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(log_loss_term(label, prob)).alias("log_loss"),
        F.avg(F.pow(prob - label, F.lit(2.0))).alias("brier"),
    )


def label_metrics(
    scored: DataFrame, threshold: float = 0.5, by: Sequence[str] = (), y: str = LABEL, p: str = SCORE
) -> DataFrame:
    """Counts and rates at one threshold from a single aggregation."""
    label, pred = checked_y(F.col(y)), checked_p(F.col(p)) >= F.lit(float(threshold))
    counts = scored.groupBy(*by).agg(
        F.count_if((label == 0) & ~pred).alias("tn"),
        F.count_if((label == 0) & pred).alias("fp"),
        F.count_if((label == 1) & ~pred).alias("fn"),
        F.count_if((label == 1) & pred).alias("tp"),
    )
    return with_rates(counts)


def six_metrics(
    scored: DataFrame, by: Sequence[str], y: str = LABEL, p: str = SCORE, **kw
) -> DataFrame:
    """ROC-AUC, average precision and accuracy, precision, recall, F1 at 0.5 per group."""
    at_half = label_metrics(scored, 0.5, by, y, p).select(
        *by, "accuracy", "precision", "recall", "f1"
    )
    ranks = rank_metrics(scored, by, y, p, **kw)
    return ranks.join(at_half, list(by))


def mean_and_std(per_fold: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, metric, mean, std)`` with the population standard deviation over folds."""
    long = per_fold.select(
        *by,
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
        ).alias("m"),
    )
    return long.groupBy(*by, F.col("m.metric").alias("metric")).agg(
        F.avg("m.value").alias("mean"), F.stddev_pop("m.value").alias("std")
    )


def classification_report(
    scored: DataFrame, threshold: float = 0.5, by: Sequence[str] = (), y: str = LABEL, p: str = SCORE
) -> DataFrame:
    """Per class and averaged precision, recall, F1 and support, one row per label."""
    c = {k: F.col(k) for k in ("tn", "fp", "fn", "tp")}
    n_neg, n_pos = c["tn"] + c["fp"], c["fn"] + c["tp"]
    n = n_neg + n_pos
    negative = (
        safe_div(c["tn"], c["tn"] + c["fn"]),
        safe_div(c["tn"], n_neg),
        safe_div(2 * c["tn"], 2 * c["tn"] + c["fn"] + c["fp"]),
    )
    positive = (
        safe_div(c["tp"], c["tp"] + c["fp"]),
        safe_div(c["tp"], n_pos),
        safe_div(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]),
    )
    accuracy = safe_div(c["tp"] + c["tn"], n)
    macro = [(a + b) / 2 for a, b in zip(negative, positive)]
    weighted = [safe_div(a * n_neg + b * n_pos, n) for a, b in zip(negative, positive)]

    def line(name: str, values, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("label"),
            *[v.alias(m) for v, m in zip(values, ("precision", "recall", "f1"))],
            support.alias("support"),
        )

    rows = F.array(
        line("0", negative, n_neg),
        line("1", positive, n_pos),
        line("accuracy", [accuracy] * 3, n),
        line("macro avg", macro, n),
        line("weighted avg", weighted, n),
    )
    counts = label_metrics(scored, threshold, by, y, p)
    return counts.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def metric_gap(metrics: DataFrame, dataset: str, first: str, second: str, names: Sequence[str]) -> DataFrame:
    """``second - first`` of each metric between two datasets of one metrics table."""

    def of(which: str, m: str) -> Column:
        return F.max(F.when(F.col(dataset) == which, F.col(m)))

    wide = metrics.agg(
        *[of(first, m).alias(f"a_{m}") for m in names],
        *[of(second, m).alias(f"b_{m}") for m in names],
    )
    return wide.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("metric"),
                        F.col(f"a_{m}").alias(first),
                        F.col(f"b_{m}").alias(second),
                        (F.col(f"b_{m}") - F.col(f"a_{m}")).alias("gap"),
                    )
                    for m in names
                ]
            )
        ).alias("g")
    ).select("g.*")


def positive_share(scored: DataFrame, threshold: float, by: Sequence[str] = (), p: str = SCORE) -> DataFrame:
    """Rows, predicted positives and their share."""
    pred = checked_p(F.col(p)) >= F.lit(float(threshold))
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(pred).alias("positive"),
        F.avg(pred.cast("double")).alias("positive_share"),
    )


def scored_checks(scored: DataFrame, y: str = LABEL, p: str = SCORE) -> DataFrame:
    """One row per input check of a scored table: ``(check, ok, bad_rows)``."""
    prob = F.col(p).cast("double")
    row = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(~F.col(y).isin(0, 1), F.lit(True))).alias("bad_y"),
        F.count_if(
            F.coalesce(F.isnan(prob) | (prob < 0) | (prob > 1), F.lit(True))
        ).alias("bad_p"),
    )
    checks = F.array(
        F.struct(F.lit("not_empty").alias("check"), (F.col("n") > 0).alias("ok"), F.lit(0).cast("bigint").alias("bad_rows")),
        F.struct(F.lit("label_binary").alias("check"), (F.col("bad_y") == 0).alias("ok"), F.col("bad_y").alias("bad_rows")),
        F.struct(F.lit("probability_range").alias("check"), (F.col("bad_p") == 0).alias("ok"), F.col("bad_p").alias("bad_rows")),
    )
    return row.select(F.explode(checks).alias("c")).select("c.*")
