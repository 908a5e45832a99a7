"""Ranking and threshold metrics grouped by any key set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import safe_ratio
from .ranking import prefix_sums

LOG_CLIP = 2.220446049250313e-16  # machine epsilon of a double


def score_counts(scored: DataFrame, keys: Sequence[str], score: str = "score", label: str = "y") -> DataFrame:
    """One row per (key, distinct score) with its positives and negatives."""
    return scored.groupBy(*keys, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def ranked_scores(scored: DataFrame, keys: Sequence[str], score: str = "score", label: str = "y", with_next: bool = False) -> DataFrame:
    """Descending cumulative positives/negatives at every distinct score."""
    return prefix_sums(score_counts(scored, keys, score, label), keys, score, ["pos", "neg"], descending=True, with_next=with_next)


def ranking_from(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AUPRC (step definition) and AUROC (ties averaged); null when a class is absent."""
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    ap = F.sum(F.col("pos") * precision) / F.max("tot_pos")
    # A negative is beaten by the positives above it and ties with half of its own group.
    wins = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0))
    both = (F.max("tot_pos") > 0) & (F.max("tot_neg") > 0)
    return ranked.groupBy(*keys).agg(
        F.max("tot_pos").alias("n_pos"),
        F.max("tot_neg").alias("n_neg"),
        F.when(both, ap).alias("auprc"),
        F.when(both, wins / (F.max("tot_pos").cast("double") * F.max("tot_neg"))).alias("auroc"),
    )


def ranking_metrics(scored: DataFrame, keys: Sequence[str], score: str = "score", label: str = "y") -> DataFrame:
    return ranking_from(ranked_scores(scored, keys, score, label), keys)


def ranking_of_counts(counts: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """As ``ranking_metrics``, from the rows of ``score_counts``; finer counts are added up to the given keys."""
    summed = counts.groupBy(*keys, score).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return ranking_from(prefix_sums(summed, keys, score, ["pos", "neg"], descending=True), keys)


def confusion(scored: DataFrame, keys: Sequence[str], predicted: Column, label: str = "y") -> DataFrame:
    """tn, fp, fn, tp per key; ``predicted`` is a boolean column."""
    y = F.col(label)
    return scored.groupBy(*keys).agg(
        F.count_if((y == 0) & ~predicted).alias("tn"),
        F.count_if((y == 0) & predicted).alias("fp"),
        F.count_if((y == 1) & ~predicted).alias("fn"),
        F.count_if((y == 1) & predicted).alias("tp"),
    )


def threshold_metric_columns() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    sensitivity = safe_ratio(tp, tp + fn)
    specificity = safe_ratio(tn, tn + fp)
    return {
        "balanced_accuracy": (sensitivity + specificity) / 2,
        "sensitivity": sensitivity,
        "specificity": specificity,
        "precision": safe_ratio(tp, tp + fp),
        "f1": safe_ratio(2 * tp, 2 * tp + fp + fn),
        "accuracy": safe_ratio(tp + tn, tp + tn + fp + fn),
        "mcc": safe_ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    }


def threshold_metrics(scored: DataFrame, keys: Sequence[str], predicted: Column, label: str = "y") -> DataFrame:
    counts = confusion(scored, keys, predicted, label)
    return counts.select("*", *[c.alias(n) for n, c in threshold_metric_columns().items()])


def null_aware_metrics(scored: DataFrame, keys: Sequence[str], predicted: Column, score: str = "score", label: str = "y") -> DataFrame:
    """Reporting form: undefined metrics are null and named in ``warnings``."""
    ranked = ranking_metrics(scored, keys, score, label)
    thr = threshold_metrics(scored, keys, predicted, label)
    joined = thr.join(ranked, list(keys))
    no_pos, no_neg = F.col("n_pos") == 0, F.col("n_neg") == 0
    none_predicted = (F.col("tp") + F.col("fp")) == 0
    warnings = F.filter(
        F.array(
            F.when(no_pos, F.lit("sensitivity_undefined")),
            F.when(no_neg, F.lit("specificity_undefined")),
            F.when(no_pos | no_neg, F.lit("ranking_undefined")),
            F.when(none_predicted, F.lit("precision_zero_division")),
        ),
        lambda w: w.isNotNull(),
    )
    return joined.select(
        *keys,
        "tn",
        "fp",
        "fn",
        "tp",
        "accuracy",
        F.when(~no_pos & ~no_neg, F.col("balanced_accuracy")).alias("balanced_accuracy"),
        "precision",
        F.when(~no_pos, F.col("sensitivity")).alias("sensitivity"),
        F.when(~no_neg, F.col("specificity")).alias("specificity"),
        "f1",
        "auroc",
        "auprc",
        F.array_join(warnings, ",").alias("warnings"),
    )


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y, F.lit(2)))


def log_loss(p: Column, y: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1.0 - LOG_CLIP)), F.lit(LOG_CLIP))
    return -F.avg(F.when(y == 1, F.log(q)).otherwise(F.log(F.lit(1.0) - q)))


def probability_losses(scored: DataFrame, keys: Sequence[str], prob: str = "prob", label: str = "y") -> DataFrame:
    p, y = F.col(prob), F.col(label)
    return scored.groupBy(*keys).agg(brier(p, y).alias("brier"), log_loss(p, y).alias("log_loss"))


def input_violations(scored: DataFrame, keys: Sequence[str], score: str = "score", label: str = "y") -> DataFrame:
    """Counts that must be zero (and classes that must be two) before strict metrics."""
    s, y = F.col(score), F.col(label)
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))).alias("bad_score"),
        F.count_if(y.isNull() | ~y.isin(0, 1)).alias("bad_label"),
        F.count_distinct(label).alias("n_classes"),
    )


def require_valid(scored: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "y") -> DataFrame:
    """Strict mode: fail where ``input_violations`` finds something, else return the input."""
    bad = input_violations(scored, keys, score, label).filter("bad_score > 0 or bad_label > 0 or n_classes <> 2")
    rows = bad.limit(5).collect()
    if rows or scored.isEmpty():
        raise ValueError(f"metrics need finite scores and both labels 0 and 1: {rows}")
    return scored


def classification_report(scored: DataFrame, keys: Sequence[str], predicted: str = "predicted", label: str = "y") -> DataFrame:
    """precision, recall, f1, support per class plus macro and weighted rows."""
    per_class = (
        scored.select(*keys, label, predicted, F.explode(F.array(F.lit(0), F.lit(1))).alias("c"))
        .groupBy(*keys, "c")
        .agg(
            F.count_if((F.col(label) == F.col("c")) & (F.col(predicted) == F.col("c"))).alias("tp"),
            F.count_if((F.col(label) != F.col("c")) & (F.col(predicted) == F.col("c"))).alias("fp"),
            F.count_if(F.col(label) == F.col("c")).alias("support"),
        )
        .select(
            *keys,
            F.col("c").cast("string").alias("row"),
            safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
            safe_ratio(F.col("tp"), F.col("support")).alias("recall"),
            safe_ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("support")).alias("f1"),
            "support",
        )
    )
    cols = ("precision", "recall", "f1")
    macro = per_class.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols], F.sum("support").alias("support"))
    weighted = per_class.groupBy(*keys).agg(
        *[safe_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in cols],
        F.sum("support").alias("support"),
    )
    return (
        per_class.unionByName(macro.withColumn("row", F.lit("macro avg")))
        .unionByName(weighted.withColumn("row", F.lit("weighted avg")))
    )


def roc_points(ranked: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """(fpr, tpr) at each distinct score plus the origin; input from ``ranked_scores``."""
    pts = ranked.select(
        *keys,
        F.col(score).alias("threshold"),
        safe_ratio(F.col("cum_neg"), F.col("tot_neg")).alias("fpr"),
        safe_ratio(F.col("cum_pos"), F.col("tot_pos")).alias("tpr"),
    )
    origin = ranked.groupBy(*keys).agg(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return pts.unionByName(origin)


def mean_roc(ranked: DataFrame, keys: Sequence[str], n_grid: int = 100) -> DataFrame:
    """Mean over folds of tpr interpolated on an even fpr grid.

    Every ROC segment [fpr, next fpr] fills the grid points it covers, so the
    interpolation is local to a row: no range join.  ``ranked`` comes from
    ``ranked_scores(..., with_next=True)``.
    """
    last = n_grid - 1
    x0 = safe_ratio(F.col("cum_neg") - F.col("neg"), F.col("tot_neg"))
    y0 = safe_ratio(F.col("cum_pos") - F.col("pos"), F.col("tot_pos"))
    seg = ranked.select(
        *keys,
        x0.alias("x0"),
        safe_ratio(F.col("cum_neg"), F.col("tot_neg")).alias("x1"),
        y0.alias("y0"),
        safe_ratio(F.col("cum_pos"), F.col("tot_pos")).alias("y1"),
    )
    first = F.ceil(F.col("x0") * last - 1e-9)
    final = F.floor(F.col("x1") * last + 1e-9)
    covered = seg.filter(first <= final).select("*", F.explode(F.sequence(first, final)).alias("g"))
    x = F.col("g") / F.lit(float(last))
    width = F.col("x1") - F.col("x0")
    value = F.when(width <= 0, F.col("y1")).otherwise(
        F.col("y0") + (F.col("y1") - F.col("y0")) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col("x0")) / width))
    )
    # At a vertical step the curve takes its highest value there.
    per_fold = covered.groupBy(*keys, "g").agg(F.max(value).alias("tpr"))
    return per_fold.groupBy("g").agg(F.avg("tpr").alias("mean_tpr"), F.count(F.lit(1)).alias("n_folds")).select(
        F.col("g").cast("bigint").alias("g"), (F.col("g") / F.lit(float(last))).alias("fpr"), "mean_tpr", "n_folds"
    )


def trapezoid_area(points: DataFrame, x: str = "fpr", y: str = "mean_tpr") -> DataFrame:
    """Area under a curve given on a bounded grid."""
    from pyspark.sql import Window as W

    w = W.orderBy(x)  # grid points only
    step = points.select(((F.lead(x).over(w) - F.col(x)) * (F.lead(y).over(w) + F.col(y)) / 2).alias("a"))
    return step.agg(F.sum("a").alias("auc"))
