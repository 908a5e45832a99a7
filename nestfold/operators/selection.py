"""Candidate grids, summaries over inner folds, and winners with tie-breaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# Fixed values of the protocol.
RATIOS = (0.25, 0.50, 0.75)
LOGISTIC_CS = (0.1, 1.0, 10.0)
FAMILIES = ("logistic_linear", "rbf_svc_decision", "random_forest_bagged", "hist_gradient_boosting")
CONFIGURATIONS = {
    "logistic_linear": ("logistic_c_0_1", "logistic_c_1_baseline", "logistic_c_10"),
    "rbf_svc_decision": ("svc_c_0_25", "svc_c_1_baseline", "svc_c_4"),
    "random_forest_bagged": ("rf_leaf_1", "rf_leaf_2_baseline", "rf_leaf_4"),
    "hist_gradient_boosting": ("hgb_l2_0_1", "hgb_l2_1_baseline", "hgb_l2_10"),
}
STRATEGIES = ("real_only", "balanced_class_weight", "smote_latent", "minority_only_ctgan", "conditional_ctgan")
WEIGHTED_STRATEGY = "balanced_class_weight"


def candidate_id(ratio: float, c: float) -> str:
    return f"ratio={ratio}|C={c}"


def latent_width(n_features: int, ratio: float) -> int:
    """ceil(d * ratio), at least 2 and below d."""
    k = -(-int(round(n_features * ratio * 1_000_000)) // 1_000_000)
    if not 2 <= k < n_features:
        raise ValueError(f"ratio {ratio} gives width {k} for {n_features} features")
    return k


def width_table(feature_counts: DataFrame, ratios: Sequence[float] = RATIOS) -> DataFrame:
    """``(modality, n_features, ratio, width, valid)`` for every ratio."""
    k = F.ceil(F.col("n_features") * F.col("ratio")).cast("int")
    return (
        feature_counts.withColumn("ratio", F.explode(F.array(*[F.lit(r) for r in ratios])))
        .withColumn("width", k)
        .withColumn("valid", (F.col("width") >= 2) & (F.col("width") < F.col("n_features")))
    )


def candidate_grid(feature_counts: DataFrame, ratios=RATIOS, cs=LOGISTIC_CS) -> DataFrame:
    """Ratio x C with the fused latent width; ratios that are invalid anywhere are dropped."""
    widths = width_table(feature_counts, ratios).groupBy("ratio").agg(
        F.sum("width").cast("int").alias("fused_width"), F.min("valid").alias("_ok")
    )
    grid = widths.filter("_ok").drop("_ok").withColumn("c", F.explode(F.array(*[F.lit(c) for c in cs])))
    return grid.withColumn("candidate_id", F.concat(F.lit("ratio="), F.col("ratio").cast("string"), F.lit("|C="), F.col("c").cast("string")))


def oof_violations(oof: DataFrame, keys: Sequence[str], train: DataFrame, train_keys: Sequence[str]) -> DataFrame:
    """Per candidate: repeated samples, samples outside the train set, expected rows."""
    twice = oof.groupBy(*keys, "sample_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = train.groupBy(*train_keys).agg(F.count(F.lit(1)).alias("n_expected"))
    known = train.select(*train_keys, "sample_id").withColumn("_known", F.lit(1))
    checked = twice.join(known, [*train_keys, "sample_id"], "left")
    per = checked.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        F.count_if(F.col("n") > 1).alias("n_repeated"),
        F.count_if(F.col("_known").isNull()).alias("n_unknown"),
    )
    return per.join(sizes, list(train_keys)).withColumn(
        "complete", (F.col("n_rows") == F.col("n_expected")) & (F.col("n_repeated") == 0) & (F.col("n_unknown") == 0)
    )


def candidate_summary(fold_metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean AUPRC/AUROC and population sd of AUPRC over inner folds."""
    return fold_metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg("auprc").alias("mean_auprc"),
        F.avg("auroc").alias("mean_auroc"),
        F.stddev_pop("auprc").alias("sd_auprc"),
    )


def select_winner(summary: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], digits: int = 12) -> DataFrame:
    """Best row per key; ``order`` lists (column, descending).  A combinable min, no window."""
    ranks = []
    for i, (name, descending) in enumerate(order):
        kind = dict(summary.dtypes)[name]
        value = F.round(F.col(name), digits) if kind == "double" else F.col(name)
        ranks.append((-value if descending else value).alias(f"_o{i}"))
    rest = [c for c in summary.columns if c not in keys]
    best = F.min(F.struct(*ranks, F.struct(*rest).alias("_row")))
    return summary.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b._row.*")


PRIMARY_ORDER = (
    ("mean_auprc", True),
    ("mean_auroc", True),
    ("sd_auprc", False),
    ("fused_width", False),
    ("c", False),
    ("candidate_id", False),
)
STAGE_A_ORDER = (
    ("mean_auprc", True),
    ("mean_balanced_accuracy", True),
    ("mean_sensitivity", True),
    ("sd_auprc", False),
    ("fused_width", False),
    ("candidate_id", False),
)
STAGE_B_ORDER = (
    ("mean_auprc", True),
    ("mean_balanced_accuracy", True),
    ("mean_sensitivity", True),
    ("sd_auprc", False),
    ("configuration_id", False),
    ("strategy", False),
)


def stage_summary(fold_metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    return fold_metrics.groupBy(*keys).agg(
        F.avg("auprc").alias("mean_auprc"),
        F.avg("balanced_accuracy").alias("mean_balanced_accuracy"),
        F.avg("sensitivity").alias("mean_sensitivity"),
        F.stddev_pop("auprc").alias("sd_auprc"),
    )


def search_space(weighted_families: Sequence[str] = FAMILIES) -> list[tuple[str, str, str]]:
    """(family, configuration, strategy) without class weights where they are unsupported."""
    return [
        (f, c, s)
        for f in FAMILIES
        for c in CONFIGURATIONS[f]
        for s in STRATEGIES
        if s != WEIGHTED_STRATEGY or f in weighted_families
    ]
