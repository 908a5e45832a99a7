"""Study-level aggregates of per-fold results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

METRICS = ("accuracy", "balanced_accuracy", "precision", "sensitivity", "specificity", "f1", "auroc", "auprc")
# Selected column and the name of its dimension in the report.
DIMENSIONS = (
    ("selected_representation", "representation_candidate"),
    ("selected_family", "classifier_family"),
    ("selected_configuration", "classifier_configuration"),
    ("selected_strategy", "imbalance_strategy"),
    ("selected_candidate_id", "complete_selected_candidate_id"),
)
INNER_NOTE = "inner-validation model-selection evidence; not final outer-test performance"


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns])
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, f"_p.{name}", f"_p.{value}")


def metric_summary(per_fold: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """count, mean, sd (ddof 1), min, max of each metric; nulls are skipped."""
    long = unpivot(per_fold, [], metrics, "metric", "value")
    return long.groupBy("metric").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
    )


def inner_comparison(inner_metrics: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    aggs: list[Column] = [F.count(F.lit(1)).alias("n_evaluations")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"mean_{m}"), F.stddev_samp(m).alias(f"sd_{m}")]
    return inner_metrics.groupBy(*keys).agg(*aggs).withColumn("interpretation", F.lit(INNER_NOTE))


def selection_frequencies(per_fold: DataFrame, dimensions=DIMENSIONS) -> DataFrame:
    long = unpivot(
        per_fold.select(*[F.col(c).cast("string").alias(label) for c, label in dimensions]),
        [],
        [label for _, label in dimensions],
        "dimension",
        "selected",
    )
    counts = long.groupBy("dimension", "selected").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("dimension").agg(F.sum("count").alias("_all"))
    return counts.join(totals, "dimension").select(
        "dimension", "selected", "count", (100.0 * F.col("count") / F.col("_all")).alias("percentage")
    )


def pooled_confusion(per_fold: DataFrame) -> DataFrame:
    return per_fold.agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])


def prediction_coverage(predictions: DataFrame, cohort: DataFrame, n_repeats: int) -> DataFrame:
    """Samples by whether each repeat predicted them exactly once."""
    per = predictions.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("repeat_id").alias("r")
    )
    joined = cohort.select("sample_id").join(per, "sample_id", "full_outer")
    full = (F.coalesce("n", F.lit(0)) == n_repeats) & (F.coalesce("r", F.lit(0)) == n_repeats)
    return joined.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(full).alias("n_complete"),
        F.count_if(~full).alias("n_incomplete"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_predictions"),
    )


def reliability_totals(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    low, ood = F.col("low_margin"), F.col("latent_ood")
    return rows.groupBy(*keys).agg(
        F.count_if(F.col("status") == "supported_with_caution").alias("n_supported"),
        F.count_if(F.col("status") == "inconclusive").alias("n_inconclusive"),
        F.count_if(low).alias("n_low_margin"),
        F.count_if(ood).alias("n_latent_ood"),
        F.count_if(low & ood).alias("n_both"),
    )


def progress(plan: DataFrame, scored: DataFrame, evaluated: DataFrame) -> DataFrame:
    """State of every planned coordinate from the published ones."""
    keys = ["repeat_id", "fold_id"]
    s = scored.select(*keys).distinct().withColumn("_s", F.lit(True))
    e = evaluated.select(*keys).distinct().withColumn("_e", F.lit(True))
    state = (
        F.when(F.col("_e") & F.col("_s").isNull(), F.raise_error(F.lit("evaluation without scoring")).cast("string"))
        .when(F.col("_e"), "EVALUATION_PUBLISHED")
        .when(F.col("_s"), "SCORING_PUBLISHED")
        .otherwise("PENDING")
    )
    return plan.join(s, keys, "left").join(e, keys, "left").select(*keys, state.alias("state"))


RESUME = {
    "PENDING": "FULL_COORDINATE_RECOMPUTE",
    "SCORING_PUBLISHED": "EVALUATION_ONLY_RESUME",
    "EVALUATION_PUBLISHED": "COMPLETE",
}


def progress_totals(states: DataFrame) -> DataFrame:
    """Coordinates per state and what a resumed run does with them."""
    resume = F.coalesce(*[F.when(F.col("state") == s, F.lit(a)) for s, a in RESUME.items()])
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("n")).withColumn("on_resume", resume)


def failure_rows(failed: DataFrame, stage: str, message: Column, error_class: Column) -> DataFrame:
    """Rows for the append-only failure log; messages are cut to 500 characters."""
    return failed.select(
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at_utc"),
        F.lit(stage).alias("stage"),
        "repeat_id",
        "fold_id",
        error_class.alias("error_class"),
        F.substring(message, 1, 500).alias("message"),
    )


def evaluation_record(per_fold: DataFrame, nested: Sequence[str]) -> DataFrame:
    """One JSON record per coordinate: identity fields and a nested metrics object."""
    plain = sorted(c for c in per_fold.columns if c not in nested)
    body = F.struct(*plain, F.struct(*sorted(nested)).alias("metrics"))
    return per_fold.select("repeat_id", "fold_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("record"))
