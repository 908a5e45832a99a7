"""Preprocessing (PRE) and the flagship slice over all 25 folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import array_sum, attach_row
from ..operators import folds as D, metrics as M, preprocess as P
from ..sources.cohorts import MODALITIES, ORDERS_FEATURES, modality_cells, orders_cohort
from ..session import cut_lineage
from .fold_queries import orders_labels
from .registry import CELLS_SQL, COHORT_SQL, FIT_SQL, MEMBERS_SQL, folds_sql, query

BASE_SQL = f"WITH {COHORT_SQL}, {CELLS_SQL}, {folds_sql()}, {MEMBERS_SQL}, {FIT_SQL}"

Z_SQL = """
z AS (
  SELECT m.repeat_id, m.fold_id, m.sample_id, m.y, c.modality, c.pos,
         ((coalesce(c.x, s.median) - s.mean) / CASE WHEN s.variance < 1e-20 THEN 1 ELSE sqrt(s.variance) END)::FLOAT AS z
  FROM members m JOIN cells c ON m.sample_id = c.sample_id
  JOIN fitted s ON s.repeat_id = m.repeat_id AND s.fold_id = m.fold_id AND s.modality = c.modality AND s.pos = c.pos
  WHERE m.role = 'test')"""


def orders_with_folds(spark, sf_dir):
    cohort = orders_cohort(spark, sf_dir)
    # Fit reads the cohort twice and transform once more: build it once.  The folds need the
    # orders' labels alone, not the line items and customers joined to them.
    return cut_lineage(P.attach_folds(cohort, D.fold_arrays(D.repeated_kfold(orders_labels(spark, sf_dir)))))


def held_out(spark, sf_dir):
    cohort = orders_with_folds(spark, sf_dir)
    return P.transform_held_out(cohort, P.stats_arrays(P.fit(cohort)))


@query(
    "pre1_median_imputer_fit",
    f"{BASE_SQL} SELECT repeat_id, fold_id, modality, pos::INT AS pos, n_present, round(median, 6) AS median FROM medians",
)
def pre1(spark, sf_dir):
    return P.train_medians(orders_with_folds(spark, sf_dir)).withColumn("median", F.round("median", 6))


@query(
    "pre2_standard_scaler_fit",
    f"""{BASE_SQL} SELECT repeat_id, fold_id, modality, pos::INT AS pos, n_train, n_missing, mean::FLOAT::DOUBLE AS mean, variance::FLOAT::DOUBLE AS variance,
 (CASE WHEN variance < 1e-20 THEN 1 ELSE sqrt(variance) END)::FLOAT::DOUBLE AS scale FROM fitted""",
)
def pre2(spark, sf_dir):
    state = P.fit(orders_with_folds(spark, sf_dir))
    return state.select(
        "repeat_id",
        "fold_id",
        "modality",
        "pos",
        "n_train",
        "n_missing",
        *[F.col(c).cast("float").cast("double").alias(c) for c in ("mean", "variance", "scale")],
    )


@query(
    "pre3_transform_held_out",
    f"""{BASE_SQL}, {Z_SQL}
SELECT repeat_id, fold_id, modality, pos::INT AS pos, count(z) AS n, round(avg(z::DOUBLE), 5) AS mean_z, round(min(z)::DOUBLE, 4) AS min_z, round(max(z)::DOUBLE, 4) AS max_z
FROM z GROUP BY ALL""",
)
def pre3(spark, sf_dir):
    cells = modality_cells(held_out(spark, sf_dir), "repeat_id", "fold_id")
    x = F.col("x").cast("double")
    return cells.groupBy("repeat_id", "fold_id", "modality", "pos").agg(
        F.count("x").alias("n"),
        F.round(F.avg(x), 5).alias("mean_z"),
        F.round(F.min(x), 4).alias("min_z"),
        F.round(F.max(x), 4).alias("max_z"),
    )


@query(
    "pre4_entirely_missing_features",
    f"""WITH {COHORT_SQL}, {CELLS_SQL}, {folds_sql()}, {MEMBERS_SQL}
SELECT m.repeat_id, m.fold_id, c.modality, c.pos::INT AS pos, count(c.x) AS n_present, count(c.x) = 0 AS entirely_missing
FROM members m JOIN cells c ON m.sample_id = c.sample_id WHERE m.role = 'train' GROUP BY ALL""",
)
def pre4(spark, sf_dir):
    """Present train values per feature from the test-fold counts alone: total minus test."""
    cohort = orders_with_folds(spark, sf_dir)
    own = modality_cells(cohort, "fold_of").select(F.posexplode("fold_of").alias("repeat_id", "_own"), "modality", "pos", "x")
    cell = own.groupBy("repeat_id", "modality", "pos", "_own").agg(F.count("x").alias("m"))
    fold = F.explode(F.sequence(F.lit(0), F.lit(D.OUTER_SPLITS - 1))).alias("fold_id")
    train = cell.select("*", fold).filter("fold_id <> _own")
    return train.groupBy("repeat_id", "fold_id", "modality", "pos").agg(F.sum("m").alias("n_present")).withColumn(
        "entirely_missing", F.col("n_present") == 0
    )


@query(
    "pre5_zero_variance_report",
    f"""{BASE_SQL},
exact AS (SELECT m.repeat_id, m.fold_id, c.modality, c.pos, count(c.x) AS n_present, sum(c.x::DECIMAL(18,9))::VARCHAR AS total,
  sum(c.x::DECIMAL(18,9) * c.x::DECIMAL(18,9))::VARCHAR AS total_of_squares
  FROM members m JOIN cells c ON m.sample_id = c.sample_id WHERE m.role = 'train' GROUP BY ALL)
SELECT repeat_id, fold_id, modality, pos::INT AS pos, n_present, n_missing, total, total_of_squares, variance < 1e-8 AS zero_variance
FROM fitted JOIN exact USING (repeat_id, fold_id, modality, pos)""",
)
def pre5(spark, sf_dir):
    """Zero-variance flags beside the exact sums they rest on (a rounded variance can sit on an edge)."""
    cohort = orders_with_folds(spark, sf_dir)
    x = F.col("x").cast("decimal(18,9)")
    own = modality_cells(cohort, "fold_of").select(F.posexplode("fold_of").alias("repeat_id", "_own"), "modality", "pos", x.alias("x"))
    cell = own.groupBy("repeat_id", "modality", "pos", "_own").agg(
        F.count("x").alias("n_present"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).cast("decimal(38,18)").alias("squares")
    )
    fold = F.explode(F.sequence(F.lit(0), F.lit(D.OUTER_SPLITS - 1))).alias("fold_id")
    keys = ["repeat_id", "fold_id", "modality", "pos"]
    exact = cell.select("*", fold).filter("fold_id <> _own").groupBy(*keys).agg(
        F.sum("n_present").alias("n_present"),
        F.sum("total").cast("decimal(38,9)").cast("string").alias("total"),
        F.sum("squares").cast("decimal(38,18)").cast("string").alias("total_of_squares"),
    )
    state = P.fit(cohort).select(*keys, "n_missing", (F.col("variance") < P.ZERO_VARIANCE).alias("zero_variance"))
    return exact.join(state, keys).select(*keys, "n_present", "n_missing", "total", "total_of_squares", "zero_variance")


@query(
    "pre6_preprocessing_audit",
    f"""{BASE_SQL}, {Z_SQL}, a AS (SELECT repeat_id, fold_id, modality, count(*) AS n_features, max(n_train) AS n_train, sum(n_missing)::BIGINT AS n_missing_train, round(avg(median), 5) AS mean_median FROM fitted GROUP BY ALL),
p AS (SELECT repeat_id, fold_id, modality, pos, avg(z::DOUBLE) AS mz, stddev_pop(z::DOUBLE) AS sz, count(*) AS n, count(*) FILTER (WHERE isfinite(z)) AS nf FROM z GROUP BY ALL),
b AS (SELECT repeat_id, fold_id, modality, max(n) AS n_test, min(n = nf) AS all_finite, round(min(mz), 4) AS min_mean, round(max(mz), 4) AS max_mean, round(min(sz), 4) AS min_std, round(max(sz), 4) AS max_std FROM p GROUP BY ALL)
SELECT * FROM a JOIN b USING (repeat_id, fold_id, modality)""",
)
def pre6(spark, sf_dir):
    cohort = orders_with_folds(spark, sf_dir)
    state = P.fit(cohort)
    keys = ["repeat_id", "fold_id", "modality"]
    fitted = state.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_features"),
        F.max("n_train").alias("n_train"),
        F.sum("n_missing").alias("n_missing_train"),
        F.round(F.avg("median"), 5).alias("mean_median"),
    )
    cells = modality_cells(P.transform_held_out(cohort, P.stats_arrays(state)), "repeat_id", "fold_id")
    x = F.col("x").cast("double")
    per = cells.groupBy(*keys, "pos").agg(
        F.avg(x).alias("mz"),
        F.stddev_pop(x).alias("sz"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.isnan(x) & (F.abs(x) < float("inf"))).alias("nf"),
    )
    out = per.groupBy(*keys).agg(
        F.max("n").alias("n_test"),
        F.min(F.col("n") == F.col("nf")).alias("all_finite"),
        F.round(F.min("mz"), 4).alias("min_mean"),
        F.round(F.max("mz"), 4).alias("max_mean"),
        F.round(F.min("sz"), 4).alias("min_std"),
        F.round(F.max("sz"), 4).alias("max_std"),
    )
    return fitted.join(out, keys)


_STACK_NAMES = [f"{label}::{n}" for m, label in (("mge", "mGE"), ("mdm", "mDM"), ("mcna", "CNA")) for n in ORDERS_FEATURES[m]]


@query(
    "pre7_modality_stacking",
    f"""WITH {COHORT_SQL}, s AS (SELECT list_concat(list_concat(mge, mdm), mcna) AS v FROM cohort),
l AS (SELECT generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS x FROM s)
SELECT pos::INT AS pos, ({_STACK_NAMES!r})[pos + 1] AS feature, count(x) AS n_present, round(avg(x), 5) AS mean FROM l GROUP BY pos""",
)
def pre7(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in _STACK_NAMES])
    cells = orders_cohort(spark, sf_dir).select(F.posexplode(P.fused()).alias("pos", "x"))
    return cells.groupBy("pos").agg(F.count("x").alias("n_present"), F.round(F.avg("x"), 5).alias("mean")).withColumn(
        "feature", F.element_at(names, F.col("pos") + 1)
    )


@query(
    "pre8_post_fusion_scaler",
    """WITH l AS (SELECT vec_id::VARCHAR AS sample_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS sd FROM l GROUP BY pos)
SELECT sample_id, round(sum((x - m) / sd), 4) AS total, round(max((x - m) / sd), 4) AS peak FROM l JOIN s USING (pos) GROUP BY sample_id""",
)
def pre8(spark, sf_dir):
    from ..sources.cohorts import embedding_latents

    rows = embedding_latents(spark, sf_dir).withColumn("_k", F.lit(1))
    scaler = P.fit_dense(rows, ["_k"])
    z = P.standardise(F.col("z"), F.col("mean"), F.col("scale"))
    return attach_row(rows, scaler.drop("_k")).select(
        "sample_id", F.round(array_sum(z), 4).alias("total"), F.round(F.array_max(z), 4).alias("peak")
    )


@query(
    "entry_linear_score_by_fold",
    f"""{BASE_SQL}, {Z_SQL},
s AS (SELECT repeat_id, fold_id, sample_id, any_value(y) AS y, round(sum(z::DOUBLE), 5) AS score FROM z GROUP BY repeat_id, fold_id, sample_id),
d AS (SELECT repeat_id, fold_id, score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM s GROUP BY ALL),
w AS (SELECT *, sum(pos) OVER k AS tp, sum(neg) OVER k AS fp, sum(pos) OVER (PARTITION BY repeat_id, fold_id) AS np, sum(neg) OVER (PARTITION BY repeat_id, fold_id) AS nn
  FROM d WINDOW k AS (PARTITION BY repeat_id, fold_id ORDER BY score DESC))
SELECT repeat_id, fold_id, max(np)::BIGINT AS n_pos, max(nn)::BIGINT AS n_neg, round(sum(pos * tp / (tp + fp)) / max(np), 6) AS auprc,
 round(sum(neg * (tp - pos / 2.0)) / (max(np)::DOUBLE * max(nn)), 6) AS auroc FROM w GROUP BY repeat_id, fold_id""",
)
def entry_linear_score_by_fold(spark, sf_dir):
    rows = held_out(spark, sf_dir)
    scored = rows.select("repeat_id", "fold_id", "y", F.round(array_sum(P.fused()), 5).alias("score"))
    out = M.ranking_metrics(scored, ["repeat_id", "fold_id"])
    return out.withColumn("auprc", F.round("auprc", 6)).withColumn("auroc", F.round("auroc", 6))
