"""Metrics, thresholds, selection and reports on scored orders (MET, THR, SEL, EVA, RPT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import attach_row, sigmoid
from ..operators import align as A, folds as D, metrics as M, report as R, selection as S, threshold as T
from ..operators.ranking import exact_quantiles
from ..session import cut_lineage
from ..sources.cohorts import ORDERS_FEATURES, document_cohort, orders_cohort, table
from .fold_queries import LABEL_SQL, orders_folds, orders_labels
from .registry import COHORT_SQL, folds_sql, query

KEYS = ["repeat_id", "fold_id"]

BASE_SCORE = "round((o_totalprice - 250000) / 100000 + 0.2 * substr(o_orderpriority, 1, 1)::DOUBLE, 3)"
SCORED_SQL = f"""{LABEL_SQL}, {folds_sql()},
raw AS (SELECT o_orderkey::VARCHAR AS sample_id, {BASE_SCORE} AS score FROM orders),
scored AS (SELECT f.repeat_id, f.fold_id, f.sample_id, f.y, r.score, round(1 / (1 + exp(-r.score)), 6) AS prob FROM folds f JOIN raw r USING (sample_id))"""


def ranked_sql(source: str, keys: str, score: str = "score", name: str = "ranked") -> str:
    return f"""
d_{name} AS (SELECT {keys}, {score}, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM {source} GROUP BY {keys}, {score}),
{name} AS (SELECT *, sum(pos) OVER k AS tp, sum(neg) OVER k AS fp, sum(pos) OVER (PARTITION BY {keys}) AS np, sum(neg) OVER (PARTITION BY {keys}) AS nn
  FROM d_{name} WINDOW k AS (PARTITION BY {keys} ORDER BY {score} DESC))"""


def ranking_sql(keys: str, ranked: str = "ranked", name: str = "ranking") -> str:
    return f"""
{name} AS (SELECT {keys}, max(np)::BIGINT AS n_pos, max(nn)::BIGINT AS n_neg,
  CASE WHEN max(np) > 0 AND max(nn) > 0 THEN sum(pos * tp / (tp + fp)) / max(np) END AS auprc,
  CASE WHEN max(np) > 0 AND max(nn) > 0 THEN sum(neg * (tp - pos / 2.0)) / (max(np)::DOUBLE * max(nn)) END AS auroc FROM {ranked} GROUP BY {keys})"""


def confusion_sql(source: str, keys: str, predicted: str, name: str = "conf") -> str:
    return f"""
{name} AS (SELECT {keys}, count(*) FILTER (WHERE y = 0 AND NOT ({predicted})) AS tn, count(*) FILTER (WHERE y = 0 AND ({predicted})) AS fp,
  count(*) FILTER (WHERE y = 1 AND NOT ({predicted})) AS fn, count(*) FILTER (WHERE y = 1 AND ({predicted})) AS tp FROM {source} GROUP BY {keys})"""


THRESHOLD_METRICS_SQL = """round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy,
 round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS sensitivity, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity,
 round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
 round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
 round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc"""


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def order_scores(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("sample_id"),
        F.round((F.col("o_totalprice") - 250000) / 100000 + 0.2 * F.substring("o_orderpriority", 1, 1).cast("double"), 3).alias("score"),
    )


def scored_orders(spark, sf_dir):
    rows = orders_folds(spark, sf_dir).join(order_scores(spark, sf_dir), "sample_id")
    return rows.select(*KEYS, "sample_id", "y", "score", F.round(sigmoid(F.col("score")), 6).alias("prob"))


RANKED = ranked_sql("scored", "repeat_id, fold_id")


@query(
    "met1_average_precision",
    f"WITH {SCORED_SQL}, {RANKED}, {ranking_sql('repeat_id, fold_id')} SELECT repeat_id, fold_id, n_pos, round(auprc, 6) AS auprc FROM ranking",
)
def met1(spark, sf_dir):
    return rounded(M.ranking_metrics(scored_orders(spark, sf_dir), KEYS)).select(*KEYS, "n_pos", "auprc")


@query(
    "met2_auroc",
    f"""WITH {SCORED_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY repeat_id, fold_id ORDER BY score) + (count(*) OVER (PARTITION BY repeat_id, fold_id, score) - 1) / 2.0 AS rk FROM scored),
a AS (SELECT repeat_id, fold_id, sum(rk) FILTER (WHERE y = 1) AS rs, (count(*) FILTER (WHERE y = 1))::DOUBLE AS p, (count(*) FILTER (WHERE y = 0))::DOUBLE AS n FROM r GROUP BY ALL)
SELECT repeat_id, fold_id, round((rs - p * (p + 1) / 2) / (p * n), 6) AS auroc FROM a""",
)
def met2(spark, sf_dir):
    return rounded(M.ranking_metrics(scored_orders(spark, sf_dir), KEYS)).select(*KEYS, "auroc")


@query(
    "met3_confusion_counts",
    f"WITH {SCORED_SQL}, {confusion_sql('scored', 'repeat_id, fold_id', 'score >= 0')} SELECT * FROM conf",
)
def met3(spark, sf_dir):
    return M.confusion(scored_orders(spark, sf_dir), KEYS, F.col("score") >= 0)


@query(
    "met4_threshold_metrics",
    f"WITH {SCORED_SQL}, {confusion_sql('scored', 'repeat_id, fold_id', 'prob >= 0.5')} SELECT *, {THRESHOLD_METRICS_SQL} FROM conf",
)
def met4(spark, sf_dir):
    return rounded(M.threshold_metrics(scored_orders(spark, sf_dir), KEYS, F.col("prob") >= 0.5))


@query("met5_brier_score", f"WITH {SCORED_SQL} SELECT repeat_id, fold_id, round(avg((prob - y) * (prob - y)), 8) AS brier FROM scored GROUP BY ALL")
def met5(spark, sf_dir):
    return rounded(M.probability_losses(scored_orders(spark, sf_dir), KEYS).drop("log_loss"), 8)


_CLIP = "greatest(least(prob, 1 - 2.220446049250313e-16), 2.220446049250313e-16)"


@query(
    "met6_log_loss",
    f"WITH {SCORED_SQL} SELECT repeat_id, fold_id, round(-avg(CASE WHEN y = 1 THEN ln({_CLIP}) ELSE ln(1 - {_CLIP}) END), 8) AS log_loss FROM scored GROUP BY ALL",
)
def met6(spark, sf_dir):
    return rounded(M.probability_losses(scored_orders(spark, sf_dir), KEYS).drop("brier"), 8)


DOCS_SQL = """docs AS (SELECT d.lang, d.source, (1 - l.quality) AS y, l.toxic, length(d.text) AS n,
  length(regexp_replace(d.text, '[^a-z]', '', 'g')) AS letters FROM documents d JOIN labels l USING (doc_id)),
ds AS (SELECT source, y, round(letters / n, 6) AS score FROM docs)"""


def scored_documents(spark, sf_dir):
    rows = document_cohort(spark, sf_dir)
    return rows.select("sample_id", "source", "lang", "y", "toxic", F.round(F.col("mge")[1] / F.col("mge")[0], 6).alias("score"))


@query(
    "met7_null_aware_metrics",
    f"""WITH {DOCS_SQL}, {ranked_sql('ds', 'source')}, {ranking_sql('source')}, {confusion_sql('ds', 'source', 'score >= 0.7')}
SELECT source, tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
 CASE WHEN n_pos > 0 AND n_neg > 0 THEN round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) END AS balanced_accuracy,
 round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, CASE WHEN n_pos > 0 THEN round(tp / (tp + fn), 6) END AS sensitivity,
 CASE WHEN n_neg > 0 THEN round(tn / (tn + fp), 6) END AS specificity, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
 round(auroc, 6) AS auroc, round(auprc, 6) AS auprc,
 array_to_string(list_filter([CASE WHEN n_pos = 0 THEN 'sensitivity_undefined' END, CASE WHEN n_neg = 0 THEN 'specificity_undefined' END,
  CASE WHEN n_pos = 0 OR n_neg = 0 THEN 'ranking_undefined' END, CASE WHEN tp + fp = 0 THEN 'precision_zero_division' END], lambda w: w IS NOT NULL), ',') AS warnings
FROM conf JOIN ranking USING (source)""",
)
def met7(spark, sf_dir):
    return rounded(M.null_aware_metrics(scored_documents(spark, sf_dir), ["source"], F.col("score") >= 0.7))


@query(
    "met8_input_validation",
    f"""WITH {DOCS_SQL} SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE score IS NULL OR isnan(score) OR isinf(score)) AS bad_score,
 count(*) FILTER (WHERE y IS NULL OR y NOT IN (0, 1)) AS bad_label, count(DISTINCT y) AS n_classes FROM ds GROUP BY source""",
)
def met8(spark, sf_dir):
    return M.input_violations(scored_documents(spark, sf_dir), ["source"])


@query(
    "met9_classification_report",
    f"""WITH {SCORED_SQL}, p AS (SELECT repeat_id, fold_id, y, (prob >= 0.5)::INT AS predicted FROM scored),
c AS (SELECT repeat_id, fold_id, c, count(*) FILTER (WHERE y = c AND predicted = c) AS tp, count(*) FILTER (WHERE y <> c AND predicted = c) AS fp, count(*) FILTER (WHERE y = c) AS support FROM p, (VALUES (0), (1)) k(c) GROUP BY ALL),
r AS (SELECT repeat_id, fold_id, c::VARCHAR AS row, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2.0 * tp / nullif(tp + fp + support, 0), 0) AS f1, support FROM c),
a AS (SELECT * FROM r UNION ALL SELECT repeat_id, fold_id, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r GROUP BY ALL
 UNION ALL SELECT repeat_id, fold_id, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM r GROUP BY ALL)
SELECT repeat_id, fold_id, row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM a""",
)
def met9(spark, sf_dir):
    rows = scored_orders(spark, sf_dir).withColumn("predicted", (F.col("prob") >= 0.5).cast("int"))
    return rounded(M.classification_report(rows, KEYS))


@query(
    "met10_roc_points",
    f"""WITH {SCORED_SQL}, {RANKED}
SELECT repeat_id, fold_id, score AS threshold, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr FROM ranked
UNION ALL SELECT DISTINCT repeat_id, fold_id, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM scored""",
)
def met10(spark, sf_dir):
    return rounded(M.roc_points(M.ranked_scores(scored_orders(spark, sf_dir), KEYS), KEYS))


MEAN_ROC_SQL = f"""WITH {SCORED_SQL}, {RANKED},
seg AS (SELECT repeat_id, fold_id, (fp - neg) / nn AS x0, fp / nn AS x1, (tp - pos) / np AS y0, tp / np AS y1 FROM ranked),
hit AS (SELECT s.repeat_id, s.fold_id, g.g, max(CASE WHEN x1 <= x0 THEN y1 ELSE y0 + (y1 - y0) * greatest(0, least(1, (g.g / 99.0 - x0) / (x1 - x0))) END) AS tpr
 FROM seg s JOIN range(100) g(g) ON g.g / 99.0 BETWEEN s.x0 - 1e-11 AND s.x1 + 1e-11 GROUP BY ALL),
m AS (SELECT g, avg(tpr) AS mean_tpr, count(*) AS n_folds FROM hit GROUP BY g)"""


@query("met11_mean_roc", f"{MEAN_ROC_SQL} SELECT g, round(g / 99.0, 6) AS fpr, round(mean_tpr, 6) AS mean_tpr, n_folds FROM m")
def met11(spark, sf_dir):
    return rounded(M.mean_roc(M.ranked_scores(scored_orders(spark, sf_dir), KEYS), KEYS))


@query(
    "met11_mean_roc_area",
    f"{MEAN_ROC_SQL}, l AS (SELECT *, lead(g) OVER (ORDER BY g) AS g2, lead(mean_tpr) OVER (ORDER BY g) AS t2 FROM m) SELECT round(sum((g2 - g) / 99.0 * (mean_tpr + t2) / 2), 6) AS auc FROM l",
)
def met11_area(spark, sf_dir):
    curve = M.mean_roc(M.ranked_scores(scored_orders(spark, sf_dir), KEYS), KEYS)
    return rounded(M.trapezoid_area(curve))


@query(
    "met12_cross_validation_averages",
    f"""WITH {SCORED_SQL}, {RANKED}, {ranking_sql('repeat_id, fold_id')},
f AS (SELECT repeat_id, fold_id, avg((prob >= 0.5) = (y = 1)) AS accuracy, -avg(CASE WHEN y = 1 THEN ln(prob) ELSE ln(1 - prob) END) AS loss FROM (SELECT *, 1 FROM scored) GROUP BY ALL),
j AS (SELECT * FROM f JOIN ranking USING (repeat_id, fold_id))
SELECT repeat_id, round(avg(loss), 6) AS mean_loss, round(min(loss), 6) AS min_loss, round(avg(accuracy), 6) AS mean_accuracy, round(max(accuracy), 6) AS max_accuracy, round(avg(auroc), 6) AS mean_auroc FROM j GROUP BY repeat_id""".replace(
        "avg((prob >= 0.5) = (y = 1))", "avg(((prob >= 0.5) = (y = 1))::INT)"
    ),
)
def met12(spark, sf_dir):
    rows = scored_orders(spark, sf_dir)
    hit = (F.col("prob") >= 0.5) == (F.col("y") == 1)
    per_fold = rows.groupBy(*KEYS).agg(
        F.avg(hit.cast("int")).alias("accuracy"), M.log_loss(F.col("prob"), F.col("y")).alias("loss")
    ).join(M.ranking_metrics(rows, KEYS), KEYS)
    return rounded(
        per_fold.groupBy("repeat_id").agg(
            F.avg("loss").alias("mean_loss"),
            F.min("loss").alias("min_loss"),
            F.avg("accuracy").alias("mean_accuracy"),
            F.max("accuracy").alias("max_accuracy"),
            F.avg("auroc").alias("mean_auroc"),
        )
    )


# --- embedding variants: (family, strategy, representation) score tables -----

VARIANT_SQL = f"""emb AS (SELECT vec_id::VARCHAR AS sample_id, (label >= 7)::INT AS y, embedding AS e FROM embeddings),
{folds_sql(source="emb")}"""

FAMILY_LIST = list(S.FAMILIES)
STRATEGY_LIST = list(S.STRATEGIES)


def embedding_variants(spark, sf_dir, variants, columns):
    """Scores of each variant on every fold: a listed combination of vector cells."""
    from ..sources.cohorts import embedding_latents

    rows = embedding_latents(spark, sf_dir)
    folds = D.repeated_kfold(rows)
    listed = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip([*columns, "i", "j"], t)]) for t in variants])
    scored = folds.join(rows.select("sample_id", "z"), "sample_id").withColumn("v", F.explode(listed))
    score = F.round(
        F.element_at("z", F.col("v.i")).cast("double") + F.element_at("z", F.col("v.j")).cast("double") * 0.5, 4
    )
    return scored.select(*KEYS, "sample_id", "y", *[F.col(f"v.{c}").alias(c) for c in columns], score.alias("score"))


def variants_sql(variants, columns, name="scored"):
    rows = ", ".join("(" + ", ".join(repr(v) for v in t) + ")" for t in variants)
    return f"""{name} AS (SELECT f.repeat_id, f.fold_id, f.sample_id, f.y, {", ".join("v." + c for c in columns)}, round(e.e[v.i]::DOUBLE + e.e[v.j]::DOUBLE * 0.5, 4) AS score
FROM folds f JOIN emb e USING (sample_id), (VALUES {rows}) v({", ".join(columns)}, i, j))"""


FAMILY_STRATEGY = [(f, s, 1 + 5 * i + j, 64 - 3 * i - j) for i, f in enumerate(FAMILY_LIST) for j, s in enumerate(STRATEGY_LIST)]
FS = "family, strategy"


@query(
    "met13_variant_evaluation",
    f"""WITH {VARIANT_SQL}, {variants_sql(FAMILY_STRATEGY, ["family", "strategy"])}, {ranked_sql("scored", "repeat_id, fold_id, family, strategy")},
{ranking_sql("repeat_id, fold_id, family, strategy")}, {confusion_sql("scored", "repeat_id, fold_id, family, strategy", "score >= 0")}
SELECT repeat_id, fold_id, family, strategy, tn, fp, fn, tp, {THRESHOLD_METRICS_SQL}, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM conf JOIN ranking USING (repeat_id, fold_id, family, strategy)""",
)
def met13(spark, sf_dir):
    keys = [*KEYS, "family", "strategy"]
    rows = embedding_variants(spark, sf_dir, FAMILY_STRATEGY, ["family", "strategy"])
    ranking = M.ranking_metrics(rows, keys).select(*keys, "auroc", "auprc")
    return rounded(M.threshold_metrics(rows, keys, F.col("score") >= 0).join(ranking, keys))


# --- thresholds ---------------------------------------------------------------


@query(
    "thr1_threshold_candidates",
    f"WITH {SCORED_SQL} SELECT DISTINCT repeat_id, fold_id, prob AS threshold FROM scored UNION SELECT DISTINCT repeat_id, fold_id, 0.0::DOUBLE FROM scored",
)
def thr1(spark, sf_dir):
    return T.threshold_candidates(scored_orders(spark, sf_dir), KEYS)


THR_SQL = f"""{ranked_sql("scored", "repeat_id, fold_id", "prob", "rp")},
cand AS (SELECT repeat_id, fold_id, prob AS t, tp, fp, np, nn FROM rp UNION ALL SELECT repeat_id, fold_id, 0, max(np), max(nn), max(np), max(nn) FROM rp GROUP BY repeat_id, fold_id),
best AS (SELECT *, row_number() OVER (PARTITION BY repeat_id, fold_id ORDER BY (tp / np + (nn - fp) / nn) / 2 DESC, tp / np DESC, abs(t - 0.5), t) AS rk FROM cand),
chosen AS (SELECT repeat_id, fold_id, t AS threshold, (tp / np + (nn - fp) / nn) / 2 AS balanced_accuracy, tp / np AS sensitivity, (nn - fp)::BIGINT AS tn, fp::BIGINT AS fp, (np - tp)::BIGINT AS fn, tp::BIGINT AS tp FROM best WHERE rk = 1)"""


@query(
    "thr2_threshold_choice",
    f"""WITH {SCORED_SQL}, {THR_SQL} SELECT repeat_id, fold_id, round(threshold, 6) AS threshold, round(balanced_accuracy, 6) AS balanced_accuracy, round(sensitivity, 6) AS sensitivity, tn, fp, fn, tp FROM chosen""",
)
def thr2(spark, sf_dir):
    return rounded(T.choose_threshold(scored_orders(spark, sf_dir), KEYS))


@query("thr3_recompute_validation")
def thr3(spark, sf_dir):
    """Stored thresholds against a fresh computation on repartitioned rows: no difference rows."""
    stored = cut_lineage(T.choose_threshold(scored_orders(spark, sf_dir), KEYS))
    again = T.choose_threshold(scored_orders(spark, sf_dir).repartition(13, "sample_id"), KEYS)
    diff = T.differences(stored, again, KEYS)
    return diff.agg(F.count(F.lit(1)).alias("n_differences"), (F.count(F.lit(1)) == 0).alias("recomputed_equal"))


@query(
    "thr3_threshold_recount",
    f"""WITH {SCORED_SQL}, {THR_SQL} SELECT c.repeat_id, c.fold_id, round(any_value(c.threshold), 6) AS threshold, count(*) FILTER (WHERE y = 0 AND prob < c.threshold) AS tn,
 count(*) FILTER (WHERE y = 0 AND prob >= c.threshold) AS fp, count(*) FILTER (WHERE y = 1 AND prob < c.threshold) AS fn, count(*) FILTER (WHERE y = 1 AND prob >= c.threshold) AS tp, true AS equal
 FROM chosen c JOIN scored s USING (repeat_id, fold_id) GROUP BY c.repeat_id, c.fold_id""",
)
def thr3_recount(spark, sf_dir):
    """Stored thresholds applied to the rows again and counted without ranks."""
    scored = scored_orders(spark, sf_dir)
    return rounded(T.recount(scored, cut_lineage(T.choose_threshold(scored, KEYS)), KEYS))


# --- selection ----------------------------------------------------------------

RATIO_C = [(S.candidate_id(r, c), r, c, w) for r, w in zip(S.RATIOS, (7, 11, 17)) for c in S.LOGISTIC_CS]
CAND_SQL = f"""cand AS (SELECT * FROM (VALUES {", ".join(f"('{i}', {r}::DOUBLE, {c}::DOUBLE, {w})" for i, r, c, w in RATIO_C)}) v(candidate_id, ratio, c, fused_width)),
cscore AS (SELECT f.repeat_id, f.fold_id, f.sample_id, f.y, c.candidate_id, round((o_totalprice - 250000) / 100000 * c.ratio + 0.2 * substr(o_orderpriority, 1, 1)::DOUBLE * log10(c.c), 3) AS score
 FROM folds f JOIN orders o ON f.sample_id = o.o_orderkey::VARCHAR, cand c)"""
CKEYS = "repeat_id, candidate_id, fold_id"
SUMMARY_SQL = f"""{ranked_sql("cscore", CKEYS)}, {ranking_sql(CKEYS)},
summary AS (SELECT repeat_id, candidate_id, count(*) AS n_folds, avg(auprc) AS mean_auprc, avg(auroc) AS mean_auroc, stddev_pop(auprc) AS sd_auprc FROM ranking GROUP BY ALL)"""


def candidate_scores(spark, sf_dir):
    """Every candidate scores every held-out row of the five folds of each repeat."""
    price = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("sample_id"),
        ((F.col("o_totalprice") - 250000) / 100000).alias("a"),
        (0.2 * F.substring("o_orderpriority", 1, 1).cast("double")).alias("b"),
    )
    listed = F.array(*[F.struct(F.lit(i).alias("candidate_id"), F.lit(r).alias("ratio"), F.lit(c).alias("c")) for i, r, c, _ in RATIO_C])
    rows = orders_folds(spark, sf_dir).join(price, "sample_id").withColumn("k", F.explode(listed))
    score = F.round(F.col("a") * F.col("k.ratio") + F.col("b") * F.log10("k.c"), 3)
    return rows.select(*KEYS, "sample_id", "y", "k.candidate_id", score.alias("score"))


def candidate_frame(spark):
    return spark.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(i).alias("candidate_id"), F.lit(r).alias("ratio"), F.lit(c).alias("c"), F.lit(w).alias("fused_width")) for i, r, c, w in RATIO_C]))
    )


def candidate_summaries(spark, sf_dir):
    keys = ["repeat_id", "candidate_id", "fold_id"]
    ranking = M.ranking_metrics(candidate_scores(spark, sf_dir), keys)
    return S.candidate_summary(ranking, ["repeat_id", "candidate_id"])


@query(
    "sel1_candidate_grid",
    f"""WITH {COHORT_SQL}, n AS (SELECT 'mge' AS modality, max(len(mge)) AS n FROM cohort UNION ALL SELECT 'mdm', max(len(mdm)) FROM cohort UNION ALL SELECT 'mcna', max(len(mcna)) FROM cohort),
w AS (SELECT ratio::DOUBLE AS ratio, sum(ceil(n * ratio))::INT AS fused_width FROM n, (VALUES (0.25), (0.5), (0.75)) r(ratio) GROUP BY ratio HAVING min(ceil(n * ratio)) >= 2 AND min(n - ceil(n * ratio)) > 0)
SELECT 'ratio=' || ratio || '|C=' || c AS candidate_id, ratio, c, fused_width, (SELECT count(*) FROM cohort) * 5 AS n_oof_rows FROM w, (SELECT unnest([0.1, 1.0, 10.0])::DOUBLE AS c)""",
)
def sel1(spark, sf_dir):
    """The grid for the widths found in the cohort, with the predictions each candidate will make."""
    cohort = orders_cohort(spark, sf_dir)
    sizes = cohort.agg(F.count(F.lit(1)).alias("_n"), *[F.max(F.size(m)).alias(m) for m in ORDERS_FEATURES])
    counts = R.unpivot(sizes, ["_n"], list(ORDERS_FEATURES), "modality", "n_features")
    grid = S.candidate_grid(counts.drop("_n"))
    total = sizes.select((F.col("_n") * D.OUTER_REPEATS).alias("n_oof_rows"))
    return attach_row(grid, total).select("candidate_id", "ratio", "c", "fused_width", "n_oof_rows")


@query(
    "sel4_candidate_summary",
    f"""WITH {LABEL_SQL}, {folds_sql()}, {CAND_SQL}, {SUMMARY_SQL}, {ranked_sql("cscore", "repeat_id, candidate_id", name="pooled")}, {ranking_sql("repeat_id, candidate_id", "pooled", "pr")}
SELECT s.repeat_id, s.candidate_id, s.n_folds, round(mean_auprc, 6) AS mean_auprc, round(mean_auroc, 6) AS mean_auroc, round(sd_auprc, 6) AS sd_auprc, round(p.auprc, 6) AS pooled_auprc, round(p.auroc, 6) AS pooled_auroc
FROM summary s JOIN pr p USING (repeat_id, candidate_id)""",
)
def sel4(spark, sf_dir):
    keys = ["repeat_id", "candidate_id"]
    # folds and pooled rows share the counts of each distinct score; the 45 scores of an order are not written
    counts = cut_lineage(M.score_counts(candidate_scores(spark, sf_dir), [*keys, "fold_id"]))
    summary = S.candidate_summary(M.ranking_of_counts(counts, [*keys, "fold_id"]), keys)
    pooled = M.ranking_of_counts(counts, keys).select(*keys, F.col("auprc").alias("pooled_auprc"), F.col("auroc").alias("pooled_auroc"))
    return rounded(summary.join(pooled, keys))


WINNER_SQL = f"""{SUMMARY_SQL}, win AS (SELECT s.*, c.ratio, c.c, c.fused_width, row_number() OVER (PARTITION BY repeat_id ORDER BY round(mean_auprc, 12) DESC, round(mean_auroc, 12) DESC, round(sd_auprc, 12), fused_width, c, candidate_id) AS rk
 FROM summary s JOIN cand c USING (candidate_id))"""


@query(
    "sel5_winner_with_tie_breaks",
    f"""WITH {LABEL_SQL}, {folds_sql()}, {CAND_SQL}, {WINNER_SQL} SELECT repeat_id, candidate_id, fused_width, c, round(mean_auprc, 6) AS mean_auprc FROM win WHERE rk = 1""",
)
def sel5(spark, sf_dir):
    joined = candidate_summaries(spark, sf_dir).join(candidate_frame(spark), "candidate_id")
    won = S.select_winner(joined, ["repeat_id"], S.PRIMARY_ORDER)
    return rounded(won.select("repeat_id", "candidate_id", "fused_width", "c", "mean_auprc"))


STAGE_A = [(f"ratio_{int(r * 100):03d}", int(w), f, 1 + 4 * i + j, 60 - 5 * i - j) for i, (r, w) in enumerate(zip(S.RATIOS, (16, 32, 48))) for j, f in enumerate(S.FAMILIES)]
STAGE_B = [(f, c, s, 1 + (7 * i) % 64, 1 + (11 * i + 3) % 64) for i, (f, c, s) in enumerate(S.search_space(("logistic_linear", "rbf_svc_decision", "random_forest_bagged")))]


def _stage_sql(columns, summary_keys, order, extra=""):
    keys = ", ".join(columns)
    sk = ", ".join(summary_keys)
    return f"""{ranked_sql("scored", f"repeat_id, fold_id, {keys}")}, {ranking_sql(f"repeat_id, fold_id, {keys}")}, {confusion_sql("scored", f"repeat_id, fold_id, {keys}", "score >= 0")},
sm AS (SELECT repeat_id, {sk}, avg(auprc) AS mean_auprc, avg((tp / (tp + fn) + tn / (tn + fp)) / 2) AS mba, avg(tp / (tp + fn)) AS ms, stddev_pop(auprc) AS sd FROM ranking JOIN conf USING (repeat_id, fold_id, {keys}) GROUP BY repeat_id, {sk}),
rk AS (SELECT *, row_number() OVER (PARTITION BY repeat_id ORDER BY round(mean_auprc, 12) DESC, round(mba, 12) DESC, round(ms, 12) DESC, round(sd, 12), {order}) AS rk FROM sm)"""


@query(
    "sel6_stage_a_representation",
    f"""WITH {VARIANT_SQL}, {variants_sql(STAGE_A, ["candidate_id", "fused_width", "family"])}, {_stage_sql(["candidate_id", "fused_width", "family"], ["candidate_id", "fused_width"], "fused_width, candidate_id")}
SELECT repeat_id, candidate_id, round(mean_auprc, 6) AS mean_auprc, round(mba, 6) AS mean_balanced_accuracy FROM rk WHERE rk = 1""",
)
def sel6a(spark, sf_dir):
    keys = [*KEYS, "candidate_id", "fused_width", "family"]
    rows = embedding_variants(spark, sf_dir, STAGE_A, keys[2:])
    per_fold = M.ranking_metrics(rows, keys).join(M.threshold_metrics(rows, keys, F.col("score") >= 0), keys)
    summary = S.stage_summary(per_fold, ["repeat_id", "candidate_id", "fused_width"])
    won = S.select_winner(summary, ["repeat_id"], S.STAGE_A_ORDER)
    return rounded(won.select("repeat_id", "candidate_id", "mean_auprc", "mean_balanced_accuracy"))


@query(
    "sel6_stage_b_configuration",
    f"""WITH {VARIANT_SQL}, {variants_sql(STAGE_B, ["family", "configuration_id", "strategy"])}, {_stage_sql(["family", "configuration_id", "strategy"], ["family", "configuration_id", "strategy"], "configuration_id, strategy")}
SELECT repeat_id, family, configuration_id, strategy, round(mean_auprc, 6) AS mean_auprc, round(mba, 6) AS mean_balanced_accuracy FROM rk WHERE rk = 1""",
)
def sel6b(spark, sf_dir):
    keys = [*KEYS, "family", "configuration_id", "strategy"]
    rows = embedding_variants(spark, sf_dir, STAGE_B, keys[2:])
    per_fold = M.ranking_metrics(rows, keys).join(M.threshold_metrics(rows, keys, F.col("score") >= 0), keys)
    summary = S.stage_summary(per_fold, ["repeat_id", *keys[2:]])
    won = S.select_winner(summary, ["repeat_id"], S.STAGE_B_ORDER)
    return rounded(won.select("repeat_id", *keys[2:], "mean_auprc", "mean_balanced_accuracy"))


@query(
    "sel7_search_space",
    f"""WITH {LABEL_SQL}, sp AS (SELECT * FROM (VALUES {", ".join(f"('{f}', '{c}')" for f in S.FAMILIES for c in S.CONFIGURATIONS[f])}) v(family, configuration_id), (VALUES {", ".join(f"('{s}')" for s in S.STRATEGIES)}) t(strategy)
 WHERE NOT (family = 'hist_gradient_boosting' AND strategy = 'balanced_class_weight'))
SELECT family, configuration_id, strategy, 3 * 25 AS n_fits, (SELECT count(*) FROM cohort) * 4 * 5 * 2 AS n_rows_fitted FROM sp""",
)
def sel7(spark, sf_dir):
    """The valid combinations and the work each one means for this cohort (3 inner folds, 25 coordinates)."""
    rows = S.search_space(("logistic_linear", "rbf_svc_decision", "random_forest_bagged"))
    listed = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(c).alias("configuration_id"), F.lit(s).alias("strategy")) for f, c, s in rows]))
    size = orders_labels(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    train_rows = F.col("n") * (D.OUTER_SPLITS - 1) * D.OUTER_REPEATS * (D.INNER_SPLITS - 1)
    return size.select(listed.alias("s"), "n").select("s.*", F.lit(D.INNER_SPLITS * D.OUTER_SPLITS * D.OUTER_REPEATS).alias("n_fits"), train_rows.alias("n_rows_fitted"))


# --- evaluation and reports ---------------------------------------------------


@query(
    "joi6_late_label_join",
    f"""WITH {SCORED_SQL}, p AS (SELECT repeat_id, fold_id, sample_id, prob FROM scored)
SELECT p.repeat_id, p.fold_id, count(*) AS n_predictions, sum(c.y)::BIGINT AS n_positive, round(sum(p.prob * c.y), 7) AS prob_of_positives FROM p JOIN cohort c USING (sample_id) GROUP BY ALL""",
)
def joi6(spark, sf_dir):
    frozen = scored_orders(spark, sf_dir).drop("y")
    rows = A.late_labels(frozen, orders_labels(spark, sf_dir))
    return rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_predictions"),
        F.sum("y").alias("n_positive"),
        F.round(F.sum(F.col("prob") * F.col("y")), 7).alias("prob_of_positives"),
    )


def outer_evaluation(frozen, labels, keys=tuple(KEYS)):
    """Labels enter here only: ranking on raw score, operations on the frozen label, losses on probability."""
    keys = list(keys)
    rows = cut_lineage(A.late_labels(frozen, labels))
    raw = M.ranking_metrics(rows, keys).select(*keys, F.col("auprc").alias("raw_auprc"), F.col("auroc").alias("raw_auroc"))
    cal = M.ranking_metrics(rows, keys, "prob").select(*keys, F.col("auprc").alias("prob_auprc"), F.col("auroc").alias("prob_auroc"))
    ops = M.threshold_metrics(rows, keys, F.col("predicted") == 1)
    return ops.join(raw, keys).join(cal, keys).join(M.probability_losses(rows, keys), keys)


@query(
    "eva1_outer_evaluation",
    f"""WITH {SCORED_SQL}, {THR_SQL}, fr AS (SELECT s.repeat_id, s.fold_id, s.sample_id, s.y, s.score, s.prob, s.prob >= c.threshold AS predicted FROM scored s JOIN chosen c USING (repeat_id, fold_id)),
{ranked_sql("fr", "repeat_id, fold_id", "score", "r1")}, {ranking_sql("repeat_id, fold_id", "r1", "k1")}, {ranked_sql("fr", "repeat_id, fold_id", "prob", "r2")}, {ranking_sql("repeat_id, fold_id", "r2", "k2")},
{confusion_sql("fr", "repeat_id, fold_id", "predicted")}, ls AS (SELECT repeat_id, fold_id, round(avg((prob - y) * (prob - y)), 6) AS brier, round(-avg(CASE WHEN y = 1 THEN ln(prob) ELSE ln(1 - prob) END), 6) AS log_loss FROM fr GROUP BY ALL)
SELECT c.repeat_id, c.fold_id, tn, fp, fn, tp, {THRESHOLD_METRICS_SQL}, round(k1.auprc, 6) AS raw_auprc, round(k1.auroc, 6) AS raw_auroc, round(k2.auprc, 6) AS prob_auprc, round(k2.auroc, 6) AS prob_auroc, brier, log_loss
FROM conf c JOIN k1 USING (repeat_id, fold_id) JOIN k2 USING (repeat_id, fold_id) JOIN ls USING (repeat_id, fold_id)""",
)
def eva1(spark, sf_dir):
    rows = scored_orders(spark, sf_dir)
    chosen = T.choose_threshold(rows, KEYS).select(*KEYS, "threshold")
    frozen = rows.join(F.broadcast(chosen), KEYS).select(  # 25 rows
        *KEYS, "sample_id", "score", "prob", (F.col("prob") >= F.col("threshold")).cast("int").alias("predicted")
    )
    return rounded(outer_evaluation(frozen, orders_labels(spark, sf_dir)))
