"""Scores with a coefficient table, explanations and reliability (MOD2, MOD8, FIN2-4, EXP, REL, RPT7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import attach_row, sigmoid
from ..operators import contract as C, explain as E, families as Z, folds as D, frozen as Fz, preprocess as P, reliability as L, report as R
from ..operators.ranking import exact_quantiles
from ..session import cut_lineage
from ..sources.cohorts import EMBEDDING_SLICES, MODALITIES, document_cohort, embedding_latents, orders_cohort
from .augment_queries import EMB
from .fold_queries import orders_labels
from .metric_queries import rounded
from .registry import CELLS_SQL, COHORT_SQL, query

WIDTH = 64
INTERCEPT = -0.5
NAMES = [f"{m}_z{i:03d}" for m, (a, b) in EMBEDDING_SLICES.items() for i in range(b - a)]


def names_col():
    return F.array(*[F.lit(n) for n in NAMES])


def split_sql(source: str, seed: int = 42) -> str:
    return f"""sp AS (SELECT sample_id, y, CASE WHEN rk <= round(n * 0.2) THEN 'stop' ELSE 'fit' END AS part FROM
 (SELECT sample_id, y, row_number() OVER (PARTITION BY y ORDER BY sha256('{seed}|' || sample_id)) AS rk, count(*) OVER (PARTITION BY y) AS n FROM {source}))"""


NAME_SQL = "CASE WHEN pos < 24 THEN 'mge_z' || format('{:03d}', pos) WHEN pos < 48 THEN 'mdm_z' || format('{:03d}', pos - 24) ELSE 'mcna_z' || format('{:03d}', pos - 48) END"
LIN_SQL = f"""{EMB}, {split_sql("emb")},
ec AS (SELECT e.sample_id, e.y, s.part, generate_subscripts(e, 1) - 1 AS pos, unnest(e)::DOUBLE AS x FROM emb e JOIN sp s USING (sample_id)),
sc AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s, median(x) AS med, corr(x, y) AS w FROM ec WHERE part = 'fit' GROUP BY pos),
zc AS (SELECT sample_id, y, part, pos, (x - m) / s AS z, (med - m) / s AS b, w, {NAME_SQL} AS name FROM ec JOIN sc USING (pos)),
lin AS (SELECT sample_id, any_value(y) AS y, any_value(part) AS part, {INTERCEPT} + sum(z * w) AS score FROM zc GROUP BY sample_id)"""


def linear_rows(spark, sf_dir):
    """Scaled embeddings with the split part and the train-derived model arrays in each row.

    The model is one row: coefficient = train correlation with the label.
    """
    latents = embedding_latents(spark, sf_dir)
    parts = D.shuffle_split(latents.select("sample_id", "y"), [], seed=42)
    rows = cut_lineage(latents.join(parts.select("sample_id", "part"), "sample_id"))
    cells = rows.filter("part = 'fit'").select("y", F.posexplode("z").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    stats = cells.groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.corr("x", F.col("y").cast("double")).alias("w"))
    full = stats.join(exact_quantiles(cells, ["pos"], "x", (0.5,)), "pos")
    packed = F.sort_array(F.collect_list(F.struct("pos", "m", "s", "w", ((F.col("q50") - F.col("m")) / F.col("s")).alias("b"))))
    model = full.agg(packed.alias("_a")).select(
        *[F.transform("_a", fn).alias(n) for n, fn in (("mean", lambda p: p["m"]), ("scale", lambda p: p["s"]), ("coef", lambda p: p["w"]), ("background", lambda p: p["b"]))],
        F.lit(INTERCEPT).alias("intercept"),
    )
    return attach_row(rows, model).select("sample_id", "y", "part", P.standardise(F.col("z"), F.col("mean"), F.col("scale")).alias("z"), "coef", "background", "intercept")


@query("mod2_linear_score", f"WITH {LIN_SQL} SELECT sample_id, round(score, 6) AS score, round(1 / (1 + exp(-score)), 6) AS raw_prob FROM lin")
def mod2(spark, sf_dir):
    return rounded(Fz.linear_score(linear_rows(spark, sf_dir), "z").select("sample_id", "score", "raw_prob"))


@query(
    "mod8_score_adapter",
    f"""WITH {LIN_SQL}, u AS (SELECT sample_id, 'decision' AS score_type, round(score, 6) AS score, 0.0::DOUBLE AS cut FROM lin UNION ALL SELECT sample_id, 'probability', round(1 / (1 + exp(-score)), 6), 0.5 FROM lin)
SELECT sample_id, score_type, score, cut, (score >= cut)::INT AS predicted FROM u""",
)
def mod8(spark, sf_dir):
    scored = Fz.linear_score(linear_rows(spark, sf_dir), "z")
    kinds = F.explode(F.array(F.struct(F.lit("decision").alias("t"), F.col("score").alias("v")), F.struct(F.lit("probability").alias("t"), F.col("raw_prob").alias("v"))))
    long = scored.select("sample_id", kinds.alias("k")).select("sample_id", F.col("k.t").alias("score_type"), F.round("k.v", 6).alias("score"))
    return Z.adapt_scores(long)


# --- frozen scoring on the orders cohort ---------------------------------------

FROZEN_SQL = f"""WITH {COHORT_SQL}, {CELLS_SQL}, {split_sql("cohort")},
md AS (SELECT modality, pos, median(x) AS med FROM cells JOIN sp USING (sample_id) WHERE part = 'fit' GROUP BY ALL),
st AS (SELECT c.modality, c.pos, any_value(med) AS med, avg(coalesce(x, med)) AS m, stddev_pop(coalesce(x, med)) AS s, corr(x, c.y) AS w FROM cells c JOIN sp USING (sample_id) JOIN md USING (modality, pos) WHERE part = 'fit' GROUP BY c.modality, c.pos),
rate AS (SELECT avg(y) AS r FROM sp WHERE part = 'fit'),
lin AS (SELECT c.sample_id, sum(((coalesce(x, med) - m) / s)::FLOAT::DOUBLE * w) AS score FROM cells c JOIN st USING (modality, pos) GROUP BY c.sample_id),
out AS (SELECT sample_id, score, 1 / (1 + exp(-(score + ln(r / (1 - r))))) AS prob, round(r, 9) AS threshold FROM lin, rate)"""


def frozen_state(spark, sf_dir):
    """One state row fitted on the 'fit' part of the orders: arrays of feature width."""
    cohort = orders_cohort(spark, sf_dir)
    parts = D.shuffle_split(orders_labels(spark, sf_dir), [], seed=42)  # the labels alone: the split reads its input more than once
    train = cut_lineage(cohort.join(parts.filter("part = 'fit'").select("sample_id"), "sample_id", "left_semi"))
    from ..sources.cohorts import modality_cells

    cells = modality_cells(train, "y")
    medians = exact_quantiles(cells, ["modality", "pos"], "x", (0.5,)).select("modality", "pos", F.col("q50").alias("median"))
    filled = cells.join(F.broadcast(medians), ["modality", "pos"])  # one row per feature
    v = F.coalesce("x", "median")
    stats = filled.groupBy("modality", "pos").agg(
        F.max("median").alias("median"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("scale"), F.corr("x", F.col("y").cast("double")).alias("w")
    ).withColumn("model_id", F.lit(0))
    stats = cut_lineage(stats)
    arrays = P.stats_arrays(stats, ["model_id"])
    order = F.when(F.col("modality") == "mge", 0).when(F.col("modality") == "mdm", 1).otherwise(2)
    coef = stats.groupBy("model_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), "pos", "w"))), lambda p: p["w"]).alias("coef"))
    return attach_row(arrays.join(coef, "model_id"), train.agg(F.avg("y").alias("r"))).select(
        *arrays.columns, "coef", F.lit(0.0).alias("intercept"), F.lit(1.0).alias("a"), F.log(F.col("r") / (1 - F.col("r"))).alias("b"), F.round("r", 9).alias("threshold")
    )


@query(
    "fin2_frozen_scoring",
    f"{FROZEN_SQL} SELECT sample_id, round(score, 5) AS score, round(prob, 5) AS prob, round(threshold, 6) AS threshold, (prob >= threshold)::INT AS predicted FROM out",
)
def fin2(spark, sf_dir):
    scored = Fz.frozen_score(orders_cohort(spark, sf_dir).drop("y"), cut_lineage(frozen_state(spark, sf_dir)))
    return scored.select("sample_id", F.round("score", 5).alias("score"), F.round("prob", 5).alias("prob"), F.round("threshold", 6).alias("threshold"), "predicted")


@query(
    "fin3_frozen_prediction_check",
    f"{FROZEN_SQL} SELECT count(*) AS n_predictions, count(*) - count(DISTINCT sample_id) AS n_repeated_ids, min(threshold) = max(threshold) AS one_threshold, 0::BIGINT AS n_wrong_labels FROM out",
)
def fin3(spark, sf_dir):
    scored = Fz.frozen_score(orders_cohort(spark, sf_dir).drop("y"), cut_lineage(frozen_state(spark, sf_dir)))
    return Fz.frozen_check(scored, ["model_id"]).drop("model_id")


@query("fin4_model_state_identity")
def fin4(spark, sf_dir):
    return Fz.state_identity(frozen_state(spark, sf_dir))


# --- explanations ----------------------------------------------------------------


def test_rows(spark, sf_dir):
    return E.logistic_contributions(linear_rows(spark, sf_dir).filter("part = 'stop'"))


CON_SQL = f"WITH {LIN_SQL}, ct AS (SELECT sample_id, pos, name, w * (z - b) AS v, w * b AS bw, w * z AS zw FROM zc WHERE part = 'stop')"


@query("exp1_permutation_importance")
def exp1(spark, sf_dir):
    rows = linear_rows(spark, sf_dir).filter("part = 'fit'").select("sample_id", "y", "z", "coef", "intercept")
    return E.rank_features(E.permutation_importance(cut_lineage(rows)), names_col())


@query(
    "exp2_logistic_contributions",
    f"""{CON_SQL} SELECT sample_id, round({INTERCEPT} + sum(bw), 6) AS background_value, round({INTERCEPT} + sum(bw) + sum(v), 6) AS reconstructed, true AS exact, round(max(v), 6) AS largest, round(min(v), 6) AS smallest FROM ct GROUP BY sample_id""",
)
def exp2(spark, sf_dir):
    return rounded(
        test_rows(spark, sf_dir).select(
            "sample_id", "background_value", "reconstructed", "exact", F.array_max("contribution").alias("largest"), F.array_min("contribution").alias("smallest")
        )
    )


@query(
    "exp3_top_signals",
    f"""{CON_SQL}, r AS (SELECT sample_id, name, v, v > 0 AS up, row_number() OVER (PARTITION BY sample_id, v > 0 ORDER BY abs(v) DESC, name) AS rk FROM ct WHERE v <> 0),
t AS (SELECT sample_id, name, v, row_number() OVER (PARTITION BY sample_id ORDER BY abs(v) DESC, name) AS rk FROM ct)
SELECT sample_id, CASE WHEN up THEN 'positive' ELSE 'negative' END AS kind, rk::INT AS rank, name, round(v, 6) AS value FROM r WHERE rk <= 5
UNION ALL SELECT sample_id, CASE WHEN v >= 0 THEN 'supports_high' ELSE 'supports_low' END, rk::INT, name, round(v, 6) FROM t WHERE rk <= 5""",
)
def exp3(spark, sf_dir):
    rows = cut_lineage(test_rows(spark, sf_dir).select("sample_id", "contribution"))
    c = F.col("contribution")

    def listed(col, kind):
        long = rows.select("sample_id", F.posexplode(col).alias("p", "s"))
        label = F.col("s.direction") if kind is None else F.lit(kind)
        return long.select("sample_id", label.alias("kind"), (F.col("p") + 1).alias("rank"), F.col("s.name").alias("name"), F.round("s.value", 6).alias("value"))

    return (
        listed(E.top_signed(c, names_col(), True), "positive")
        .unionByName(listed(E.top_signed(c, names_col(), False), "negative"))
        .unionByName(listed(E.top_absolute(c, names_col()), None))
    )


@query(
    "exp4_modality_totals",
    f"""{CON_SQL}, m AS (SELECT sample_id, split_part(name, '_', 1) AS modality, sum(v) AS signed, sum(abs(v)) AS absolute FROM ct GROUP BY ALL)
SELECT sample_id, modality, round(signed, 6) AS signed, round(absolute, 6) AS absolute, row_number() OVER (PARTITION BY sample_id ORDER BY absolute DESC)::INT AS rank FROM m""",
)
def exp4(spark, sf_dir):
    totals = test_rows(spark, sf_dir).select("sample_id", F.posexplode(E.modality_totals(F.col("contribution"), EMBEDDING_SLICES)).alias("p", "t"))
    return rounded(totals.select("sample_id", F.col("t.modality").alias("modality"), F.col("t.signed").alias("signed"), F.col("t.absolute").alias("absolute"), (F.col("p") + 1).alias("rank")))


@query(
    "exp6_attach_to_predictions",
    f"""{CON_SQL}, t AS (SELECT sample_id, name, row_number() OVER (PARTITION BY sample_id ORDER BY abs(v) DESC, name) AS rk FROM ct)
SELECT t.sample_id, t.name AS top_feature, round(l.score, 6) AS score, (l.score >= 0)::INT AS predicted FROM t JOIN lin l USING (sample_id) WHERE rk = 1""",
)
def exp6(spark, sf_dir):
    rows = cut_lineage(test_rows(spark, sf_dir))
    told = rows.select("sample_id", E.top_absolute(F.col("contribution"), names_col(), 1)[0]["name"].alias("top_feature"))
    scored = Fz.linear_score(rows, "z").select("sample_id", F.round("score", 6).alias("score"), (F.col("score") >= 0).cast("int").alias("predicted"))
    return E.attach(told, scored)


# --- reliability -------------------------------------------------------------------


def margins(spark, sf_dir):
    scored = Fz.linear_score(linear_rows(spark, sf_dir), "z")
    return cut_lineage(scored.select("sample_id", "part", F.round("score", 6).alias("score"), F.round(F.abs("score"), 6).alias("margin")))


@query(
    "rel1_margin_reference",
    f"""WITH {LIN_SQL}, m AS (SELECT part, round(abs(score), 6) AS v FROM lin)
SELECT part, count(*) AS count, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(quantile_cont(v, 0.1), 6) AS q10 FROM m GROUP BY part""",
)
def rel1(spark, sf_dir):
    return rounded(L.margin_reference(margins(spark, sf_dir), ["part"]))


REL2_SQL = f"""{LIN_SQL}, mg AS (SELECT sample_id, part, round(score, 6) AS score, round(abs(score), 6) AS v FROM lin),
rp AS (SELECT q.sample_id, q.score, q.v AS margin, (SELECT count(*) FROM mg f WHERE f.part = 'fit' AND f.v <= q.v) / (SELECT count(*) FROM mg WHERE part = 'fit') AS percentile FROM mg q WHERE part = 'stop')"""


@query("rel2_margin_percentile", f"WITH {REL2_SQL} SELECT sample_id, margin, round(percentile, 6) AS percentile, percentile < 0.1 AS low_margin FROM rp")
def rel2(spark, sf_dir):
    rows = margins(spark, sf_dir)
    found = L.margin_percentile(rows.filter("part = 'stop'"), rows.filter("part = 'fit'").select("margin"))
    return rounded(found.select("sample_id", "margin", "percentile", "low_margin"))


REL3_SQL = """zv AS (SELECT sample_id, any_value(part) AS part, list(z ORDER BY pos) AS v FROM zc GROUP BY sample_id),
own AS (SELECT a.sample_id, min(list_distance(a.v, b.v)) AS d FROM zv a JOIN zv b ON a.part = 'fit' AND b.part = 'fit' AND a.sample_id <> b.sample_id GROUP BY 1),
far AS (SELECT a.sample_id, min(list_distance(a.v, b.v)) AS distance FROM zv a JOIN zv b ON a.part = 'stop' AND b.part = 'fit' GROUP BY 1),
od AS (SELECT sample_id, distance, t AS ood_threshold, distance > t AS latent_ood FROM far, (SELECT quantile_cont(d, 0.95) AS t FROM own))"""


def _ood(spark, sf_dir):
    latents = embedding_latents(spark, sf_dir)
    parts = D.shuffle_split(latents.select("sample_id", "y"), [], seed=42).select("sample_id", "part")
    rows = cut_lineage(latents.join(parts, "sample_id"))
    return L.latent_ood(rows.filter("part = 'stop'"), rows.filter("part = 'fit'"))


@query("rel3_latent_ood", f"WITH {LIN_SQL}, {REL3_SQL} SELECT sample_id, round(distance, 5) AS distance, round(ood_threshold, 5) AS ood_threshold, latent_ood FROM od")
def rel3(spark, sf_dir):
    return rounded(_ood(spark, sf_dir), 5)


@query("rel4_mahalanobis_ood")
def rel4(spark, sf_dir):
    latents = embedding_latents(spark, sf_dir)
    parts = D.shuffle_split(latents.select("sample_id", "y"), [], seed=42).select("sample_id", "part")
    rows = cut_lineage(latents.join(parts, "sample_id"))
    return L.mahalanobis_risk(rows.filter("part = 'stop'"), rows.filter("part = 'fit'"))


@query(
    "rel4_mahalanobis_two_features",
    """WITH t AS (SELECT doc_id::VARCHAR AS sample_id, length(regexp_replace(text, '[^ ]', '', 'g'))::DOUBLE AS a, length(regexp_replace(text, '[^\n]', '', 'g'))::DOUBLE AS b FROM documents JOIN labels USING (doc_id)),
c AS (SELECT avg(a) AS ma, avg(b) AS mb, var_samp(a) + 1e-6 AS vaa, var_samp(b) + 1e-6 AS vbb, covar_samp(a, b) AS vab FROM t),
d AS (SELECT sample_id, sqrt(greatest(0, (vbb * (a - ma) * (a - ma) - 2 * vab * (a - ma) * (b - mb) + vaa * (b - mb) * (b - mb)) / (vaa * vbb - vab * vab))) AS distance FROM t, c),
q AS (SELECT quantile_cont(distance, 0.95) AS th FROM d)
SELECT sample_id, round(distance, 5) AS distance, round(th, 5) AS ood_threshold, CASE WHEN distance >= th THEN 'high' WHEN distance >= 0.85 * th THEN 'moderate' ELSE 'low' END AS ood_risk FROM d, q""",
)
def rel4_two(spark, sf_dir):
    rows = cut_lineage(document_cohort(spark, sf_dir).select("sample_id", F.col("mdm").alias("z")))
    return rounded(L.mahalanobis_risk(rows, rows), 5)


STATUS_SQL = f"""{COHORT_SQL}, c AS (SELECT sample_id, mdm[1] AS price, mdm[5] AS prio, (list_count(mge) + list_count(mdm) + list_count(mcna)) / (len(mge) + len(mdm) + len(mcna))::DOUBLE AS completeness FROM cohort),
g AS (SELECT avg(price) AS m, var_samp(price) AS v FROM c), s AS (SELECT c.*, round((price - 250) / 100 + 0.2 * prio, 9) AS score, round(abs(price - m) / sqrt(v + 1e-6), 6) AS distance FROM c, g),
k AS (SELECT quantile_cont(distance, 0.95) AS th FROM s),
r AS (SELECT sample_id, round(1 / (1 + exp(-score)), 6) AS prob, completeness, distance, (SELECT round(th, 6) FROM k) AS th,
 list_aggregate([1 / (1 + exp(-score * 0.6)), 1 / (1 + exp(-score * 0.8)), 1 / (1 + exp(-score)), 1 / (1 + exp(-score * 1.2)), 1 / (1 + exp(-score * 1.4))], 'stddev_pop') AS disagreement FROM s),
f AS (SELECT *, CASE WHEN completeness < 0.8 THEN 'high_missingness_detected' WHEN completeness < 0.95 THEN 'moderate_missingness_detected' ELSE 'none' END AS quality,
 CASE WHEN distance >= th THEN 'high' WHEN distance >= 0.85 * th THEN 'moderate' ELSE 'low' END AS ood_risk FROM r),
st AS (SELECT *, list_filter([CASE WHEN prob BETWEEN 0.4 AND 0.6 THEN 'borderline_confidence' END, CASE WHEN quality <> 'none' THEN quality END, CASE WHEN ood_risk <> 'low' THEN 'ood_risk_' || ood_risk END,
 CASE WHEN disagreement >= 0.1 THEN 'model_disagreement' END], lambda w: w IS NOT NULL) AS reasons FROM f)"""


def status_rows(spark, sf_dir):
    """Probability, completeness, price distance and disagreement of five sharpened scores per order."""
    cohort = orders_cohort(spark, sf_dir)
    price, prio = F.col("mdm")[0], F.col("mdm")[4]
    base = cohort.select("sample_id", price.alias("price"), F.round((price - 250) / 100 + 0.2 * prio, 9).alias("score"), C.completeness().alias("completeness"))
    spread_of = base.agg(F.avg("price").alias("m"), F.var_samp("price").alias("v"))
    rows = attach_row(base, spread_of).withColumn("distance", F.round(F.abs(F.col("price") - F.col("m")) / F.sqrt(F.col("v") + 1e-6), 6))
    rows = cut_lineage(rows.select("sample_id", "score", "completeness", "distance"))
    rows = attach_row(rows, exact_quantiles(rows, [], "distance", (0.95,)).select(F.round("q95", 6).alias("th")))
    probs = F.array(*[sigmoid(F.col("score") * k) for k in (0.6, 0.8, 1.0, 1.2, 1.4)])
    mean = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x) / 5
    spread = F.sqrt(F.aggregate(probs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / 5)
    return rows.select(
        "sample_id",
        "score",
        F.round(sigmoid(F.col("score")), 6).alias("prob"),
        "completeness",
        C.missingness_band(F.col("completeness")).alias("quality"),
        L.ood_risk(F.col("distance"), F.col("th")).alias("ood_risk"),
        spread.alias("disagreement"),
    )


@query(
    "rel5_status_rules",
    f"""WITH {STATUS_SQL} SELECT sample_id, prob, quality, ood_risk, round(disagreement, 6) AS disagreement, array_to_string(reasons, ',') AS reasons, CASE WHEN len(reasons) = 0 THEN 'Reliable' ELSE 'Caution' END AS status FROM st""",
)
def rel5(spark, sf_dir):
    rows = status_rows(spark, sf_dir)
    reasons = L.caution_reasons(F.col("prob"), F.col("quality"), F.col("ood_risk"), F.col("disagreement"))
    return rows.select("sample_id", "prob", "quality", "ood_risk", F.round("disagreement", 6).alias("disagreement"), F.array_join(reasons, ",").alias("reasons"), L.status_of(reasons).alias("status"))


REL6_SQL = f"""{REL2_SQL}, {REL3_SQL}, rr AS (SELECT rp.sample_id, rp.score, percentile, percentile < 0.1 AS low_margin, distance, latent_ood FROM rp JOIN od USING (sample_id))"""


@query(
    "rel6_published_reliability",
    f"""WITH {REL6_SQL} SELECT sample_id, score, (score >= 0)::INT AS predicted, round(percentile, 6) AS percentile, round(distance, 5) AS distance, low_margin, latent_ood,
 array_to_string(list_filter([CASE WHEN low_margin THEN 'low_relative_margin' END, CASE WHEN latent_ood THEN 'latent_out_of_distribution' END], lambda w: w IS NOT NULL), ',') AS flags,
 CASE WHEN low_margin OR latent_ood THEN 'inconclusive' ELSE 'supported_with_caution' END AS status FROM rr""",
)
def rel6(spark, sf_dir):
    return published(spark, sf_dir).select(
        "sample_id", "score", "predicted", F.round("percentile", 6).alias("percentile"), F.round("distance", 5).alias("distance"), "low_margin", "latent_ood", "flags", "status"
    )


def published(spark, sf_dir):
    rows = margins(spark, sf_dir)
    near = L.margin_percentile(rows.filter("part = 'stop'"), rows.filter("part = 'fit'").select("margin"))
    joined = near.join(_ood(spark, sf_dir), "sample_id").withColumn("predicted", (F.col("score") >= 0).cast("int"))
    return L.published_rows(joined)


@query(
    "rpt7_reliability_totals",
    f"""WITH {REL6_SQL} SELECT count(*) FILTER (WHERE NOT (low_margin OR latent_ood)) AS n_supported, count(*) FILTER (WHERE low_margin OR latent_ood) AS n_inconclusive, count(*) FILTER (WHERE low_margin) AS n_low_margin,
 count(*) FILTER (WHERE latent_ood) AS n_latent_ood, count(*) FILTER (WHERE low_margin AND latent_ood) AS n_both FROM rr""",
)
def rpt7(spark, sf_dir):
    return R.reliability_totals(published(spark, sf_dir))


@query(
    "rel7_sample_report",
    f"""WITH {STATUS_SQL}, x AS (SELECT *, CASE WHEN prob >= 0.5 THEN 'High-TMB' ELSE 'Low-TMB' END AS pr, len(reasons) = 0 AS ok, prob BETWEEN 0.4 AND 0.6 AS inc FROM st)
SELECT sample_id, CASE WHEN ok THEN 'Reliable' ELSE 'Caution' END AS status, to_json({{'prediction': pr, 'predicted_tmb_category': CASE WHEN inc THEN 'Inconclusive' ELSE pr END, 'probability_high_tmb': prob,
 'confidence': round(greatest(prob, 1 - prob), 6), 'inconclusive': inc, 'data_completeness': round(completeness, 6), 'data_quality_warning': quality, 'out_of_distribution_risk': ood_risk,
 'dominant_omics': ['mdm', 'mge'], 'top_contributing_signals': [{{'name': 'price', 'value': round(prob - 0.5, 2) + 0.0}}], 'reliability_status': CASE WHEN ok THEN 'Reliable' ELSE 'Caution' END, 'warnings': reasons,
 'clinical_interpretation': CASE WHEN prob >= 0.5 THEN '{L.HIGH_TEXT}' ELSE '{L.LOW_TEXT}' END,
 'reliability_summary': CASE WHEN ok THEN '{L.RELIABLE_TEXT}' ELSE 'Prediction carries caution flags: ' || array_to_string(reasons, ', ') || '.' END,
 'recommendation': CASE WHEN ok THEN '{L.RELIABLE_ADVICE}' ELSE '{L.CAUTION_ADVICE}' END, 'disclaimer': '{L.DISCLAIMER}'}})::VARCHAR AS report FROM x""",
)
def rel7(spark, sf_dir):
    rows = status_rows(spark, sf_dir)
    # rounded as hundredths: 0.615 - 0.5 is 0.11499999999999999 as a double, but 11.5 hundredths
    signal = F.array(F.struct(F.lit("price").alias("name"), (F.round((F.col("prob") - 0.5) * 100, 0) / 100).alias("value")))
    return L.sample_report(rows.withColumn("top_signals", signal).withColumn("dominant", F.array(F.lit("mdm"), F.lit("mge"))))
