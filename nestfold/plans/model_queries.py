"""Encoders, classifiers, the nested search, calibration and final refit (REP, MOD, SEL2-3, FIN1, CAL, EXP5, REL8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import array_sum, attach_row
from ..operators import align as A, augment as G, boosting as B, calibrate as K, explain as E, families as Z, folds as D, linear as L, metrics as M, model_state as MS, preprocess as P, selection as S, wide as WD
from ..session import cut_lineage
from ..sources.cohorts import EMBEDDING_SLICES, MODALITIES, ORDERS_FEATURES, embedding_cohort, embedding_latents, orders_cohort, table
from . import fitted as FS, nested as N
from .augment_queries import EMB
from .explain_queries import names_col
from .fold_queries import orders_labels
from .metric_queries import KEYS, SCORED_SQL, rounded, scored_orders
from .registry import COHORT_SQL, MEMBERS_SQL, folds_sql, query

ORDERS_LAYOUT = N.Layout(tuple(len(v) for v in ORDERS_FEATURES.values()))
_STUDIES: dict = {}


def orders_study(spark, sf_dir) -> N.Study:
    """The nested study of the orders cohort; queries of one session share it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STUDIES:
        _STUDIES[key] = N.run(orders_cohort(spark, sf_dir), ORDERS_LAYOUT)
    return _STUDIES[key]


# --- representation -------------------------------------------------------------


@query(
    "rep1_ratio_to_width",
    f"""WITH {COHORT_SQL}, n AS (SELECT 'mge' AS modality, max(len(mge)) AS n FROM cohort UNION ALL SELECT 'mdm', max(len(mdm)) FROM cohort UNION ALL SELECT 'mcna', max(len(mcna)) FROM cohort)
SELECT modality, n::INT AS n_features, ratio::DOUBLE AS ratio, ceil(n * ratio)::INT AS width, ceil(n * ratio) >= 2 AND ceil(n * ratio) < n AS valid FROM n, (VALUES (0.25), (0.5), (0.75), (1.0)) r(ratio)""",
)
def rep1(spark, sf_dir):
    from ..operators.report import unpivot

    sizes = orders_cohort(spark, sf_dir).agg(*[F.max(F.size(m)).alias(m) for m in MODALITIES])
    return S.width_table(unpivot(sizes, [], MODALITIES, "modality", "n_features"), (*S.RATIOS, 1.0))


def model_table(spark, layout, models):
    """Fitted encoders as rows: set, modality, component, explained variance, loadings."""
    rows = []
    for s, m in models.items():
        for name, sl, (start, k) in zip(MODALITIES, layout.slices, layout.latent):
            for j in range(k):
                rows.append((*s, name, j, float(m.eigen[start + j]), [float(v) for v in m.loadings[sl, start + j]]))
    return spark.createDataFrame(rows, "repeat_id int, fold_id int, inner_fold_id int, modality string, component int, variance double, loadings array<double>")


@query("rep2_encoder_fit")
def rep2(spark, sf_dir):
    study = orders_study(spark, sf_dir)
    return model_table(spark, study.layout, study.models)


WIDE_FEATURES, WIDE_LATENTS = 20_000, 16


def hashed_words(spark, sf_dir):
    """Word counts of every document in hashed features: ``doc_id``, ``idx``, ``val``."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")).alias("w")).filter("w <> ''")
    cells = words.groupBy("doc_id", F.pmod(F.xxhash64("w"), F.lit(WIDE_FEATURES)).cast("int").alias("i")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    packed = F.sort_array(F.collect_list(F.struct("i", "v")))  # at most WIDE_FEATURES cells
    return cells.groupBy("doc_id").agg(packed.alias("p")).select("doc_id", F.col("p.i").alias("idx"), F.col("p.v").alias("val"))


@query("rep2_wide_encoder_fit")
def rep2_wide(spark, sf_dir):
    """Encoder of 20,000 hashed word features: variance along each latent and the share that is kept."""
    model = WD.fit_wide(cut_lineage(hashed_words(spark, sf_dir)), WIDE_FEATURES, WIDE_LATENTS)
    rows = [(j, float(v), float(model.variance[: j + 1].sum() / model.total)) for j, v in enumerate(model.variance)]
    return spark.createDataFrame(rows, "component int, variance double, share_kept double")


def stop_errors(spark, sf_dir):
    """Reconstruction error on fit and stop rows of every outer train part, for each ratio."""
    layout = N.Layout(ORDERS_LAYOUT.widths, n_inner=2)  # the parts stop and fit
    table = N.stop_table(orders_cohort(spark, sf_dir))
    errors: list = []
    N.fit_sets(table, layout, errors)
    frame = spark.createDataFrame(
        errors, "repeat_id int, fold_id int, inner_fold_id int, part string, modality string, ratio double, width int, n_rows int, mse double"
    )
    part = F.when(F.col("part") == "train", "fit").otherwise("stop")
    return frame.filter("inner_fold_id = 0").drop("inner_fold_id").withColumn("part", part)


@query("rep3_reconstruction_error")
def rep3(spark, sf_dir):
    return stop_errors(spark, sf_dir)


@query("rep4_capacity_selection")
def rep4(spark, sf_dir):
    """Width with the smallest stop error; ties go to the smaller width."""
    stop = stop_errors(spark, sf_dir).filter("part = 'stop'")
    best = F.min(F.struct(F.round("mse", 12).alias("mse"), "width", "ratio"))
    return stop.groupBy(*KEYS, "modality").agg(best.alias("b")).select(*KEYS, "modality", "b.width", "b.ratio", "b.mse")


@query("rep5_fresh_refit")
def rep5(spark, sf_dir):
    """Outer-train models with the selected ratio's width; held-out rows are only transformed."""
    study = orders_study(spark, sf_dir)
    refit = {s: m for s, m in study.models.items() if s[2] < 0}
    table = model_table(spark, study.layout, refit)
    widths = study.winners.select(*KEYS, "ratio", "fused_width")
    sizes = spark.createDataFrame(
        [(name, float(r), S.latent_width(d, r)) for name, d in zip(MODALITIES, study.layout.widths) for r in study.layout.ratios], "modality string, ratio double, width int"
    )
    used = widths.join(F.broadcast(sizes), "ratio")
    return table.join(used, [*KEYS, "modality"]).filter("component < width").groupBy(*KEYS, "ratio", "fused_width", "modality", "width").agg(
        F.count(F.lit(1)).alias("n_components"), F.sum("variance").alias("variance_kept")
    )


@query("rep6_encode_held_out")
def rep6(spark, sf_dir):
    study = orders_study(spark, sf_dir)
    z = N.encoded_rows(study.table, study.layout, {s: m for s, m in study.models.items() if s[2] < 0})
    finite = F.forall("z", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    return z.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.size("z")).alias("min_width"),
        F.max(F.size("z")).alias("max_width"),
        F.count_if(~finite).alias("n_not_finite"),
        F.avg(array_sum(F.col("z"))).alias("mean_total"),
    )


FUSED_SQL = f"""{EMB}, fu AS (SELECT sample_id, list_concat(list_concat(e[1:24], e[25:48]), e[49:64]) AS z, e FROM emb)"""


@query("rep7_latent_fusion", f"WITH {FUSED_SQL}, l AS (SELECT sample_id, generate_subscripts(z, 1) - 1 AS pos, unnest(z)::DOUBLE AS x FROM fu) SELECT sample_id, pos::INT AS pos, round(x, 6) AS x FROM l")
def rep7(spark, sf_dir):
    fused = embedding_cohort(spark, sf_dir).select("sample_id", P.as_float_array(P.fused()).alias("z"))
    return fused.select("sample_id", F.posexplode("z").alias("pos", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


LABELS = {"mge": "mGE", "mdm": "mDM", "mcna": "mCNA"}


@query(
    "rep8_latent_names_and_slices",
    f"""WITH {EMB}, w AS (SELECT min(len(e)) AS w FROM emb), s AS (SELECT * FROM (VALUES ('mGE', 0, 24), ('mDM', 24, 48), ('mCNA', 48, 64)) v(modality, start, stop))
SELECT modality, start::INT AS start, stop::INT AS stop, i::INT AS pos, modality || '_z' || lpad((i - start)::VARCHAR, 3, '0') AS name FROM s, w, LATERAL (SELECT unnest(range(start, least(stop, w))) AS i)""",
)
def rep8(spark, sf_dir):
    """Names and half-open slices from the widths found in the data."""
    widths = embedding_cohort(spark, sf_dir).agg(*[F.min(F.size(m)).alias(m) for m in MODALITIES])
    starts = {"mge": F.lit(0), "mdm": F.col("mge"), "mcna": F.col("mge") + F.col("mdm")}
    parts = F.explode(F.array(*[F.struct(F.lit(LABELS[m]).alias("modality"), starts[m].alias("start"), (starts[m] + F.col(m)).alias("stop")) for m in MODALITIES]))
    rows = widths.select(parts.alias("p")).select("p.*").withColumn("pos", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)))
    return rows.withColumn("name", F.concat("modality", F.lit("_z"), F.lpad((F.col("pos") - F.col("start")).cast("string"), 3, "0")))


@query(
    "rep9_slice_recovery",
    f"""WITH {FUSED_SQL} SELECT modality, count(*) AS n_rows, count(*) FILTER (WHERE z[a:b] <> e[a:b]) AS n_mismatch FROM fu, (VALUES ('mge', 1, 24), ('mdm', 25, 48), ('mcna', 49, 64)) s(modality, a, b) GROUP BY modality""",
)
def rep9(spark, sf_dir):
    rows = embedding_cohort(spark, sf_dir).withColumn("z", P.fused())
    out = None
    checks = [F.count_if(F.slice("z", a + 1, b - a) != F.col(m)).alias(m) for m, (a, b) in EMBEDDING_SLICES.items()]
    found = rows.agg(F.count(F.lit(1)).alias("n_rows"), *checks)
    for m in MODALITIES:
        part = found.select(F.lit(m).alias("modality"), "n_rows", F.col(m).alias("n_mismatch"))
        out = part if out is None else out.unionByName(part)
    return out


# --- classifiers ------------------------------------------------------------------


def embedding_train(spark, sf_dir):
    latents = embedding_latents(spark, sf_dir)
    train = D.membership(D.repeated_kfold(latents)).filter("role = 'train'").drop("role", "y")
    return cut_lineage(train.join(latents, "sample_id").select(*KEYS, "sample_id", "y", "z"))


@query("mod1_l2_logistic")
def mod1(spark, sf_dir):
    """75 fits (25 coordinates x 3 C) in common Newton passes."""
    weights, log = L.fit_rows(embedding_train(spark, sf_dir), KEYS, S.LOGISTIC_CS)
    return L.weights_frame(spark, weights, KEYS, ["int", "int"])


@query("mod9_convergence_record")
def mod9(spark, sf_dir):
    _, log = L.fit_rows(embedding_train(spark, sf_dir), KEYS, S.LOGISTIC_CS)
    return L.convergence(L.log_frame(spark, log))


@query("mod10_bootstrap_disagreement")
def mod10(spark, sf_dir):
    """Five classifiers on bootstrap draws of the train part; sd of their probabilities per held-out row."""
    latents = embedding_latents(spark, sf_dir)
    parts = D.shuffle_split(latents.select("sample_id", "y"), [], seed=42).select("sample_id", "part")
    rows = cut_lineage(latents.join(parts, "sample_id"))
    train = rows.filter("part = 'fit'").select("sample_id", "y", "z")
    n = train.count()
    samples = None
    for b in range(5):
        drawn = D.bootstrap(train, n, seed=100 + b).select(F.lit(b).alias("model_id"), "y", "z")
        samples = drawn if samples is None else samples.unionByName(drawn)
    weights, _ = L.fit_rows(cut_lineage(samples), ["model_id"])
    models = L.weights_frame(spark, weights, ["model_id"], ["int"])
    from ..operators.frozen import linear_score

    held = rows.filter("part = 'stop'").select("sample_id", "y", "z", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("model_id"))
    scored = linear_score(held.join(F.broadcast(models), "model_id"), "z")  # five rows
    return scored.groupBy("sample_id", "y").agg(F.avg("raw_prob").alias("mean_prob"), F.stddev_pop("raw_prob").alias("disagreement"))


def _split(spark, sf_dir):
    latents = embedding_latents(spark, sf_dir)
    parts = D.shuffle_split(latents.select("sample_id", "y"), [], seed=42).select("sample_id", "part")
    rows = cut_lineage(latents.join(parts, "sample_id"))
    return rows.filter("part = 'fit'").drop("part"), rows.filter("part = 'stop'").drop("part")


@query("mod3_l1_logistic_explainer")
def mod3(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    weighted = train.join(F.broadcast(G.class_weights(train).select("y", "weight")), "y")  # two rows
    total = weighted.agg(F.sum("weight")).first()[0]
    model = Z.l1_logistic(0.5, total).fit(Z.as_vectors(weighted).withColumn("label", F.col("y").cast("double")))
    coef = spark.createDataFrame([(i, float(v)) for i, v in enumerate(model.coefficients)], "pos int, coef double")
    return coef.select("pos", F.element_at(names_col(), F.col("pos") + 1).alias("feature"), "coef", (F.col("coef") != 0).alias("kept"))


def _family(name, parameter):
    def build(spark, sf_dir):
        train, held = _split(spark, sf_dir)
        scored, _ = Z.fit_score(train, held, name, parameter)
        return Z.adapt_scores(scored)

    return build


query("mod4_rbf_svc")(_family("rbf_svc_decision", 1.0))
query("mod5_random_forest")(_family("random_forest_bagged", 2))
query("mod6_gradient_boosting")(_family("hist_gradient_boosting", 1.0))
query("mod7_dense_net")(_family("dense_net", 0))


@query("mod6_second_order_boosting")
def mod6_second_order(spark, sf_dir):
    """100 boosted trees with L2 = 1 for each of 25 coordinates in common passes; probabilities of the held-out rows."""
    train, held = FS.outer_sets(embedding_latents(spark, sf_dir))
    scored = B.score_boosted(held, B.fit_boosted(train, KEYS, (1.0,)))
    return Z.adapt_scores(scored.withColumnRenamed("prob", "score").withColumn("score_type", F.lit("probability")))


@query("sel6_fitted_configuration")
def sel6_fitted(spark, sf_dir):
    """Best fitted family, configuration and strategy of each coordinate, by its three inner folds."""
    train, held = FS.inner_sets(embedding_latents(spark, sf_dir))
    return FS.select_configuration(FS.fitted_scores(train, held, FS.INNER))


@query("met13_fitted_variants")
def met13_fitted(spark, sf_dir):
    """Outer-test metrics of the families' baselines under each augmentation strategy, really fitted."""
    train, held = FS.outer_sets(embedding_latents(spark, sf_dir))
    return FS.variant_metrics(FS.fitted_scores(train, held, FS.OUTER, FS.BASELINES), FS.OUTER)


@query("exp5_native_importance")
def exp5(spark, sf_dir):
    train, held = _split(spark, sf_dir)
    _, model = Z.fit_score(train, held, "random_forest_bagged", 2)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(model.featureImportances.toArray())], "pos int, importance double")
    return rows.select("pos", F.element_at(names_col(), F.col("pos") + 1).alias("feature"), "importance")


# --- nested search, calibration, refit --------------------------------------------


@query("sel2_inner_search")
def sel2(spark, sf_dir):
    study = orders_study(spark, sf_dir)
    return study.summary.join(study.winners.select(*KEYS, F.col("candidate").alias("winner")), KEYS)


@query(
    "sel3_out_of_fold_predictions",
    f"""WITH cohort AS (SELECT o_orderkey::VARCHAR AS sample_id, (o_orderstatus = 'F')::INT AS y FROM orders), {folds_sql()}, {MEMBERS_SQL}
SELECT repeat_id, fold_id, count(*) AS n_rows, 0::BIGINT AS n_repeated, 0::BIGINT AS n_unknown, count(*) AS n_expected, true AS complete FROM members WHERE role = 'train' GROUP BY repeat_id, fold_id""",
)
def sel3(spark, sf_dir):
    """Completeness of the winners' out-of-fold rows against the outer train sets."""
    study = orders_study(spark, sf_dir)
    train = D.membership(D.repeated_kfold(orders_labels(spark, sf_dir))).filter("role = 'train'")
    return S.oof_violations(study.oof, KEYS, train, KEYS)


@query("fin1_final_refit")
def fin1(spark, sf_dir):
    study = orders_study(spark, sf_dir)
    return rounded(study.evaluation(orders_labels(spark, sf_dir)))


@query("cal1_cross_fitted_calibration")
def cal1(spark, sf_dir):
    return orders_study(spark, sf_dir).calibrators.filter("held >= 0")


@query("cal2_final_calibrator")
def cal2(spark, sf_dir):
    """Two-number fits on all scores of each fold of the scored orders."""
    return K.fit_sigmoid(cut_lineage(scored_orders(spark, sf_dir)), KEYS)


CAL_SQL = f"""WITH {SCORED_SQL}, ab AS (SELECT repeat_id, fold_id, 1 / stddev_pop(score) AS a, ln(avg(y) / (1 - avg(y))) - avg(score) / stddev_pop(score) AS b FROM scored GROUP BY ALL),
cal AS (SELECT s.repeat_id, s.fold_id, s.sample_id, s.y, round(1 / (1 + exp(-(a * score + b))), 6) AS prob FROM scored s JOIN ab USING (repeat_id, fold_id))"""


def calibrated_orders(spark, sf_dir):
    """Probabilities from a stored (a, b) per coordinate: unit slope in sd units, intercept from the prevalence."""
    rows = cut_lineage(scored_orders(spark, sf_dir).drop("prob"))
    rate = F.avg("y")
    ab = rows.groupBy(*KEYS).agg((1 / F.stddev_pop("score")).alias("a"), (F.log(rate / (1 - rate)) - F.avg("score") / F.stddev_pop("score")).alias("b"))
    return K.apply_sigmoid(rows, ab, KEYS).withColumn("prob", F.round("prob", 6))


@query("cal3_apply_calibrator", f"{CAL_SQL} SELECT repeat_id, fold_id, sample_id, prob FROM cal")
def cal3(spark, sf_dir):
    return calibrated_orders(spark, sf_dir).select(*KEYS, "sample_id", "prob")


@query(
    "cal4_calibration_diagnostics",
    f"{CAL_SQL} SELECT repeat_id, fold_id, round(avg((prob - y) * (prob - y)), 7) AS brier, round(-avg(CASE WHEN y = 1 THEN ln(prob) ELSE ln(1 - prob) END), 7) AS log_loss FROM cal GROUP BY repeat_id, fold_id",
)
def cal4(spark, sf_dir):
    return rounded(M.probability_losses(calibrated_orders(spark, sf_dir), KEYS), 7)


# --- saved refits ---------------------------------------------------------------


_STATES: dict = {}
DEPLOYED = (0, 0)  # the coordinate whose refit judges new rows


def study_state(spark, sf_dir):
    """The saved state table of the orders study, written once a session and read back."""
    from ..sources.sinks import scratch_path

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STATES:
        _STATES[key] = scratch_path(spark, "refits")
        MS.save_state(spark, MS.state_rows(orders_study(spark, sf_dir)), _STATES[key])
    return MS.load_state(spark, _STATES[key])


def refit_scores(spark, sf_dir):
    """Outer-test rows scored with the saved refits; the label column is not read."""
    table = orders_study(spark, sf_dir).table
    rows = table.select("sample_id", "x", F.posexplode("fold_of").alias("repeat_id", "fold_id")).withColumn("fold_id", F.col("fold_id").cast("int"))
    return MS.score_rows(rows, MS.models_of(study_state(spark, sf_dir)))


@query("fin2_refit_scoring")
def fin2_refit(spark, sf_dir):
    return rounded(refit_scores(spark, sf_dir).drop("z"))


TESTED_SQL = f"""WITH cohort AS (SELECT o_orderkey::VARCHAR AS sample_id, (o_orderstatus = 'F')::INT AS y FROM orders), {folds_sql()}, {MEMBERS_SQL}"""


@query("fin2_refit_equals_study", f"{TESTED_SQL} SELECT repeat_id, fold_id, count(*) AS n_rows, count(*) AS n_equal FROM members WHERE role <> 'train' GROUP BY repeat_id, fold_id")
def fin2_equal(spark, sf_dir):
    """The saved state gives the study's own outer predictions, row by row."""
    own = orders_study(spark, sf_dir).frozen.select(*KEYS, "sample_id", F.col("score").alias("s"), F.col("prob").alias("p"), F.col("predicted").alias("d"))
    both = refit_scores(spark, sf_dir).join(own, [*KEYS, "sample_id"], "full_outer")
    same = (F.abs(F.col("score") - F.col("s")) < 1e-5) & (F.abs(F.col("prob") - F.col("p")) < 1e-5) & (F.col("predicted") == F.col("d"))
    return both.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.coalesce(same, F.lit(False))).alias("n_equal"))


@query(
    "fin3_refit_prediction_check",
    f"{TESTED_SQL} SELECT repeat_id, fold_id, count(*) AS n_predictions, 0::BIGINT AS n_repeated_ids, true AS one_threshold, 0::BIGINT AS n_wrong_labels FROM members WHERE role <> 'train' GROUP BY repeat_id, fold_id",
)
def fin3_refit(spark, sf_dir):
    from ..operators.frozen import frozen_check

    return frozen_check(refit_scores(spark, sf_dir), KEYS)


@query("fin4_refit_state_identity")
def fin4_refit(spark, sf_dir):
    return MS.state_digests(study_state(spark, sf_dir))


def deployed_rows(rows, *keep):
    """Raw rows of the three modalities as input of the deployed refit, with what else is to stay beside them."""
    return rows.select(F.lit(DEPLOYED[0]).alias("repeat_id"), F.lit(DEPLOYED[1]).alias("fold_id"), "sample_id", F.concat(*MODALITIES).alias("x"), *keep)


def reliability_state(spark, sf_dir, models):
    """What the deployed refit needs to judge its own predictions, as one row.

    Mean, inverse covariance and distance limit of its training rows in the fused latent
    space, and the weights of five classifiers fitted on bootstrap draws of them.
    """
    from ..operators import reliability as Rl

    train = orders_study(spark, sf_dir).table.filter(F.col("fold_of")[DEPLOYED[0]] != DEPLOYED[1])
    z = MS.score_rows(train.select(F.lit(DEPLOYED[0]).alias("repeat_id"), F.lit(DEPLOYED[1]).alias("fold_id"), "sample_id", "x"), models).select("sample_id", "z")
    rows = cut_lineage(z.join(train.select("sample_id", "y"), "sample_id"))
    n, samples = rows.count(), None
    for b in range(5):
        drawn = D.bootstrap(rows, n, seed=100 + b).select(F.lit(b).alias("model_id"), "y", "z")
        samples = drawn if samples is None else samples.unionByName(drawn)
    weights, _ = L.fit_rows(cut_lineage(samples), ["model_id"])
    return Rl.distance_state(rows, [[float(v) for v in w] for _, w in sorted(weights.items())])


def saved_reliability(spark, sf_dir, models):
    """Folder of the written reliability state."""
    from ..sources import sinks

    path = sinks.scratch_path(spark, "trust")
    reliability_state(spark, sf_dir, models).write.parquet(path)
    return path


def judged_rows(spark, sf_dir, raw, models, trust_path=None, keep=()):
    """Report inputs of raw rows: probability, completeness, distance, disagreement, and signals of the refit's own latents.

    Rows without an id are not judged.  Everything is computed beside its row; ``keep`` names further columns of ``raw``.
    """
    from ..operators import contract as C, reliability as Rl

    trust_path = trust_path or saved_reliability(spark, sf_dir, models)
    state = study_state(spark, sf_dir).filter((F.col("repeat_id") == DEPLOYED[0]) & (F.col("fold_id") == DEPLOYED[1]))
    widths = state.first()["latent_widths"]
    edges, names, start = {}, [], 0
    for m, k in zip(MODALITIES, widths, strict=True):
        edges[m], start = (start, start + k), start + k
        names += [f"{LABELS[m]}_z{i:03d}" for i in range(k)]
    rows = deployed_rows(raw.filter("sample_id is not null"), C.completeness().alias("completeness"), *keep)
    scored = attach_row(MS.score_rows(rows, models, ("completeness", *keep)), state.select(F.col("coef").alias("_w")))
    told = Rl.with_saved_reliability(scored.withColumn("c", F.zip_with("z", "_w", lambda a, b: a * b)), spark.read.parquet(trust_path))
    return told.select(
        "sample_id",
        "prob",
        "completeness",
        C.missingness_band(F.col("completeness")).alias("quality"),
        "ood_risk",
        "disagreement",
        E.top_absolute(F.col("c"), F.array(*[F.lit(n) for n in names])).alias("top_signals"),
        F.transform(E.modality_totals(F.col("c"), edges), lambda t: t["modality"]).alias("dominant"),
        *keep,
    )


@query("rel7_refit_report")
def rel7_refit(spark, sf_dir):
    """Reports of all orders by the deployed refit, with its own signals and dominant modalities."""
    from ..operators import reliability as Rl

    models = MS.models_of(study_state(spark, sf_dir))
    return Rl.sample_report(judged_rows(spark, sf_dir, orders_cohort(spark, sf_dir).drop("y"), models))


@query("rel8_batch_inference")
def rel8(spark, sf_dir):
    """Saved refit read back, raw rows judged in batch and scored as a file stream; both results are compared."""
    from ..operators import reliability as Rl
    from ..sources import sinks
    from ..streaming.scoring import start_refit_scoring, stream_rows

    models = MS.models_of(study_state(spark, sf_dir))
    raw_path, out, mark = (sinks.scratch_path(spark, n) for n in ("raw", "out", "mark"))
    orders_cohort(spark, sf_dir).drop("y").write.parquet(raw_path)
    raw = spark.read.parquet(raw_path)
    start_refit_scoring(deployed_rows(stream_rows(spark, raw_path, raw.schema)), models, out, mark).awaitTermination()
    streamed = spark.read.parquet(out).select("sample_id", F.col("prob").alias("stream_prob"))
    # both sides meet before the reports are written out, so what is shuffled are raw rows and numbers
    met = judged_rows(spark, sf_dir, raw.join(streamed, "sample_id", "left"), models, keep=("stream_prob",))
    same = F.col("prob").eqNullSafe(F.col("stream_prob")).alias("stream_equal")
    return Rl.sample_report(met.withColumn("stream_equal", same), ("stream_equal",))


@query(
    "rel8_stream_reports",
    "SELECT o_orderkey::VARCHAR AS sample_id, 1::BIGINT AS n_reports, (o_orderpriority LIKE '1%')::BIGINT AS n_repeats, true AS equals_batch FROM orders",
)
def rel8_stream(spark, sf_dir):
    """Whole reports on a stream: urgent orders are delivered a second time and must be flagged, not reported again."""
    from ..operators import reliability as Rl
    from ..sources import sinks
    from ..streaming.scoring import start_reports, stream_rows

    models = MS.models_of(study_state(spark, sf_dir))
    trust = saved_reliability(spark, sf_dir, models)
    raw_path, out, mark = (sinks.scratch_path(spark, n) for n in ("raw", "out", "mark"))
    raw = orders_cohort(spark, sf_dir).drop("y")
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority like '1%'").select(F.col("o_orderkey").cast("string").alias("sample_id"))

    def report(rows):
        return Rl.sample_report(judged_rows(spark, sf_dir, rows, models, trust)).select("sample_id", "status", "report")

    for delivery in (raw, raw.join(urgent, "sample_id", "left_semi")):  # the second run continues from the first one's checkpoint
        delivery.write.mode("append").parquet(raw_path)
        start_reports(stream_rows(spark, raw_path, spark.read.parquet(raw_path).schema), report, out, mark).awaitTermination()
    again = report(raw).select("sample_id", F.struct("status", "report").alias("batch"))
    told = spark.read.parquet(f"{out}/reports").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_reports"), F.first(F.struct("status", "report")).alias("streamed"))
    repeats = spark.read.parquet(f"{out}/repeats").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_repeats"))
    return again.join(told, "sample_id", "full_outer").join(repeats, "sample_id", "full_outer").select(
        "sample_id", F.coalesce("n_reports", F.lit(0)).alias("n_reports"), F.coalesce("n_repeats", F.lit(0)).alias("n_repeats"), F.col("batch").eqNullSafe(F.col("streamed")).alias("equals_batch")
    )
