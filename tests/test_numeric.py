"""Preprocessing, metrics, thresholds, calibration and linear models on inline values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestfold.operators import calibrate as K, linear as L, metrics as M, preprocess as P, threshold as T
from nestfold.operators.threshold import differences

KEY = ["k"]


def scored(spark, y, s, name="score"):
    return spark.createDataFrame([(1, int(a), float(b)) for a, b in zip(y, s)], f"k int, y int, {name} double")


def cohort(spark, extra=()):
    """Train rows in fold 1, held-out rows in fold 0 of a single repeat."""
    rows = [("1", 0, 1.0, 10.0, 1), ("2", 1, 2.0, None, 1), ("3", 0, 3.0, 30.0, 1), ("h", 1, None, None, 0), *extra]
    return spark.createDataFrame(
        [(i, y, [a, b], [0.0, a], [1.0, 2.0], [f]) for i, y, a, b, f in rows],
        "sample_id string, y int, mge array<double>, mdm array<double>, mcna array<double>, fold_of array<int>",
    )


def fitted(df):
    state = P.fit(df, n_splits=2, n_repeats=1).filter("fold_id = 0 and modality = 'mge'").orderBy("pos").collect()
    return [(r["median"], r["mean"], r["variance"]) for r in state]


def test_fit_uses_train_median_and_population_variance(spark):
    got = fitted(cohort(spark))
    assert np.allclose(got, [(2, 2, 2 / 3), (20, 20, 200 / 3)])


def test_extreme_held_out_rows_do_not_change_the_fit(spark):
    wild = [("w1", 0, 1e6, -1e6, 0), ("w2", 1, -1e6, 1e6, 0)]
    assert np.allclose(fitted(cohort(spark, wild)), fitted(cohort(spark)))


def test_missing_held_out_cells_become_zero(spark):
    df = cohort(spark)
    stats = P.stats_arrays(P.fit(df, 2, 1))
    row = P.transform_held_out(df, stats).filter("sample_id = 'h'").first()
    assert row["mge"] == [0.0, 0.0]
    assert row["mcna"] == [0.0, 0.0]  # zero variance keeps x - mean


def test_even_median_is_the_middle_average(spark):
    rows = [(str(i), i % 2, v, v, 1) for i, v in enumerate([1.0, 2.0, 3.0, 10.0])] + [("h", 0, 0.0, 0.0, 0)]
    df = spark.createDataFrame(
        [(i, y, [a], [b], [b], [f]) for i, y, a, b, f in rows],
        "sample_id string, y int, mge array<double>, mdm array<double>, mcna array<double>, fold_of array<int>",
    )
    got = P.train_medians(df, 2, 1).filter("fold_id = 0 and modality = 'mge'").first()
    assert got["median"] == 2.5 and got["n_present"] == 4


def test_ranking_values(spark):
    row = M.ranking_metrics(scored(spark, [0, 0, 1, 1], [-2, -1, 1, 2]), KEY).first()
    assert (row["auprc"], row["auroc"]) == (1.0, 1.0)
    row = M.ranking_metrics(scored(spark, [1, 0, 1, 0, 1, 0], [0.9, 0.8, 0.7, 0.7, 0.3, 0.1]), KEY).first()
    assert round(row["auprc"], 3) == 0.700 and round(row["auroc"], 4) == 0.6111


def test_ranking_is_null_for_one_class(spark):
    row = M.ranking_metrics(scored(spark, [1, 1], [0.2, 0.3]), KEY).first()
    assert row["auprc"] is None and row["auroc"] is None


@pytest.mark.parametrize("y, s", [([1, 1], [0.1, 0.2]), ([0, 1], [float("nan"), 1.0]), ([0, 2], [0.1, 0.2])])
def test_strict_metrics_reject_bad_input(spark, y, s):
    with pytest.raises(ValueError):
        M.require_valid(scored(spark, y, s), KEY)


def test_confusion_and_mcc(spark):
    df = scored(spark, [0, 0, 1, 1], [-2, -1, 1, 2])
    row = M.threshold_metrics(df, KEY, F.col("score") >= 0).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"], row["mcc"]) == (2, 0, 0, 2, 1.0)
    row = M.threshold_metrics(df, KEY, F.col("score") >= -9).first()
    assert row["specificity"] == 0.0 and row["mcc"] == 0.0


def test_threshold_candidates(spark):
    got = [r["threshold"] for r in T.threshold_candidates(scored(spark, [0, 0, 1, 1], [0.2, 0.2, 1.0, 0.0], "prob"), KEY).orderBy("threshold").collect()]
    assert got == [0.0, 0.2, 1.0]


def brute_threshold(y, p):
    best = None
    for t in sorted({0.0, *p}):
        pred = p >= t
        sens = (pred & (y == 1)).sum() / (y == 1).sum()
        spec = (~pred & (y == 0)).sum() / (y == 0).sum()
        key = (-(sens + spec) / 2, -sens, abs(t - 0.5), t)
        best = key if best is None or key < best else best
    return best[3]


def test_threshold_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    for n in (7, 60, 400):
        y = np.r_[0, 1, rng.integers(0, 2, n)]
        p = np.round(rng.random(n + 2), 2)
        got = T.choose_threshold(scored(spark, y, p, "prob"), KEY).first()["threshold"]
        assert got == brute_threshold(y, p)


def test_mean_roc_equals_interpolation(spark):
    rng = np.random.default_rng(2)
    rows, curves = [], []
    for fold in range(3):
        y = np.r_[0, 1, rng.integers(0, 2, 40)]
        s = np.round(rng.normal(size=42) + y * 0.5, 1)
        rows += [(fold, int(a), float(b)) for a, b in zip(y, s)]
        cut = np.unique(s)[::-1]
        fpr = np.r_[0, [((s >= c) & (y == 0)).sum() / (y == 0).sum() for c in cut]]
        tpr = np.r_[0, [((s >= c) & (y == 1)).sum() / (y == 1).sum() for c in cut]]
        curves.append(np.interp(np.linspace(0, 1, 100), fpr, tpr))
    df = spark.createDataFrame(rows, "fold int, y int, score double")
    got = M.mean_roc(M.ranked_scores(df, ["fold"]), ["fold"]).orderBy("g").toPandas()
    assert np.allclose(got["mean_tpr"], np.mean(curves, 0)) and (got["n_folds"] == 3).all()


def test_sigmoid_fit_reaches_the_optimum(spark):
    rng = np.random.default_rng(1)
    s = rng.normal(size=600) * 3 + 2
    y = (rng.random(600) < 1 / (1 + np.exp(-(0.7 * s - 1)))).astype(int)
    row = K.fit_sigmoid(scored(spark, y, s), KEY).first()
    p = 1 / (1 + np.exp(-(row["a"] * s + row["b"])))
    assert row["converged"] and abs((p - y).sum()) < 1e-3 and abs(((p - y) * s).sum()) < 1e-3


def test_separable_scores_end_and_single_class_fails(spark):
    row = K.fit_sigmoid(scored(spark, [0, 0, 1, 1], [-2, -1, 1, 2]), KEY, max_steps=40).first()
    assert np.isfinite(row["a"]) and row["a"] > 1
    with pytest.raises(ValueError, match="both classes"):
        K.fit_sigmoid(scored(spark, [1, 1], [0.0, 1.0]), KEY)


def test_cross_fit_excludes_the_held_fold(spark):
    rng = np.random.default_rng(7)
    rows = [(1, f, int(rng.random() < 0.3 + 0.4 * (s > 0)), float(s)) for f in range(3) for s in rng.normal(size=80)]
    df = spark.createDataFrame(rows, "k int, inner_fold_id int, y int, score double")
    flipped = df.withColumn("y", F.when(F.col("inner_fold_id") == 0, 1 - F.col("y")).otherwise(F.col("y")))
    a, b = (K.cross_fit(d, KEY).filter("held = 0").first() for d in (df, flipped))
    assert np.isclose(a["a"], b["a"]) and np.isclose(a["b"], b["b"])


def test_logistic_matches_a_direct_solution_for_all_keys(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    y = (rng.random(200) < 1 / (1 + np.exp(-x @ [1, -1, 0.5]))).astype(int)
    rows = [(i % 2, int(t), [float(v) for v in z]) for i, (z, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k int, y int, z array<double>").repartition(5)
    weights, log = L.fit_rows(df, KEY, (0.1, 10.0))
    for (key, c), w in weights.items():
        part = np.arange(200) % 2 == key
        d = np.column_stack([x[part], np.ones(part.sum())])
        p = 1 / (1 + np.exp(-d @ w))
        assert np.abs(w + c * d.T @ (p - y[part])).max() < 1e-6
    assert len(weights) == 4
    states = L.convergence(L.log_frame(spark, log)).collect()
    assert all(r["status"] == "converged" for r in states)


def test_unfinished_fits_are_told_apart(spark):
    rng = np.random.default_rng(4)
    rows = [(0, int(v > 0.3), [float(v), float(w)]) for v, w in rng.normal(size=(80, 2))]
    df = spark.createDataFrame(rows, "k int, y int, z array<double>")
    for steps, state in ((1, "iteration_limit"), (2, "iteration_limit"), (50, "converged")):
        _, log = L.fit_rows(df, KEY, (10.0,), max_iter=steps)
        found = L.convergence(L.log_frame(spark, log), max_iter=steps).first()
        assert found["status"] == state and found["hit_limit"] == (state == "iteration_limit")
        assert bool(L.unconverged(log)) == (state != "converged")
    last_step = len(log)
    assert L.convergence(L.log_frame(spark, log), max_iter=last_step).first()["status"] == "converged"


def test_differences_report_changed_rows(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.25)], "k int, v double")
    b = spark.createDataFrame([(1, 0.5), (2, 0.75)], "k int, v double")
    assert differences(a, a, KEY).count() == 0 and differences(a, b, KEY).count() == 2


def test_number_text_is_exact_and_never_overflows(spark):
    import math

    from nestfold.operators.identity import number_text

    values = [0.0, -0.0, 1.0, 2.0, 0.5, 3.0, 1e-12, 1e-12 + 2e-28, 2e10, 2e10 + 4e-6, 9.3e9, -1.5, 1e300, 5e-324, 2.0**52, 2.0**53 - 1, 8.0, 0.1, 1 / 3, 2.0**-1022]
    values += [math.nextafter(2.0**k, d) for k in range(-30, 31) for d in (0, math.inf)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", number_text(F.col("x")).alias("t")).collect()
    assert len({r.t for r in rows}) == len(set(values))
    for r in rows:
        if r.x:
            m, e = r.t.split("b")
            assert 2**52 <= abs(int(m)) < 2**53 and math.ldexp(int(m), int(e) - 52) == r.x
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "x double").select(number_text(F.col("x")).alias("t"))
    assert [r.t for r in odd.collect()] == ["null", "NaN", "Infinity"]


def test_recount_sees_a_wrong_choice(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(rng.random() < 0.4), float(np.round(rng.random(), 2))) for k in range(2) for _ in range(150)]
    scored = spark.createDataFrame(rows, "k int, y int, prob double")
    chosen = T.choose_threshold(scored, ["k"])
    assert [r["equal"] for r in T.recount(scored, chosen, ["k"]).collect()] == [True, True]
    for column, change in (("threshold", 0.25), ("tp", 1), ("balanced_accuracy", 1e-6)):
        wrong = chosen.withColumn(column, F.when(F.col("k") == 1, F.col(column) + change).otherwise(F.col(column)))
        assert {r["k"]: r["equal"] for r in T.recount(scored, wrong, ["k"]).collect()} == {0: True, 1: False}
