"""The study's passes: packed scores give the row-by-row results, and no step copies rows."""

import numpy as np
import pytest

from nestfold.operators import calibrate as K, linear as L, threshold as T

PLACES = [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(5)
    rows, blocks = [], []
    for k, (key, fold) in enumerate(PLACES):
        for n in (40, 1, 25):  # several blocks a group
            s = np.round(rng.normal(size=n), 1)  # ties
            y = (rng.random(n) < 1 / (1 + np.exp(-s))).astype(int)
            rows += [(key, fold, int(a), float(b)) for a, b in zip(y, s)]
            blocks.append(tuple(bytearray(v) for v in K.block_row([k], s, y)))
    df = spark.createDataFrame(rows, "k int, inner_fold_id int, y int, score double")
    return df, spark.createDataFrame(blocks, K.BLOCK_SCHEMA).repartition(4)


def test_packed_calibrators_and_thresholds_equal_those_of_rows(scores):
    df, blocks = scores
    names = ["k", "held"]
    want = {tuple(r[n] for n in names): r for r in K.cross_fit(df, ["k"]).collect()}
    fitted = K.cross_fit_blocks(blocks, PLACES, [("k", "int")])
    got = {tuple(r[n] for n in names): r for r in fitted.collect()}
    assert got.keys() == want.keys() and len(got) == 8
    for at, r in want.items():
        assert np.isclose(got[at].a, r.a, atol=1e-9) and np.isclose(got[at].b, r.b, atol=1e-9) and (got[at].steps, got[at].converged) == (r.steps, r.converged)
    ab = [(got[p].a, got[p].b) for p in PLACES]
    want = T.choose_threshold(K.cross_fitted_probabilities(df, fitted, ["k"]), ["k"]).orderBy("k").collect()
    for range_rows in (10**9, 20):
        chosen = T.choose_from_blocks(blocks, [p[:1] for p in PLACES], ab, [("k", "int")], range_rows).orderBy("k").collect()
        for a, b in zip(chosen, want, strict=True):
            assert np.allclose(list(a), list(b), atol=1e-12)


def test_calibration_copies_no_row(scores, monkeypatch):
    """A row counts for three calibrators; its block is written once."""
    df, _ = scores
    cut, seen = K.cut_lineage, []
    monkeypatch.setattr(K, "cut_lineage", lambda d: seen.append(cut(d)) or seen[-1])
    K.cross_fit(df, ["k"]).collect()
    assert len(seen) == 1 and sum(len(r.score) // 8 for r in seen[0].collect()) == df.count()


def test_many_keys_in_one_block(spark):
    rng = np.random.default_rng(6)
    rows = [(f"k{i % 50}", int(rng.random() < 0.5), float(rng.normal())) for i in range(3000)]
    df = spark.createDataFrame([*rows, ("k0", None, 1.0), ("k0", 1, None)], "k string, y int, score double").coalesce(1)
    for r in K.fit_sigmoid(df, ["k"]).collect():
        s, y = (np.array(v) for v in zip(*[(c, b) for a, b, c in rows if a == r["k"]]))
        p = 1 / (1 + np.exp(-(r["a"] * s + r["b"])))
        assert r["converged"] and abs((p - y).sum()) < 1e-4 and abs(((p - y) * s).sum()) < 1e-4


@pytest.mark.parametrize("known", [False, True])
def test_newton_sums_equal_weights_once(monkeypatch, known):
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.normal(size=(500, 3)), np.ones(500)])
    y = (rng.random(500) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    cs = {"low": 0.1, "mid": 1.0, "high": 10.0}
    asked = []

    def step(current):
        asked.append(len(current))
        return {k: L.block_sums(x, y, None, w) for k, w in current.items()}

    monkeypatch.setattr(L, "sum_partials", lambda sums: sums)
    alone, _ = L.newton(step, dict.fromkeys(cs, 4), cs, tol=1e-9)
    before, asked[:] = sum(asked), []
    zero = {"rows": L.block_sums(x, y, None, np.zeros(4))} if known else None
    shared, log = L.newton(step, dict.fromkeys(cs, 4), cs, tol=1e-9, share=dict.fromkeys(cs, "rows"), zero=zero)
    assert not L.unconverged(log, 1e-8) and all(np.allclose(shared[k], alone[k], atol=1e-8) for k in cs)
    assert asked[: 1 if known else 2] == [1] * (1 if known else 2) and sum(asked) <= before


def test_log_of_sums():
    e = np.random.default_rng(8).random(3000)
    assert np.isclose(L.log_of_sums(e), np.log1p(e).sum()) and L.log_of_sums(e[:0]) == 0.0 and np.isclose(L.log_of_sums(np.ones(2000)), 2000 * np.log(2))


def test_saved_reliability_is_computed_on_arrays(spark):
    from nestfold.operators import reliability as R

    rng = np.random.default_rng(9)
    z, mean, inverse, members = rng.normal(size=(50, 3)), rng.normal(size=3), np.eye(3) + 0.1, rng.normal(size=(5, 4))
    state = spark.createDataFrame([(mean.tolist(), inverse.tolist(), 2.0, members.tolist())], "ood_mean array<double>, ood_inverse array<array<double>>, ood_threshold double, members array<array<double>>")
    rows = spark.createDataFrame([(f"s{i}", v.tolist(), [1.0, None]) for i, v in enumerate(z)], "sample_id string, z array<double>, c array<double>")
    told = R.with_saved_reliability(rows, state)
    assert "zip_with" not in told._jdf.queryExecution().optimizedPlan().toString()
    got = {r.sample_id: r for r in told.collect()}
    gap = z - mean
    distance = np.sqrt(np.einsum("ij,jk,ik->i", gap, inverse, gap))
    probs = 1 / (1 + np.exp(-(z @ members[:, :3].T + members[:, 3])))
    for i in range(50):
        r = got[f"s{i}"]
        assert np.isclose(r.distance, distance[i]) and np.isclose(r.disagreement, probs[i].std()) and r.c == [1.0, None]
        assert r.ood_risk == ("high" if distance[i] >= 2 else "moderate" if distance[i] >= 1.7 else "low")


def test_reports_are_written_without_a_join(spark):
    from nestfold.operators import model_state as MS, reliability as R

    rows = spark.createDataFrame([(0, 0, f"s{i}", [float(i), -1.0], i / 10, None) for i in range(5)], "repeat_id int, fold_id int, sample_id string, x array<double>, completeness double, seen double")
    refit = MS.Refit(np.zeros(2), np.zeros(2), np.ones(2), np.eye(2), np.zeros(2), np.ones(2), np.ones(2), 0.0, 1.0, 0.0, 0.5)
    got = {r.sample_id: r for r in MS.score_rows(rows, {(0, 0): refit}, ("completeness", "seen")).collect()}
    assert all(got[f"s{i}"].completeness == i / 10 and got[f"s{i}"].seen is None and np.isclose(got[f"s{i}"].score, i - 1) for i in range(5))
    cells = "sample_id string, prob double, completeness double, quality string, ood_risk string, disagreement double, top_signals array<struct<f:string>>, dominant array<string>, extra boolean"
    told = R.sample_report(spark.createDataFrame([("a", 0.9, 1.0, "none", "low", 0.0, [], [], True)], cells), ("extra",)).first()
    assert told.status == "Reliable" and told.extra is True


def test_rows_without_a_label_count_for_the_curvature_only():
    rng = np.random.default_rng(10)
    s, y = rng.normal(size=90), (rng.random(90) < 0.4).astype(float)
    y[::9] = np.nan
    known = ~np.isnan(y)
    for c in (None, np.zeros(90, dtype=int)):
        got = np.ravel(K._block_sums(s, y, 1.5, -0.2, 0.1, 2.0, c, 1))
        own = np.ravel(K._block_sums(s[known], y[known], 1.5, -0.2, 0.1, 2.0))
        p = 1 / (1 + np.exp(-(1.5 * (s - 0.1) / 2.0 - 0.2)))
        assert np.allclose(got[[0, 1, 5, 6]], own[[0, 1, 5, 6]]) and np.isclose(got[2], (p * (1 - p)).sum())
