"""The nested study end to end on a small cohort, checked against direct NumPy computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestfold.operators import folds as D
from nestfold.plans import nested as N

WIDTHS = (6, 5, 4)


def make(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    hidden = rng.normal(size=(n, 3))
    x = hidden @ rng.normal(size=(3, sum(WIDTHS))) + 0.3 * rng.normal(size=(n, sum(WIDTHS))) + 5
    y = (hidden[:, 0] + 0.5 * rng.normal(size=n) > 0.6).astype(int)
    x[rng.random(x.shape) < 0.03] = np.nan
    edges = np.cumsum([0, *WIDTHS])
    rows = []
    for i in range(n):
        parts = [[None if np.isnan(v) else float(v) for v in x[i, a:b]] for a, b in zip(edges[:-1], edges[1:])]
        rows.append((f"P{i:04d}", int(y[i]), *parts))
    df = spark.createDataFrame(rows, "sample_id string, y int, mge array<double>, mdm array<double>, mcna array<double>")
    return df, x, y


LAYOUT = N.Layout(WIDTHS, n_repeats=1, n_splits=2, n_inner=2, ratios=(0.5, 0.75), cs=(0.1, 1.0))


@pytest.fixture(scope="module")
def prepared(spark):
    df, x, y = make(spark)
    outer = D.repeated_kfold(df, 2, 1)
    inner = D.inner_folds(outer, 2, 2)
    rows = df.select("sample_id", "y", F.concat("mge", "mdm", "mcna").alias("x"))
    grid = F.sequence(F.lit(0), F.lit(1))
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("fold_id").alias("k"), F.col("inner_fold_id").alias("v"))))
    inner_of = inner.groupBy("sample_id").agg(entries.alias("m")).select("sample_id", F.transform(grid, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(-1))).alias("inner_of"))
    table = N.cut_lineage(rows.join(D.fold_arrays(outer), "sample_id").join(inner_of, "sample_id").repartition(5))
    return df, x, y, table


def members(table, s):
    pdf = table.toPandas().sort_values("sample_id")
    folds = np.vstack(pdf["fold_of"].to_numpy())
    inner = np.vstack(pdf["inner_of"].to_numpy())
    return LAYOUT.train(folds, inner, s)


def test_sets_equal_direct_fits(prepared):
    df, x, y, table = prepared
    models = N.fit_sets(table, LAYOUT)
    assert len(models) == 2 + 4
    for s, m in models.items():
        keep = members(table, s)
        train = x[keep]
        med = np.nanmedian(train, 0)
        filled = np.where(np.isnan(train), med, train)
        assert m.n == keep.sum()
        assert np.allclose(m.mean, filled.mean(0), atol=1e-8)
        assert np.allclose(m.scale, filled.std(0), atol=1e-8)
        z = (filled - filled.mean(0)) / filled.std(0)
        values = np.linalg.eigvalsh(np.cov(z[:, :6], rowvar=False, ddof=0))[::-1]
        assert np.allclose(m.eigen[:5], values[:5], atol=1e-6)
        minority = m.encode(train[y[keep] == m.minority])
        assert np.allclose(m.minority_mean, minority.mean(0), atol=1e-4)
        assert np.allclose(m.minority_sd, minority.std(0), atol=1e-4)


def test_held_out_rows_do_not_touch_the_fit(spark, prepared):
    df, x, y, table = prepared
    wild = table.withColumn(
        "x", F.when(F.col("fold_of")[0] == 0, F.transform("x", lambda v: v * 1e5)).otherwise(F.col("x"))
    )
    a, b = N.fit_sets(table, LAYOUT), N.fit_sets(N.cut_lineage(wild), LAYOUT)
    for s in a:
        if s[1] == 0:  # fold 0 is held out here
            assert np.allclose(a[s].mean, b[s].mean, rtol=1e-6) and np.allclose(a[s].scale, b[s].scale, rtol=1e-5)


def test_study_is_complete_and_calibrated(spark, prepared, monkeypatch):
    df, x, y, table = prepared
    monkeypatch.setattr(N, "study_table", lambda cohort: table)
    study = N.run(df, LAYOUT)
    assert study.summary.count() == 2 * 4 and study.winners.count() == 2
    assert study.oof.count() == sum(members(table, (0, f, -1)).sum() for f in range(2))
    assert study.oof.groupBy("fold_id", "sample_id").count().filter("count > 1").count() == 0
    assert study.frozen.count() == len(y) and "y" not in study.frozen.columns
    ev = study.evaluation(df.select("sample_id", "y")).collect()
    assert all(r["raw_auroc"] > 0.75 for r in ev)
    grads = {}
    for k, step, _, g in study.fit_log:
        grads[k] = g
    assert max(grads.values()) < 1e-2
    again = N.run(df, LAYOUT)
    a = {r["sample_id"]: round(r["score"], 6) for r in study.frozen.collect()}
    b = {r["sample_id"]: round(r["score"], 6) for r in again.frozen.collect()}
    assert a == b


def test_stop_errors_follow_from_the_gram(prepared):
    df, x, y, table = prepared
    errors = []
    models = N.fit_sets(table, LAYOUT, errors)
    s = (0, 1, -1)
    m = models[s]
    held = ~members(table, s)
    filled = np.where(np.isnan(x[held]), m.median, x[held])
    z = (filled - m.mean) / m.scale
    w = m.loadings[:6, :3]
    want = ((z[:, :6] - z[:, :6] @ w @ w.T) ** 2).mean()
    got = next(e[-1] for e in errors if e[:3] == s and e[3] == "held" and e[4] == "mge" and e[5] == 0.5)
    assert np.isclose(got, want, rtol=1e-6)


def test_saved_state_gives_the_studys_predictions(spark, prepared, monkeypatch, tmp_path):
    from nestfold.operators import model_state as MS

    df, x, y, table = prepared
    monkeypatch.setattr(N, "study_table", lambda cohort: table)
    study = N.run(df, LAYOUT)
    path = str(tmp_path / "state")
    state = MS.save_state(spark, MS.state_rows(study), path)
    rows = table.select("sample_id", "x", F.posexplode("fold_of").alias("repeat_id", "fold_id")).withColumn("fold_id", F.col("fold_id").cast("int"))
    scored = MS.score_rows(rows, MS.models_of(state))
    own = {(r.repeat_id, r.fold_id, r.sample_id): r for r in study.frozen.collect()}
    got = {(r.repeat_id, r.fold_id, r.sample_id): r for r in scored.collect()}
    assert own.keys() == got.keys()
    for k, r in own.items():
        assert np.isclose(got[k].score, r.score, atol=1e-6) and np.isclose(got[k].prob, r.prob, atol=1e-6)
        assert got[k].threshold == r.threshold and got[k].predicted == r.predicted
    digests = {(r.repeat_id, r.fold_id): r.state_sha256 for r in MS.state_digests(state).collect()}
    changed = state.withColumn("loadings", F.transform("loadings", lambda v, i: F.transform(v, lambda w, j: F.when((i == 0) & (j == 0), w + 1e-9).otherwise(w))))
    assert digests == {(r.repeat_id, r.fold_id): r.state_sha256 for r in MS.state_digests(state.repartition(3)).collect()}
    assert not set(digests.values()) & {r.state_sha256 for r in MS.state_digests(changed).collect()}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        MS.save_state(spark, MS.state_rows(study), path)
    state.withColumn("state_version", F.lit("other")).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="no model state"):
        MS.load_state(spark, str(tmp_path / "other"))
    with pytest.raises(Exception, match="no saved model"):
        MS.score_rows(rows.withColumn("fold_id", F.lit(9)), MS.models_of(state)).collect()


def test_minority_marginals_keep_their_tails(spark, prepared):
    """No value is cut, ends are exact, and a quantile's rank is within the stated error."""
    df, x, y, table = prepared
    far = table.withColumn("x", F.when(F.col("sample_id").isin("P0003", "P0040", "P0041"), F.transform("x", lambda v: v * 40)).otherwise(F.col("x")))
    far = N.cut_lineage(far)
    models = N.fit_sets(far, LAYOUT)
    N.fit_marginals(far, LAYOUT, models)
    pdf = far.toPandas().sort_values("sample_id")
    cells = np.vstack(pdf["x"].to_numpy()).astype(float)
    label = pdf["y"].to_numpy()
    for s, m in models.items():
        z = m.encode(cells[members(far, s) & (label == m.minority)])
        assert np.allclose(m.grid[:, 0], z.min(0), rtol=1e-6, atol=1e-6) and np.allclose(m.grid[:, -1], z.max(0), rtol=1e-6, atol=1e-6)
        assert m.rank_error <= 3 / len(z)  # three rows in the fullest cell
        for j in range(z.shape[1]):
            below = (z[:, j][None, :] < m.grid[j][:, None] - 1e-9).mean(1)
            upto = (z[:, j][None, :] <= m.grid[j][:, None] + 1e-9).mean(1)
            assert (below <= np.array(N.QUANTILE_GRID) + m.rank_error + 1e-9).all() and (upto >= np.array(N.QUANTILE_GRID) - m.rank_error - 1e-9).all()
    assert max(np.abs((m.grid - m.minority_mean[:, None]) / m.minority_sd[:, None]).max() for m in models.values()) > 5


@pytest.mark.parametrize("kind", ["normal", "cauchy", "two_scales"])
def test_refined_cells_hold_few_rows(kind):
    r = np.random.default_rng(1)
    v = {"normal": r.normal(size=50_000), "cauchy": r.standard_cauchy(50_000), "two_scales": np.append(r.normal(size=25_000) * 1e-3, r.normal(size=25_000) * 1e3)}[kind]
    edges = np.sinh(np.linspace(np.arcsinh(v.min()), np.arcsinh(v.max()), N.HISTOGRAM_CELLS + 1))
    edges[[0, -1]] = v.min(), v.max()
    for _ in range(N.REFINEMENTS):
        counts = np.histogram(v, edges)[0]
        assert counts.sum() == len(v) and edges[0] == v.min() and edges[-1] == v.max()
        if N._fullest(edges[:, None], counts[:, None]) <= N.RANK_ERROR:
            break
        edges = N._refined(edges, counts)
    assert N._fullest(edges[:, None], np.histogram(v, edges)[0][:, None]) <= N.RANK_ERROR


@pytest.mark.parametrize("range_rows", [10**9, 30])
def test_packed_ranks_equal_the_row_by_row_ones(spark, prepared, range_rows):
    from nestfold.operators import metrics as M

    df, x, y, table = prepared
    models = N.fit_sets(table, LAYOUT)
    N.fit_marginals(table, LAYOUT, models)
    N.fit_latent_scalers(spark, LAYOUT, models)
    inner, candidates = list(LAYOUT.sets(outer=False)), [(0, 0.5, 1.0), (1, 0.75, 0.1)]
    rng = np.random.default_rng(1)
    weights = {N.candidate_name(s, r, c): rng.normal(size=len(LAYOUT.columns[r]) + 1) for s in inner for _, r, c in candidates}
    weights[N.candidate_name(inner[0], 0.5, 1.0)][:] = 0  # all scores tie
    plan = {s: candidates for s in inner}
    keys = ["repeat_id", "fold_id", "candidate", "inner_fold_id"]
    want = M.ranking_metrics(N.held_out_scores(table, LAYOUT, models, weights, plan), keys).orderBy(*keys).collect()
    got = N.ranked_candidates(table, LAYOUT, models, weights, plan, range_rows).orderBy(*keys).collect()
    assert len(got) == len(want) == 8
    for a, b in zip(got, want):
        assert [a[c] for c in (*keys, "n_pos", "n_neg")] == [b[c] for c in (*keys, "n_pos", "n_neg")]
        assert np.isclose(a["auprc"], b["auprc"], atol=1e-12) and np.isclose(a["auroc"], b["auroc"], atol=1e-12)


def test_synthetic_blocks_keep_their_tasks(spark):
    """A handful of small rows, but each is 4,096 draws: they must not be joined into one task."""
    from types import SimpleNamespace

    blocks = N.synthetic_blocks(spark, {(0, f, -1): SimpleNamespace(needed=200_000) for f in range(4)})
    used = blocks.select(F.spark_partition_id().alias("p"), "size").groupBy("p").agg(F.sum("size").alias("n")).collect()
    assert sum(r["n"] for r in used) == 800_000 and len(used) > 1
    assert max(r["n"] for r in used) < 400_000


def test_partial_sums_of_any_length_add_up(spark):
    from nestfold.operators import linear as L

    parts = spark.createDataFrame([(k, [float(i + j) for i in range(n)]) for j in range(3) for k, n in (("a", 1), ("b", L.PIECE), ("c", 2 * L.PIECE + 3))], L.SUM_SCHEMA)
    sums = L.sum_partials(parts)
    assert {k: len(v) for k, v in sums.items()} == {"a": 1, "b": L.PIECE, "c": 2 * L.PIECE + 3}
    assert all((v == 3 * np.arange(len(v)) + 3).all() for v in sums.values())


def test_medians_shuffle_the_values_around_the_middle_only(spark, monkeypatch):
    """Far tails, ties and gaps: exact medians of every set, from a few of the rows."""
    rng = np.random.default_rng(3)
    n = 3000
    x = np.column_stack([rng.normal(size=n), rng.integers(1, 8, size=n), np.exp(20 * rng.normal(size=n)), np.where(rng.random(n) < 0.5, -1e307, 1e307)])
    x[rng.random(x.shape) < 0.1] = np.nan
    fold, inner = rng.integers(0, 2, size=n), rng.integers(0, 2, size=(n, 2))
    inner[np.arange(n), fold] = -1
    rows = [([None if np.isnan(v) else float(v) for v in r], 0, [int(f)], [int(v) for v in i]) for r, f, i in zip(x, fold, inner)]
    table = spark.createDataFrame(rows, "x array<double>, y int, fold_of array<int>, inner_of array<int>").repartition(3)
    cut, sizes = N.cut_lineage, []
    monkeypatch.setattr(N, "cut_lineage", lambda df: sizes.append(df.count()) or cut(df))
    monkeypatch.setattr(N, "MEDIAN_ROWS", 50)
    found = N.set_medians(table, LAYOUT, [0, 1, 2, 3])
    for s, medians in found.items():
        keep = LAYOUT.train(fold[:, None], inner, s)
        for j, m in medians.items():
            values = np.sort(x[keep & ~np.isnan(x[:, j]), j])
            k = len(values)
            assert m == np.mean([values[(k + 1) // 2 - 1], values[k // 2]]), (s, j)
    assert len(found) == 6 and all(len(m) == 4 for m in found.values())
    assert sum(sizes) < n
