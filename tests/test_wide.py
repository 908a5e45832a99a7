"""The randomised encoder against exact principal components."""

import numpy as np
import pytest

from nestfold.operators import wide as W


def sparse(spark, x):
    rows = [([int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for r in x]
    return spark.createDataFrame(rows, "idx array<int>, val array<double>").repartition(5)


def exact(x, k):
    var = x.var(0)
    z = (x - x.mean(0)) / np.where(var < 1e-12, 1.0, np.sqrt(np.maximum(var, 1e-300)))
    s = np.linalg.svd(z, compute_uv=False) ** 2 / len(x)
    return s[:k], (s.sum() - s[:k].sum()) / x.shape[1]


def test_small_width_equals_exact_components(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 6)) @ r.normal(size=(6, 40)) + 0.5 * r.normal(size=(600, 40)) + 3
    x[:, 7] = 2.0  # a constant feature
    x[r.random(x.shape) < 0.3] = 0
    x[:, 7] = 2.0
    values, error = exact(x, 8)
    m = W.fit_wide(sparse(spark, x), 40, 8)
    # six directions stand out, the others are as good as equal: there only the error is bound
    assert m.n == 600 and np.allclose(m.variance[:6], values[:6], rtol=0.01) and abs(m.error - error) <= 0.01 * error
    assert np.allclose(m.loadings.T @ m.loadings, np.eye(8), atol=1e-8) and not m.loadings[7].any() and m.scale[7] == 1
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, x array<double>")
    z = {q.id: q.z for q in W.encode_wide(df.select("id", *W.sparse_cells(df["x"])), m, "id").collect()}
    want = (x - m.mean) / m.scale @ m.loadings
    assert np.allclose([z[i] for i in range(600)], want)


def test_twenty_thousand_features(spark):
    r = np.random.default_rng(5)
    group, owner = r.integers(0, 4, 160), r.integers(0, 4, 20_000)  # features of four groups of rows: three directions stand out
    x = np.where((owner[None, :] == group[:, None]) & (r.random((160, 20_000)) < 0.25), r.normal(size=(160, 20_000)) + 5, 0.0)
    values, error = exact(x, 6)
    m = W.fit_wide(sparse(spark, x), 20_000, 6)
    assert m.loadings.shape == (20_000, 6) and abs(m.error - error) <= 0.01 * error
    assert np.allclose(m.variance[:3], values[:3], rtol=0.01) and values[2] > 2 * values[3]


def test_refusals(spark):
    rows = sparse(spark, np.ones((3, 4)))
    with pytest.raises(ValueError, match="between 1"):
        W.fit_wide(rows, 4, 5)
    with pytest.raises(ValueError, match="no rows"):
        W.fit_wide(rows.limit(0), 4, 2)
