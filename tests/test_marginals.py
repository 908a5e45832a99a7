"""Quantile grids of the samplers: exact, from the values near the wanted ranks only."""

import numpy as np

from nestfold.operators import augment as G


def test_grids_are_exact_and_rank_few_values(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows, data = [], {}
    for k, n in ((1, 2000), (2, 7), (3, 1)):
        x = np.column_stack([rng.normal(size=n), rng.integers(0, 4, size=n), np.exp(3 * rng.normal(size=n)), np.full(n, 2.5)])
        data[(k,)] = x
        rows += [(k, [float(v) for v in r]) for r in x]
    df = spark.createDataFrame(rows, "k int, z array<double>").repartition(3)
    sizes, ranked = [], G.prefix_sums
    monkeypatch.setattr(G, "prefix_sums", lambda d, *a, **o: sizes.append(d.filter("pos = 0").count()) or ranked(d, *a, **o))
    grids = G.marginal_grids(df, ["k"])
    assert set(grids) == set(data)
    for key, x in data.items():
        assert np.allclose(grids[key], np.quantile(x, G.QUANTILE_GRID, axis=0).T, rtol=1e-12, atol=1e-12)
    assert 0 < sizes[0] < 700
    whole = G.marginal_grids(df.drop("k"), [])
    assert np.allclose(whole[()], np.quantile(np.concatenate(list(data.values())), G.QUANTILE_GRID, axis=0).T, rtol=1e-12, atol=1e-12)
