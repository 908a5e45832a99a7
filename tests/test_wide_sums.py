"""Sparse products of the wide encoder add up columns, not single cells."""

import numpy as np

from nestfold.operators import wide as W


def test_products_of_cells_equal_dense_ones(monkeypatch):
    r = np.random.default_rng(1)
    dense = np.where(r.random((30, 50)) < 0.2, r.normal(size=(30, 50)), 0.0)
    dense[[0, 7]] = 0.0  # rows without cells
    row, idx = np.nonzero(dense)
    mix = r.permutation(len(row))
    right, mean = r.normal(size=(50, 4)), r.normal(size=50)

    class NoScatter:
        at = None  # a call of np.add.at fails

    monkeypatch.setattr(W.np, "add", NoScatter, raising=True)
    got = W._times(idx[mix], dense[row, idx][mix], row[mix], 30, right, mean)
    monkeypatch.undo()
    assert np.allclose(got, (dense - mean) @ right)
    assert W._times(idx[:0], np.zeros(0), row[:0], 3, right, mean).shape == (3, 4)
