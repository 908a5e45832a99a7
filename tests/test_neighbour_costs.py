"""Block join of neighbours: what a task sends on at once does not grow with the blocks."""

import numpy as np

from nestfold.operators import neighbours as N


def test_pivots_follow_the_largest_key(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i % 2, str(i), [float(v) for v in rng.standard_normal(6)]) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, sample_id string, z array<double>")
    assert len(N._pivots(df, ["k"])) == 1  # 64 before: every row was sent to 64 blocks of a few rows
    monkeypatch.setattr(N, "BLOCK_ROWS", 30)
    monkeypatch.setattr(N, "PIECE_ROWS", 7)
    monkeypatch.setattr(N, "BOUND_CELLS", 16)
    assert len(N._pivots(df, ["k"])) == 7
    got = {(r["sample_id"], r["neighbour_id"]) for r in N.knn_join(df, df, 1, ["k"], broadcast_cells=0).collect()}
    x = np.array([r[2] for r in rows])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    d[(np.arange(400)[:, None] + np.arange(400)) % 2 == 1] = np.inf
    np.fill_diagonal(d, np.inf)
    assert got == {(str(i), str(j)) for i, j in enumerate(d.argmin(1))}
