import numpy as np
import pytest

from nestfold.llm import topk

SCHEMA = "vec_id long, embedding array<double>, row int, score double, rank string"


def brute(rows, k=5, every=50, scale=256):
    kept = [(i, tuple(int(np.floor(scale * x)) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(kept):
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for n, (j, v) in enumerate(kept) if n != at and len(v) == len(q))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, 0.5, "x") for i, v in rows], SCHEMA).repartition(4)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_inner_products(df, **kw).collect())


def test_equals_brute_force_over_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_ROWS", 64)
    r = np.random.default_rng(8)
    x = r.normal(size=(600, 12)) / 4
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, x[50].tolist()) for i in range(300)]  # a hot group of copies: ties
    rows += [(100, x[3].tolist()), (50, x[50].tolist())]  # repeated ids
    rows += [(2000, None), (2050, []), (2100, [float("nan")] * 12), (2150, [None] + [0.5] * 11), (None, [9.0] * 12)]
    rows += [(3000, [0.0] * 12), (3050, [-0.5] * 12), (4000, [1.0, 2.0]), (4001, [2.0, -1.0]), (4050, [3.0])]
    want = brute(rows)
    assert got(spark, rows, block_rows=200, query_rows=7) == want
    assert got(spark, rows) == want


def test_few_rows_and_empty(spark):
    rows = [(0, [1.0, -1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]
    assert got(spark, rows) == brute(rows) == [(0, 1, 1, 0), (0, 2, 2, 0)]
    assert got(spark, [(0, [1.0])]) == [] and got(spark, []) == []
    with pytest.raises(ValueError, match="too large"):
        got(spark, [(0, [1e12, 1.0])])


@pytest.mark.parametrize("shift", [0, 4, 7])
@pytest.mark.parametrize("kind", ["spread", "clustered", "ties", "negative"])
def test_search_stops_only_on_proof(shift, kind):
    r = np.random.default_rng(shift)
    x = r.normal(size=(3000, 24)) * 40
    if kind == "clustered":
        x = x[r.integers(0, 30, 3000)] + r.normal(size=x.shape) * 4
    if kind == "ties":
        x = np.round(x / 60) * 60
    if kind == "negative":
        x = -np.abs(x)
    values = np.floor(x).astype(np.int64)
    index = topk.Index(values, shift)
    for q in range(0, 3000, 300):
        query = -values[q] if kind == "negative" and q % 600 else values[q]
        found, score = index.search(query, 5, skip=q)
        exact = values @ query
        exact[q] = np.iinfo(np.int64).min
        best = np.sort(exact)[-5]
        assert sorted(found.tolist()) == np.flatnonzero(exact >= best).tolist() and score.tolist() == exact[found].tolist()


def test_search_reads_fewer_postings_on_clustered_rows():
    r = np.random.default_rng(2)
    centre = r.normal(size=(60, 64)) / 8
    x = np.floor(256 * (centre[r.integers(0, 60, 4000)] + r.normal(size=(4000, 64)) / 40)).astype(np.int64)
    index, read = topk.Index(x), []
    ragged = topk.chars.ragged
    try:
        topk.chars.ragged = lambda v, s, n: read.append(int(n.sum())) or ragged(v, s, n)
        for q in range(20):
            index.search(x[q], 5, skip=q)
    finally:
        topk.chars.ragged = ragged
    assert sum(read) < 20 * 4000 * 64 / 3
