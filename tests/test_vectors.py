"""Neighbour joins, balancing, quality, explanations and reliability."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestfold.operators import augment as G, explain as E, moments as Mo, neighbours as N, quality as Q, reliability as R


def vectors(spark, z, y=None, prefix="R", keys=None):
    rows = []
    for i, v in enumerate(z):
        rows.append((f"{prefix}{i:04d}", int(y[i]) if y is not None else 0, int(keys[i]) if keys is not None else 0, [float(t) for t in v]))
    return spark.createDataFrame(rows, "sample_id string, y int, k int, z array<float>")


def brute(a, b, k, skip_self):
    d = np.sqrt(((a[:, None, :].astype(np.float32).astype(float) - b[None, :, :].astype(np.float32).astype(float)) ** 2).sum(2))
    if skip_self:
        np.fill_diagonal(d, np.inf)
    return np.sort(d, 1)[:, :k]


@pytest.mark.parametrize("cells", [N.BROADCAST_CELLS, 0])
@pytest.mark.parametrize("k", [1, 5])
def test_knn_equals_brute_force(spark, cells, k, monkeypatch):
    """Both routes, with a third of the reference being copies of one point."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 40)
    monkeypatch.setattr(N, "CHUNK_ROWS", 50)
    monkeypatch.setattr(N, "SLICE_ROWS", 30)  # the copies are one block, met in slices
    monkeypatch.setattr(N, "N_PIVOTS", 8)
    rng = np.random.default_rng(0)
    z = np.r_[rng.normal(size=(200, 4)) * [1, 2, 1, 1], np.tile([3.0, 3, 3, 3], (100, 1))]
    df = vectors(spark, z)
    got = N.knn_join(df, df, k, broadcast_cells=cells).toPandas().sort_values(["sample_id", "rank"])
    want = brute(z, z, k, True)
    assert len(got) == 300 * k
    assert np.allclose(got["distance"].to_numpy().reshape(300, k), want, atol=1e-6)


def test_knn_refuses_a_layout_above_its_bound(spark, monkeypatch):
    monkeypatch.setattr(N, "MAX_LAYOUT", 3)
    df = vectors(spark, np.arange(20.0).reshape(10, 2), keys=np.arange(10)).select("k", "sample_id", "z")
    with pytest.raises(ValueError, match="join fewer keys"):
        N.knn_join(df, df, 1, ["k"], broadcast_cells=0)


@pytest.mark.parametrize("cells", [N.BROADCAST_CELLS, 0])
@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_knn_is_exact_with_ties_and_offsets(spark, cells, offset, monkeypatch):
    """Twenty equal distances, repeated vectors and values far from zero: same ids on both routes."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 12)
    monkeypatch.setattr(N, "N_PIVOTS", 4)
    rng = np.random.default_rng(3)
    z = np.r_[np.tile([1.0, 0.0], (20, 1)), [[0.0, 0.0]], np.tile([0.0, 0.0], (3, 1)), rng.integers(-40, 40, size=(60, 2)) / 8.0] + offset
    rows = [(f"r{i:03d}", v.tolist()) for i, v in enumerate(z)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "sample_id string, z array<double>")
    got = N.knn_join(df, df, 5, broadcast_cells=cells).collect()
    d = np.sqrt(((z[:, None, :] - z[None, :, :]) ** 2).sum(2))
    want = {(f"r{i:03d}", n + 1): f"r{j:03d}" for i in range(len(z)) for n, j in enumerate(sorted((j for j in range(len(z)) if j != i), key=lambda j: (d[i, j], j))[:5])}
    assert {(r["sample_id"], r["rank"]): r["neighbour_id"] for r in got} == want


@pytest.mark.parametrize("cells", [N.BROADCAST_CELLS, 0])
def test_knn_respects_keys(spark, cells, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(1)
    z, keys = rng.normal(size=(90, 3)), np.arange(90) % 3
    df = vectors(spark, z, keys=keys).select("k", "sample_id", "z")
    got = N.knn_join(df, df, 2, ["k"], broadcast_cells=cells).toPandas()
    for key, part in got.groupby("k"):
        own = z[keys == key]
        want = brute(own, own, 2, True)
        part = part.sort_values(["sample_id", "rank"])
        assert np.allclose(part["distance"].to_numpy().reshape(-1, 2), want, atol=1e-6)


def imbalanced(spark, n0=40, n1=15, d=3, seed=0):
    rng = np.random.default_rng(seed)
    y = np.r_[np.zeros(n0), np.ones(n1)].astype(int)
    return vectors(spark, rng.normal(size=(n0 + n1, d)) + y[:, None], y), y


def test_minority_sizing_rules(spark):
    df, _ = imbalanced(spark, 6, 4)
    row = G.minority_sizing(df, []).first()
    assert (row["minority_label"], row["n_minority"], row["needed"]) == (1, 4, 2)
    for bad in (imbalanced(spark, 5, 5)[0], imbalanced(spark, 5, 0)[0]):
        with pytest.raises(Exception, match="imbalanced"):
            G.minority_sizing(bad, []).collect()


def test_smote_balances_and_stays_between_neighbours(spark):
    df, y = imbalanced(spark)
    drawn = G.smote(df).collect()
    assert len(drawn) == 25 and len({r["sample_id"] for r in drawn}) == 25 and {r["y"] for r in drawn} == {1}
    real = np.array([r["z"] for r in df.filter("y = 1").orderBy("sample_id").collect()])
    for r in drawn:
        p = np.array(r["z"])
        assert (p >= real.min(0) - 1e-5).all() and (p <= real.max(0) + 1e-5).all()
    again = G.smote(df.repartition(7)).collect()
    assert {r["sample_id"]: tuple(r["z"]) for r in drawn} == {r["sample_id"]: tuple(r["z"]) for r in again}


def test_smote_needs_more_rows_than_neighbours(spark):
    with pytest.raises(Exception, match="neighbours"):
        G.smote(imbalanced(spark, 20, 5)[0]).collect()


@pytest.mark.parametrize("maker", [G.minority_synthesiser, G.conditional_synthesiser])
def test_synthesisers_follow_the_minority(spark, maker):
    df, y = imbalanced(spark, 900, 300, 2, seed=3)
    drawn = maker(df).collect()
    z = np.array([r["z"] for r in drawn])
    real = np.array([r["z"] for r in df.filter("y = 1").collect()])
    assert z.shape == (600, 2) and np.isfinite(z).all()
    assert np.abs(z.mean(0) - real.mean(0)).max() < 0.15
    assert (z.min(0) >= real.min(0) - 1e-5).all() and (z.max(0) <= real.max(0) + 1e-5).all()
    held = maker(df.unionByName(df.filter("y = 0").limit(0))).collect()
    assert sorted(tuple(r["z"]) for r in held) == sorted(tuple(r["z"]) for r in drawn)


def test_copula_draws_do_not_depend_on_partitions(spark):
    models = {(): G.CopulaModel(np.tile(np.linspace(0, 1, 21), (2, 1)), np.eye(2))}

    def draw(needed):
        sizing = spark.createDataFrame([(1, needed)], "minority_label int, needed bigint")
        return {r["draw"]: tuple(r["z"]) for r in G.sample_copulas(sizing, [], models, 5, block=64).collect()}

    a, b = draw(300), draw(200)
    assert len(a) == 300 and all(a[i] == b[i] for i in b)


def test_namespace_is_checked():
    with pytest.raises(ValueError):
        G.synthetic_id("bad name", [], F.lit(1), F.lit(0))


def test_correlations_match_numpy_and_skip_constants(spark):
    rng = np.random.default_rng(2)
    z = np.column_stack([rng.normal(size=(80, 3)) @ rng.normal(size=(3, 3)), np.full(80, 2.0)])
    got = {(r["i"], r["j"]): r["corr"] for r in Mo.correlations(vectors(spark, z).repartition(6), ["k"]).collect()}
    want = np.corrcoef(z[:, :3].astype(np.float32), rowvar=False)
    assert np.isclose(got[(0, 1)], want[0, 1], atol=1e-6) and np.isclose(got[(1, 2)], want[1, 2], atol=1e-6)
    assert got[(0, 3)] is None and len(got) == 6


def test_wasserstein_and_ks(spark):
    rows = [("s", "real", [float(v)]) for v in (0, 1, 3)] + [("s", "synthetic", [float(v)]) for v in (5, 6, 8)]
    cells = Q.quality_cells(spark.createDataFrame(rows, "strategy string, side string, z array<double>"), "strategy")
    row = Q.distance_metrics(cells).first()
    assert np.isclose(row["wasserstein"], 5.0) and row["ks"] == 1.0


def test_contributions_rebuild_the_score(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], [0.5, 0.5], [2.0, -1.0], 0.25)], "sample_id string, z array<double>, background array<double>, coef array<double>, intercept double")
    row = E.logistic_contributions(df).first()
    assert row["exact"] and np.isclose(row["reconstructed"], 0.25 + 2 - 2)
    assert row["contribution"] == [1.0, -1.5]


def test_top_signals_break_ties_by_name(spark):
    df = spark.createDataFrame([([1.0, 1.0, -3.0], ["b", "a", "c"])], "v array<double>, n array<string>")
    row = df.select(E.top_signed(F.col("v"), F.col("n"), True, 1).alias("p"), E.top_absolute(F.col("v"), F.col("n"), 2).alias("t")).first()
    assert row["p"][0]["name"] == "a"
    assert [(t["name"], t["direction"]) for t in row["t"]] == [("c", "supports_low"), ("a", "supports_high")]


def test_attach_fails_on_missing_partner(spark):
    a = spark.createDataFrame([("x", 1)], "sample_id string, e int")
    b = spark.createDataFrame([("y", 1)], "sample_id string, p int")
    with pytest.raises(Exception, match="differ"):
        E.attach(a, b).collect()


def test_permutation_finds_the_used_feature(spark):
    rng = np.random.default_rng(6)
    z = rng.normal(size=(300, 2))
    y = (z[:, 0] > 0).astype(int)
    df = vectors(spark, z, y).withColumn("coef", F.array(F.lit(1.0), F.lit(0.0))).withColumn("intercept", F.lit(0.0))
    rows = {r["pos"]: r for r in E.permutation_importance(df).collect()}
    assert rows[0]["importance_mean"] > 0.2 and abs(rows[1]["importance_mean"]) < 1e-9


def test_mahalanobis_and_risk(spark):
    rng = np.random.default_rng(8)
    z = rng.normal(size=(200, 3)) @ np.diag([1, 5, 0.2])
    train = vectors(spark, z)
    got = R.mahalanobis(train, train).toPandas().sort_values("sample_id")["distance"].to_numpy()
    zz = z.astype(np.float32).astype(float)
    c = zz - zz.mean(0)
    inv = np.linalg.pinv(np.cov(zz, rowvar=False) + 1e-6 * np.eye(3))
    assert np.allclose(got, np.sqrt(np.einsum("ij,jk,ik->i", c, inv, c)), atol=1e-6)
    far = R.mahalanobis_risk(vectors(spark, [[50.0, 50, 50]], prefix="F"), train).first()
    assert far["ood_risk"] == "high"


def test_status_rules(spark):
    df = spark.createDataFrame([(0.9, "none", "low", 0.0), (0.5, "high_missingness_detected", "high", 0.2)], "p double, q string, r string, d double")
    reasons = R.caution_reasons(F.col("p"), F.col("q"), F.col("r"), F.col("d"))
    rows = df.select(reasons.alias("w"), R.status_of(reasons).alias("s")).collect()
    assert rows[0]["s"] == "Reliable" and rows[0]["w"] == []
    assert rows[1]["w"] == ["borderline_confidence", "high_missingness_detected", "ood_risk_high", "model_disagreement"]
