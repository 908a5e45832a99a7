"""Partition properties, independence of layout, tamper checks, identities."""

import pytest
from pyspark.sql import functions as F

from nestfold.operators import folds as D, identity as I
from nestfold.operators.ranking import exact_quantiles, hash_rank, prefix_sums


@pytest.fixture(scope="module")
def cohort(spark):
    return spark.range(90).select(
        F.format_string("P-%03d", "id").alias("sample_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("y")
    )


def test_each_repeat_is_a_balanced_partition(spark, cohort):
    folds = D.repeated_kfold(cohort, 5, 3)
    per = folds.groupBy("repeat_id", "sample_id").count()
    assert per.count() == 270 and per.filter("count <> 1").count() == 0
    sizes = folds.groupBy("repeat_id", "fold_id").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()
    assert {(r["n"], r["p"]) for r in sizes} == {(18, 6)}


def test_fold_sizes_differ_by_at_most_one(spark):
    odd = spark.range(83).select(F.col("id").cast("string").alias("sample_id"), (F.col("id") % 2).cast("int").alias("y"))
    sizes = [r["count"] for r in D.repeated_kfold(odd, 5, 2).groupBy("repeat_id", "fold_id").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_assignment_does_not_depend_on_layout(spark, cohort):
    a = {tuple(r) for r in D.repeated_kfold(cohort.repartition(1)).collect()}
    b = {tuple(r) for r in D.repeated_kfold(cohort.repartition(13)).collect()}
    assert a == b


def test_inner_folds_live_inside_train(spark, cohort):
    folds = D.repeated_kfold(cohort, 5, 2)
    inner = D.inner_folds(folds)
    report = {r["rule"]: r["violations"] for r in D.validate_inner(folds, inner).collect()}
    assert set(report.values()) == {0}
    leaked = folds.filter("repeat_id = 0 and fold_id = 0").limit(1).select("repeat_id", "fold_id", F.lit(0).alias("inner_fold_id"), "sample_id", "y")
    report = {r["rule"]: r["violations"] for r in D.validate_inner(folds, inner.unionByName(leaked)).collect()}
    assert report["inner_meets_test"] == 1 and report["inner_outside_train"] == 1


def test_tampered_folds_are_found(spark, cohort):
    folds = D.repeated_kfold(cohort)
    broken = folds.filter("not (repeat_id = 0 and sample_id = 'P-000')")
    report = {r["rule"]: r["violations"] for r in D.validate_folds(cohort, broken).collect()}
    assert report["each_sample_once_per_repeat"] == 1
    report = {r["rule"]: r["violations"] for r in D.validate_folds(cohort, folds).collect()}
    assert set(report.values()) == {0}


def test_hash_rank_equals_row_number(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), "id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    from pyspark.sql import Window as W

    want = df.withColumn("w", F.row_number().over(W.partitionBy("k").orderBy("h")))
    got = hash_rank(df, ["k"], "h").join(want, ["k", "id"])
    assert got.filter("rank <> w").count() == 0 and got.count() == 5000


def test_prefix_sums_with_one_hot_key(spark):
    """A third of all rows share one key and many share one value; totals stay exact."""
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
        F.when(F.col("id") % 7 == 0, 5.0).otherwise((F.col("id") * 7919 % 1000) / 10.0).alias("x"),
    )
    counts = df.groupBy("k", "x").agg(F.count("*").alias("n"))
    got = prefix_sums(counts, ["k"], "x", ["n"], with_next=True).toPandas()
    for _, part in got.groupby("k"):
        part = part.sort_values("x")
        assert (part["n"].cumsum() == part["cum_n"]).all()
        assert (part["tot_n"] == part["n"].sum()).all()
        assert part["next_x"].iloc[:-1].tolist() == part["x"].iloc[1:].tolist() and part["next_x"].isna().iloc[-1]


def test_exact_quantiles_match_numpy(spark):
    import numpy as np

    values = [float(v) for v in np.random.default_rng(3).integers(0, 50, 997)]
    df = spark.createDataFrame([(1, v) for v in values], "k int, x double").repartition(9)
    row = exact_quantiles(df, ["k"], "x", (0.05, 0.5, 0.95)).first()
    want = np.quantile(values, [0.05, 0.5, 0.95])
    assert np.allclose([row["q05"], row["q50"], row["q95"]], want)


def test_identities(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "k int, v string, p int")
    b = spark.createDataFrame([(1, "y", 1), (1, "x", 2)], "k int, v string, p int")
    c = spark.createDataFrame([(1, "x", 1), (1, "x", 2)], "k int, v string, p int")

    def one(df):
        return df.first()["identity_sha256"]

    assert one(I.set_identity(a, ["k"], "v")) == one(I.set_identity(b, ["k"], "v"))
    assert one(I.set_identity(a, ["k"], "v")) != one(I.set_identity(c, ["k"], "v"))
    assert one(I.list_identity(a, ["k"], "v", "p")) != one(I.list_identity(b, ["k"], "v", "p"))


def test_bootstrap_draws_known_rows(spark, cohort):
    drawn = D.bootstrap(cohort, 500, seed=3)
    assert drawn.count() == 500 and drawn.join(cohort, "sample_id", "left_anti").count() == 0
