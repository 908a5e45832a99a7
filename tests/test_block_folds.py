"""Folds dealt on packed rows equal those of the relations."""

import pytest
from pyspark.sql import functions as F

from nestfold.operators import block_folds as BF, folds as D
from nestfold.plans import nested as N

SCHEMA = "sample_id string, y int, mge array<double>, mdm array<double>, mcna array<double>"


def rows_of(n):
    return [(f"s{i}", int(i % 3 == 0), [float(i), None], [1.0, 2.0], [float(-i)]) for i in range(n)]


def test_packed_folds_equal_the_relations(spark, monkeypatch):
    monkeypatch.setattr(BF, "BUCKET_ROWS", 50)
    monkeypatch.setattr(BF, "BLOCK_ROWS", 70)
    cohort = N.cut_lineage(spark.createDataFrame([*rows_of(400), (None, 1, [0.0, 0.0], [0.0, 0.0], [0.0]), (None, 0, [0.0, 0.0], [0.0, 0.0], [0.0])], SCHEMA).repartition(3))
    table = N.study_table(cohort)
    got = {r.sample_id: r for r in table.collect()}
    outer = N.cut_lineage(D.repeated_kfold(cohort))
    want = D.fold_arrays(outer).join(D.inner_arrays(D.inner_folds(outer, written=True)), "sample_id").collect()
    assert got.keys() == {r.sample_id for r in want} and len(got) == 400 == table.count()
    for r in want:
        assert (got[r.sample_id].fold_of, got[r.sample_id].inner_of) == (r.fold_of, r.inner_of)
    x = {r.sample_id: r.x for r in cohort.select("sample_id", F.concat(*N.MODALITIES).alias("x")).collect()}
    assert all(r.x == x[k] and r.y == int(int(k[1:]) % 3 == 0) for k, r in got.items())


def test_an_id_that_occurs_twice_is_refused(spark):
    with pytest.raises(Exception, match="occurs more than once"):
        N.study_table(spark.createDataFrame([*rows_of(60), rows_of(8)[7]], SCHEMA)).count()


def test_only_digests_are_shuffled_per_coordinate(spark, monkeypatch):
    """What a row costs per coordinate are 12 bytes of digest and a few more, not a row with its id."""
    cut, seen = BF.cut_lineage, []
    monkeypatch.setattr(BF, "cut_lineage", lambda df: seen.append(cut(df)) or seen[-1])
    N.study_table(spark.createDataFrame(rows_of(200), SCHEMA))
    assert not any("sample_id" in df.columns for df in seen[:-1]) and "sample_id" in seen[-1].columns
    assert sum(len(r.value) for r in seen[1].filter("coord >= 0 and value is not null").collect()) == 200 * 20
