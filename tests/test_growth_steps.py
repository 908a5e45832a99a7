"""Steps whose work must not grow faster than their input."""

import os

from nestfold.plans import explain_queries as E, metric_queries as M, report_queries as R


def recorded(monkeypatch, module):
    seen, cut = [], module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df: (seen.append(df.columns), cut(df))[1])
    return seen


def test_candidate_summary_writes_counts_not_scores(spark, sf, monkeypatch):
    seen = recorded(monkeypatch, M)
    assert M.sel4(spark, sf).count() == 45
    assert seen and not any("sample_id" in c for c in seen)


def test_runs_read_folders_of_their_coordinates(spark, sf, monkeypatch):
    seen = recorded(monkeypatch, R)
    read, of = [], R.U.of_coordinates
    monkeypatch.setattr(R.U, "of_coordinates", lambda rows, at: (read.append((len(at), of(rows, at))), read[-1][1])[1])
    R.strict_then_lenient(spark, sf)
    assert not any("sample_id" in c for c in seen)
    few = [df for n, df in read if n == 1 and "sample_id" in df.columns]
    assert few and all("PartitionFilters: [isnotnull(repeat_id" in df._jdf.queryExecution().executedPlan().toString() for df in few[:1])


def test_the_split_of_the_frozen_state_reads_the_labels_only(spark, sf, monkeypatch):
    read, split = [], E.D.shuffle_split
    monkeypatch.setattr(E.D, "shuffle_split", lambda rows, *a, **k: (read.extend(rows.inputFiles()), split(rows, *a, **k))[1])
    E.frozen_state(spark, sf)
    assert {os.path.basename(f) for f in read} == {"orders.parquet"}
