"""Data contract, alignment, sources and sinks on small inline tables."""

import pytest
from pyspark.sql import functions as F

from nestfold.operators import align as A, contract as C
from nestfold.sources import sinks, tables as S
from nestfold.sources.tables import ContractError


def write(tmp_path, name, text):
    path = tmp_path / f"{name}.csv"
    path.write_text(text)
    return str(path)


GOOD = "SAMPLE_ID,CLASS,f\nS-2,2,2.5\nS-1,1,1.5\n"


def test_scan_keeps_ids_as_text_and_empty_cells_as_missing(spark, tmp_path):
    df = S.read_modality(spark, write(tmp_path, "m", "﻿SAMPLE_ID,CLASS,f\n001,1,\n002,2,3.5\n"))
    rows = {r["sample_id"]: r["features"] for r in df.collect()}
    assert rows == {"001": [None], "002": [3.5]}
    assert df.schema["features"].metadata["names"] == ["f"]


@pytest.mark.parametrize(
    "text",
    ["", "SAMPLE_ID,f\nA,1\n", "CLASS,f\n1,1\n", "SAMPLE_ID,CLASS,f,f\nA,1,1,1\n", "SAMPLE_ID,CLASS\nA,1\n"],
)
def test_header_contract(spark, tmp_path, text):
    with pytest.raises(ContractError):
        S.read_header(spark, write(tmp_path, "h", text))


@pytest.mark.parametrize(
    "body, word",
    [
        ("A,1,1\nA,2,2\n", "duplicate"),
        (",1,1\nB,2,2\n", "blank"),
        ("  ,1,1\nB,2,2\n", "blank"),
        ("A,3,1\nB,2,2\n", "labels"),
        ("A,x,1\nB,2,2\n", "labels"),
        ("A,1,text\nB,2,2\n", "non-numeric"),
        ("A,1,Infinity\nB,2,2\n", "infinite"),
    ],
)
def test_broken_tables_are_rejected(spark, tmp_path, body, word):
    raw = S.read_modality_text(spark, write(tmp_path, "b", "SAMPLE_ID,CLASS,f\n" + body))
    with pytest.raises(ContractError, match=word):
        C.validate_text_table(raw, "mGE")


def test_long_rows_stop_and_short_rows_end_in_missing_cells(spark, tmp_path):
    short = S.read_modality(spark, write(tmp_path, "s", "SAMPLE_ID,CLASS,f,g\nA,1,2\nB,2,3,4\n"))
    assert {r["sample_id"]: r["features"] for r in short.collect()} == {"A": [2.0, None], "B": [3.0, 4.0]}
    for body in ("A,1,2,9\nB,2,3\n", "A,1,2,\nB,2,3\n", "A,1,2,,\nB,2,3\n", 'A,1,"2",9\nB,2,3\n'):
        with pytest.raises(Exception, match="more than 3 cells"):
            S.read_modality(spark, write(tmp_path, "l", "SAMPLE_ID,CLASS,f\n" + body)).collect()
        with pytest.raises(Exception, match="more than 3 cells"):
            S.read_modality_text(spark, write(tmp_path, "l", "SAMPLE_ID,CLASS,f\n" + body)).select("CLASS").collect()
    quoted = S.read_modality(spark, write(tmp_path, "q", 'SAMPLE_ID,CLASS,f\n"A,""x""",1,2\nB,2,3\n'))
    assert {r["sample_id"] for r in quoted.collect()} == {'A,"x"', "B"}


def test_files_with_different_headers_are_refused(spark, tmp_path):
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "a.csv").write_text("SAMPLE_ID,CLASS,f1,f2\nA,1,1,2\n")
    (tmp_path / "many" / "b.csv").write_text("SAMPLE_ID,CLASS,f2,f1\nB,2,1,2\n")
    with pytest.raises(ContractError, match="different headers"):
        S.read_modality(spark, str(tmp_path / "many"))
    (tmp_path / "many" / "b.csv").write_text("SAMPLE_ID,CLASS,f1,f2\nB,2,1,2\n")
    assert S.read_modality(spark, str(tmp_path / "many")).count() == 2


def test_fractional_label_is_refused(spark, tmp_path):
    path = write(tmp_path, "c", "SAMPLE_ID,CLASS,f\nA,1.9,1\nB,2,2\n")
    with pytest.raises(ContractError, match="labels"):
        S.read_modality(spark, path)
    assert {r["label_raw"] for r in S.parse_modality(S.read_modality_text(spark, path)).collect()} == {None, 2}


def test_concatenated_records_are_all_read(spark, tmp_path):
    path = tmp_path / "many.json"
    path.write_text('{\n "id": 1}\n{"id": 2}  [{"id": 3},\n {"id": 4}]\n')
    assert sorted(r["id"] for r in S.read_records(spark, str(path), "id int", 4, ["id"], pretty=True).collect()) == [1, 2, 3, 4]
    for tail in ("tail", "{", "}"):
        path.write_text('{"id": 1}\n' + tail)
        with pytest.raises(Exception, match="not a JSON record"):
            S.read_records(spark, str(path), "id int", pretty=True)


def test_good_table_passes(spark, tmp_path):
    C.validate_text_table(S.read_modality_text(spark, write(tmp_path, "g", GOOD)), "mGE")


def tables(spark, labels_c=(2, 1)):
    schema = "sample_id string, label_raw int, features array<double>"
    return {
        "mge": spark.createDataFrame([("S-2", 2, [2.5]), ("S-1", 1, [1.5])], schema),
        "mdm": spark.createDataFrame([("S-1", 1, [10.5]), ("S-2", 2, [20.5])], schema),
        "mcna": spark.createDataFrame([("S-2", labels_c[0], [200.5]), ("S-1", labels_c[1], [100.5])], schema),
    }


def test_strict_alignment(spark):
    rows = A.strict_align(tables(spark)).orderBy("sample_id").collect()
    assert [(r["sample_id"], r["y"], r["mge"][0], r["mdm"][0], r["mcna"][0]) for r in rows] == [
        ("S-1", 0, 1.5, 10.5, 100.5),
        ("S-2", 1, 2.5, 20.5, 200.5),
    ]


def test_label_mismatch_and_id_mismatch(spark):
    with pytest.raises(ContractError, match="labels disagree"):
        A.strict_align(tables(spark, labels_c=(1, 1)))
    t = tables(spark)
    t["mdm"] = t["mdm"].filter("sample_id = 'S-1'")
    with pytest.raises(ContractError, match="id sets differ"):
        A.strict_align(t)
    assert [r[0] for r in A.common_ids(t).collect()] == ["S-1"]


def test_nan_is_missing(spark):
    from nestfold.functions.columns import missing_to_null

    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double").select(missing_to_null(F.col("x")).alias("x"))
    assert df.agg(F.avg("x"), F.count("x")).first() == (1.0, 1)


def test_forbidden_names(spark):
    df = spark.createDataFrame([("mge_z001",), ("is_synthetic",), ("class_x",), ("y",), ("really",)], "n string")
    hit = {r[0]: r[1] for r in df.select("n", C.forbidden_name(F.col("n"))).collect()}
    assert hit == {"mge_z001": False, "is_synthetic": True, "class_x": True, "y": True, "really": True}


def test_record_stream_rules(spark, tmp_path):
    path = str(tmp_path / "r.jsonl")
    (tmp_path / "r.jsonl").write_text('{"a":1,"b":2}\n{"a":2,"b":2}\n')
    assert S.read_records(spark, path, "a int, b int", 2, ["a"]).count() == 2
    with pytest.raises(ContractError, match="expected 3"):
        S.read_records(spark, path, "a int, b int", 3)
    with pytest.raises(ContractError, match="duplicate"):
        S.read_records(spark, path, "a int, b int", 2, ["b"])
    (tmp_path / "bad.jsonl").write_text('{"a":1\n')
    with pytest.raises(Exception):
        S.read_records(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    (tmp_path / "pretty.json").write_text('[\n {"id": 1},\n {"id": 2}\n]')
    assert S.read_records(spark, str(tmp_path / "pretty.json"), "id int", 2, ["id"], pretty=True).count() == 2


def test_jsonl_sink_refuses_nan_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"))], "b int, a double")
    with pytest.raises(ValueError, match="NaN"):
        sinks.write_jsonl(df, str(tmp_path / "x"))
    with pytest.raises(ValueError, match="empty"):
        sinks.write_jsonl(df.filter("false"), str(tmp_path / "y"))
    sinks.write_jsonl(spark.createDataFrame([(1, None)], "b int, a double"), str(tmp_path / "z"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "z")).collect()] == ['{"a":null,"b":1}']


def test_publication_happens_once(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "v int")
    sinks.publish(df, str(tmp_path), "s", "scoring", 0, 0)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.publish(df, str(tmp_path), "s", "scoring", 0, 0)
    assert sinks.published(spark, str(tmp_path), "s", "evaluation") is None


def test_report_set_writes_only_absent_tables(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "v int")
    assert sinks.write_report_set({"metric_summary": df}, str(tmp_path)) == ["metric_summary"]
    both = {"metric_summary": df, "per_fold_results": df}
    assert sinks.write_report_set(both, str(tmp_path)) == ["per_fold_results"]
    with pytest.raises(ValueError, match="unknown"):
        sinks.write_report_set({"other": df}, str(tmp_path))


def test_csv_sink_writes_null_as_empty_cell(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("a", None)], "k string, v double").coalesce(1), str(tmp_path / "c"), ["v", "k"])
    lines = [r[0] for r in spark.read.text(str(tmp_path / "c")).collect()]
    assert lines == ["v,k", ",a"]


def test_a_folder_without_the_mark_of_success_is_not_published(spark, tmp_path):
    df = spark.range(3)
    path = tmp_path / "aggregate" / "metric_summary"
    path.mkdir(parents=True)
    (path / "part-0.parquet").write_bytes(b"half a file")
    assert not sinks.path_exists(spark, str(path)) and not sinks.path_exists(spark, str(tmp_path / "none"))
    assert sinks.write_report_set({"metric_summary": df}, str(tmp_path)) == ["metric_summary"]
    assert sinks.path_exists(spark, str(path)) and spark.read.parquet(str(path)).count() == 3
    assert sinks.write_report_set({"metric_summary": df}, str(tmp_path)) == []
