"""A stream of rows gets the same scores as the batch."""

import hashlib
import os

from pyspark.sql import functions as F

from nestfold.operators.frozen import frozen_check, frozen_score, state_identity
from nestfold.plans.explain_queries import frozen_state
from nestfold.session import cut_lineage
from nestfold.sources.cohorts import orders_cohort
from nestfold.sources.tables import fingerprint
from nestfold.streaming.scoring import start_reports, start_scoring, stream_rows


def test_stream_equals_batch(spark, sf, tmp_path):
    state = cut_lineage(frozen_state(spark, sf))
    raw_path = str(tmp_path / "raw")
    orders_cohort(spark, sf).drop("y").repartition(4).write.parquet(raw_path)
    raw = spark.read.parquet(raw_path)
    query = start_scoring(stream_rows(spark, raw_path, raw.schema, max_files=1), state, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    batch = frozen_score(raw, state).select("sample_id", "prob", "predicted")
    stream = spark.read.parquet(str(tmp_path / "out")).select("sample_id", "prob", "predicted")
    assert batch.exceptAll(stream).count() == 0 and stream.exceptAll(batch).count() == 0
    checked = frozen_check(frozen_score(raw, state), ["model_id"]).first()
    assert checked["n_repeated_ids"] == 0 and checked["one_threshold"] and checked["n_wrong_labels"] == 0


def test_state_identity_sees_a_changed_weight(spark, sf):
    state = cut_lineage(frozen_state(spark, sf))
    changed = state.withColumn("coef", F.transform("coef", lambda w, i: F.when(i == 0, w + 1e-6).otherwise(w)))
    a, b = (state_identity(s).first()["state_sha256"] for s in (state, changed))
    assert a != b and a == state_identity(state).first()["state_sha256"]


RAW = "sample_id string, x double"


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(folder)


def test_reports_once_per_id_over_batches_restarts_and_replays(spark, tmp_path):
    raw, out, mark = (str(tmp_path / n) for n in ("raw", "out", "mark"))

    def run():
        rows = stream_rows(spark, raw, spark.read.parquet(raw).schema, max_files=1)
        start_reports(rows, lambda r: r.select("sample_id", (F.col("x") * 2).alias("score")), out, mark).awaitTermination()
        reports = sorted((r["sample_id"], r["score"], r["batch_id"]) for r in spark.read.parquet(f"{out}/reports").collect())
        repeats = sorted((r["sample_id"] or "", -1 if r["seen_before"] is None else r["seen_before"]) for r in spark.read.parquet(f"{out}/repeats").collect())
        return reports, repeats

    deliver(spark, raw, [("a", 1.0), ("b", 2.0), ("b", 2.0), (None, 3.0), (None, 3.0)])
    assert run() == ([("a", 2.0, 0), ("b", 4.0, 0)], [("", -1), ("", -1), ("b", 1)])
    deliver(spark, raw, [("a", 9.0), ("c", 5.0), ("b", 7.0)])
    later = run()
    assert later == ([("a", 2.0, 0), ("b", 4.0, 0), ("c", 10.0, 1)], [("", -1), ("", -1), ("a", 1), ("b", 1), ("b", 2)])
    # the driver was lost after publishing and before the commit: the batch runs again
    for name in ("1", ".1.crc"):
        os.remove(f"{mark}/commits/{name}")
    assert run() == later


def test_fingerprint_of_a_file_above_two_gigabytes(spark, tmp_path):
    small, large = str(tmp_path / "small file%20.bin"), str(tmp_path / "large file%20.bin")
    for path, size in ((small, 0), (large, 2**31 + 5)):
        with open(path, "wb") as f:
            f.truncate(size)  # sparse
            f.seek(0, 2)
            f.write(b"end")
    got = {r["file"]: (r["n_bytes"], r["sha256"]) for r in fingerprint(spark, str(tmp_path / "*.bin")).collect()}
    want = hashlib.sha256()
    for _ in range(2**7):
        want.update(bytes(2**24))
    want.update(bytes(5) + b"end")
    assert got == {"small file%20.bin": (3, hashlib.sha256(b"end").hexdigest()), "large file%20.bin": (2**31 + 8, want.hexdigest())}
    every = {r["file"]: r["sha256"] for r in fingerprint(spark, small, inline_bytes=0).collect()}
    assert every == {"small file%20.bin": got["small file%20.bin"][1]}
