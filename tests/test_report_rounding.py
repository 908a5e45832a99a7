"""REL7: the signal of the sample report is rounded to hundredths as its SQL rounds it."""

import json

import duckdb
from pyspark.sql import functions as F

from nestfold.plans import explain_queries as X


def test_signals_of_half_hundredths(spark, monkeypatch):
    probs = [i / 1000 for i in range(1001)]
    rows = spark.createDataFrame([(str(i), p, 1.0, "none", "low", 0.0) for i, p in enumerate(probs)], "sample_id string, prob double, completeness double, quality string, ood_risk string, disagreement double")
    monkeypatch.setattr(X, "status_rows", lambda *_: rows)
    got = {r["sample_id"]: json.loads(r["report"])["top_contributing_signals"][0]["value"] for r in X.rel7(spark, "").collect()}
    want = duckdb.sql("SELECT i::VARCHAR, round(round(i / 1000.0::DOUBLE, 6) - 0.5, 2) + 0.0 FROM range(0, 1001) r(i)").fetchall()
    assert got == dict(want)
    assert got["615"] == 0.12 and got["35"] == -0.47
