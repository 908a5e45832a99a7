"""Restartable runs: failures are isolated and logged, a second run takes what is left."""

import pytest
from pyspark.sql import functions as F

from nestfold.operators import folds as D
from nestfold.operators.runs import RunError, StudyRun, of_coordinates


@pytest.fixture
def rows(spark):
    plan = D.coordinate_plan(2, 3, spark)
    return plan.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("score", F.col("i") / 10 + F.col("fold_id"))


def evaluate(scored):
    return scored.groupBy("repeat_id", "fold_id").agg(F.avg("score").alias("mean_score"))


def failing(rows, bad):
    """Scores whose job stops at the rows of one coordinate."""
    wrong = (F.col("repeat_id") == bad[0]) & (F.col("fold_id") == bad[1])
    stop = F.raise_error(F.concat(F.lit("no model for this fold"), F.repeat(F.lit(" x"), 600))).cast("double")
    return lambda at: of_coordinates(rows, at).withColumn("score", F.when(wrong, stop).otherwise(F.col("score")))


def states(run):
    return {(r["repeat_id"], r["fold_id"]): r["state"] for r in run.states().collect()}


def test_a_killed_coordinate_resumes(spark, rows, tmp_path):
    asked = []
    plan = D.coordinate_plan(2, 3, spark)
    first = StudyRun(spark, str(tmp_path / "s"), "one", plan)
    assert first.summary().first()["study_state"] == "PREFLIGHTED"
    first.run(failing(rows, (1, 2)), evaluate)
    assert [c for c, s in states(first).items() if s != "EVALUATION_PUBLISHED"] == [(1, 2)] and states(first)[1, 2] == "PENDING"
    (failure,) = first.failures().collect()
    assert (failure["stage"], failure["repeat_id"], failure["fold_id"]) == ("scoring", 1, 2)
    assert "no model for this fold" in failure["message"] and len(failure["message"]) == 500 and failure["error_class"].endswith("Exception")
    assert first.summary().first().asDict() == {"study_state": "RUNNING", "n_coordinates": 6, "n_complete": 5, "n_failures": 1}

    def score(at):
        asked.append(at)
        return of_coordinates(rows, at)

    second = StudyRun(spark, str(tmp_path / "s"), "one", plan)
    second.run(score, evaluate)
    assert asked == [[(1, 2)]]
    assert set(states(second).values()) == {"EVALUATION_PUBLISHED"}
    assert {r["run"] for c, r in second.receipts("scoring").items() if c == (1, 2)} == {second.run_id}
    got = {(r["repeat_id"], r["fold_id"]): r["mean_score"] for r in second.published("evaluation").collect()}
    assert got == pytest.approx({(r, f): 0.45 + f for r in range(2) for f in range(3)})
    third = StudyRun(spark, str(tmp_path / "s"), "one", plan)
    third.run(score, evaluate)
    assert len(asked) == 1 and third.summary().first()["study_state"] == "COMPLETE"


def test_failed_evaluation_keeps_the_scores(spark, rows, tmp_path):
    plan = D.coordinate_plan(2, 3, spark)
    run = StudyRun(spark, str(tmp_path / "s"), "one", plan)

    def broken(scored):
        if scored.filter((F.col("repeat_id") == 0) & (F.col("fold_id") == 1)).count():
            raise ZeroDivisionError("no positive rows")
        return evaluate(scored)

    run.run(lambda at: of_coordinates(rows, at), broken)
    assert [c for c, s in states(run).items() if s == "SCORING_PUBLISHED"] == [(0, 1)]
    (failure,) = run.failures().collect()
    assert (failure["stage"], failure["error_class"], failure["message"]) == ("evaluation", "ZeroDivisionError", "no positive rows")

    def never(at):
        raise AssertionError("scores exist already")

    again = StudyRun(spark, str(tmp_path / "s"), "one", plan)
    again.run(never, evaluate)
    assert set(states(again).values()) == {"EVALUATION_PUBLISHED"} and again.failures().count() == 1


def test_output_without_a_receipt_is_not_read(spark, rows, tmp_path):
    plan = D.coordinate_plan(2, 3, spark)
    run = StudyRun(spark, str(tmp_path / "s"), "one", plan)
    rows.withColumn("score", F.lit(9.0)).write.partitionBy("repeat_id", "fold_id").parquet(str(tmp_path / "s/scoring/attempt=a-lost"))
    assert set(states(run).values()) == {"PENDING"}
    run.run(lambda at: of_coordinates(rows, at), evaluate)
    assert run.published("scoring").filter("score = 9").count() == 0 and run.published("scoring").count() == 60


def test_other_studies_plans_and_changed_rows_are_refused(spark, rows, tmp_path):
    plan = D.coordinate_plan(2, 3, spark)
    run = StudyRun(spark, str(tmp_path / "s"), "one", plan)
    with pytest.raises(RunError, match="another study"):
        StudyRun(spark, str(tmp_path / "s"), "two", plan)
    with pytest.raises(RunError, match="twice"):
        StudyRun(spark, str(tmp_path / "t"), "one", plan.union(plan))
    run.run(lambda at: of_coordinates(rows, at).filter("fold_id < 2 OR repeat_id = 0"), evaluate)  # a coordinate without rows
    (failure,) = run.failures().collect()
    assert failure["error_class"] == "RunError" and "none of [(1, 2)]" in failure["message"]
    run.verify("scoring", [(0, 0), (1, 1)])
    attempt = run.receipts("scoring")[0, 0]["attempt"]
    rows.filter("repeat_id = 0 AND fold_id = 0").select("i", "score").write.mode("append").parquet(str(tmp_path / f"s/scoring/attempt={attempt}/repeat_id=0/fold_id=0"))
    with pytest.raises(RunError, match="differs"):
        run.verify("scoring", [(0, 0), (1, 1)])
    other = [("scoring", 1, 1, "a-other", "r", 1, "00", None)]
    run._append("receipts", other, "stage string, repeat_id int, fold_id int, attempt string, run string, n_rows bigint, content_sha256 string, scoring_sha256 string")
    with pytest.raises(RunError, match="different contents"):
        run.receipts("scoring")


def test_empty_plan(spark, tmp_path):
    run = StudyRun(spark, str(tmp_path / "s"), "one", D.coordinate_plan(2, 3, spark).filter("false"))
    assert run.run(lambda at: None, lambda s: s).count() == 0
