"""Writers: JSON lines, CSV results, create-once publication, report sets."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException

from ..session import ensure_checkpoint_dir

# The twelve tables of a study report: fixed names.
REPORT_TABLES = (
    "per_fold_results",
    "metric_summary",
    "selected_pipeline_per_fold",
    "selection_frequencies",
    "inner_candidate_comparison",
    "representation_comparison",
    "aggregate_confusion_matrix",
    "reliability_summary",
    "aggregate_outer_test_predictions",
    "aggregate_outer_test_predictions_records",
    "aggregate_manifest",
    "research_results_manifest",
)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder was published: its writer ended and left the mark of success."""
    try:
        spark.read.format("binaryFile").load(f"{path}/_SUCCESS")
        return True
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def not_finite(df: DataFrame) -> Column:
    """True where any floating-point column of the row is NaN or infinite."""
    bad = F.lit(False)
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(field.name)
            bad = bad | F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    return bad


def canonical_json(columns: Sequence[str]) -> Column:
    """Compact JSON object with keys in sorted order; missing values are explicit nulls."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str) -> None:
    """One sorted-key object per line; refuses an empty table, NaN and infinity."""
    facts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(not_finite(df)).alias("bad")).first()
    if facts["n"] == 0:
        raise ValueError("refusing to write an empty record stream")
    if facts["bad"]:
        raise ValueError(f"{facts['bad']} rows hold NaN or infinity")
    df.select(canonical_json(df.columns).alias("value")).write.mode("errorifexists").text(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Fixed column order, null as an empty cell."""
    df.select(*columns).write.mode("errorifexists").csv(path, header=True, nullValue="", emptyValue="")


def publish(df: DataFrame, root: str, study: str, stage: str, repeat_id: int, fold_id: int) -> str:
    """Write the results of one coordinate exactly once; a second write fails."""
    path = f"{root}/study={study}/stage={stage}/repeat_id={repeat_id}/fold_id={fold_id}"
    df.write.mode("errorifexists").parquet(path)
    return path


def publish_all(df: DataFrame, root: str, study: str, stage: str) -> str:
    """Publish all coordinates of a stage in one job, partitioned by coordinate."""
    path = f"{root}/study={study}/stage={stage}"
    df.write.mode("errorifexists").partitionBy("repeat_id", "fold_id").parquet(path)
    return path


def published(spark: SparkSession, root: str, study: str, stage: str) -> DataFrame | None:
    path = f"{root}/study={study}/stage={stage}"
    return spark.read.parquet(path) if path_exists(spark, path) else None


def write_report_set(tables: Mapping[str, DataFrame], root: str) -> list[str]:
    """Write the tables of a report that are still absent; returns the names written."""
    unknown = sorted(set(tables) - set(REPORT_TABLES))
    if unknown:
        raise ValueError(f"unknown report tables {unknown}")
    written = []
    for name in REPORT_TABLES:
        if name not in tables:
            continue
        path = f"{root}/aggregate/{name}"
        if not path_exists(tables[name].sparkSession, path):
            tables[name].write.mode("overwrite").parquet(path)  # a folder without the mark is what a lost writer left
            written.append(name)
    return written
