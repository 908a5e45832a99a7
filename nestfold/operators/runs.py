"""Restartable runs: coordinates are scored, evaluated and published once, failures become rows.

All open coordinates of a stage go through one Spark job.  If the job fails, the list is halved until
the failing coordinates stand alone, so the others are still published and a healthy run costs one job
per stage.  A job writes to a folder of its own (an attempt) and a receipt is appended after the job
has ended; only attempts with receipts are read, so output of a lost driver is never met.  What is open
follows from the receipts alone, and a second run takes only that.

The plan, the receipts and the failures have a few rows per coordinate; they are the only rows that
reach the driver.  Two drivers on one study are not locked out, but a coordinate that both publish
with different contents is refused when it is read.
"""

from __future__ import annotations

import hashlib
import traceback
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.sinks import canonical_json
from .identity import multiset_digest
from .report import progress

KEYS = ("repeat_id", "fold_id")
STAGES = ("scoring", "evaluation")
MESSAGE_LENGTH = 500
BINDING = "study_sha256 string"
RECEIPT = "stage string, repeat_id int, fold_id int, attempt string, run string, n_rows bigint, content_sha256 string, scoring_sha256 string"
FAILURE = "at_utc string, run string, stage string, repeat_id int, fold_id int, error_class string, message string, trace_sha256 string"

Coordinate = tuple[int, int]


class RunError(ValueError):
    """Published rows that contradict their receipts or the plan."""


def _contents(rows: DataFrame) -> DataFrame:
    """Rows and multiset digest of each coordinate."""
    body = canonical_json([c for c in rows.columns if c not in KEYS and c != "attempt"])
    return rows.select(*KEYS, F.sha2(body, 256).alias("_d")).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"), multiset_digest(F.col("_d")).alias("content_sha256"))


class StudyRun:
    """One run of a study; opening an existing study with another identity is refused.

    ``plan`` lists the coordinates, ``identity`` is a text that names data, folds and settings.
    """

    def __init__(self, spark: SparkSession, root: str, identity: str, plan: DataFrame):
        self.spark, self.root, self.run_id = spark, root, uuid.uuid4().hex
        self.plan = sorted((r["repeat_id"], r["fold_id"]) for r in plan.select(*KEYS).collect())
        if len(set(self.plan)) != len(self.plan):
            raise RunError("the plan names a coordinate twice")
        held = {r[0] for r in self._table("binding", BINDING).collect()}
        if not held:
            self._append("binding", [(identity,)], BINDING)
        elif held != {identity}:
            raise RunError(f"{root} belongs to another study")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, name: str, rows: Sequence[tuple], schema: str) -> None:
        self.spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def failures(self) -> DataFrame:
        """All failures of all runs."""
        return self._table("failures", FAILURE)

    def receipts(self, stage: str) -> dict[Coordinate, dict]:
        """The valid receipt of each published coordinate."""
        found: dict[Coordinate, dict] = {}
        for r in sorted(self._table("receipts", RECEIPT).filter(F.col("stage") == stage).collect(), key=lambda r: r["attempt"]):
            kept = found.setdefault((r["repeat_id"], r["fold_id"]), r.asDict())
            if kept["content_sha256"] != r["content_sha256"] or kept["scoring_sha256"] != r["scoring_sha256"]:
                raise RunError(f"{stage} of coordinate {(r['repeat_id'], r['fold_id'])} was published twice with different contents")
        if stage == "evaluation":
            scored = self.receipts("scoring")
            for at, r in found.items():
                if at not in scored or scored[at]["content_sha256"] != r["scoring_sha256"]:
                    raise RunError(f"evaluation of coordinate {at} does not belong to its published scores")
        return found

    def states(self) -> DataFrame:
        """State of every planned coordinate, from the receipts."""
        at = lambda rows: self.spark.createDataFrame(sorted(rows), "repeat_id int, fold_id int")
        return progress(at(self.plan), at(self.receipts("scoring")), at(self.receipts("evaluation")))

    def summary(self) -> DataFrame:
        """One row: state of the study, coordinates, complete ones, failures logged so far."""
        done, begun = F.count_if(F.col("state") == "EVALUATION_PUBLISHED"), F.count_if(F.col("state") != "PENDING")
        state = F.when(F.col("n_complete") == F.col("n_coordinates"), "COMPLETE").when(F.col("n_begun") == 0, "PREFLIGHTED").otherwise("RUNNING")
        counted = self.states().agg(F.count(F.lit(1)).alias("n_coordinates"), done.alias("n_complete"), begun.alias("n_begun"))
        failed = self.failures().agg(F.count(F.lit(1)).alias("n_failures"))
        return counted.crossJoin(failed).select(state.alias("study_state"), "n_coordinates", "n_complete", "n_failures")  # one row each

    def published(self, stage: str, at: Sequence[Coordinate] | None = None) -> DataFrame:
        """Rows of published coordinates; folders without a receipt are not read."""
        receipts = self.receipts(stage)
        wanted = [c for c in (receipts if at is None else at)]
        missing = [c for c in wanted if c not in receipts]
        if missing or not wanted:
            raise RunError(f"no published {stage} of {missing or 'any coordinate'}")
        by_attempt: dict[str, list[Coordinate]] = {}
        for c in wanted:
            by_attempt.setdefault(receipts[c]["attempt"], []).append(c)
        base = f"{self.root}/{stage}"
        rows = self.spark.read.option("basePath", base).parquet(*[f"{base}/attempt={a}" for a in by_attempt])
        keep = F.lit(False)
        for attempt, coords in by_attempt.items():
            folds: dict[int, list[int]] = {}
            for repeat_id, fold_id in coords:
                folds.setdefault(repeat_id, []).append(fold_id)
            for repeat_id, fold_ids in folds.items():  # plain comparisons, so folders are pruned
                keep = keep | ((F.col("attempt") == attempt) & (F.col("repeat_id") == repeat_id) & F.col("fold_id").isin(fold_ids))
        return rows.filter(keep).drop("attempt")

    def verify(self, stage: str, at: Sequence[Coordinate]) -> None:
        """Compare published rows with their receipts."""
        receipts = self.receipts(stage)
        held = {(r["repeat_id"], r["fold_id"]): (r["n_rows"], r["content_sha256"]) for r in _contents(self.published(stage, at)).collect()}
        changed = [c for c in at if held.get(c) != (receipts[c]["n_rows"], receipts[c]["content_sha256"])]
        if changed:
            raise RunError(f"published {stage} of {changed} differs from its receipt")

    def _publish(self, stage: str, at: Sequence[Coordinate], rows: DataFrame) -> None:
        attempt = f"a-{uuid.uuid4().hex}"
        path = f"{self.root}/{stage}/attempt={attempt}"
        rows.write.mode("errorifexists").partitionBy(*KEYS).parquet(path)
        made = {(r["repeat_id"], r["fold_id"]): r for r in _contents(self.spark.read.schema(rows.schema).parquet(path)).collect()}
        if set(made) != set(at):
            raise RunError(f"{stage} gave rows of {sorted(set(made) - set(at))} and none of {sorted(set(at) - set(made))}")
        scored = self.receipts("scoring") if stage == "evaluation" else {}
        self._append("receipts", [(stage, *c, attempt, self.run_id, made[c]["n_rows"], made[c]["content_sha256"], scored[c]["content_sha256"] if scored else None) for c in at], RECEIPT)

    def _fail(self, stage: str, at: Coordinate, error: Exception) -> None:
        now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        trace = hashlib.sha256("".join(traceback.format_exception(error)).encode()).hexdigest()
        self._append("failures", [(now, self.run_id, stage, *at, type(error).__name__, " ".join(str(error).split())[:MESSAGE_LENGTH], trace)], FAILURE)

    def _advance(self, stage: str, at: list[Coordinate], make: Callable[[list[Coordinate]], DataFrame]) -> None:
        if not at:
            return
        try:
            self._publish(stage, at, make(at))
        except Exception as error:  # the failing coordinates are found and logged, the others published
            if len(at) == 1:
                self._fail(stage, at[0], error)
                return
            half = len(at) // 2
            self._advance(stage, at[:half], make)
            self._advance(stage, at[half:], make)

    def run(self, score: Callable[[list[Coordinate]], DataFrame], evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Score what is pending, evaluate what is scored, and return the states.

        ``score`` gets the open coordinates and returns their rows; ``evaluate`` gets published scores,
        verified against their receipts.  Both return ``repeat_id``, ``fold_id`` and columns of their own.
        """
        scored = self.receipts("scoring")
        self._advance("scoring", [c for c in self.plan if c not in scored], score)

        def evaluated(at: list[Coordinate]) -> DataFrame:
            self.verify("scoring", at)
            return evaluate(self.published("scoring", at))

        scored, done = self.receipts("scoring"), self.receipts("evaluation")
        self._advance("evaluation", [c for c in self.plan if c in scored and c not in done], evaluated)
        return self.states()


def of_coordinates(rows: DataFrame, at: Sequence[Coordinate]) -> DataFrame:
    """Rows of the listed coordinates."""
    keep = F.lit(False)
    for repeat_id in sorted({r for r, _ in at}):
        keep = keep | ((F.col("repeat_id") == repeat_id) & F.col("fold_id").isin([f for r, f in at if r == repeat_id]))
    return rows.filter(keep)
