"""Joins by sample id: alignment, label agreement, cohorts, late labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from ..sources.tables import ContractError


def id_set_differences(tables: Mapping[str, DataFrame], reference: str) -> DataFrame:
    """Every id that a table lacks or has in excess of the reference table."""
    base = tables[reference].select("sample_id").distinct().withColumn("_in_ref", F.lit(True))
    out = None
    for name, df in tables.items():
        if name == reference:
            continue
        other = df.select("sample_id").distinct().withColumn("_in_other", F.lit(True))
        diff = base.join(other, "sample_id", "full_outer").filter("_in_ref is null or _in_other is null")
        row = diff.select(
            F.lit(name).alias("modality"),
            "sample_id",
            F.when(F.col("_in_other").isNull(), "missing").otherwise("unexpected").alias("kind"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def difference_report(diff: DataFrame, top: int = 10) -> DataFrame:
    """Count and the first ids of each (modality, kind); the first ids come from a per-task top-k."""
    keys = ["modality", "kind"]
    diff = cut_lineage(diff)
    counts = diff.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ids"))
    first = None
    for r in counts.select(*keys).collect():  # two kinds per modality
        part = diff.filter((F.col("modality") == r["modality"]) & (F.col("kind") == r["kind"])).orderBy("sample_id").limit(top)
        first = part if first is None else first.unionByName(part)
    if first is None:
        return counts.withColumn("first_ids", F.lit(None).cast("string"))
    listed = first.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("sample_id")), ",").alias("first_ids"))
    return counts.join(listed, keys)


def align(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Inner join on the id: one row per sample with all modality arrays and raw labels."""
    out = None
    for name, df in tables.items():
        part = df.select("sample_id", F.col("features").alias(name), F.col("label_raw").alias(f"label_{name}"))
        out = part if out is None else out.join(part, "sample_id")
    return out


def label_disagreements(aligned: DataFrame, names) -> DataFrame:
    first, *rest = [f"label_{n}" for n in names]
    bad = F.lit(False)
    for c in rest:
        bad = bad | ~F.col(first).eqNullSafe(F.col(c))
    return aligned.filter(bad)


def common_ids(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Lenient cohort: ids present in every table (semi joins, no error)."""
    names = list(tables)
    out = tables[names[0]].select("sample_id")
    for n in names[1:]:
        out = out.join(tables[n].select("sample_id"), "sample_id", "left_semi")
    return out


def strict_align(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Strict cohort ``(sample_id, y, modalities)``: id sets and labels must agree."""
    names = list(tables)
    diff = id_set_differences(tables, names[0]).limit(1).collect()
    if diff:
        raise ContractError(f"id sets differ, e.g. {diff[0].asDict()}")
    aligned = align(tables)
    bad = label_disagreements(aligned, names).limit(10).select("sample_id").collect()
    if bad:
        raise ContractError(f"labels disagree for {[r[0] for r in bad]}")
    return aligned.select("sample_id", (F.col(f"label_{names[0]}") - 1).alias("y"), *names)


def materialise_partition(cohort: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of every listed part: a join with the fold relation, never a collected id list."""
    return parts.join(cohort.drop("y"), "sample_id")


def late_labels(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Attach labels to frozen predictions; a prediction without a label is an error."""
    joined = predictions.join(labels.select("sample_id", "y"), "sample_id", "left")
    return joined.withColumn("y", F.coalesce("y", F.raise_error(F.lit("prediction without label")).cast("int")))


def union_synthetic(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Real rows unchanged, synthetic rows appended, told apart by ``is_synthetic``."""
    return real.withColumn("is_synthetic", F.lit(False)).unionByName(synthetic.withColumn("is_synthetic", F.lit(True)))


def exact_copies(rows: DataFrame, reference: DataFrame, vector: str = "z") -> DataFrame:
    """Rows whose 32-bit vector occurs in the reference (semi join on the array)."""
    return rows.join(reference.select(vector).distinct(), vector, "left_semi")


def copy_counts(rows: DataFrame, reference: DataFrame, keys, vector: str = "z") -> DataFrame:
    """Rows and copies per key; equal vectors are counted before the join, so a mass of copies is one row."""
    keys = list(keys)
    counted = rows.groupBy(*keys, vector).agg(F.count(F.lit(1)).alias("_n"))
    known = reference.select(vector).distinct().withColumn("_hit", F.lit(1))
    return counted.join(known, vector, "left").groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("_hit") == 1, F.col("_n"))), F.lit(0)).alias("n_copies")
    )
