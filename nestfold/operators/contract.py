"""Data-contract checks on raw modality tables and parsed cohorts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import is_infinite
from ..sources.cohorts import MODALITIES, modality_cells
from ..sources.tables import ContractError

# Columns and name tokens that may not be model features.
FORBIDDEN_COLUMNS = ("SAMPLE_ID", "CLASS")
FORBIDDEN_TOKENS = ("class", "sample_id", "target", "label", "is_synthetic", "synthetic", "real")
FORBIDDEN_NAMES = (
    "sample_id",
    "class",
    "outcome_class",
    "target",
    "label",
    "y",
    "provenance",
    "is_synthetic",
    "record_id",
    "synthetic_record_id",
)
HIGH_MISSINGNESS = 0.80
MODERATE_MISSINGNESS = 0.95


def is_blank(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.isNull() | (F.trim(col) == "")


def duplicate_ids(df: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Each repeated id with its number of rows."""
    return df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def label_violations(df: DataFrame, label: str, allowed: Sequence[int] = (1, 2)) -> DataFrame:
    """Distinct label texts that are not one of the allowed numbers, with row counts."""
    number = F.expr(f"try_cast({label} as double)")
    good = F.coalesce(number.isin([float(a) for a in allowed]), F.lit(False))
    return df.filter(~good).groupBy(F.col(label).alias("bad_label")).agg(F.count(F.lit(1)).alias("n_rows"))


def label_to_binary(label: str) -> Column:
    """Raw 1 (low) to 0 and raw 2 (high) to 1; no numeric cut-off is asserted."""
    return F.when(F.col(label) == 2, F.lit(1)).otherwise(F.lit(0))


def unparsable(text: Column) -> Column:
    """A non-blank cell that is no number (an empty cell is just missing)."""
    return text.try_cast("double").isNull() & ~(text.isNull() | (F.trim(text) == ""))


def table_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, distinct ids, features, missing cells and duplicate-id rows per modality."""
    out = None
    for name, df in tables.items():
        per_id = df.groupBy("sample_id").agg(
            F.count(F.lit(1)).alias("k"),
            F.max(F.size("features")).alias("width"),
            F.sum(F.size(F.filter("features", lambda x: x.isNull()))).alias("missing"),
        )
        row = per_id.agg(
            F.sum("k").alias("n_rows"),
            F.count(F.lit(1)).alias("n_ids"),
            F.max("width").cast("bigint").alias("n_features"),
            F.sum("missing").alias("n_missing"),
            F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("n_duplicate_rows"),
        ).select(F.lit(name).alias("modality"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def class_counts(df: DataFrame, label: str = "y", domain: Sequence[int] = (0, 1)) -> DataFrame:
    """Count per label, zero-filled over the domain."""
    zero = [F.lit(d).cast("int") for d in domain]
    found = df.groupBy(F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    fill = df.sparkSession.range(1).select(F.explode(F.array(*zero)).alias("label"), F.lit(0).cast("bigint").alias("n"))
    return found.unionByName(fill).groupBy("label").agg(F.sum("n").alias("n"))


def completeness(modalities: Sequence[str] = MODALITIES) -> Column:
    """Non-missing share of a row's cells over all modalities."""
    present = sum((F.size(F.filter(m, lambda x: x.isNotNull())) for m in modalities), F.lit(0))
    cells = sum((F.size(m) for m in modalities), F.lit(0))
    return present / cells


def missingness_band(share: Column) -> Column:
    return (
        F.when(share < HIGH_MISSINGNESS, "high_missingness_detected")
        .when(share < MODERATE_MISSINGNESS, "moderate_missingness_detected")
        .otherwise("none")
    )


def forbidden_name(name: Column) -> Column:
    lowered = F.lower(name)
    hit = lowered.isin(*FORBIDDEN_NAMES) | F.upper(name).isin(*FORBIDDEN_COLUMNS)
    for token in FORBIDDEN_TOKENS:
        hit = hit | lowered.contains(token)
    return hit


def leakage_report(cohort: DataFrame, names: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per feature: forbidden name, correlation with the label, share of exact copies."""
    listed = F.map_from_arrays(
        F.array(*[F.lit(m) for m in names]), F.array(*[F.array(*[F.lit(n) for n in ns]) for ns in names.values()])
    )
    cells = modality_cells(cohort, "y")
    stats = cells.groupBy("modality", "pos").agg(
        F.corr("x", F.col("y").cast("double")).alias("label_corr"),
        F.count_if(F.col("x") == F.col("y")).alias("n_equal"),
        F.count("x").alias("n_present"),
    )
    name = F.element_at(F.element_at(listed, F.col("modality")), F.col("pos") + 1)
    return stats.select(
        "modality",
        name.alias("feature"),
        forbidden_name(name).alias("forbidden_name"),
        "label_corr",
        "n_equal",
        ((F.col("n_present") > 0) & (F.col("n_equal") == F.col("n_present"))).alias("copies_label"),
    )


def validate_text_table(raw: DataFrame, modality: str) -> None:
    """Raise on the first broken rule of a raw (all-string) modality table; one aggregate job."""
    features = [c for c in raw.columns if c not in FORBIDDEN_COLUMNS]
    label = F.expr("try_cast(CLASS as double)")
    found = raw.agg(
        F.count_if(is_blank("SAMPLE_ID")).alias("blank_ids"),
        F.count_if(~F.coalesce(label.isin(1.0, 2.0), F.lit(False))).alias("bad_labels"),
    ).first()
    if found["blank_ids"]:
        raise ContractError(f"{modality}: {found['blank_ids']} null or blank ids")
    repeated = duplicate_ids(raw, "SAMPLE_ID").orderBy("SAMPLE_ID").limit(10).collect()
    if repeated:
        raise ContractError(f"{modality}: duplicate ids {[r[0] for r in repeated]}")
    if found["bad_labels"]:
        raise ContractError(f"{modality}: {found['bad_labels']} labels outside 1 and 2")
    # one array per row instead of two aggregates per feature: the plan does not grow with the width
    cells = raw.select(F.posexplode(F.array(*[F.col(f"`{n}`") for n in features])).alias("i", "text"))
    infinite = F.coalesce(is_infinite(F.col("text").try_cast("double")), F.lit(False))
    broken = cells.groupBy("i").agg(F.count_if(unparsable(F.col("text"))).alias("texts"), F.count_if(infinite).alias("infs"))
    first = broken.where("texts > 0 or infs > 0").orderBy("i").first()
    if first:
        kind = "non-numeric" if first["texts"] else "infinite"
        raise ContractError(f"{modality}: feature {features[first['i']]!r} holds {kind} values")
