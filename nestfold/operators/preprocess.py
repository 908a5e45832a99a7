"""Train-only imputation and scaling for every coordinate in one job.

Medians: one sort of the distinct values per feature serves all coordinates,
because the train count of a value is its total count minus its count in the
coordinate's test fold.  Means and variances: moments are aggregated per test
fold and the k-1 train folds are merged, so no row is copied k-1 times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import as_float_array
from ..sources.cohorts import MODALITIES, modality_cells
from .folds import OUTER_REPEATS, OUTER_SPLITS
from .ranking import prefix_sums

ZERO_VARIANCE = 1e-8
COORD = ["repeat_id", "fold_id"]


def attach_folds(cohort: DataFrame, arrays: DataFrame) -> DataFrame:
    return cohort.join(arrays, "sample_id")


def train_medians(cohort: DataFrame, n_splits: int = OUTER_SPLITS, n_repeats: int = OUTER_REPEATS) -> DataFrame:
    """``(repeat_id, fold_id, modality, pos, n_present, median)``; ``cohort`` carries ``fold_of``."""
    coords = [(r, f) for r in range(n_repeats) for f in range(n_splits)]
    cells = modality_cells(cohort, "fold_of").filter("x is not null")
    held = [F.count_if(F.col("fold_of")[r] == f).alias(f"t{r}_{f}") for r, f in coords]
    train = [(F.col("n") - F.col(f"t{r}_{f}")).alias(f"c{r}_{f}") for r, f in coords]
    counts = (
        cells.groupBy("modality", "pos", "x").agg(F.count(F.lit(1)).alias("n"), *held).select("modality", "pos", "x", *train)
    )
    names = [f"c{r}_{f}" for r, f in coords]
    ranked = prefix_sums(counts, ["modality", "pos"], "x", names)
    picks = []
    for c in names:
        lower = F.floor((F.col(f"tot_{c}") + 1) / 2)
        upper = F.floor(F.col(f"tot_{c}") / 2) + 1
        picks.append(F.min(F.when(F.col(f"cum_{c}") >= lower, F.col("x"))).alias(f"lo_{c}"))
        picks.append(F.min(F.when(F.col(f"cum_{c}") >= upper, F.col("x"))).alias(f"hi_{c}"))
        picks.append(F.max(f"tot_{c}").alias(f"tot_{c}"))
    wide = ranked.groupBy("modality", "pos").agg(*picks)
    stacked = F.array(
        *[
            F.struct(
                F.lit(r).alias("repeat_id"),
                F.lit(f).alias("fold_id"),
                F.col(f"tot_c{r}_{f}").cast("bigint").alias("n_present"),
                ((F.col(f"lo_c{r}_{f}") + F.col(f"hi_c{r}_{f}")) / 2).alias("median"),
            )
            for r, f in coords
        ]
    )
    return wide.select("modality", "pos", F.explode(stacked).alias("s")).select(*[f"s.{c}" for c in COORD], "modality", "pos", "s.n_present", "s.median")


def train_moments(cohort: DataFrame, medians: DataFrame, n_splits: int = OUTER_SPLITS) -> DataFrame:
    """Mean, population variance and scale of the imputed train values."""
    own = modality_cells(cohort, "fold_of").select(
        F.posexplode("fold_of").alias("repeat_id", "_own"), "modality", "pos", "x"
    )
    keys = ["repeat_id", "modality", "pos"]
    cell = own.groupBy(*keys, "_own").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("x").alias("m"),
        F.coalesce(F.avg("x"), F.lit(0.0)).alias("mu"),
        (F.coalesce(F.var_pop("x"), F.lit(0.0)) * F.count("x")).alias("m2"),
    )
    fold = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold_id")
    parts = cell.select("*", fold).filter("fold_id <> _own")
    with_median = parts.join(medians, [*COORD, "modality", "pos"])
    # Each train fold contributes its present values and its imputed ones.
    grouped = with_median.groupBy(*COORD, "modality", "pos").agg(
        F.max("median").alias("median"),
        F.sum("n").alias("n_train"),
        F.sum(F.col("n") - F.col("m")).alias("n_missing"),
        (F.sum(F.col("m") * F.col("mu") + (F.col("n") - F.col("m")) * F.coalesce("median", F.lit(0.0))) / F.sum("n")).alias("mean"),
        F.collect_list(F.struct("m", "mu", "m2")).alias("_parts"),  # k-1 entries
    )
    spread = F.aggregate(
        "_parts",
        F.col("n_missing") * F.pow(F.coalesce("median", F.lit(0.0)) - F.col("mean"), F.lit(2)),
        lambda acc, p: acc + p["m2"] + p["m"] * F.pow(p["mu"] - F.col("mean"), F.lit(2)),
    )
    return grouped.withColumn("variance", spread / F.col("n_train")).select(
        *COORD,
        "modality",
        "pos",
        "n_train",
        "n_missing",
        "median",
        "mean",
        "variance",
        F.when(F.col("variance") < 1e-20, 1.0).otherwise(F.sqrt("variance")).alias("scale"),
    )


def fit(cohort: DataFrame, n_splits: int = OUTER_SPLITS, n_repeats: int = OUTER_REPEATS) -> DataFrame:
    """Fitted state in long form, one row per (coordinate, modality, feature)."""
    medians = train_medians(cohort, n_splits, n_repeats)
    return train_moments(cohort, medians, n_splits)


def stats_arrays(state: DataFrame, keys: Sequence[str] = tuple(COORD)) -> DataFrame:
    """One row per coordinate: ``<m>_median/mean/scale`` arrays in feature order."""
    frames = F.sort_array(F.collect_list(F.struct("pos", "median", "mean", "scale")))
    per_modality = state.groupBy(*keys, "modality").agg(frames.alias("_a"))
    aggs = []
    for m in MODALITIES:
        chosen = F.max(F.when(F.col("modality") == m, F.col("_a")))
        for c in ("median", "mean", "scale"):
            aggs.append(chosen.getField(c).alias(f"{m}_{c}"))
    return per_modality.groupBy(*keys).agg(*aggs)


def scaled(values, median, mean, scale):
    """Impute with the train median, standardise, store as 32-bit."""
    zipped = F.arrays_zip(values.alias("x"), median.alias("q"), mean.alias("m"), scale.alias("s"))
    return as_float_array(F.transform(zipped, lambda t: (F.coalesce(t["x"], t["q"]) - t["m"]) / t["s"]))


def transform_held_out(cohort: DataFrame, stats: DataFrame) -> DataFrame:
    """Held-out rows of every coordinate: each sample appears once per repeat."""
    held = cohort.select("sample_id", "y", *MODALITIES, F.posexplode("fold_of").alias("repeat_id", "fold_id"))
    joined = held.join(F.broadcast(stats), COORD)  # repeats x folds rows of feature-wide arrays
    out = [scaled(F.col(m), F.col(f"{m}_median"), F.col(f"{m}_mean"), F.col(f"{m}_scale")).alias(m) for m in MODALITIES]
    return joined.select(*COORD, "sample_id", "y", *out)


def transform_train(cohort: DataFrame, stats: DataFrame, n_splits: int = OUTER_SPLITS) -> DataFrame:
    """Train rows of every coordinate (k-1 copies of each sample per repeat)."""
    fold = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold_id")
    own = cohort.select("sample_id", "y", *MODALITIES, F.posexplode("fold_of").alias("repeat_id", "_own"))
    rows = own.select("*", fold).filter("fold_id <> _own")
    joined = rows.join(F.broadcast(stats), COORD)
    out = [scaled(F.col(m), F.col(f"{m}_median"), F.col(f"{m}_mean"), F.col(f"{m}_scale")).alias(m) for m in MODALITIES]
    return joined.select(*COORD, "sample_id", "y", *out)


def fused(cols: Sequence[str] = MODALITIES):
    """Stack the modality vectors in protocol order."""
    return F.concat(*[F.col(c) for c in cols])


def fit_dense(rows: DataFrame, keys: Sequence[str], vector: str = "z") -> DataFrame:
    """Mean and population scale of complete vectors per key, as arrays."""
    cells = rows.select(*keys, F.posexplode(vector).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    per_pos = cells.groupBy(*keys, "pos").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("v"))
    per_pos = per_pos.withColumn("scale", F.when(F.col("v") < 1e-20, 1.0).otherwise(F.sqrt("v")))
    frames = F.sort_array(F.collect_list(F.struct("pos", "mean", "scale")))
    return per_pos.groupBy(*keys).agg(frames.alias("_a")).select(
        *keys, F.transform("_a", lambda s: s["mean"]).alias("mean"), F.transform("_a", lambda s: s["scale"]).alias("scale")
    )


def standardise(vector, mean, scale):
    return F.transform(
        F.arrays_zip(vector.alias("x"), mean.alias("m"), scale.alias("s")),
        lambda t: (t["x"].cast("double") - t["m"]) / t["s"],
    )
