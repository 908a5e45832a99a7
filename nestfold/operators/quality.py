"""How close synthetic rows B are to the real minority rows A, grouped by strategy.

Inputs are vector rows ``(strategy, side, sample_id, z)`` with side ``real`` or
``synthetic``; ``quality_cells`` gives the long form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .moments import correlations
from .neighbours import nearest_distance
from .preprocess import standardise
from .ranking import pick_quantiles, prefix_sums, value_counts
from .report import unpivot

QUANTILES = (0.05, 0.25, 0.50, 0.75, 0.95)


def quality_cells(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, "side", F.posexplode("z").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def numeric_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """count, min, mean, median, max and the five quantiles of a value per key."""
    keys = list(keys)
    base = df.groupBy(*keys).agg(F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    ranked = prefix_sums(value_counts(df, keys, value), keys, value, ["n"])
    q = pick_quantiles(ranked, keys, value, QUANTILES)
    return q.join(base, keys).withColumn("median", F.col("q50"))


def duplicate_metrics(rows: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Duplicates among synthetic rows, copies of real rows, unique ratio."""
    keys = list(keys)
    syn = rows.filter("side = 'synthetic'").groupBy(*keys, "z").agg(F.count(F.lit(1)).alias("n"))
    real = rows.filter("side = 'real'").select(*keys, "z").distinct().withColumn("_hit", F.lit(1))
    joined = syn.join(real, [*keys, "z"], "left")
    return joined.groupBy(*keys).agg(
        F.sum("n").alias("n_synthetic"),
        (F.sum("n") - F.count(F.lit(1))).alias("n_duplicates"),
        F.coalesce(F.sum(F.when(F.col("_hit") == 1, F.col("n"))), F.lit(0)).alias("n_copies_of_real"),
        F.count(F.lit(1)).alias("n_unique"),
        (F.count(F.lit(1)) / F.sum("n")).alias("unique_ratio"),
    )


def _by_side(value, side):
    return F.when(F.col("side") == side, value)


def shift_metrics(cells: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Mean and sd (ddof 1) of both sides, differences and absolute differences per feature."""
    x = F.col("x")
    base = cells.groupBy(*keys, "pos").agg(
        F.avg(_by_side(x, "real")).alias("real_mean"),
        F.avg(_by_side(x, "synthetic")).alias("synthetic_mean"),
        F.stddev_samp(_by_side(x, "real")).alias("real_sd"),
        F.stddev_samp(_by_side(x, "synthetic")).alias("synthetic_sd"),
    )
    dm, ds = F.col("synthetic_mean") - F.col("real_mean"), F.col("synthetic_sd") - F.col("real_sd")
    return base.select(
        "*",
        dm.alias("mean_difference"),
        F.abs(dm).alias("abs_mean_difference"),
        ds.alias("sd_difference"),
        F.abs(ds).alias("abs_sd_difference"),
    )


def distance_metrics(cells: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Wasserstein-1 distance and two-sample KS statistic per feature, from one sorted pass."""
    group = [*keys, "pos"]
    counts = cells.groupBy(*group, "x").agg(
        F.count_if(F.col("side") == "real").alias("a"), F.count_if(F.col("side") == "synthetic").alias("b")
    )
    ranked = prefix_sums(counts, group, "x", ["a", "b"], with_next=True)
    gap = F.abs(F.col("cum_a") / F.col("tot_a") - F.col("cum_b") / F.col("tot_b"))
    return ranked.groupBy(*group).agg(
        F.coalesce(F.sum(gap * (F.col("next_x") - F.col("x"))), F.lit(0.0)).alias("wasserstein"), F.max(gap).alias("ks")
    )


def range_violations(cells: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Synthetic values below the real minimum / above the real maximum per feature."""
    group = [*keys, "pos"]
    edge = cells.filter("side = 'real'").groupBy(*group).agg(F.min("x").alias("real_min"), F.max("x").alias("real_max"))
    syn = cells.filter("side = 'synthetic'").join(edge, group)
    return syn.groupBy(*group).agg(
        F.count_if(F.col("x") < F.col("real_min")).alias("n_below"),
        F.count_if(F.col("x") > F.col("real_max")).alias("n_above"),
    ).withColumn("n_total", F.col("n_below") + F.col("n_above"))


FEATURE_STATISTICS = ("abs_mean_difference", "abs_sd_difference", "wasserstein", "ks")


def feature_rollup(cells: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Summary over features of each per-feature statistic."""
    group = [*keys, "pos"]
    stats = shift_metrics(cells, keys).join(distance_metrics(cells, keys), group)
    long = unpivot(stats, keys, FEATURE_STATISTICS, "statistic", "value")
    return numeric_summary(long, [*keys, "statistic"], "value")


def correlation_preservation(rows: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """|corr_A - corr_B| over feature pairs; pairs with a constant feature are excluded and counted."""
    keys = list(keys)
    both = correlations(rows.select(*keys, "side", "z"), [*keys, "side"])
    paired = both.groupBy(*keys, "i", "j").agg(
        F.max(_by_side(F.col("corr"), "real")).alias("a"), F.max(_by_side(F.col("corr"), "synthetic")).alias("b")
    )
    diffs = paired.withColumn("d", F.abs(F.col("a") - F.col("b")))
    counts = diffs.groupBy(*keys).agg(
        F.count("d").alias("n_pairs"),
        F.count_if(F.col("d").isNull()).alias("n_excluded"),
        F.avg("d").alias("mean_abs_difference"),
        F.median("d").alias("median_abs_difference"),  # at most d^2/2 values
        F.max("d").alias("max_abs_difference"),
    )
    return counts


def neighbour_distances(rows: DataFrame, keys: Sequence[str] = ("strategy",), standardised: bool = False) -> DataFrame:
    """Nearest distances B to A, A to B and A to A (self excluded), one row per row and direction."""
    keys = list(keys)
    if standardised:
        cells = quality_cells(rows.filter("side = 'real'"), *keys)
        per = cells.groupBy(*keys, "pos").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
        per = per.withColumn("s", F.when(F.coalesce("s", F.lit(0.0)) < 1e-8, 1.0).otherwise(F.col("s")))
        frames = F.sort_array(F.collect_list(F.struct("pos", "m", "s")))
        scaler = per.groupBy(*keys).agg(frames.alias("_a")).select(
            *keys, F.transform("_a", lambda p: p["m"]).alias("mean"), F.transform("_a", lambda p: p["s"]).alias("scale")
        )
        rows = rows.join(scaler, keys).select(*keys, "side", "sample_id", standardise(F.col("z"), F.col("mean"), F.col("scale")).alias("z"))
    real = rows.filter("side = 'real'").select(*keys, "sample_id", "z")
    syn = rows.filter("side = 'synthetic'").select(*keys, "sample_id", "z")
    out = None
    for name, a, b, skip in (
        ("synthetic_to_real", syn, real, False),
        ("real_to_synthetic", real, syn, False),
        ("real_internal", real, real, True),
    ):
        part = nearest_distance(a, b, keys, exclude_self=skip).withColumn("direction", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
