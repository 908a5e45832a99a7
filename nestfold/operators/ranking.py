"""Prefix sums, ranks and exact quantiles that never put a whole key into one task.

A window ``PARTITION BY key ORDER BY value`` sends every row of a key to one
task.  Here ties are collapsed first by a map-side combined aggregate, the
distinct values are range-partitioned on ``(key, value)`` so that a hot key is
spread over many partitions, and each partition's running sum is shifted by
the total of the partitions before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Sequence[str],
    descending: bool = False,
    with_next: bool = False,
) -> DataFrame:
    """Add ``cum_<s>`` (inclusive) and ``tot_<s>`` per key in order of ``order``.

    ``df`` has one row per ``(keys, order)``.  ``with_next`` also adds
    ``next_<order>``, the following value of the same key.
    """
    keys = list(keys)
    direction = F.col(order).desc() if descending else F.col(order).asc()
    ranged = cut_lineage(
        df.select(*keys, order, *sums)
        .repartitionByRange(*[F.col(k) for k in keys], direction)
        .withColumn("_part", F.spark_partition_id())
    )
    edge = F.max(order) if descending else F.min(order)
    parts = ranged.groupBy(*keys, "_part").agg(
        *[F.sum(s).alias(f"_sum_{s}") for s in sums], edge.alias("_edge")
    )
    # One row per (key, partition): at most (#keys + #partitions) rows.
    by_key = W.partitionBy(*keys)
    before = by_key.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        *keys,
        "_part",
        *[F.coalesce(F.sum(f"_sum_{s}").over(before), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_sum_{s}").over(by_key).alias(f"tot_{s}") for s in sums],
        F.lead("_edge").over(by_key.orderBy("_part")).alias("_next_edge"),
    )
    local = W.partitionBy(*keys, "_part").orderBy(direction)
    running = local.rowsBetween(W.unboundedPreceding, 0)
    inner = [F.sum(s).over(running).alias(f"_run_{s}") for s in sums]
    if with_next:
        inner.append(F.lead(order).over(local).alias("_next_local"))
    out = ranged.select("*", *inner).join(offsets, [*keys, "_part"])
    cols: list[Column] = [*[F.col(k) for k in keys], F.col(order), *[F.col(s) for s in sums]]
    cols += [(F.col(f"_run_{s}") + F.col(f"_off_{s}")).alias(f"cum_{s}") for s in sums]
    cols += [F.col(f"tot_{s}") for s in sums]
    if with_next:
        cols.append(F.coalesce("_next_local", "_next_edge").alias(f"next_{order}"))
    return out.select(*cols)


def hash_slice(digest: str) -> Column:
    """The slice (0 to 4,095) of a hex digest."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def hash_rank(df: DataFrame, keys: Sequence[str], digest: str, out: str = "rank") -> DataFrame:
    """Exact ``row_number() OVER (PARTITION BY keys ORDER BY digest)``, spread over tasks.

    The digest is uniform, so its first three hex digits cut every key into
    4,096 equal slices; a slice's ranks start after the rows of the slices
    before it.  The slice counts are at most 4,096 rows per key.  The order is
    that of the digest's first 96 bits, which is all of it that is shuffled.
    """
    keys = list(keys)
    sliced = df.withColumn("_slice", hash_slice(digest)).withColumn("_order", F.expr(f"substring(unhex({digest}), 1, 12)")).drop(digest)
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    local = W.partitionBy(*keys, "_slice").orderBy("_order")
    return (
        sliced.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*keys, "_slice"])
        .withColumn(out, (F.col("_local") + F.col("_before")).cast("bigint"))
        .drop("_slice", "_order", "_local", "_before")
    )


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Collapse ties: one row per (keys, value) with its count ``n``."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def quantile_label(p: float) -> str:
    return f"q{round(p * 100):02d}"


def pick_quantiles(ranked: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Linear-interpolation quantiles from a ``prefix_sums`` result over counts ``n``."""
    picks, outs = [], []
    for p in probs:
        name = quantile_label(p)
        position = F.lit(float(p)) * (F.col("tot_n") - 1)
        picks.append(F.min(F.when(F.col("cum_n") > F.floor(position), F.col(value))).alias(f"_lo_{name}"))
        picks.append(F.min(F.when(F.col("cum_n") > F.ceil(position), F.col(value))).alias(f"_hi_{name}"))
        frac = F.lit(float(p)) * (F.col("count") - 1) - F.floor(F.lit(float(p)) * (F.col("count") - 1))
        outs.append(
            (F.col(f"_lo_{name}") + frac * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name)
        )
    grouped = ranked.groupBy(*keys).agg(F.max("tot_n").alias("count"), *picks)
    return grouped.select(*keys, "count", *outs)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles per key; columns ``count`` and ``qNN``."""
    ranked = prefix_sums(value_counts(df, keys, value), keys, value, ["n"])
    return pick_quantiles(ranked, keys, value, probs)
