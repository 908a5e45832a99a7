"""Means and covariances of vector columns: partial Gram matrices per partition, then a sum.

Each task folds its Arrow batches into one d x d matrix per key, so what is
shuffled is d^2 numbers per (task, key), never the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import attach_row

MAX_WIDTH = 2048  # a d x d matrix of doubles stays below 32 MB


def stack(series: pd.Series) -> np.ndarray:
    return np.vstack(series.to_numpy()).astype(np.float64)


def list_matrix(column: pa.ListArray, dtype) -> np.ndarray:
    """Lists of one length as a matrix; missing cells are NaN."""
    values, n = column.flatten(), len(column)
    width = len(values) // max(n, 1)
    if column.null_count or (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError("arrays of different lengths")
    return np.ascontiguousarray(values.to_numpy(zero_copy_only=False), dtype=dtype).reshape(n, width)


def centred_gram(rows: DataFrame, keys: Sequence[str], vector: str = "z") -> DataFrame:
    """``(keys, i, j, s, n)`` with i <= j: sums of centred cross products."""
    keys = list(keys)
    means = rows.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(
        F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n")
    )
    packed = means.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("_mean"),
        F.max("n").alias("n"),
    )
    if keys:
        joined = rows.select(*keys, vector).join(packed, keys)
    else:
        joined = attach_row(rows.select(vector), packed)
    types = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys)

    def partial(batches):
        sums: dict = {}
        for pdf in batches:
            groups = pdf.groupby(keys, sort=False) if keys else [((), pdf)]
            for key, part in groups:
                if not len(part):
                    continue
                key = key if isinstance(key, tuple) else (key,)
                c = stack(part[vector]) - np.asarray(part["_mean"].iloc[0], dtype=np.float64)
                g = c.T @ c
                old = sums.get(key)
                sums[key] = (g if old is None else old[0] + g, part["n"].iloc[0])
        out = [[*key, g[np.triu_indices(len(g))].tolist(), n, len(g)] for key, (g, n) in sums.items()]
        if out:
            yield pd.DataFrame(out, columns=[*keys, "tri", "n", "d"])

    parts = joined.mapInPandas(partial, f"{types}tri array<double>, n bigint, d int")
    summed = parts.select(*keys, "n", "d", F.posexplode("tri").alias("t", "v")).groupBy(*keys, "t").agg(
        F.sum("v").alias("s"), F.max("n").alias("n"), F.max("d").alias("d")
    )
    # Row i of the upper triangle starts at t = i*d - i*(i-1)/2.
    b = F.col("d") + 0.5
    i = F.floor(b - F.sqrt(b * b - 2.0 * F.col("t")) + 1e-9).cast("int")
    start = i * F.col("d") - (i * (i - 1) / 2).cast("int")
    return summed.select(*keys, i.alias("i"), (F.col("t") - start + i).cast("int").alias("j"), "s", "n")


def covariance_matrix(rows: DataFrame, vector: str = "z") -> tuple[np.ndarray, np.ndarray, int]:
    """Mean vector, sum-of-products matrix and count of one key, on the driver (d^2 numbers)."""
    width = rows.select(F.size(vector).alias("d")).limit(1).collect()[0]["d"]
    if width > MAX_WIDTH:
        raise ValueError(f"vectors of width {width} exceed the covariance bound {MAX_WIDTH}")
    means = rows.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("pos").collect()
    cells = centred_gram(rows, [], vector).collect()
    g = np.zeros((width, width))
    n = 0
    for r in cells:
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["s"]
        n = r["n"]
    return np.array([r["m"] for r in means]), g, n


def correlations(rows: DataFrame, keys: Sequence[str], vector: str = "z") -> DataFrame:
    """``(keys, i, j, corr)`` for i < j; null when a feature has no variance."""
    keys = list(keys)
    gram = centred_gram(rows, keys, vector)
    diag = gram.filter("i = j").select(*keys, "i", F.when(F.sqrt(F.col("s") / (F.col("n") - 1)) > 1e-8, F.col("s")).alias("v"))
    left = diag.withColumnRenamed("v", "_vi")
    right = diag.withColumnRenamed("v", "_vj").withColumnRenamed("i", "j")
    return (
        gram.filter("i < j")
        .join(left, [*keys, "i"])
        .join(right, [*keys, "j"])
        .select(*keys, "i", "j", (F.col("s") / F.sqrt(F.col("_vi") * F.col("_vj"))).alias("corr"))
    )
