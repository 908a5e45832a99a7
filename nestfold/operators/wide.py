"""Linear encoders of wide tables by a randomised range finder.

The principal directions of d standardised features are found without their d x d matrix:
a random sketch of ``k + OVERSAMPLE`` directions is multiplied by the covariance in one
pass over the rows, orthonormalised, sharpened by further passes, and rotated to the
directions of largest variance.  State is d x (k + OVERSAMPLE) numbers, linear in the
width.  Rows are sparse (``idx``, ``val``); centring is done on the products, so zeros stay implicit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import linear as L

OVERSAMPLE, POWER = 10, 2
MAX_STATE = 64_000_000  # numbers per task and on the driver


@dataclass(frozen=True)
class WideEncoder:
    """Mean and scale of every feature, loadings (features x k) and the variance along each of them."""

    n: int
    mean: np.ndarray
    scale: np.ndarray
    loadings: np.ndarray
    variance: np.ndarray
    total: float

    @property
    def error(self) -> float:
        """Mean squared reconstruction error per standardised cell of the rows it was fitted on."""
        return float((self.total - self.variance.sum()) / len(self.mean))

    def project(self, idx: np.ndarray, val: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Latents of ``rows`` sparse rows given as cells (row, idx, val)."""
        return _times(idx, val, row, rows, self.loadings / self.scale[:, None], self.mean)


def _times(idx: np.ndarray, val: np.ndarray, row: np.ndarray, rows: int, right: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return _added(row, val[:, None] * right[idx], rows) - mean @ right


def _added(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of ``values`` by their place ``at``, column by column."""
    return np.column_stack([np.bincount(at, v, size) for v in values.T])


def sparse_cells(values: Column) -> tuple[Column, Column]:
    """``idx`` and ``val`` of a dense array without its zeros and missing cells."""
    pairs = F.filter(F.transform(values, lambda v, i: F.struct(i.alias("i"), v.cast("double").alias("v"))), lambda p: F.coalesce(p["v"], F.lit(0.0)) != 0)
    return F.transform(pairs, lambda p: p["i"]).alias("idx"), F.transform(pairs, lambda p: p["v"]).alias("val")


def _cells(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    sizes = pdf["idx"].map(len).to_numpy()
    none = np.zeros(0)
    idx = np.concatenate([none, *pdf["idx"]]).astype(np.int64)
    return idx, np.concatenate([none, *pdf["val"]]).astype(float), np.repeat(np.arange(len(pdf)), sizes), len(pdf)


def _pass(rows: DataFrame, fold) -> dict[str, np.ndarray]:
    def run(batches):
        sums: dict = {}
        for pdf in batches:
            for a in range(0, len(pdf), 512):
                part = pdf.iloc[a : a + 512]
                for key, v in fold(*_cells(part)):
                    sums[key] = sums[key] + v if key in sums else v
        yield L.partial_frame(sums)

    return L.sum_partials(rows.select("idx", "val").mapInPandas(run, L.SUM_SCHEMA))


def fit_wide(rows: DataFrame, width: int, k: int, seed: int = 11, power: int = POWER, oversample: int = OVERSAMPLE) -> WideEncoder:
    """Encoder of ``k`` latents for sparse rows (``idx array<int>`` ascending or not, ``val array<double>``; a repeated index adds up).

    Constant features get scale 1 and no loading.  An empty table or one with a null row stops the job.
    """
    size = min(width, k + oversample)
    if k < 1 or k > width or width * size > MAX_STATE:
        raise ValueError(f"{k} latents of {width} features: between 1 and the width, and at most {MAX_STATE} numbers of state")

    def moments(idx, val, row, n):
        key, at = np.unique(row * width + idx, return_inverse=True)
        v = np.bincount(at, val)
        i = key % width
        yield "sums", np.concatenate([[n], np.bincount(i, v, width), np.bincount(i, v * v, width)])

    sums = _pass(rows, moments).get("sums")
    if sums is None or not sums[0]:
        raise ValueError("no rows to fit an encoder on")
    n, mean = int(sums[0]), sums[1 : width + 1] / sums[0]
    var = np.maximum(sums[width + 1 :] / n - mean * mean, 0.0)
    fixed = var < 1e-12 * np.maximum(1.0, mean * mean)
    scale = np.where(fixed, 1.0, np.sqrt(var))

    def covariance(right: np.ndarray) -> np.ndarray:
        """(standardised rows)' (standardised rows) right / n, in one pass."""
        right = np.where(fixed[:, None], 0.0, right)
        shared = rows.sparkSession.sparkContext.broadcast(right / scale[:, None])

        def products(idx, val, row, m):
            p = _times(idx, val, row, m, shared.value, mean)
            g = _added(idx, val[:, None] * p[row], width)
            yield "g", np.concatenate([g.ravel(), p.sum(0)])

        flat = _pass(rows, products)["g"]
        g = flat[: right.size].reshape(right.shape) - np.outer(mean, flat[right.size :])
        shared.destroy()
        return np.where(fixed[:, None], 0.0, g / scale[:, None] / n)

    basis = np.random.default_rng(seed).standard_normal((width, size))
    for _ in range(1 + power):
        basis = np.linalg.qr(covariance(basis))[0]
    small = basis.T @ covariance(basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(values)[::-1][:k]
    loadings = np.where(fixed[:, None], 0.0, basis @ vectors[:, order])
    signs = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(k)])
    return WideEncoder(n, mean, scale, loadings * np.where(signs == 0, 1.0, signs), np.maximum(values[order], 0.0), float((~fixed).sum()))


def encode_wide(rows: DataFrame, model: WideEncoder, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``z``, the latents of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            for a in range(0, len(pdf), 512):
                part = pdf.iloc[a : a + 512]
                yield pd.DataFrame({**{c: part[c] for c in keep}, "z": list(shared.value.project(*_cells(part)))})

    kinds = dict(rows.dtypes)
    return rows.select(*keep, "idx", "val").mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "z array<double>"]))
