"""Sigmoid calibration p = 1/(1+exp(-(a*s+b))) fitted for many keys at once.

Scores are packed into blocks once; a Newton step folds each block into six sums for every
calibrator that its rows count for, so no row is copied per calibrator.  The only state is two numbers per key.
"""

from __future__ import annotations

from collections.abc import Sequence

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import sigmoid
from ..session import cut_lineage
from .linear import log_of_sums

MAX_STEPS = 1000
TOLERANCE = 1e-12
MAX_KEYS = 100_000


BLOCK_SCHEMA = "k binary, score binary, y binary"  # 32-bit group numbers (one, or one per score), doubles, doubles
SUMS = ("g0", "g1", "h00", "h01", "h11", "loss", "n")


def block_row(k, score: np.ndarray, y: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """One packed block of ``BLOCK_SCHEMA``."""
    return np.asarray(k, dtype=np.int32).tobytes(), np.asarray(score, dtype=float).tobytes(), np.asarray(y, dtype=float).tobytes()


def _unpacked(batch: pa.RecordBatch):
    for k, score, y in zip(batch.column("k").to_pylist(), batch.column("score").to_pylist(), batch.column("y").to_pylist()):
        yield np.frombuffer(k, dtype=np.int32), np.frombuffer(score), np.frombuffer(y)


def _groups(rows: DataFrame, keys: Sequence[str], score: str, label: str) -> tuple[list, DataFrame]:
    """Count, label sum, mean and squared deviations of every key, and the rows as packed blocks."""
    base = rows.groupBy(*keys).agg(
        F.count(label).alias("n_y"),
        F.coalesce(F.sum(F.col(label).cast("double")), F.lit(0.0)).alias("sum_y"),
        F.count(score).alias("n"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("mu"),
        F.coalesce(F.var_pop(score), F.lit(0.0)).alias("var"),
    ).limit(MAX_KEYS + 1).collect()
    if len(base) > MAX_KEYS:
        raise ValueError("calibration keeps two numbers per key on the driver; too many keys")
    groups = [(tuple(r[k] for k in keys), r["n_y"], r["sum_y"], r["n"], r["mu"], r["n"] * r["var"]) for r in base]
    if not groups:
        return groups, rows.sparkSession.createDataFrame([], BLOCK_SCHEMA)
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", _k int"
    numbers = F.broadcast(rows.sparkSession.createDataFrame([(*g[0], i) for i, g in enumerate(groups)], schema))  # one row per key

    def pack(batches):
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("_k", "_s", "_y")]
            yield pa.RecordBatch.from_arrays([pa.array([v], type=pa.binary()) for v in block_row(*columns)], ["k", "score", "y"])

    used = rows.select(*keys, F.col(score).cast("double").alias("_s"), F.col(label).cast("double").alias("_y")).filter("_s is not null")
    return groups, cut_lineage(used.join(numbers, list(keys)).select("_k", "_s", "_y").mapInArrow(pack, BLOCK_SCHEMA))


def _block_sums(s: np.ndarray, y: np.ndarray, a, b, mu, sd, c=None, n: int = 0):
    """The sums of one Newton step: of the whole block, or per calibrator number ``c`` (below ``n``)."""
    t = (s - mu) / sd
    eta = a * t + b
    e = np.exp(-np.abs(eta))
    p = np.where(eta >= 0, 1.0, e) / (1.0 + e)
    r, h = p - y, p * (1.0 - p)
    loss = np.maximum(eta, 0.0) - y * eta
    known = ~np.isnan(y)  # a row without a label counts for the curvature only
    if not known.all():
        r, loss = np.where(known, r, 0.0), np.where(known, loss, 0.0)
    if c is None:
        return np.array([r.sum(), r @ t, h.sum(), h @ t, h @ (t * t), loss.sum() + log_of_sums(e[known]), known.sum()])
    each = (r, r * t, h, h * t, h * t * t, loss + np.log1p(e) * known, known)
    return np.column_stack([np.bincount(c, weights=v, minlength=n) for v in each])


def _newton_sums(blocks: DataFrame, uses: np.ndarray, params: np.ndarray) -> dict:
    """Sums per calibrator over all blocks; ``uses[k]`` lists the calibrators that group ``k`` counts for (-1: none).

    ``params`` has the rows a, b, mu, sd and whether the calibrator still moves.
    """
    shared = blocks.sparkSession.sparkContext.broadcast((uses, params))

    def run(batches):
        uses, (a, b, mu, sd, moving) = shared.value
        used = np.where((uses >= 0) & (moving[uses] > 0), uses, -1)
        sums = np.zeros((len(a), len(SUMS)))
        for batch in batches:
            for k, s, y in _unpacked(batch):
                if len(k) == 1:
                    for c in used[k[0]]:
                        if c >= 0:
                            sums[c] += _block_sums(s, y, a[c], b[c], mu[c], sd[c])
                    continue
                for column in used.T:
                    c = column[k]
                    on = c >= 0
                    if on.any():
                        c = c[on]
                        present, at = np.unique(c, return_inverse=True)
                        sums[present] += _block_sums(s[on], y[on], a[c], b[c], mu[c], sd[c], at, len(present))
        at = np.flatnonzero(sums[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(v) for v in sums[at].T]], ["c", *SUMS])

    parts = blocks.mapInArrow(run, "c int, " + ", ".join(f"{n} double" for n in SUMS))
    return {r["c"]: r for r in parts.groupBy("c").agg(*[F.sum(n).alias(n) for n in SUMS]).collect()}


def _merged(parts: Sequence[tuple]) -> tuple:
    """Count and sum of labels, count, mean and squared deviations of a union of groups."""
    n_y, sum_y, n = (sum(p[i] for p in parts) for i in (1, 2, 3))
    mu = sum(p[3] * p[4] for p in parts) / max(n, 1)
    return n_y, sum_y, n, mu, sum(p[5] + p[3] * (p[4] - mu) ** 2 for p in parts)


def _fit(blocks: DataFrame, groups: list, members: dict, keys: Sequence[tuple[str, str]], max_steps: int) -> DataFrame:
    """Newton for all calibrators; ``members`` maps a calibrator's key to the numbers of its groups."""
    state, lists = {}, [[] for _ in groups]
    for c, (key, own) in enumerate(members.items()):
        n_y, sum_y, n, mu, squares = _merged([groups[k] for k in own])
        if not 0 < sum_y < n_y:
            raise ValueError(f"calibration needs both classes in {list(key)}")
        rate = sum_y / n_y
        state[c] = {
            "w": [0.0, math.log(rate / (1 - rate))],
            "mu": mu,
            "sd": math.sqrt(squares / max(n, 1)) or 1.0,
            "loss": math.inf,
            "step": (0.0, 0.0),
            "steps": 0,
            "done": False,
            "converged": False,
        }
        for k in own:
            lists[k].append(c)
    width = max((len(v) for v in lists), default=0)
    uses = np.array([v + [-1] * (width - len(v)) for v in lists], dtype=np.int64).reshape(len(groups), width)
    while not all(s["done"] for s in state.values()):
        params = np.array([[*s["w"], s["mu"], s["sd"], not s["done"]] for s in state.values()], dtype=float).T
        sums = _newton_sums(blocks, uses, params)
        for c, s in state.items():
            if s["done"]:
                continue
            r = sums.get(c)
            if r is None:  # no row has both a score and a label
                s["done"] = True
                continue
            loss = r["loss"] / r["n"]
            s["steps"] += 1
            if loss > s["loss"] + 1e-15:  # overshoot: go back half of the last step
                s["step"] = (s["step"][0] / 2, s["step"][1] / 2)
                s["w"] = [s["w"][0] - s["step"][0], s["w"][1] - s["step"][1]]
                s["done"] = max(abs(v) for v in s["step"]) < 1e-14
                s["converged"] = s["done"]
            else:
                s["converged"] = s["loss"] - loss < TOLERANCE
                s["loss"] = loss
                if s["converged"]:
                    s["done"] = True
                    continue
                ridge = 1e-12
                h00, h01, h11 = r["h00"] + ridge, r["h01"], r["h11"] + ridge
                det = h00 * h11 - h01 * h01
                if det <= 1e-18 * max(1.0, h00 * h11):  # no score variance: intercept only
                    da, db = 0.0, -r["g0"] / h00
                else:
                    da = -(h00 * r["g1"] - h01 * r["g0"]) / det
                    db = -(h11 * r["g0"] - h01 * r["g1"]) / det
                scale = min(1.0, 10.0 / max(abs(da), abs(db), 1e-300))
                s["step"] = (da * scale, db * scale)
                s["w"] = [s["w"][0] + s["step"][0], s["w"][1] + s["step"][1]]
            if s["steps"] >= max_steps:
                s["done"] = True
    fitted = [
        (*key, s["w"][0] / s["sd"], s["w"][1] - s["w"][0] * s["mu"] / s["sd"], s["steps"], s["converged"]) for key, s in zip(members, state.values(), strict=True)
    ]
    out = ", ".join(f"{k} {kind}" for k, kind in keys)
    return blocks.sparkSession.createDataFrame(fitted, f"{out}, a double, b double, steps int, converged boolean")


def fit_sigmoid(rows: DataFrame, keys: Sequence[str], score: str = "score", label: str = "y", max_steps: int = MAX_STEPS) -> DataFrame:
    """``(keys, a, b, steps, converged)`` maximising the unpenalised likelihood per key.

    The loop ends for a key when a step improves its mean log loss by less
    than 1e-12; separable scores stop at ``max_steps`` with ``converged`` false.
    """
    keys = list(keys)
    groups, blocks = _groups(rows, keys, score, label)
    members = {g[0]: [k] for k, g in enumerate(groups)}
    return _fit(blocks, groups, members, [(k, rows.schema[k].dataType.simpleString()) for k in keys], max_steps)


def cross_fit(oof: DataFrame, keys: Sequence[str], fold: str = "inner_fold_id", n_folds: int = 3) -> DataFrame:
    """Calibrators for every held-out inner fold (fit on the others) and, as ``held = -1``, on all rows."""
    keys = list(keys)
    groups, blocks = _groups(oof, [*keys, fold], "score", "y")
    return _cross_fit(blocks, groups, [(k, oof.schema[k].dataType.simpleString()) for k in keys], n_folds)


def cross_fit_blocks(blocks: DataFrame, places: Sequence[tuple], keys: Sequence[tuple[str, str]], n_folds: int = 3) -> DataFrame:
    """``cross_fit`` of packed blocks with one group number each; ``places[k]`` is the group's key, its fold last."""

    def facts(batches):
        found: dict = {}
        for batch in batches:
            for k, s, y in _unpacked(batch):
                part = (None, len(y), y.sum(), len(s), s.mean(), ((s - s.mean()) ** 2).sum())
                found[int(k[0])] = (None, *_merged([found[int(k[0])], part])) if int(k[0]) in found else part
        yield pd.DataFrame([(k, *p[1:]) for k, p in found.items()], columns=["k", "n_y", "sum_y", "n", "mu", "squares"])

    def as_arrow(batches):
        for pdf in facts(batches):
            yield pa.RecordBatch.from_pandas(pdf.astype({"k": "int32", **dict.fromkeys(("n_y", "sum_y", "n", "mu", "squares"), float)}), preserve_index=False)

    parts: dict = {}
    for r in blocks.mapInArrow(as_arrow, "k int, n_y double, sum_y double, n double, mu double, squares double").collect():  # tasks x groups rows
        parts.setdefault(r["k"], []).append((None, *r[1:]))
    groups = [(place, *_merged(parts.get(k, []))) for k, place in enumerate(places)]
    return _cross_fit(blocks, groups, keys, n_folds)


def _cross_fit(blocks: DataFrame, groups: list, keys: Sequence[tuple[str, str]], n_folds: int) -> DataFrame:
    members: dict = {}
    for k, (*place, fold) in enumerate(g[0] for g in groups):
        for held in range(-1, n_folds):
            if fold is not None and fold != held:
                members.setdefault((*place, held), []).append(k)
    return _fit(blocks, groups, members, [*keys, ("held", "int")], MAX_STEPS)


def apply_sigmoid(rows: DataFrame, calibrators: DataFrame, keys: Sequence[str], score: str = "score", out: str = "prob") -> DataFrame:
    joined = rows.join(F.broadcast(calibrators.select(*keys, "a", "b")), list(keys))  # one row per key
    return joined.withColumn(out, sigmoid(F.col("a") * F.col(score) + F.col("b"))).drop("a", "b")


def cross_fitted_probabilities(oof: DataFrame, calibrators: DataFrame, keys: Sequence[str], fold: str = "inner_fold_id") -> DataFrame:
    """Each row gets the probability of the calibrator that did not see its fold."""
    tagged = oof.withColumn("held", F.col(fold))
    return apply_sigmoid(tagged, calibrators, [*keys, "held"]).drop("held")
