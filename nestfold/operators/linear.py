"""L2 logistic regression for many keys at once, by Newton steps on summed partials.

A step function returns one row of partial sums per (task, key); the sums
(gradient, upper triangle of the Hessian, loss) are added up by Spark and only
``keys * width^2`` numbers reach the driver, which solves the small systems.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .moments import list_matrix

MAX_NUMBERS = 50_000_000  # driver bound: keys * width^2 doubles (400 MB)
SUM_SCHEMA = "key string, v array<double>"
PIECE = 512  # numbers of a partial sum that travel in one row: an Arrow batch of 10,000 rows stays below 41 MB


LOG_RUN = 64  # factors between one and two whose product is taken before its logarithm


def log_of_sums(e: np.ndarray) -> float:
    """Sum of log(1 + e) for e in [0, 1], with one logarithm per run of factors."""
    whole = len(e) // LOG_RUN * LOG_RUN
    runs = np.multiply.reduce((1.0 + e[:whole]).reshape(LOG_RUN, -1), axis=0) if whole else np.ones(1)
    return float(np.log(runs).sum() + np.log1p(e[whole:]).sum())


def block_sums(design: np.ndarray, y: np.ndarray, weight: np.ndarray | None, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian triangle of one block; the last design column is the intercept."""
    eta = design @ w
    e = np.exp(-np.abs(eta))
    p = np.where(eta >= 0, 1.0, e) / (1.0 + e)
    loss = np.maximum(eta, 0.0) - y * eta
    r, h = p - y, p * (1.0 - p)
    if weight is not None:
        total = ((loss + np.log1p(e)) * weight).sum()
        r, h = r * weight, h * weight
    else:
        total = loss.sum() + log_of_sums(e)
    hess = design.T @ (design * h[:, None])
    return np.concatenate([[total], design.T @ r, hess[np.triu_indices(len(w))]])


def column_sums(design: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``block_sums`` of an unweighted design of columns x rows."""
    eta = w @ design
    e = np.exp(-np.abs(eta))
    total = np.maximum(eta, 0.0).sum() - y @ eta + log_of_sums(e)
    p = np.where(eta >= 0, 1.0, e) / (1.0 + e)
    hess = (design * (p * (1.0 - p))) @ design.T
    return np.concatenate([[total], design @ (p - y), hess[np.triu_indices(len(w))]])


def partial_frame(sums: dict) -> pd.DataFrame:
    """Partial sums as rows; typed so that a task without rows yields a valid empty frame."""
    return pd.DataFrame(
        {
            "key": pd.Series(list(sums), dtype=object),
            "v": pd.Series([np.asarray(v, dtype=float).ravel().tolist() for v in sums.values()], dtype=object),
        }
    )


def sum_partials(parts: DataFrame) -> dict[str, np.ndarray]:
    """Add the arrays of equal keys element by element; they travel in pieces, not as one row per number."""
    last = F.floor((F.size("v") - 1) / PIECE)
    each = F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda i: F.slice("v", (i * PIECE + 1).cast("int"), PIECE))
    pieces = parts.filter(F.size("v") > 0).select("key", F.posexplode(each).alias("i", "v"))

    def add(batches):
        sums: dict = {}
        for pdf in batches:
            for key, i, v in zip(pdf["key"], pdf["i"], pdf["v"]):
                old = sums.get((key, i))
                sums[(key, i)] = np.array(v, dtype=float) if old is None else old + v
        yield partial_frame(sums).assign(i=pd.Series([i for _, i in sums], dtype="int32"), key=pd.Series([k for k, _ in sums], dtype=object))

    n_tasks = parts.sparkSession.sparkContext.defaultParallelism
    table = pieces.repartition(n_tasks, "key", "i").mapInPandas(add, "key string, v array<double>, i int").toPandas().sort_values(["key", "i"])
    return {k: np.concatenate([np.asarray(v, dtype=float) for v in g]) for k, g in table.groupby("key", sort=False)["v"]}


def newton(
    step: Callable[[dict[str, np.ndarray]], DataFrame],
    widths: dict[str, int],
    c: dict[str, float],
    max_iter: int = 50,
    tol: float = 1e-8,
    share: dict | None = None,
    zero: dict | None = None,
) -> tuple[dict[str, np.ndarray], list[tuple]]:
    """Minimise 0.5 |w|^2 + C * loss per key (the intercept is penalised like any weight).

    ``share`` names the rows of every key: keys of the same rows that differ in C are summed once where their
    weights are equal, at zero and after the first step, which all of them take along the one of the middle C (at zero
    it lowers the objective of any C).  ``zero`` has the sums of these rows at zero weights, if they are known.
    Returns the weights and a log of ``(key, step, objective, grad_norm)``.
    """
    if sum(w * w for w in widths.values()) > MAX_NUMBERS:
        raise ValueError("too many keys or too wide vectors for driver-side Newton systems")
    weights = {k: np.zeros(n) for k, n in widths.items()}
    last: dict[str, tuple] = {}
    active, log = set(widths), []
    leader = _leaders(share or {}, c)
    for it in range(max_iter):
        if it == 0 and zero:
            sums = {k: zero[share[k]] for k in active}
        else:
            same = {k: leader[k] for k in active if k in leader and np.array_equal(weights[k], weights[leader[k]])}
            asked = {same.get(k, k) for k in active}
            sums = sum_partials(step({k: weights[k] for k in asked}))
            sums |= {k: sums[same[k]] for k in active - asked}
        for k in sorted(active, key=lambda k: (leader.get(k, k) != k, k)):
            n = widths[k]
            v = sums[k]
            w = weights[k]
            objective = 0.5 * w @ w + c[k] * v[0]
            grad = w + c[k] * v[1 : 1 + n]
            if k in last and objective > last[k][0] + 1e-9 * (1 + abs(objective)):
                _, w0, delta, t = last[k]
                t *= 0.5
                weights[k] = w0 + t * delta
                last[k] = (last[k][0], w0, delta, t)
                log.append((k, it, float(objective), float(np.abs(grad).max())))
                if t < 1e-8:
                    active.discard(k)
                continue
            hess = np.zeros((n, n))
            hess[np.triu_indices(n)] = c[k] * v[1 + n :]
            hess = hess + np.triu(hess, 1).T + np.eye(n)
            norm = float(np.abs(grad).max())
            log.append((k, it, float(objective), norm))
            if norm < tol * max(1.0, c[k] * v[0] / max(1, n)) and not (it == 0 and zero):
                active.discard(k)
                continue
            if it == 0 and leader.get(k, k) in last:
                delta = last[leader[k]][2]
            else:
                delta = -np.linalg.solve(hess, grad)
            last[k] = (objective, w, delta, 1.0)
            weights[k] = w + delta
        if not active:
            break
    return weights, log


def _leaders(share: dict, c: dict[str, float]) -> dict[str, str]:
    """The key of the middle C among the keys of the same rows."""
    groups: dict = {}
    for k, rows in share.items():
        groups.setdefault(rows, []).append(k)
    middle = {rows: sorted(ks, key=lambda k: (c[k], k))[len(ks) // 2] for rows, ks in groups.items()}
    return {k: middle[rows] for k, rows in share.items()}


def fit_rows(
    rows: DataFrame,
    keys: Sequence[str],
    cs: Sequence[float] = (1.0,),
    vector: str = "z",
    label: str = "y",
    weight: str | None = None,
    max_iter: int = 50,
) -> tuple[dict[tuple, np.ndarray], list[tuple]]:
    """Fit rows ``(keys, y, z[, weight])`` for each key and each C; keys of the result are (key..., C)."""
    keys = list(keys)
    names = [r for r in rows.select(*keys, F.size(vector).alias("_d")).distinct().collect()]
    listed = {"/".join(str(r[k]) for k in keys): tuple(r[k] for k in keys) for r in names}
    width = {"/".join(str(r[k]) for k in keys): r["_d"] + 1 for r in names}
    widths = {f"{k}#{c}": width[k] for k in listed for c in cs}
    c_of = {f"{k}#{c}": float(c) for k in listed for c in cs}
    used = rows.select(*keys, label, vector, *([weight] if weight else []))

    def step(current):
        shared = rows.sparkSession.sparkContext.broadcast(current)

        def partial(batches):
            sums: dict = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                plain = batch.drop_columns([vector]).to_pandas()
                vectors = batch.column(batch.schema.get_field_index(vector))
                groups = plain.groupby(keys, sort=False).indices if keys else {(): np.arange(len(plain))}
                for key, at in groups.items():
                    key = key if isinstance(key, tuple) else (key,)
                    x = list_matrix(vectors if len(at) == len(plain) else vectors.take(pa.array(at)), float)
                    x = np.column_stack([x, np.ones(len(x))])
                    y = plain[label].to_numpy(dtype=float)[at]
                    wt = plain[weight].to_numpy(dtype=float)[at] if weight else None
                    for c in cs:
                        k = "/".join(str(v) for v in key) + f"#{c}"
                        if k in shared.value:
                            s = block_sums(x, y, wt, shared.value[k])
                            sums[k] = sums[k] + s if k in sums else s
            kinds = pa.schema([("key", pa.string()), ("v", pa.list_(pa.float64()))])
            yield pa.RecordBatch.from_pandas(partial_frame(sums), schema=kinds, preserve_index=False)

        return used.mapInArrow(partial, SUM_SCHEMA)

    weights, log = newton(step, widths, c_of, max_iter)
    out = {(*listed[k.split("#")[0]], float(k.split("#")[1])): w for k, w in weights.items()}
    return out, log


def weights_frame(spark: SparkSession, weights: dict[tuple, np.ndarray], keys: Sequence[str], key_types: Sequence[str]) -> DataFrame:
    """Fitted models as a table ``(keys, c, coef ARRAY<DOUBLE>, intercept)``."""
    rows = [(*k, [float(v) for v in w[:-1]], float(w[-1])) for k, w in weights.items()]
    head = "".join(f"{k} {t}, " for k, t in zip(keys, key_types))
    return spark.createDataFrame(rows, f"{head}c double, coef array<double>, intercept double")


def log_frame(spark: SparkSession, log: list[tuple]) -> DataFrame:
    return spark.createDataFrame(log, "key string, step int, objective double, grad_norm double")


def unconverged(log: list[tuple], tol: float = 1e-6) -> list[str]:
    """Keys whose last step left a gradient above the tolerance (relative to the objective)."""
    last = {k: (objective, norm) for k, _, objective, norm in log}
    return sorted(k for k, (objective, norm) in last.items() if norm > tol * max(1.0, abs(objective)))


def convergence(log: DataFrame, tol: float = 1e-6, max_iter: int = 50) -> DataFrame:
    """Steps taken, final objective and gradient, and how each key ended.

    ``converged``: the last gradient is within the tolerance, in whatever step;
    ``iteration_limit``: it is not after ``max_iter`` steps; ``stalled``: the step length vanished before.
    """
    last = F.max_by(F.struct("objective", "grad_norm"), "step")
    done = F.col("grad_norm") <= tol * F.greatest(F.lit(1.0), F.abs("objective"))
    return log.groupBy("key").agg((F.max("step") + 1).alias("n_steps"), last.alias("_l")).select("key", "n_steps", "_l.objective", "_l.grad_norm").select(
        "*",
        (~done & (F.col("n_steps") >= max_iter)).alias("hit_limit"),
        F.when(done, "converged").when(F.col("n_steps") >= max_iter, "iteration_limit").otherwise("stalled").alias("status"),
    )
