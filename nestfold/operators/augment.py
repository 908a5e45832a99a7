"""Class balancing: sizing, SMOTE, bootstrap jitter, up-sampling, weights, copula samplers."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_float_array, attach_row, hash_normal, hash_uniform, hash_word, key_hash
from .linear import SUM_SCHEMA, partial_frame, sum_partials
from .moments import centred_gram, stack
from .neighbours import knn_join
from .preprocess import fit_dense, standardise
from .ranking import hash_rank, prefix_sums

SMOTE_NEIGHBOURS = 5
DRAW_CHUNK = 10_000
JITTER_SD = 0.01
QUANTILE_GRID = tuple(i / 20 for i in range(21))
_NAMESPACE = re.compile(r"[A-Za-z0-9._:-]+")


def minority_sizing(rows: DataFrame, keys: Sequence[str], label: str = "y") -> DataFrame:
    """Minority and majority label, their counts and the rows needed for balance; fails on a tie or one class."""
    counts = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    sized = counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_classes"),
        F.min_by(label, "_n").alias("minority_label"),
        F.max_by(label, "_n").alias("majority_label"),
        F.min("_n").alias("n_minority"),
        F.max("_n").alias("n_majority"),
    )
    ok = (F.col("_classes") == 2) & (F.col("n_minority") < F.col("n_majority"))
    needed = F.when(ok, F.col("n_majority") - F.col("n_minority")).otherwise(
        F.raise_error(F.lit("two strictly imbalanced classes are required")).cast("bigint")
    )
    return sized.select(*keys, "minority_label", "majority_label", "n_minority", "n_majority", needed.alias("needed"))


def draw_table(sizing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per synthetic row to draw, generated in chunks that spread over tasks."""
    chunks = sizing.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("needed") - 1) / DRAW_CHUNK))))
    first = F.col("_c") * DRAW_CHUNK
    last = F.least(first + DRAW_CHUNK, F.col("needed")) - 1
    return chunks.repartition(*keys, "_c").withColumn("draw", F.explode(F.sequence(first, last))).drop("_c")


def minority_rows(rows: DataFrame, sizing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of each key's minority class."""
    small = sizing.select(*keys, F.col("minority_label").alias("y"))
    return rows.join(F.broadcast(small), [*keys, "y"])  # one row per key


def _ranked_minority(rows: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    hashed = rows.withColumn("_h", key_hash(seed, "order", *[F.col(k) for k in keys], F.col("sample_id")))
    return hash_rank(hashed, keys, "_h", "_rank").drop("_h")


def synthetic_id(namespace: str, keys: Sequence[str], label: Column, index: Column) -> Column:
    """``SYNTHETIC:<namespace>:<keys>:CLASS<label>:000123``."""
    if not _NAMESPACE.fullmatch(namespace):
        raise ValueError("namespace may hold letters, digits and . _ : - only")
    parts = [F.lit(f"SYNTHETIC:{namespace}"), *[F.col(k).cast("string") for k in keys]]
    return F.concat_ws(":", *parts, F.concat(F.lit("CLASS"), label.cast("string")), F.format_string("%06d", index))


def _draw_hash(seed: int, keys: Sequence[str]) -> Column:
    return key_hash(seed, *[F.col(k) for k in keys], F.col("draw"))


def smote(rows: DataFrame, keys: Sequence[str] = (), seed: int = 11, k: int = SMOTE_NEIGHBOURS, namespace: str = "SMOTE") -> DataFrame:
    """Synthetic minority rows ``(keys, sample_id, y, z)``: random points between a row and a neighbour."""
    keys = list(keys)
    sizing = minority_sizing(rows, keys)
    checked = sizing.withColumn(
        "needed",
        F.when(F.col("n_minority") > k, F.col("needed")).otherwise(
            F.raise_error(F.lit("SMOTE needs more minority rows than neighbours")).cast("bigint")
        ),
    )
    small = minority_rows(rows, sizing, keys)
    near = knn_join(small, small, k, keys)
    bases = _ranked_minority(small.select(*keys, "sample_id", "z"), keys, seed)
    h = _draw_hash(seed, keys)
    draws = draw_table(checked, keys).select(
        *keys,
        "draw",
        "minority_label",
        (F.pmod(hash_word(h, 0), F.col("n_minority")) + 1).alias("_rank"),
        (F.pmod(hash_word(h, 1), F.lit(k)) + 1).cast("int").alias("rank"),
        hash_uniform(h, 2).alias("_u"),
    )
    picked = (
        draws.join(bases, [*keys, "_rank"])
        .join(near.select(*keys, "sample_id", "neighbour_id", "rank"), [*keys, "sample_id", "rank"])
        .join(small.select(*keys, F.col("sample_id").alias("neighbour_id"), F.col("z").alias("_b")), [*keys, "neighbour_id"])
    )
    u = F.col("_u")
    point = F.zip_with("z", "_b", lambda a, b: a.cast("double") + u * (b.cast("double") - a.cast("double")))
    return picked.select(
        *keys,
        synthetic_id(namespace, keys, F.col("minority_label"), F.col("draw")).alias("sample_id"),
        F.col("minority_label").alias("y"),
        as_float_array(point).alias("z"),
    )


def standardised_smote(rows: DataFrame, keys: Sequence[str] = (), seed: int = 11) -> DataFrame:
    """Scale the train rows, draw in that space, scale only the new rows back."""
    keys = list(keys)
    scaler = fit_dense(rows, keys)
    if keys:

        def attach(df: DataFrame) -> DataFrame:
            return df.join(F.broadcast(scaler), keys)  # one row per key

    else:
        one = scaler.first()  # two vectors

        def attach(df: DataFrame) -> DataFrame:
            return df.withColumns({c: F.lit(list(one[c])) for c in ("mean", "scale")})

    z = as_float_array(standardise(F.col("z"), F.col("mean"), F.col("scale")))
    drawn = smote(attach(rows).select(*keys, "sample_id", "y", z.alias("z")), keys, seed, namespace="SSMOTE")
    zipped = F.arrays_zip(F.col("z").alias("x"), F.col("mean").alias("m"), F.col("scale").alias("s"))
    raw = F.transform(zipped, lambda t: t["x"].cast("double") * t["s"] + t["m"])
    return attach(drawn).select(*keys, "sample_id", "y", as_float_array(raw).alias("z"))


def resampled_minority(rows: DataFrame, keys: Sequence[str] = (), seed: int = 13, jitter: float = 0.0, namespace: str = "RESAMPLE") -> DataFrame:
    """Minority rows drawn with replacement up to the majority size, with optional normal noise."""
    keys = list(keys)
    sizing = minority_sizing(rows, keys)
    bases = _ranked_minority(minority_rows(rows, sizing, keys).select(*keys, "sample_id", "z"), keys, seed)
    h = _draw_hash(seed, keys)
    draws = draw_table(sizing, keys).withColumn("_rank", F.pmod(hash_word(h), F.col("n_minority")) + 1)
    picked = draws.join(bases, [*keys, "_rank"])
    z = F.col("z")
    if jitter:
        z = F.transform(
            z, lambda x, i: x + F.lit(jitter) * hash_normal(key_hash(seed, "noise", *[F.col(c) for c in keys], F.col("draw"), i))
        )
    return picked.select(
        *keys,
        synthetic_id(namespace, keys, F.col("minority_label"), F.col("draw")).alias("sample_id"),
        F.col("minority_label").alias("y"),
        F.col("sample_id").alias("source_id"),
        as_float_array(z).alias("z"),
    )


def class_weights(rows: DataFrame, keys: Sequence[str] = (), label: str = "y") -> DataFrame:
    """Balanced weights n / (2 n_c) per key and class."""
    counts = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n_class"))
    totals = counts.groupBy(*keys).agg(F.sum("n_class").alias("_n"))
    joined = counts.join(totals, list(keys)) if keys else attach_row(counts, totals)
    return joined.select(*keys, label, "n_class", (F.col("_n") / (2.0 * F.col("n_class"))).alias("weight"))


def balance_report(augmented: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Class counts after augmentation and whether they are equal."""
    return augmented.groupBy(*keys).agg(
        F.count_if(F.col("y") == 0).alias("n_class0"),
        F.count_if(F.col("y") == 1).alias("n_class1"),
        F.count_if("is_synthetic").alias("n_synthetic"),
        (F.count_if(F.col("y") == 0) == F.count_if(F.col("y") == 1)).alias("balanced"),
    )


# --- copula samplers ----------------------------------------------------------

MAX_MODEL_NUMBERS = 20_000_000  # keys x features x (features + grid) doubles on the driver


@lru_cache(maxsize=None)
def _normal_table(limit: float, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Standard normal CDF on an even grid, built once per worker."""
    knots = np.linspace(-limit, limit, points)
    return knots, np.array([0.5 * (1.0 + math.erf(t / math.sqrt(2.0))) for t in knots])


def norm_ppf(p: np.ndarray) -> np.ndarray:
    """Standard normal quantile by interpolation of the CDF table."""
    knots, cdf = _normal_table(4.5, 3601)
    return np.interp(p, cdf, knots)


def norm_cdf(x: np.ndarray) -> np.ndarray:
    knots, cdf = _normal_table(6.0, 4801)
    return np.interp(x, knots, cdf)


class CopulaModel:
    """Quantile grid per feature and the Cholesky factor of the normal-score correlation."""

    def __init__(self, grid: np.ndarray, factor: np.ndarray):
        self.grid = grid
        self.factor = factor

    def sample(self, seed: int, block: int, size: int) -> np.ndarray:
        """Rows of one fixed-size block: a pure function of (seed, block)."""
        rng = np.random.Generator(np.random.Philox(key=seed, counter=block << 64))
        g = rng.standard_normal((size, self.factor.shape[0])) @ self.factor.T
        u = norm_cdf(g)
        return np.column_stack([np.interp(u[:, j], QUANTILE_GRID, self.grid[j]) for j in range(u.shape[1])])


def _key_of(row, keys) -> tuple:
    return tuple(row[k] for k in keys)


GRID_NUMBERS, GRID_CELLS = 4_000_000, 512  # counts of a task, and cells of a key and feature, at most


def marginal_grids(rows: DataFrame, keys: Sequence[str]) -> dict[tuple, np.ndarray]:
    """Exact quantile grid of each vector element per key (21 numbers per key and feature).

    A pass counts the values in even cells between the ends of every key and element.  The counts
    tell which cells hold the wanted ranks; only values in those are ranked.
    """
    keys = list(keys)
    spark = rows.sparkSession
    named = rows.select(F.concat_ws("/", F.lit("k"), *[F.col(k).cast("string") for k in keys]).alias("_key"), *keys, "z")

    def groups(batches):
        for pdf in batches:
            for name, part in pdf.groupby("_key", sort=False):
                yield name, stack(part["z"])

    def ends(batches):
        held: dict = {}
        for name, x in groups(batches):
            low, high = held.get(name, (x[0], x[0]))
            held[name] = (np.minimum(low, x.min(0)), np.maximum(high, x.max(0)))
        yield pd.DataFrame([(k, a.tolist(), b.tolist()) for k, (a, b) in held.items()], columns=["_key", "low", "high"])

    found = named.select("_key", "z").mapInPandas(ends, "_key string, low array<double>, high array<double>")
    cells = found.select("_key", F.posexplode(F.arrays_zip("low", "high")).alias("pos", "c")).groupBy("_key", "pos")
    limits: dict = {}
    for r in cells.agg(F.min("c.low").alias("low"), F.max("c.high").alias("high")).orderBy("_key", "pos").collect():  # keys x features rows
        limits.setdefault(r["_key"], []).append((r["low"], r["high"]))
    n_cells = max(32, min(GRID_CELLS, GRID_NUMBERS // max(1, sum(len(v) for v in limits.values()))))
    cuts = {k: np.array([np.linspace(a, b, n_cells + 1)[1:-1] for a, b in v]) for k, v in limits.items()}
    shared = spark.sparkContext.broadcast(cuts)

    def cell_of(name, x):
        return np.column_stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(shared.value[name])])

    def count(batches):
        sums: dict = {}
        for name, x in groups(batches):
            width = x.shape[1]
            v = np.bincount((cell_of(name, x) + n_cells * np.arange(width)).ravel(), minlength=n_cells * width)
            sums[name] = sums[name] + v if name in sums else v
        yield partial_frame(sums)

    wanted: dict = {}
    for name, v in sum_partials(named.select("_key", "z").mapInPandas(count, SUM_SCHEMA)).items():
        upto = v.reshape(-1, n_cells).cumsum(1)
        at = np.array(QUANTILE_GRID) * (upto[0, -1] - 1)
        ranks = np.concatenate([np.floor(at), np.ceil(at)])  # from 0
        cell = np.array([np.searchsorted(u, ranks, side="right") for u in upto])
        before = np.array([np.append(0, u)[c] for u, c in zip(upto, cell)])
        wanted[name] = (at - np.floor(at), cell, ranks - before)
    used = spark.sparkContext.broadcast({k: [np.unique(c) for c in cell] for k, (_, cell, _) in wanted.items()})

    def near(batches):
        for name, x in groups(batches):
            cell = cell_of(name, x)
            for j, own in enumerate(used.value[name]):
                keep = np.isin(cell[:, j], own)
                if keep.any():
                    values, first, n = np.unique(x[keep, j], return_index=True, return_counts=True)
                    yield pd.DataFrame({"_key": name, "pos": j, "cell": cell[keep, j][first], "x": values, "n": n})

    kept = named.select("_key", "z").mapInPandas(near, "_key string, pos int, cell int, x double, n bigint")
    by = ["_key", "pos", "cell"]
    ranked = prefix_sums(kept.groupBy(*by, "x").agg(F.sum("n").alias("n")), by, "x", ["n"])
    asked = pd.DataFrame(
        [(k, j, int(c), int(r)) for k, (_, cell, rank) in wanted.items() for j in range(len(cell)) for c, r in set(zip(cell[j], rank[j]))],
        columns=[*by, "r"],
    )
    picks = spark.createDataFrame(asked, "_key string, pos int, cell int, r bigint")
    at = F.col("cum_n") > F.col("r")
    starts = ranked.join(F.broadcast(picks), by).filter(at & (F.col("cum_n") - F.col("n") <= F.col("r")))  # 42 rows per key and feature
    value = {(r["_key"], r["pos"], r["cell"], r["r"]): r["x"] for r in starts.select(*by, "r", "x").collect()}
    out: dict = {}
    for r in named.select("_key", *keys).distinct().collect():  # one row per key
        name, half = r["_key"], len(QUANTILE_GRID)
        frac, cell, rank = wanted[name]
        v = np.array([[value[(name, j, int(c), int(k))] for c, k in zip(cell[j], rank[j])] for j in range(len(cell))])
        out[_key_of(r, keys)] = v[:, :half] + frac * (v[:, half:] - v[:, :half])
    return out


def normal_scores(rows: DataFrame, keys: Sequence[str], grids: dict[tuple, np.ndarray]) -> DataFrame:
    """Replace each value by the normal score of its position in its key's quantile grid."""
    keys = list(keys)
    shared = rows.sparkSession.sparkContext.broadcast(grids)
    types = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys)

    def apply(batches):
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False) if keys else [((), pdf)]:
                if not len(part):
                    continue
                grid = shared.value[key if isinstance(key, tuple) else (key,)]
                x = stack(part["z"])
                u = np.column_stack([np.interp(x[:, j], grid[j], QUANTILE_GRID) for j in range(x.shape[1])])
                yield part.assign(z=list(norm_ppf(np.clip(u, 1e-4, 1 - 1e-4))))

    return rows.select(*keys, "z").mapInPandas(apply, f"{types}z array<double>")


def fit_copulas(
    rows: DataFrame, keys: Sequence[str] = (), correlation_rows: DataFrame | None = None, grids: dict | None = None
) -> dict[tuple, CopulaModel]:
    """One sampler per key, fitted on ``rows``; the correlation may come from a wider set of rows."""
    keys = list(keys)
    grids = grids or marginal_grids(rows, keys)
    width = max(len(g) for g in grids.values())
    if len(grids) * width * (width + len(QUANTILE_GRID)) > MAX_MODEL_NUMBERS:
        raise ValueError("too many keys or too wide vectors for driver-side samplers")
    source = rows if correlation_rows is None else correlation_rows
    wide = grids if correlation_rows is None else marginal_grids(correlation_rows, keys)
    grams = {k: np.zeros((len(g), len(g))) for k, g in grids.items()}
    for r in centred_gram(normal_scores(source, keys, wide), keys).collect():
        g = grams[_key_of(r, keys)]
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["s"]
    models = {}
    for key, gram in grams.items():
        sd = np.sqrt(np.maximum(np.diag(gram), 1e-12))
        corr = gram / np.outer(sd, sd)
        np.fill_diagonal(corr, 1.0)
        values, vectors = np.linalg.eigh(corr)
        models[key] = CopulaModel(grids[key], vectors * np.sqrt(np.maximum(values, 0.0)))
    return models


def sample_copulas(sizing: DataFrame, keys: Sequence[str], models: dict[tuple, CopulaModel], seed: int, block: int = 4096) -> DataFrame:
    """``(keys, minority_label, draw, z)``: blocks of draws made in parallel, the same on any cluster."""
    keys = list(keys)
    shared = sizing.sparkSession.sparkContext.broadcast(models)
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("needed") - 1) / block)))
    blocks = sizing.select(*keys, "minority_label", "needed", number.alias("block")).repartition(*keys, "block")
    types = "".join(f"{k} {sizing.schema[k].dataType.simpleString()}, " for k in keys)

    def draw(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                key = _key_of(row, keys)
                start = int(row["block"]) * block
                size = min(block, int(row["needed"]) - start)
                own = zlib.crc32("|".join(str(v) for v in (seed, *key)).encode())
                z = shared.value[key].sample(own, int(row["block"]), block)[:size].astype(np.float32)
                out = pd.DataFrame({"draw": np.arange(start, start + size), "z": list(z)})
                yield out.assign(minority_label=row["minority_label"], **{k: row[k] for k in keys})[[*keys, "minority_label", "draw", "z"]]

    return blocks.mapInPandas(draw, f"{types}minority_label int, draw bigint, z array<float>")


def _synthesise(rows: DataFrame, keys: Sequence[str], seed: int, namespace: str, conditional: bool, grids) -> DataFrame:
    keys = list(keys)
    sizing = minority_sizing(rows, keys)
    small = minority_rows(rows, sizing, keys).select(*keys, "sample_id", "y", "z")
    models = fit_copulas(small, keys, rows if conditional else None, grids)
    drawn = sample_copulas(sizing, keys, models, seed)
    label = F.col("minority_label")
    return drawn.select(*keys, synthetic_id(namespace, keys, label, F.col("draw")).alias("sample_id"), label.alias("y"), "z")


def minority_synthesiser(
    rows: DataFrame, keys: Sequence[str] = (), seed: int = 17, namespace: str = "MINORITY", grids: dict | None = None
) -> DataFrame:
    """Gaussian-copula sampler fitted on each key's minority rows only."""
    return _synthesise(rows, keys, seed, namespace, False, grids)


def conditional_synthesiser(
    rows: DataFrame, keys: Sequence[str] = (), seed: int = 19, namespace: str = "CONDITIONAL", grids: dict | None = None
) -> DataFrame:
    """Sampler with the dependence of all rows of a key, drawn with the minority's marginals."""
    return _synthesise(rows, keys, seed, namespace, True, grids)
