"""The nested study: 25 outer coordinates x 3 inner folds x 9 candidates as passes over one table.

The cohort table (features, label, fold arrays) is the only large input and
stays as it is: no row is copied per fold.  Every stage is one pass that folds
each Arrow batch into small sums per training set:

1. medians of features with missing cells, for all 100 training sets, from counts
   and one sort of the few values around them;
2. moments of ``[x, missing]`` per held-out cell and class; a training set's
   moments are the merge of its cells, whatever its medians are;
3. on the driver, per set: mean, scale and principal directions (the linear
   encoder), and the minority's latent mean and covariance;
4. minority marginals (refined histograms with exact ends), giving the copula sampler;
5. Newton steps for 675 candidate classifiers together, over real rows and
   over synthetic rows that are re-drawn from (set, block) seeds;
6. out-of-fold scores, selection, calibration, threshold, final refit of 25
   models and label-free scoring of the outer test rows.

What reaches the driver or a broadcast is bounded by the protocol: sets x
width^2 numbers (checked), never rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import sigmoid
from ..operators import block_folds as BF, calibrate as K, folds as D, linear as L, selection as S, threshold as T
from ..operators.augment import QUANTILE_GRID, norm_cdf
from ..operators.moments import list_matrix
from ..session import cut_lineage
from ..sources.cohorts import MODALITIES

MAX_STATE = 64_000_000  # doubles per task and on the driver (512 MB)
SYNTHETIC_BLOCK = 4096
HISTOGRAM_CELLS = 256
RANK_ERROR, REFINEMENTS = 1 / 64, 5  # aimed at, and passes spent on it at most
KEYS = ["repeat_id", "fold_id"]


@dataclass(frozen=True)
class Layout:
    """Fixed shape of a study: coordinates, feature widths and latent columns per ratio."""

    widths: tuple[int, ...]
    n_repeats: int = D.OUTER_REPEATS
    n_splits: int = D.OUTER_SPLITS
    n_inner: int = D.INNER_SPLITS
    ratios: tuple[float, ...] = S.RATIOS
    cs: tuple[float, ...] = S.LOGISTIC_CS
    seed: int = D.OUTER_SEED
    slices: list = field(init=False)
    latent: list = field(init=False)
    columns: dict = field(init=False)

    def __post_init__(self):
        edges = np.cumsum([0, *self.widths])
        object.__setattr__(self, "slices", [slice(a, b) for a, b in zip(edges[:-1], edges[1:])])
        top = [S.latent_width(d, max(self.ratios)) for d in self.widths]
        starts = np.cumsum([0, *top])
        object.__setattr__(self, "latent", list(zip(starts[:-1], top)))
        columns = {
            ratio: np.concatenate([np.arange(s, s + S.latent_width(d, ratio)) for d, (s, _) in zip(self.widths, self.latent)])
            for ratio in self.ratios
        }
        object.__setattr__(self, "columns", columns)

    @property
    def n_features(self) -> int:
        return int(sum(self.widths))

    @property
    def n_latent(self) -> int:
        return int(sum(k for _, k in self.latent))

    def sets(self, inner: bool = True, outer: bool = True):
        """Training sets (repeat, fold, inner); inner = -1 is the whole outer train part."""
        for r in range(self.n_repeats):
            for f in range(self.n_splits):
                if outer:
                    yield r, f, -1
                if inner:
                    for i in range(self.n_inner):
                        yield r, f, i

    def held(self, fold_of: np.ndarray, inner_of: np.ndarray, s) -> np.ndarray:
        r, f, i = s
        return fold_of[:, r] == f if i < 0 else inner_of[:, r * self.n_splits + f] == i

    def train(self, fold_of: np.ndarray, inner_of: np.ndarray, s) -> np.ndarray:
        r, f, i = s
        part = fold_of[:, r] != f
        return part if i < 0 else part & (inner_of[:, r * self.n_splits + f] != i)


@dataclass
class SetModel:
    """Fitted preprocessing, encoder and sampler of one training set (small arrays)."""

    median: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    loadings: np.ndarray  # features x latent, block diagonal over modalities
    eigen: np.ndarray
    n: int
    needed: int = 0
    minority: int = 1
    n_minority: int = 0
    second: np.ndarray | None = None  # mean products of the real latents
    drawn: np.ndarray | None = None  # sums and products of the synthetic latents
    minority_mean: np.ndarray | None = None
    minority_sd: np.ndarray | None = None
    factor: np.ndarray | None = None
    grid: np.ndarray | None = None
    rank_error: float | None = None
    z_mean: dict = field(default_factory=dict)
    z_scale: dict = field(default_factory=dict)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Impute, standardise (stored as 32-bit) and project (stored as 32-bit)."""
        return self.encode_columns(np.ascontiguousarray(x.T)).T

    def encode_columns(self, x: np.ndarray) -> np.ndarray:
        """``encode`` of features x rows, giving latents x rows: every step runs along the rows."""
        z = np.empty(x.shape, dtype=np.float32)
        for j, v in enumerate(x):
            gaps = np.isnan(v)
            if gaps.any():
                v = np.where(gaps, self.median[j], v)
            v = v - self.mean[j]
            z[j] = np.divide(v, self.scale[j], out=v)
        return (self.loadings.T @ z.astype(np.float64)).astype(np.float32).astype(np.float64)

    def draw(self, seed: int, block: int, size: int) -> np.ndarray:
        return self.draw_columns(seed, block, size).T

    def draw_columns(self, seed: int, block: int, size: int) -> np.ndarray:
        """Synthetic latents x rows."""
        rng = np.random.Generator(np.random.Philox(key=seed, counter=block << 64))
        normal = rng.standard_normal((size, len(self.factor))) @ self.factor.T
        u = even_interp(np.ascontiguousarray(normal.T), -NORMAL_END, NORMAL_END, NORMAL_CDF)
        z = np.stack([even_interp(v, 0.0, 1.0, grid) for v, grid in zip(u, self.grid)])
        return z.astype(np.float32).astype(np.float64)


NORMAL_END = 6.0
NORMAL_CDF = norm_cdf(np.linspace(-NORMAL_END, NORMAL_END, 4801))


def even_interp(x: np.ndarray, low: float, high: float, values: np.ndarray) -> np.ndarray:
    """``np.interp`` on evenly spaced knots, found by a product instead of a search."""
    last = len(values) - 1
    at = x - low
    at *= last / (high - low)
    np.clip(at, 0.0, last, out=at)
    left = np.minimum(at.astype(np.int32), last - 1)
    at -= left
    at *= np.diff(values).take(left)
    at += values.take(left)
    return at


def set_name(s) -> str:
    return "/".join(str(v) for v in s)


def set_seed(layout: Layout, s, component: str) -> int:
    """Component seed of a set: CRC of the same key text everywhere."""
    return zlib.crc32(f"{layout.seed}|{set_name(s)}|{component}".encode())


def study_table(cohort: DataFrame) -> DataFrame:
    """Cohort rows with ``fold_of`` and ``inner_of`` arrays, written once for all passes."""
    rows = cohort.select("sample_id", "y", F.concat(*MODALITIES).alias("x"))
    return _as_table(BF.with_folds(cut_lineage(_pack_plain(rows)), _tasks(cohort.sparkSession)))


def stop_table(cohort: DataFrame, seed: int = 7) -> DataFrame:
    """As ``study_table`` with the fit/stop split as two inner parts (0 = stop, 1 = fit)."""
    outer = cut_lineage(D.repeated_kfold(cohort))
    train = D.membership(outer).filter("role = 'train'").drop("role")
    split = D.shuffle_split(train, KEYS, seed)
    return _with_arrays(cohort, outer, split.withColumn("inner_fold_id", F.when(F.col("part") == "stop", 0).otherwise(1)))


def _with_arrays(cohort: DataFrame, outer: DataFrame, inner: DataFrame) -> DataFrame:
    rows = cohort.select("sample_id", "y", F.concat(*MODALITIES).alias("x"))
    joined = rows.join(D.fold_arrays(outer), "sample_id").join(D.inner_arrays(inner), "sample_id")
    # The passes are heavy per row: keep every core busy even when the bytes are few.  Every task
    # sends the sums of all sets, so there are as many tasks as cores ask for and no more.
    return _as_table(cut_lineage(_pack_rows(joined.repartition(_tasks(cohort.sparkSession), "sample_id"))))


def _tasks(spark: SparkSession) -> int:
    """Tasks of a pass: one a core on a local master, three a core on a cluster, so that slow ones even out."""
    sc = spark.sparkContext
    return sc.defaultParallelism * (1 if sc.master.startswith("local") else 3)


BLOCK_SCHEMA = "sample_id array<string>, y binary, x binary, fold_of binary, inner_of binary, n int"


def _pack_plain(rows: DataFrame) -> DataFrame:
    """Rows without folds as numbered blocks ``(bid, sample_id, y, x, n)``."""

    def pack(batches):
        first = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(b for b in batches if b.num_rows):
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], type=pa.int32()), batch.column("sample_id"))
            cells = batch.column("y").to_numpy(zero_copy_only=False).astype(float).tobytes(), list_matrix(batch.column("x"), float).tobytes()
            packed = [pa.array([first + i]), ids, *[pa.array([c], type=pa.binary()) for c in cells], pa.array([batch.num_rows], type=pa.int32())]
            yield pa.RecordBatch.from_arrays(packed, ["bid", "sample_id", "y", "x", "n"])

    return rows.mapInArrow(pack, "bid bigint, sample_id array<string>, y binary, x binary, n int")


def _pack_rows(rows: DataFrame) -> DataFrame:
    """Study rows as one row of bytes per Arrow batch, so that a pass does not touch single cells."""
    named = "sample_id" in rows.columns

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("sample_id") if named else pa.nulls(batch.num_rows, pa.string())
            cells = [
                batch.column("y").to_numpy(zero_copy_only=False).astype(float).tobytes(),
                list_matrix(batch.column("x"), float).tobytes(),
                list_matrix(batch.column("fold_of"), np.int8).tobytes(),
                list_matrix(batch.column("inner_of"), np.int8).tobytes(),
            ]
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], type=pa.int32()), ids.cast(pa.string()))
            packed = [ids, *[pa.array([c], type=pa.binary()) for c in cells], pa.array([batch.num_rows], type=pa.int32())]
            yield pa.RecordBatch.from_arrays(packed, ["sample_id", "y", "x", "fold_of", "inner_of", "n"])

    wanted = [*(["sample_id"] if named else []), "y", "x", "fold_of", "inner_of"]
    return rows.select(*wanted).mapInArrow(pack, BLOCK_SCHEMA)


def _block_arrays(batch: pa.RecordBatch):
    """``(x, y, fold_of, inner_of, ids)`` of every packed row of a batch."""
    for i in range(batch.num_rows):
        n = batch.column("n")[i].as_py()
        y, x, fold_of, inner_of = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=t) for c, t in (("y", float), ("x", float), ("fold_of", np.int8), ("inner_of", np.int8)))
        ids = batch.column("sample_id")[i].values if "sample_id" in batch.schema.names else None
        yield x.reshape(n, -1), y, fold_of.reshape(n, -1), inner_of.reshape(n, -1), ids


def _blocks(table: DataFrame) -> DataFrame:
    """The packed rows of a study table: those it was made of, else packed once and kept with it."""
    found = table.__dict__.get("_packed_rows")
    if found is None:
        found = table.__dict__["_packed_rows"] = cut_lineage(_pack_rows(table))
    return found


def _as_table(blocks: DataFrame) -> DataFrame:
    """Study rows of packed ones."""

    def unpack(batches):
        for batch in batches:
            for x, y, fold_of, inner_of, ids in _block_arrays(batch):
                lists = []
                for m, kind in ((x, pa.float64()), (fold_of, pa.int32()), (inner_of, pa.int32())):
                    flat = pa.array(m.ravel(), mask=np.isnan(m.ravel())) if m is x else pa.array(m.ravel().astype(np.int32))
                    lists.append(pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), flat.cast(kind)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(y.astype(np.int32)), *lists], ["sample_id", "y", "x", "fold_of", "inner_of"])

    table = blocks.mapInArrow(unpack, "sample_id string, y int, x array<double>, fold_of array<int>, inner_of array<int>")
    table.__dict__["_packed_rows"] = blocks
    return table


def _sum_arrays(df: DataFrame) -> dict[str, np.ndarray]:
    return L.sum_partials(df)


def _sum_rows(table: DataFrame, fold_batch) -> DataFrame:
    """Partial sums of each task: ``fold_batch(x, y, fold_of, inner_of)`` yields (key, array); equal keys are added."""

    def run(batches):
        sums: dict = {}
        for batch in batches:
            for *arrays, _ in _block_arrays(batch):
                for key, v in fold_batch(*arrays):
                    if key in sums:
                        sums[key] += v
                    else:
                        sums[key] = np.array(v, dtype=float)
        yield _partial_batch(sums)

    return _blocks(table).select("y", "x", "fold_of", "inner_of", "n").mapInArrow(run, L.SUM_SCHEMA)


def _partial_batch(sums: dict) -> pa.RecordBatch:
    """Partial sums as the rows of ``L.partial_frame``."""
    arrays = [np.asarray(v, dtype=float).ravel() for v in sums.values()]
    ends = np.cumsum([0, *[len(v) for v in arrays]]).astype(np.int32)
    flat = pa.array(np.concatenate(arrays) if arrays else np.zeros(0))
    return pa.RecordBatch.from_arrays([pa.array(list(sums), type=pa.string()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["key", "v"])


def _pass(table: DataFrame, fold_batch) -> dict[str, np.ndarray]:
    """One pass over the packed rows; see ``_sum_rows``."""
    return _sum_arrays(_sum_rows(table, fold_batch))


MEDIAN_CELLS, MEDIAN_PASSES, MEDIAN_ROWS = 256, 4, 4096  # cells a pass, passes at most, rows of a set that are few enough


def set_medians(table: DataFrame, layout: Layout, features: list[int]) -> dict:
    """Exact train medians of the listed features for every set: ``{set: {feature: median}}``.

    The medians of all sets lie close together.  Counting passes narrow, per feature, the band of
    values that holds all of them; rows below it are only counted.  What lies in the band becomes one
    row of counts per task and distinct value; these are range-partitioned and sorted by
    (feature, value), a pass counts train rows per partition and set, and another one reads off the
    middle ranks.
    """
    sets = list(layout.sets())
    if not features:
        return {s: {} for s in sets}
    below, totals, bands = _median_bands(table, layout, features, sets)
    empty = [j for j in features if (totals[j] == 0).any()]
    if empty:
        raise ValueError(f"features {empty} have no value in some training set")
    held = table.sparkSession.sparkContext.broadcast(bands)

    def collapse(batches):
        counts: dict = {}
        for x, _, fold_of, inner_of, _ in (arrays for batch in batches for arrays in _block_arrays(batch)):
            members = _members(layout, sets, fold_of, inner_of)
            for j, (low, high) in held.value.items():
                rows = np.flatnonzero((x[:, j] >= low) & (x[:, j] < high))
                if not len(rows):
                    continue
                order = rows[np.argsort(x[rows, j], kind="stable")]
                first = np.flatnonzero(np.append(True, np.diff(x[order, j]) > 0))
                n = np.add.reduceat(members[order].astype(np.int32), first, axis=0).astype(np.int64)
                for v, c in zip(x[order[first], j], n):
                    old = counts.get((j, v))
                    counts[(j, v)] = c if old is None else old + c
            if len(counts) * len(sets) > MEDIAN_STATE:
                yield _count_batch(counts)
                counts = {}
        yield _count_batch(counts)

    cells = _blocks(table).select("y", "x", "fold_of", "inner_of", "n").mapInArrow(collapse, "feature int, v double, n array<bigint>")
    ordered = cut_lineage(
        cells.repartitionByRange("feature", "v").sortWithinPartitions("feature", "v").withColumn("part", F.spark_partition_id())
    )

    def count(batches):
        sums: dict = {}
        for pdf in batches:
            for (j, p), g in pdf.groupby(["feature", "part"]):
                c = np.vstack(g["n"].to_numpy()).sum(0)
                sums[(j, p)] = sums[(j, p)] + c if (j, p) in sums else c
        if sums:
            yield pd.DataFrame([(j, p, v.tolist()) for (j, p), v in sums.items()], columns=["feature", "part", "n"])

    counts = ordered.mapInPandas(count, "feature int, part int, n array<bigint>").collect()  # (features + partitions) rows
    before, upto = {}, {j: below[j].copy() for j in features}
    for r in sorted(counts, key=lambda r: (r["feature"], r["part"])):
        before[(r["feature"], r["part"])] = upto[r["feature"]].copy()
        upto[r["feature"]] += np.array(r["n"], dtype=np.int64)
    shared = table.sparkSession.sparkContext.broadcast((before, totals))

    def pick(batches):
        before, totals = shared.value
        seen: dict = {}
        for pdf in batches:
            for (j, p), g in pdf.groupby(["feature", "part"]):
                start = seen.get((j, p), before[(j, p)])
                cum = np.vstack(g["n"].to_numpy()).cumsum(0) + start
                seen[(j, p)] = cum[-1]
                values = g["v"].to_numpy()
                for rank in ((totals[j] + 1) // 2, totals[j] // 2 + 1):
                    hit = (start < rank) & (cum[-1] >= rank)
                    for s in np.nonzero(hit)[0]:
                        at = np.searchsorted(cum[:, s], rank[s])
                        yield pd.DataFrame({"feature": [j], "s": [s], "v": [values[at]]})

    middle = ordered.mapInPandas(pick, "feature int, s int, v double").groupBy("feature", "s").agg(F.avg("v").alias("m")).collect()
    out: dict = {s: {} for s in sets}
    for r in middle:
        out[sets[r["s"]]][r["feature"]] = r["m"]
    return out


MEDIAN_STATE = 2_000_000  # counts that a task keeps before it passes them on


def _members(layout: Layout, sets: list, fold_of: np.ndarray, inner_of: np.ndarray) -> np.ndarray:
    return np.column_stack([layout.train(fold_of, inner_of, s) for s in sets])


def _count_batch(counts: dict) -> pa.RecordBatch:
    kinds = pa.int32(), pa.float64(), pa.list_(pa.int64())
    columns = [j for j, _ in counts], [v for _, v in counts], list(counts.values())
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], ["feature", "v", "n"])


def _ends(table: DataFrame, features: list[int]) -> dict:
    """Least and greatest value of every feature that has one."""

    def run(batches):
        ends: dict = {}
        for x, *_ in (arrays for batch in batches for arrays in _block_arrays(batch)):
            for j in features:
                v = x[~np.isnan(x[:, j]), j]
                if len(v):
                    low, high = ends.get(j, (v[0], v[0]))
                    ends[j] = min(low, v.min()), max(high, v.max())
        columns = list(ends), [float(a) for a, _ in ends.values()], [float(b) for _, b in ends.values()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, (pa.int32(), pa.float64(), pa.float64()))], ["j", "low", "high"])

    found = _blocks(table).select("y", "x", "fold_of", "inner_of", "n").mapInArrow(run, "j int, low double, high double")
    return {r["j"]: (r["low"], r["high"]) for r in found.groupBy("j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}


def _median_bands(table: DataFrame, layout: Layout, features: list[int], sets: list) -> tuple[dict, dict, dict]:
    """Per feature: train rows of every set below the band, train rows in all, and the band ``[low, high)``."""
    ends = _ends(table, features)
    bare = [j for j in features if j not in ends]
    if bare:
        raise ValueError(f"features {bare} have no value in some training set")
    bands = {j: (ends[j][0], np.nextafter(ends[j][1], np.inf)) for j in features}
    below: dict = {}
    totals: dict = {}
    wide = list(features)
    for _ in range(MEDIAN_PASSES):
        edges = {}
        for j in wide:
            low, high = bands[j]
            edges[j] = 2 * np.linspace(low / 2, high / 2, MEDIAN_CELLS + 1)  # halves: the width itself may overflow
            edges[j][[0, -1]] = low, high
        shared = table.sparkSession.sparkContext.broadcast(edges)

        def count(x, y, fold_of, inner_of):
            members = _members(layout, sets, fold_of, inner_of)
            for j, e in shared.value.items():
                rows = np.flatnonzero(~np.isnan(x[:, j]))
                cell = np.searchsorted(e, x[rows, j], side="right")  # 0 lies below the band, the last above it
                order = np.argsort(cell, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(cell[order]) > 0)) if len(rows) else np.zeros(0, dtype=int)
                n = np.zeros((len(e) + 1, len(sets)))
                if len(rows):
                    n[cell[order[first]]] = np.add.reduceat(members[rows[order]].astype(np.int32), first, axis=0)
                yield str(j), n.ravel()

        sums = _pass(table, count)
        wide = []
        for j, e in edges.items():
            n = sums[str(j)].reshape(-1, len(sets)).astype(np.int64)
            upto = n.cumsum(0)
            totals[j] = upto[-1]
            first, last = ((upto < rank).sum(0) for rank in ((totals[j] + 1) // 2, totals[j] // 2 + 1))
            a, b = int(first.min()), int(last.max())
            if (totals[j] == 0).any() or not 1 <= a <= b < len(e):
                a, b = 1, len(e) - 1
            below[j] = upto[a - 1]
            if (upto[b] - below[j]).max() > MEDIAN_ROWS and (e[a - 1], e[b]) != bands[j]:
                wide.append(j)
            bands[j] = (e[a - 1], e[b])
        if not wide:
            break
    return below, totals, bands


@dataclass
class Moments:
    """Count, mean and sum of centred cross products of the vector ``[x or 0, missing]``."""

    n: float
    mean: np.ndarray
    gram: np.ndarray


def merge(parts: list[Moments]) -> Moments:
    """Moments of a union of disjoint cells; nothing is ever subtracted."""
    n = sum(p.n for p in parts)
    mean = sum(p.n * p.mean for p in parts) / max(n, 1.0)
    gram = sum(p.gram + p.n * np.outer(p.mean - mean, p.mean - mean) for p in parts)
    return Moments(n, mean, gram)


def cell_moments(table: DataFrame, layout: Layout, gaps: list[int]) -> dict:
    """Moments of every held-out cell and class, in two passes (means, then centred products)."""
    cells = list(layout.sets())
    w = layout.n_features + len(gaps)
    if len(cells) * w * (w + 1) > MAX_STATE:
        raise ValueError(f"{layout.n_features} features: the state of {len(cells)} sets exceeds {MAX_STATE} numbers")
    tri = np.triu_indices(w)

    def extended(x):
        return np.column_stack([np.nan_to_num(x), np.isnan(x)[:, gaps].astype(float)])

    def parts(u, y, fold_of, inner_of):
        for s in cells:
            h = layout.held(fold_of, inner_of, s)
            for label in (0, 1):
                yield f"{set_name(s)}/{label}", u[h & (y == label)]

    def totals(x, y, fold_of, inner_of):
        for key, part in parts(extended(x), y, fold_of, inner_of):
            yield key, np.concatenate([[len(part)], part.sum(0)])

    sums = _pass(table, totals)
    means = {k: v[1:] / max(v[0], 1.0) for k, v in sums.items()}
    shared = table.sparkSession.sparkContext.broadcast(means)

    def products(x, y, fold_of, inner_of):
        for key, part in parts(extended(x), y, fold_of, inner_of):
            c = part - shared.value[key]
            yield key, (c.T @ c)[tri]

    grams = _pass(table, products)
    out = {}
    for s in cells:
        for label in (0, 1):
            key = f"{set_name(s)}/{label}"
            g = np.zeros((w, w))
            g[tri] = grams[key]
            out[(s, label)] = Moments(float(sums[key][0]), means[key], g + np.triu(g, 1).T)
    return out


def fit_sets(table: DataFrame, layout: Layout, errors: list | None = None) -> dict:
    """Preprocessing, encoder and sampler of all training sets.

    A training set's moments are the merge of the cells it is made of, so
    held-out rows, however extreme, have no part in them.  With ``errors`` a
    list, the reconstruction error of the train and of the held-out rows is
    appended per (set, modality, ratio); it follows from the same moments.
    """
    d = layout.n_features
    missing = _pass(table, lambda x, *_: [("n", np.isnan(x).sum(0))]).get("n", np.zeros(d))
    gaps = [j for j in range(d) if missing[j]]
    medians = set_medians(table, layout, gaps)
    held = cell_moments(table, layout, gaps)
    models = {}
    for s in layout.sets():
        r, f, i = s
        if i < 0:
            train = [(r, g, -1) for g in range(layout.n_splits) if g != f]
        else:
            train = [(r, f, h) for h in range(layout.n_inner) if h != i]
        by_label = {label: merge([held[(c, label)] for c in train]) for label in (0, 1)}
        models[s] = _fit_set(layout, by_label, medians[s], gaps)
        if errors is not None:
            own = merge([held[(s, 0)], held[(s, 1)]])
            for part, moments in (("train", merge(list(by_label.values()))), ("held", own)):
                errors.extend(_reconstruction(layout, models[s], s, part, moments, medians[s], gaps))
    return models


def _fill_map(d: int, medians: dict, gaps: list[int]) -> np.ndarray:
    """Matrix taking ``[x or 0, missing]`` to the median-filled vector."""
    to_filled = np.zeros((d, d + len(gaps)))
    to_filled[:, :d] = np.eye(d)
    for c, j in enumerate(gaps):
        to_filled[j, d + c] = medians[j]
    return to_filled


def _reconstruction(layout: Layout, model: SetModel, s, part: str, moments: Moments, medians: dict, gaps: list[int]):
    """Mean squared error per cell after encoding and decoding with each ratio's width."""
    if not moments.n:
        return
    to_filled = _fill_map(layout.n_features, medians, gaps)
    off = to_filled @ moments.mean - model.mean
    second = (to_filled @ moments.gram @ to_filled.T + moments.n * np.outer(off, off)) / np.outer(model.scale, model.scale) / moments.n
    for name, sl, (start, _) in zip(MODALITIES, layout.slices, layout.latent):
        block = second[sl, sl]
        d = block.shape[0]
        for ratio in layout.ratios:
            k = S.latent_width(d, ratio)
            w = model.loadings[sl, start : start + k]
            yield (*s, part, name, float(ratio), int(k), int(round(moments.n)), float((np.trace(block) - np.trace(w.T @ block @ w)) / d))


def _fit_set(layout: Layout, by_label: dict, medians: dict, gaps: list[int]) -> SetModel:
    d = layout.n_features
    to_filled = _fill_map(d, medians, gaps)
    both = merge([by_label[0], by_label[1]])
    mean = to_filled @ both.mean
    cov = to_filled @ both.gram @ to_filled.T / both.n
    var = np.maximum(np.diag(cov), 0.0)
    scale = np.where(var < 1e-20, 1.0, np.sqrt(var))
    corr = cov / np.outer(scale, scale)
    loadings = np.zeros((d, layout.n_latent))
    eigen = np.zeros(layout.n_latent)
    for part, (start, k) in zip(layout.slices, layout.latent):
        values, vectors = np.linalg.eigh(corr[part, part])
        order = np.argsort(values)[::-1][:k]
        vectors = vectors[:, order]
        signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])
        loadings[part, start : start + k] = vectors * signs
        eigen[start : start + k] = values[order]
    model = SetModel(np.array([medians.get(j, 0.0) for j in range(d)]), mean, scale, loadings, eigen, int(round(both.n)))
    if by_label[1].n == by_label[0].n:
        raise ValueError("the classes of a training set are equally large: there is no minority to augment")
    model.minority = 1 if by_label[1].n < by_label[0].n else 0
    model.needed = int(round(abs(by_label[0].n - by_label[1].n)))
    small = by_label[model.minority]
    model.n_minority = int(round(small.n))
    model.second = loadings.T @ corr @ loadings
    project = loadings / scale[:, None]
    model.minority_mean = (to_filled @ small.mean - mean) @ project
    latent_cov = project.T @ (to_filled @ small.gram @ to_filled.T / max(small.n, 1.0)) @ project
    model.minority_sd = np.sqrt(np.maximum(np.diag(latent_cov), 1e-18))
    r = latent_cov / np.outer(model.minority_sd, model.minority_sd)
    np.fill_diagonal(r, 1.0)
    values, vectors = np.linalg.eigh(r)
    model.factor = vectors * np.sqrt(np.maximum(values, 0.0))
    return model


def fit_marginals(table: DataFrame, layout: Layout, models: dict) -> None:
    """Quantile grid of each minority latent, with exact ends and without a cut.

    Passes fold rows into mergeable counts per set and latent: the ends; counts between them in
    cells that are even in the inverse hyperbolic sine of the standardised value, so that far
    tails take few cells; and counts in cells refined where the last ones were full, until none holds
    more than ``RANK_ERROR`` of the rows.  A quantile's rank is off by at most the fullest cell, which ``rank_error`` keeps as a share of the rows.
    """
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast(models)

    def minority(x, y, fold_of, inner_of):
        rows = {}
        for label in {model.minority for model in shared.value.values()}:
            own = y == label
            rows[label] = np.ascontiguousarray(x[own].T), fold_of[own], inner_of[own]
        for s, model in shared.value.items():
            columns, *folds = rows[model.minority]
            z = model.encode_columns(np.compress(layout.train(*folds, s), columns, axis=1))
            yield s, (z - model.minority_mean[:, None]) / model.minority_sd[:, None]

    def ends(batches):
        held: dict = {}
        for arrays in (arrays for batch in batches for arrays in _block_arrays(batch)):
            for s, t in minority(*arrays[:4]):
                if t.shape[1]:
                    low, high = held.get(s, (t[:, 0], t[:, 0]))
                    held[s] = (np.minimum(low, t.min(1)), np.maximum(high, t.max(1)))
        columns = [set_name(s) for s in held], [a.tolist() for a, _ in held.values()], [b.tolist() for _, b in held.values()]
        kinds = pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], ["key", "low", "high"])

    found = _blocks(table).select("y", "x", "fold_of", "inner_of", "n").mapInArrow(ends, "key string, low array<double>, high array<double>")
    span = found.groupBy("key").agg(*[F.array(*[f(F.col(c)[j]) for j in range(layout.n_latent)]).alias(c) for c, f in (("low", F.min), ("high", F.max))])
    limits = {tuple(int(v) for v in r["key"].split("/")): (np.array(r["low"]), np.array(r["high"])) for r in span.collect()}  # one row per set
    share = np.linspace(0, 1, HISTOGRAM_CELLS + 1)[:, None]
    edges = {s: np.sinh(np.arcsinh(a) + (np.arcsinh(b) - np.arcsinh(a)) * share) for s, (a, b) in limits.items()}
    counts = _cell_counts(table, layout, edges, minority)
    for _ in range(REFINEMENTS):
        if max(_fullest(edges[s], counts[s]) for s in edges) <= RANK_ERROR:
            break
        edges = {s: np.column_stack([_refined(edges[s][:, j], counts[s][:, j]) for j in range(layout.n_latent)]) for s in edges}
        counts = _cell_counts(table, layout, edges, minority)
    for s, model in models.items():
        e, h = edges[s], counts[s]
        e[0], e[-1] = limits[s]
        cdf = np.concatenate([np.zeros((1, layout.n_latent)), np.cumsum(h, 0)]) / h.sum(0)
        grid = np.empty((layout.n_latent, len(QUANTILE_GRID)))
        for j in range(layout.n_latent):
            first, last = np.flatnonzero(h[:, j])[[0, -1]]
            grid[j] = np.interp(QUANTILE_GRID, cdf[first : last + 2, j], e[first : last + 2, j])
        model.grid = grid * model.minority_sd[:, None] + model.minority_mean[:, None]
        model.rank_error = _fullest(e, h)


def _cell_counts(table: DataFrame, layout: Layout, edges: dict, minority) -> dict:
    """Rows per cell and latent of every set; what lies outside by rounding counts at the ends."""
    shared = table.sparkSession.sparkContext.broadcast(edges)

    def count(x, y, fold_of, inner_of):
        for s, t in minority(x, y, fold_of, inner_of):
            cuts = shared.value[s][1:-1]
            t.sort(axis=1)  # sorted rows are counted by looking up the cuts, of which there are fewer
            below = np.stack([np.searchsorted(t[j], cuts[:, j]) for j in range(layout.n_latent)], axis=1)
            ends = np.zeros((1, layout.n_latent)), np.full((1, layout.n_latent), t.shape[1])
            yield set_name(s), np.diff(np.concatenate([ends[0], below, ends[1]]), axis=0).ravel()

    sums = _pass(table, count)
    return {s: sums[set_name(s)].reshape(-1, layout.n_latent) for s in edges}


def _refined(edges: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """As many cells again, each with about the same number of rows if rows lie evenly within the old cells."""
    cdf = np.append(0.0, np.cumsum(counts)) / counts.sum()
    rising = np.append(True, np.diff(cdf) > 0)
    out = np.interp(np.linspace(0, 1, len(edges)), cdf[rising], edges[rising])
    out[0], out[-1] = edges[0], edges[-1]
    return out


def _fullest(edges: np.ndarray, counts: np.ndarray) -> float:
    """Share of the rows in the fullest cell; equal values are one point and do not count, whatever their number."""
    wide = np.diff(edges, axis=0) > 1e-9 * (1e-3 + np.abs(edges[1:]))
    return float((counts * wide).max() / counts.sum(0).min())


def synthetic_blocks(spark: SparkSession, models: dict) -> DataFrame:
    """``(key, block, size)`` of every synthetic block to draw, generated from one row per set.

    The number of partitions is named: the rows are few bytes, and AQE would join them into one task.
    """
    rows = [(set_name(s), m.needed) for s, m in models.items() if m.needed > 0]
    sets = spark.createDataFrame(rows, "key string, needed bigint")
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("needed") - 1) / SYNTHETIC_BLOCK)))
    return sets.withColumn("block", block).select(
        "key", "block", F.least(F.lit(SYNTHETIC_BLOCK), F.col("needed") - F.col("block") * SYNTHETIC_BLOCK).cast("int").alias("size")
    ).repartition(_tasks(spark), "key", "block")


def _synthetic_pass(blocks: DataFrame, layout: Layout, shared, fold_block) -> DataFrame:
    def run(batches):
        sums: dict = {}
        for pdf in batches:
            for key, block, size in zip(pdf["key"], pdf["block"], pdf["size"]):
                s = tuple(int(v) for v in key.split("/"))
                model = shared.value[s]
                z = model.draw_columns(set_seed(layout, s, "sampler"), int(block), SYNTHETIC_BLOCK)[:, :size]
                for name, v in fold_block(s, model, z):
                    sums[name] = sums[name] + v if name in sums else v
        yield L.partial_frame(sums)

    return blocks.mapInPandas(run, L.SUM_SCHEMA)


def fit_latent_scalers(spark: SparkSession, layout: Layout, models: dict) -> None:
    """Post-fusion scaler over real and synthetic train rows of every set."""
    k = layout.n_latent
    tri = np.triu_indices(k)
    shared = spark.sparkContext.broadcast(models)
    sums = _sum_arrays(
        _synthetic_pass(synthetic_blocks(spark, models), layout, shared, lambda s, m, z: [(set_name(s), np.concatenate([z.sum(1), (z @ z.T)[tri]]))])
    )
    for s, m in models.items():
        v = sums.get(set_name(s), np.zeros(k + len(tri[0])))
        m.drawn = np.zeros((k + 1, k))
        m.drawn[0] = v[:k]
        m.drawn[1:][tri] = v[k:]
        m.drawn[1:] += np.triu(m.drawn[1:], 1).T
        n = m.n + m.needed
        mean = v[:k] / n  # real latents have mean 0
        second = (np.diag(m.drawn[1:]) + m.n * m.eigen) / n
        sd = np.sqrt(np.maximum(second - mean * mean, 0.0))
        m.z_mean, m.z_scale = mean, np.where(sd < 1e-9, 1.0, sd)


def candidate_name(s, ratio: float, c: float) -> str:
    return f"{set_name(s)}#{ratio}#{c}"


def _sums_at_zero(m: SetModel, columns: np.ndarray) -> np.ndarray:
    """``L.block_sums`` of all train rows at zero weights, from the moments of the latents.

    Latents are stored as 32-bit numbers and moments are not, so this differs from the sum over rows by
    rounding.  It only names where the first step goes; every later step is summed over rows.
    """
    n, k = m.n + m.needed, len(columns)
    total, products = m.drawn[0][columns], (m.drawn[1:] + m.n * m.second)[np.ix_(columns, columns)]  # real latents have mean 0
    centre, scale = m.z_mean[columns], m.z_scale[columns]
    first = (total - n * centre) / scale
    centred = products - np.outer(total, centre) - np.outer(centre, total) + n * np.outer(centre, centre)
    gram = np.empty((k + 1, k + 1))
    gram[:k, :k], gram[k, :k], gram[:k, k], gram[k, k] = centred / np.outer(scale, scale), first, first, n
    small = np.append((total + m.n_minority * m.minority_mean[columns] - (m.needed + m.n_minority) * centre) / scale, m.needed + m.n_minority)
    hits = small if m.minority == 1 else gram[k] - small  # sums over the rows of class 1
    return np.concatenate([[n * np.log(2.0)], gram[k] / 2 - hits, (gram / 4)[np.triu_indices(k + 1)]])


def fit_classifiers(table: DataFrame, layout: Layout, models: dict, wanted: list[tuple], max_iter: int = 50):
    """Newton for all ``(set, ratio, C)`` in ``wanted`` together; returns weights and the fit log."""
    spark = table.sparkSession
    used = {s: models[s] for s in {w[0] for w in wanted}}
    shared = spark.sparkContext.broadcast(used)
    by_set: dict = {}
    for s, ratio, c in wanted:
        by_set.setdefault(s, []).append((ratio, c, candidate_name(s, ratio, c)))
    widths = {name: len(layout.columns[ratio]) + 1 for rs in by_set.values() for ratio, _, name in rs}
    cs = {name: c for rs in by_set.values() for _, c, name in rs}
    blocks = cut_lineage(synthetic_blocks(spark, used))

    def step(current):
        weights = spark.sparkContext.broadcast(current)

        def sums_of(s, model, z, y):
            t = np.ones((len(z) + 1, z.shape[1]))
            t[:-1] = (z - model.z_mean[:, None]) / model.z_scale[:, None]
            done = {}
            for ratio, _, name in by_set[s]:
                if name in weights.value:
                    if ratio not in done:
                        done[ratio] = t[[*layout.columns[ratio], -1]]
                    yield name, L.column_sums(done[ratio], y, weights.value[name])

        live = {s for s, rs in by_set.items() if any(name in current for _, _, name in rs)}

        def real(x, y, fold_of, inner_of):
            columns = np.ascontiguousarray(x.T)
            for s in live:
                keep = layout.train(fold_of, inner_of, s)
                yield from sums_of(s, shared.value[s], shared.value[s].encode_columns(np.compress(keep, columns, axis=1)), y[keep])

        drawn = _synthetic_pass(
            blocks, layout, shared, lambda s, m, z: sums_of(s, m, z, np.full(z.shape[1], float(m.minority))) if s in live else []
        )
        return _sum_rows(table, real).unionByName(drawn)

    share = {name: (s, ratio) for s, rs in by_set.items() for ratio, _, name in rs}
    zero = {at: _sums_at_zero(models[at[0]], layout.columns[at[1]]) for at in set(share.values())}
    weights, log = L.newton(step, widths, cs, max_iter, tol=1e-6, share=share, zero=zero)
    if unfinished := L.unconverged(log):
        raise RuntimeError(f"{len(unfinished)} of {len(widths)} classifiers did not converge in {max_iter} steps, the first is {unfinished[0]}")
    return weights, log


def encoded_rows(table: DataFrame, layout: Layout, models: dict) -> DataFrame:
    """Latents of the held-out rows of every given set: ``(repeat_id, fold_id, inner_fold_id, sample_id, z)``."""
    shared = table.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for x, _, fold_of, inner_of, ids in (arrays for batch in batches for arrays in _block_arrays(batch)):
            rows = np.ascontiguousarray(x.T)
            for s, m in shared.value.items():
                keep = layout.held(fold_of, inner_of, s)
                if keep.any():
                    z = m.encode_columns(np.compress(keep, rows, axis=1)).T.astype(np.float32)
                    ends = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
                    columns = [*_repeated(s, len(z)), ids.filter(pa.array(keep)), pa.ListArray.from_arrays(ends, pa.array(z.ravel()))]
                    yield pa.RecordBatch.from_arrays(columns, ["repeat_id", "fold_id", "inner_fold_id", "sample_id", "z"])

    schema = "repeat_id int, fold_id int, inner_fold_id int, sample_id string, z array<float>"
    return _blocks(table).mapInArrow(run, schema)


def _repeated(values, n: int) -> list[pa.Array]:
    return [pa.array(np.full(n, v, dtype=np.int32)) for v in values]


def _held_scores(layout: Layout, x, fold_of, inner_of, models: dict, weights: dict, plan: dict):
    """``(set, number, held rows, scores)`` of one batch for every candidate of the plan."""
    rows = np.ascontiguousarray(x.T)
    for s, candidates in plan.items():
        keep = layout.held(fold_of, inner_of, s)
        if keep.any():
            m = models[s]
            t = (m.encode_columns(np.compress(keep, rows, axis=1)) - m.z_mean[:, None]) / m.z_scale[:, None]
            for number, ratio, c in candidates:
                w = weights[candidate_name(s, ratio, c)]
                yield s, number, keep, w[:-1] @ t[layout.columns[ratio]] + w[-1]


def held_out_scores(table: DataFrame, layout: Layout, models: dict, weights: dict, plan: dict) -> DataFrame:
    """Scores of held-out rows: ``plan`` maps a set to its candidates ``[(number, ratio, C)]``.

    Rows ``(repeat_id, fold_id, inner_fold_id, candidate, sample_id, y, score)``;
    synthetic rows are never scored.
    """
    shared = table.sparkSession.sparkContext.broadcast(({s: models[s] for s in plan}, weights, plan))

    def run(batches):
        for x, y, fold_of, inner_of, ids in (arrays for batch in batches for arrays in _block_arrays(batch)):
            for s, number, keep, score in _held_scores(layout, x, fold_of, inner_of, *shared.value):
                columns = [*_repeated((*s, number), len(score)), ids.filter(pa.array(keep)), pa.array(y[keep].astype(np.int32)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["repeat_id", "fold_id", "inner_fold_id", "candidate", "sample_id", "y", "score"])

    schema = "repeat_id int, fold_id int, inner_fold_id int, candidate int, sample_id string, y int, score double"
    return _blocks(table).mapInArrow(run, schema)


def packed_scores(table: DataFrame, layout: Layout, models: dict, weights: dict, plan: dict) -> DataFrame:
    """Scores and labels of ``held_out_scores`` without ids, one packed block per batch and set.

    ``k`` numbers the sets in the order of the plan; a set has one candidate here.
    """
    shared = table.sparkSession.sparkContext.broadcast(({s: models[s] for s in plan}, weights, plan))
    numbers = {s: k for k, s in enumerate(plan)}

    def run(batches):
        for batch in batches:
            for x, y, fold_of, inner_of, _ in _block_arrays(batch):
                rows = [K.block_row([numbers[s]], score, y[keep]) for s, _, keep, score in _held_scores(layout, x, fold_of, inner_of, *shared.value)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=pa.binary()) for i in range(3)], ["k", "score", "y"])

    return _blocks(table).select("y", "x", "fold_of", "inner_of", "n").mapInArrow(run, K.BLOCK_SCHEMA)


RANGE_ROWS = 500_000  # scores of one key that are ranked together, about
RANK_CELLS = 64  # cells of a counted histogram; ranges are runs of cells


def ranked_candidates(table: DataFrame, layout: Layout, models: dict, weights: dict, plan: dict, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``ranking_metrics`` of ``held_out_scores`` per (set, candidate), without a row per score.

    Scores travel as packed arrays of 9 bytes a score.  A key with more than ``range_rows`` held-out rows
    is cut into ranges of scores: a pass counts both classes in cells of every key, runs of cells become
    ranges, and a range is ranked by one task after the counted rows of the ranges above it.  The counts
    are exact, so the cut decides only where a score is ranked.  Equal scores are always in one cell.
    """
    spark = table.sparkSession
    held = {s: models[s] for s in plan}
    shared = spark.sparkContext.broadcast((held, weights, plan))
    share = np.linspace(0, 1, RANK_CELLS + 1)[1:-1]
    cells = np.log(share / (1 - share))  # even in the probability
    # Where all rows of the table cannot fill two ranges, no key can.
    many = (_blocks(table).agg(F.sum("n")).first()[0] or 0) > range_rows
    cuts: dict = {}
    before: dict = {}
    if many:

        def bounds(x, y, fold_of, inner_of):
            for s, number, keep, score in _held_scores(layout, x, fold_of, inner_of, *shared.value):
                low = np.searchsorted(cells, score, side="right")
                own = y[keep]
                yield f"{set_name(s)}#{number}", np.concatenate([np.bincount(low[own == label], minlength=RANK_CELLS) for label in (1, 0)])

        for key, v in _pass(table, bounds).items():
            pos, neg = v[:RANK_CELLS], v[RANK_CELLS:]
            # ranges from the highest cell down; number 0 holds the highest scores
            above = np.concatenate([[0.0], np.cumsum((pos + neg)[::-1])])[:-1]
            number = (above // range_rows).astype(int)[::-1]
            cuts[key] = np.unique(number, return_inverse=True)[1]
            n = cuts[key].max() + 1
            for name, count in (("pos", pos), ("neg", neg)):
                total = np.bincount(cuts[key], weights=count, minlength=n)
                for j, b in enumerate(np.cumsum(total) - total):
                    before.setdefault((key, j), {})[name] = b
    places = spark.sparkContext.broadcast((cuts, before))

    def pack(batches):
        for x, y, fold_of, inner_of, _ in (arrays for batch in batches for arrays in _block_arrays(batch)):
            out = []
            for s, number, keep, score in _held_scores(layout, x, fold_of, inner_of, *shared.value):
                key, own = f"{set_name(s)}#{number}", y[keep].astype(np.int8)
                cut = places.value[0].get(key)
                if cut is None:
                    out.append((key, 0, score.tobytes(), own.tobytes()))
                    continue
                if cut.max() == 0:
                    out.append((key, 0, score.tobytes(), own.tobytes()))
                    continue
                at = cut[np.searchsorted(cells, score, side="right")]
                out.extend((key, int(j), score[at == j].tobytes(), own[at == j].tobytes()) for j in np.unique(at))
            kinds = pa.string(), pa.int32(), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=k) for i, k in enumerate(kinds)], ["key", "j", "score", "y"])

    def rank(batches):
        found: dict = {}
        for pdf in batches:
            for key, j, score, y in zip(pdf["key"], pdf["j"], pdf["score"], pdf["y"]):
                found.setdefault((key, j), []).append((np.frombuffer(score), np.frombuffer(y, dtype=np.int8)))
        out = []
        for key, j in list(found):
            scores, labels = (np.concatenate(v) for v in zip(*found.pop((key, j))))
            start = places.value[1].get((key, j), {"pos": 0.0, "neg": 0.0})
            out.append((key, *_range_sums(scores, labels, start["pos"], start["neg"])))
        yield pd.DataFrame(out, columns=["key", "n_pos", "n_neg", "ap", "wins"])

    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = _blocks(table).select("y", "x", "fold_of", "inner_of", "n").mapInArrow(pack, "key string, j int, score binary, y binary")
    sums = packed.repartition(max(n_tasks, _tasks(spark)), "key", "j").mapInPandas(rank, "key string, n_pos double, n_neg double, ap double, wins double")
    total = sums.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n_pos", "n_neg", "ap", "wins")])
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    part = F.split("key", "[/#]")
    names = ("repeat_id", "fold_id", "inner_fold_id", "candidate")
    return total.select(
        *[part[i].cast("int").alias(n) for i, n in enumerate(names)],
        F.col("n_pos").cast("bigint").alias("n_pos"),
        F.col("n_neg").cast("bigint").alias("n_neg"),
        F.when(both, F.col("ap") / F.col("n_pos")).alias("auprc"),
        F.when(both, F.col("wins") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"),
    )


def _range_sums(scores: np.ndarray, labels: np.ndarray, pos_before: float, neg_before: float) -> tuple:
    """Positives, negatives, and the two sums of ``metrics.ranking_from`` over one range of scores, ties together."""
    order = np.argsort(-scores)
    scores, hits = scores[order], (labels[order] == 1).astype(np.float64)
    last = np.append(np.flatnonzero(scores[1:] != scores[:-1]), len(scores) - 1)
    cum_pos = np.cumsum(hits)[last]
    cum_neg = last + 1 - cum_pos
    pos, neg = np.diff(cum_pos, prepend=0.0), np.diff(cum_neg, prepend=0.0)
    above = cum_pos + pos_before
    ap = (pos * above / (above + cum_neg + neg_before)).sum()
    return cum_pos[-1], cum_neg[-1], ap, (neg * (above - pos / 2.0)).sum()


@dataclass
class Study:
    """Everything a run leaves behind; DataFrames except the small model dictionaries."""

    layout: Layout
    table: DataFrame
    models: dict
    candidates: list
    weights: dict
    fit_log: list
    fold_metrics: DataFrame
    summary: DataFrame
    winners: DataFrame
    oof: DataFrame
    calibrators: DataFrame
    calibrated: DataFrame
    thresholds: DataFrame
    frozen: DataFrame

    def evaluation(self, labels: DataFrame) -> DataFrame:
        from .metric_queries import outer_evaluation

        return outer_evaluation(self.frozen, labels)


def prepare(cohort: DataFrame, layout: Layout) -> tuple[DataFrame, dict]:
    """Study table and the fitted sets (steps 1 to 4)."""
    table = study_table(cohort)
    models = fit_sets(table, layout)
    fit_marginals(table, layout, models)
    fit_latent_scalers(cohort.sparkSession, layout, models)
    return table, models


def search(table: DataFrame, layout: Layout, models: dict):
    """Inner search: fold metrics, candidate summaries and one winner per coordinate."""
    candidates = [(n, ratio, c) for n, (ratio, c) in enumerate((r, c) for r in layout.ratios for c in layout.cs)]
    inner = list(layout.sets(outer=False))
    weights, log = fit_classifiers(table, layout, models, [(s, ratio, c) for s in inner for _, ratio, c in candidates])
    fold_metrics = cut_lineage(ranked_candidates(table, layout, models, weights, {s: candidates for s in inner}))  # coordinates x candidates x folds rows
    facts = table.sparkSession.createDataFrame(
        [(n, S.candidate_id(ratio, c), ratio, c, len(layout.columns[ratio])) for n, ratio, c in candidates],
        "candidate int, candidate_id string, ratio double, c double, fused_width int",
    )
    summary = S.candidate_summary(fold_metrics, [*KEYS, "candidate"]).join(F.broadcast(facts), "candidate")
    incomplete = summary.filter((F.col("n_folds") != layout.n_inner) | F.col("mean_auprc").isNull()).limit(1).collect()
    if incomplete:
        raise ValueError(f"the candidate grid is incomplete: {incomplete[0].asDict()}")
    winners = cut_lineage(S.select_winner(summary, KEYS, S.PRIMARY_ORDER))
    return candidates, weights, log, fold_metrics, summary, winners


def run(cohort: DataFrame, layout: Layout) -> Study:
    """The whole study; outer-test labels are not read before ``Study.evaluation``."""
    table, models = prepare(cohort, layout)
    candidates, weights, log, fold_metrics, summary, winners = search(table, layout, models)
    won = {(r["repeat_id"], r["fold_id"]): (r["candidate"], r["ratio"], r["c"]) for r in winners.collect()}
    inner_plan = {s: [won[s[:2]]] for s in layout.sets(outer=False)}
    # The rows of ``oof`` are made where they are read; calibrators and thresholds need no ids and work on packed scores.
    oof = held_out_scores(table, layout, models, weights, inner_plan)
    packed = cut_lineage(packed_scores(table, layout, models, weights, inner_plan))
    calibrators = K.cross_fit_blocks(packed, list(inner_plan), [(k, "int") for k in KEYS], n_folds=layout.n_inner)
    calibrated = K.cross_fitted_probabilities(oof, calibrators, KEYS)
    own = {(r["repeat_id"], r["fold_id"], r["held"]): (r["a"], r["b"]) for r in calibrators.collect()}  # sets + coordinates rows
    thresholds = T.choose_from_blocks(packed, [s[:2] for s in inner_plan], [own[s] for s in inner_plan], [(k, "int") for k in KEYS])
    finals = [(s, *won[s[:2]][1:]) for s in layout.sets(inner=False)]
    final_weights, final_log = fit_classifiers(table, layout, models, finals)
    outer_plan = {s: [won[s[:2]]] for s in layout.sets(inner=False)}
    raw = held_out_scores(table, layout, models, final_weights, outer_plan).drop("y", "inner_fold_id")
    final_calibrators = calibrators.filter("held = -1").drop("held")
    scored = K.apply_sigmoid(raw, final_calibrators, KEYS)
    limits = F.broadcast(thresholds.select(*KEYS, "threshold"))  # one row per coordinate
    frozen = cut_lineage(
        scored.join(limits, KEYS).withColumn("predicted", (F.col("prob") >= F.col("threshold")).cast("int"))
    )
    return Study(
        layout, table, models, candidates, {**weights, **final_weights}, log + final_log, fold_metrics, summary, winners, oof, calibrators, calibrated, thresholds, frozen
    )
