"""Exact k-nearest-neighbour join without a cross join.

A reference whose counted size fits the broadcast bound goes to every task as
one matrix.  Beyond the bound:

Reference rows are cut into blocks of bounded size: each row goes to its
closest pivot, and a pivot's rows are cut into rings by distance to it.  For a
query row, the block table gives an upper bound on its k-th neighbour distance
and, by the triangle inequality, the only blocks that can hold a neighbour.
The row is sent to those blocks, each block visit keeps the row's best k (no
pair is emitted), and the best k over all visits is the exact answer.  Visits
of a popular block are salted into chunks, and a block is met in slices of at most
about ``SLICE_ROWS`` rows, so both sides of a task stay the same size while the tables grow.

Rows without structure visit every block, so there are no more pivots than the
largest key has blocks of ``BLOCK_ROWS``, and a task cuts what it sends on into
pieces of ``PIECE_ROWS`` visits.

The block table and the pivots are the only data sent to every task.  Their
size is set here: at most ``N_PIVOTS`` pivots and ``MAX_BLOCKS`` blocks a key (the
block height grows with the reference instead), ``MAX_LAYOUT`` blocks over all keys,
beyond which the join refuses to run.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

N_PIVOTS = 64
MAX_BLOCKS = 4096
BLOCK_ROWS = 8192
CHUNK_ROWS = 8192
SLICE_ROWS = 8192
PIECE_ROWS = 8192
BOUND_CELLS = 1 << 19  # rows x blocks that are bounded at once
MAX_LAYOUT = 1 << 20
EXACT_ROWS = 1 << 16
BROADCAST_CELLS = 4_000_000  # 32 MB of doubles


def _matrix(series: pd.Series) -> np.ndarray:
    return np.vstack(series.to_numpy()).astype(np.float64) if len(series) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances to a few rows ``b`` (the pivots), from differences: no cancellation at any offset."""
    out = np.empty((len(a), len(b)))
    for j, row in enumerate(b):
        gap = a - row
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def _pivots(reference: DataFrame, by: Sequence[str]) -> np.ndarray:
    """Rows with the smallest id hashes: a deterministic choice, one per block of the largest key."""
    largest = reference.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    wanted = min(N_PIVOTS, -(-largest // BLOCK_ROWS))
    rows = reference.orderBy(F.xxhash64(*by, "sample_id"), "sample_id").limit(wanted).select("z").collect()
    return np.array([r["z"] for r in rows], dtype=np.float64)


def knn_join(
    queries: DataFrame,
    reference: DataFrame,
    k: int = 1,
    by: Sequence[str] = (),
    exclude_self: bool = True,
    broadcast_cells: int = BROADCAST_CELLS,
) -> DataFrame:
    """``(by..., sample_id, neighbour_id, distance, rank)`` for ranks 1..k.

    Both inputs carry ``sample_id`` and ``z``; neighbours share the ``by``
    keys.  ``exclude_self`` drops pairs with equal ids.  Ties go to the
    smaller neighbour id.
    """
    by = list(by)
    spark = queries.sparkSession
    id_type = queries.schema["sample_id"].dataType.simpleString()
    key_types = ", ".join(f"{b} {reference.schema[b].dataType.simpleString()}" for b in by)
    head = f"{key_types}, " if by else ""
    reference = reference.select(*by, "sample_id", F.col("z").cast("array<double>").alias("z"))
    queries = queries.select(*by, "sample_id", F.col("z").cast("array<double>").alias("z"))
    size = reference.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("z")).alias("d")).first()
    if size["n"] * (size["d"] or 0) <= broadcast_cells:
        return _broadcast_join(queries, reference, k, by, exclude_self, head, id_type)
    pivots = spark.sparkContext.broadcast(_pivots(reference, by))

    def assign(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            d = _distances(_matrix(pdf["z"]), pivots.value)
            cell = d.argmin(1)
            yield pdf.assign(cell=cell.astype(np.int32), radius=d[np.arange(len(pdf)), cell])

    placed = cut_lineage(
        reference.mapInPandas(assign, f"{head}sample_id {id_type}, z array<double>, cell int, radius double")
    )
    total = placed.count()
    height = max(BLOCK_ROWS, -(-total // (MAX_BLOCKS // 2)))
    cells = placed.groupBy(*by, "cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("radius").alias("r_max"), F.min("radius").alias("r_min")
    )
    # Rings of equal width in r (bounded count per cell), then exact extents per ring.
    ringed = placed.join(F.broadcast(cells), [*by, "cell"]) if not by else placed.join(cells, [*by, "cell"])
    n_rings = F.ceil(F.col("n") / F.lit(height))
    width = (F.col("r_max") - F.col("r_min")) / n_rings
    ring = F.when(width > 0, F.least(F.floor((F.col("radius") - F.col("r_min")) / width), n_rings - 1)).otherwise(0)
    blocks = ringed.withColumn("ring", ring.cast("int")).select(*by, "cell", "ring", "sample_id", "z", "radius")
    table = blocks.groupBy(*by, "cell", "ring").agg(
        F.count(F.lit(1)).alias("n"), F.min("radius").alias("lo"), F.max("radius").alias("hi")
    )
    listed = table.limit(MAX_LAYOUT + 1).toPandas()  # at most MAX_BLOCKS + N_PIVOTS rows per key
    if len(listed) > MAX_LAYOUT:
        raise ValueError(f"more than {MAX_LAYOUT} blocks over all keys; join fewer keys at once")
    by_key: dict = {}
    for _, row in listed.iterrows():
        by_key.setdefault(tuple(row[b] for b in by), []).append((row["cell"], row["ring"], row["n"], row["lo"], row["hi"]))
    packed = {key: np.array(sorted(v), dtype=np.float64) for key, v in by_key.items()}
    layout = spark.sparkContext.broadcast(packed)
    need = k + (1 if exclude_self else 0)

    def visited(z, blk):
        d = _distances(z, pivots.value)[:, blk[:, 0].astype(int)]
        # k-th distance is at most (distance to pivot + outer radius) over enough rows.
        reach = d + blk[:, 4]
        order = np.argsort(reach, axis=1, kind="stable")
        enough = np.cumsum(blk[:, 2][order], axis=1) >= need
        first = enough.argmax(1)
        bound = np.take_along_axis(np.take_along_axis(reach, order, 1), first[:, None], 1)[:, 0]
        bound = np.where(enough.any(1), bound, np.inf)
        slack = 1e-6 * (1.0 + np.where(np.isfinite(bound), bound, 0.0)) + 1e-7 * d.max(initial=0.0)
        floor = np.maximum(d - blk[:, 4], blk[:, 3] - d)
        return np.nonzero(floor <= (bound + slack)[:, None])

    def visits(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            groups = pdf.groupby(by, sort=False) if by else [((), pdf)]
            for key, part in groups:
                key = key if isinstance(key, tuple) else (key,)
                blk = layout.value.get(key)
                if blk is None:
                    continue
                step = max(1, BOUND_CELLS // len(blk))
                for start in range(0, len(part), step):
                    some = part.iloc[start : start + step]
                    rows, cols = visited(_matrix(some["z"]), blk)
                    for first in range(0, len(rows), PIECE_ROWS):
                        r, c = rows[first : first + PIECE_ROWS], cols[first : first + PIECE_ROWS]
                        yield some.iloc[r].assign(cell=blk[c, 0].astype(np.int32), ring=blk[c, 1].astype(np.int32))

    routed = queries.mapInPandas(visits, f"{head}sample_id {id_type}, z array<double>, cell int, ring int")
    # A block visited by many rows is met in chunks: the block is copied once per chunk.
    group = [*by, "cell", "ring"]
    load = routed.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK_ROWS)).cast("int").alias("chunks"))
    sides = load.join(
        table.select(*group, F.ceil(F.col("n") / F.lit(SLICE_ROWS)).cast("int").alias("slices")), group
    )
    left = (
        routed.join(sides, group)
        .withColumn("chunk", F.pmod(F.xxhash64("sample_id"), F.col("chunks")).cast("int"))
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select(*group, "chunk", "slice", "sample_id", "z")
    )
    right = (
        blocks.join(sides, group)
        .withColumn("slice", F.pmod(F.xxhash64("sample_id"), F.col("slices")).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(*group, "chunk", "slice", "sample_id", "z")
    )
    meet = [*group, "chunk", "slice"]
    out_schema = f"{head}sample_id {id_type}, neighbour_id {id_type}, distance double"

    cols = [*by, "sample_id", "neighbour_id", "distance"]

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in cols})
        pieces = _nearest(a["sample_id"].to_numpy(), _matrix(a["z"]), b["sample_id"].to_numpy(), _matrix(b["z"]), k, exclude_self)
        near = pd.DataFrame(pieces, columns=["sample_id", "neighbour_id", "distance"])
        return near.assign(**{c: a[c].iloc[0] for c in by})[cols]

    found = left.groupBy(*meet).cogroup(right.groupBy(*meet)).applyInPandas(best, out_schema)
    # At most k rows per visited block meet here.
    nearest = F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))), 1, k)
    return (
        found.groupBy(*by, "sample_id")
        .agg(nearest.alias("_n"))
        .select(*by, "sample_id", F.posexplode("_n").alias("_p", "n"))
        .select(*by, "sample_id", "n.neighbour_id", "n.distance", (F.col("_p") + 1).alias("rank"))
    )


def _nearest(ids_a, za, ids_b, zb, k: int, exclude_self: bool) -> dict:
    """Best k of one block per row, ordered by (distance, id).

    A matrix product of the centred vectors gives squared distances with a known
    error bound.  Every row within that bound of the k-th is kept, however
    many there are, and decided by its distance from differences.
    """
    step = max(1, 4_000_000 // max(1, len(zb)))
    out = {"sample_id": [], "neighbour_id": [], "distance": []}
    centre = zb.mean(0) if len(zb) else 0.0
    cb = zb - centre
    sq_b = np.einsum("ij,ij->i", cb, cb)
    for s in range(0, len(za), step):
        ca = za[s : s + step] - centre
        sq_a = np.einsum("ij,ij->i", ca, ca)
        d = sq_a[:, None] + sq_b[None, :] - 2.0 * (ca @ cb.T)
        error = 8.0 * (zb.shape[1] + 4) * np.finfo(float).eps * (sq_a + sq_b.max(initial=0.0))
        if exclude_self:
            d[ids_a[s : s + step, None] == ids_b[None, :]] = np.inf
        take = min(k, d.shape[1])
        kth = np.partition(d, take - 1, axis=1)[:, take - 1]
        i, j = np.nonzero((d <= (kth + 2.0 * error)[:, None]) & np.isfinite(d))
        exact = np.empty(len(i))
        for c in range(0, len(i), EXACT_ROWS):
            gap = za[s + i[c : c + EXACT_ROWS]] - zb[j[c : c + EXACT_ROWS]]
            exact[c : c + EXACT_ROWS] = np.sqrt((gap**2).sum(1))
        order = np.lexsort((ids_b[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        top = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
        out["sample_id"].append(ids_a[s + i[top]])
        out["neighbour_id"].append(ids_b[j[top]])
        out["distance"].append(exact[top])
    return {c: np.concatenate(v) if v else np.array([]) for c, v in out.items()}


def _broadcast_join(queries, reference, k, by, exclude_self, head, id_type) -> DataFrame:
    """Small reference (its size was checked): one matrix per key in every task."""
    table = reference.toPandas()
    groups = table.groupby(by, sort=False) if by else [((), table)]
    packed = {}
    for key, part in groups:
        packed[key if isinstance(key, tuple) else (key,)] = (part["sample_id"].to_numpy(), _matrix(part["z"]))
    shared = queries.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            for key, part in pdf.groupby(by, sort=False) if by else [((), pdf)]:
                key = key if isinstance(key, tuple) else (key,)
                ids, z = shared.value.get(key, (None, None))
                if ids is None:
                    continue
                near = pd.DataFrame(_nearest(part["sample_id"].to_numpy(), _matrix(part["z"]), ids, z, k, exclude_self))
                near["rank"] = near.groupby("sample_id", sort=False).cumcount() + 1
                for b, v in zip(by, key):
                    near[b] = v
                yield near[[*by, "sample_id", "neighbour_id", "distance", "rank"]]

    schema = f"{head}sample_id {id_type}, neighbour_id {id_type}, distance double, rank int"
    return queries.mapInPandas(run, schema)


def nearest_distance(queries: DataFrame, reference: DataFrame, by: Sequence[str] = (), exclude_self: bool = True) -> DataFrame:
    """``(by..., sample_id, distance)`` to the closest reference row."""
    return knn_join(queries, reference, 1, by, exclude_self).select(*by, "sample_id", "distance")
