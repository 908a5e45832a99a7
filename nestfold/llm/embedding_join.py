"""Exact metric range join over embeddings.

Cosine ``c`` on unit vectors is the Euclidean range ``sqrt(2 - 2c)``.  Pivots, a
bounded sample of the vectors, give every vector its home cell (the nearest
pivot).  A vector is replicated into another cell only where the triangle
inequality lets that cell hold a partner: the distance to the border
hyperplane of the two pivots and the distance to the cell's covering ball are both
within the range.  Cells then join independently: every vector of a cell, native
or replica, is compared with the cell's natives, so each link is seen once from either side.

Equal vectors are one row with a weight before anything is compared.  Cells
above ``CELL_BLOCK`` rows are cut into blocks, the visitors of a cell into chunks by their counted
number, so a native is copied as often as its own cell is visited, whatever the table's size.  A task returns one
count per vector and one edge to its local component, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, stored

# Bound of the pivot sample, rows per cell aimed at, natives and visitors that meet in one task.
MAX_PIVOTS = 1024
CELL_ROWS = 8192
CELL_BLOCK = 8192
CHUNK_VISITS = 4 * CELL_BLOCK
# Distances are compared with this slack, the links themselves by exact cosines.
SLACK = 1e-6
# Half width of the band around the threshold that single precision cannot decide.
BAND = 1e-4
# Pivots nearer to one already taken are dropped: they cut nothing apart.
LEAST_GAP = 1e-6


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True, initial=0)  # squares neither overflow nor vanish
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def _place(batches: Iterator[pa.RecordBatch], pivots, width: int) -> Iterator[pa.RecordBatch]:
    """Home cell of every vector and its distance to the pivot."""
    centre = pivots.value
    for batch in batches:
        x = _unit(_matrix(batch.column("vector"), width))
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            d2 = np.maximum(2 - 2 * (part @ centre.T), 0)
            home = d2.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rep").slice(a, len(part)),
                    batch.column("vector").slice(a, len(part)),
                    batch.column("weight").slice(a, len(part)),
                    pa.array(home, pa.int32()),
                    pa.array(np.sqrt(d2[np.arange(len(part)), home])),
                ],
                names=["rep", "vector", "weight", "home", "dist"],
            )


def _apart(centre: np.ndarray) -> np.ndarray:
    """Distances of the pivots, from differences: products cancel where two are close."""
    return np.array([np.linalg.norm(centre - c, axis=1) for c in centre])


def _spaced(centre: np.ndarray, least: float) -> np.ndarray:
    """Pivots in their order without those within ``least`` of one taken before."""
    taken: list[int] = []
    for i, row in enumerate(_apart(centre)):
        if not len(taken) or row[taken].min() > least:
            taken.append(i)
    return centre[taken]


def _near(part: np.ndarray, home: np.ndarray, centre: np.ndarray, apart: np.ndarray, ball: np.ndarray, cut: np.ndarray, reach: float) -> np.ndarray:
    """Which cells can hold a partner of each vector (vectors x cells)."""
    rounding = 16 * (part.shape[1] + 4) * np.finfo(np.float64).eps  # of a difference of two squared distances
    d2 = np.maximum(2 - 2 * (part @ centre.T), 0)
    own = d2[np.arange(len(part)), home]
    near = (d2 - own[:, None] <= 2 * apart[home] * (reach + SLACK) + rounding) & (np.sqrt(d2) <= ball[None, :] + reach + SLACK) & (cut > 0)[None, :]
    near[np.arange(len(part)), home] = True
    return near


def _loads(batches: Iterator[pa.RecordBatch], pivots, radius, blocks, width: int, reach: float) -> Iterator[pa.RecordBatch]:
    """How many vectors of a task visit each cell."""
    centre, ball, cut = pivots.value, radius.value, blocks.value
    apart, load = _apart(centre), np.zeros(len(centre), np.int64)
    for batch in batches:
        x = _unit(_matrix(batch.column("vector"), width))
        home = np.asarray(batch.column("home"))
        for a in range(0, len(x), 2048):
            load += _near(x[a : a + 2048], home[a : a + 2048], centre, apart, ball, cut, reach).sum(axis=0)
    met = np.flatnonzero(load)
    yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(load[met])], names=["cell", "visits"])


def _visits(batches: Iterator[pa.RecordBatch], pivots, radius, blocks, width: int, reach: float) -> Iterator[pa.RecordBatch]:
    """One row for every block of natives that a vector has to meet."""
    centre, ball, cut = pivots.value, radius.value, blocks.value
    apart = _apart(centre)
    for batch in batches:
        x = _unit(_matrix(batch.column("vector"), width))
        home_all = np.asarray(batch.column("home"))
        for a in range(0, len(x), 2048):
            row, cell = np.nonzero(_near(x[a : a + 2048], home_all[a : a + 2048], centre, apart, ball, cut, reach))
            times = cut[cell]
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            take = pa.array(row + a)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cell, pa.int32()),
                    pa.array(nth, pa.int32()),
                    batch.column("rep").take(take),
                    batch.column("vector").take(take),
                    batch.column("weight").take(take),
                ],
                names=["cell", "block", "rep", "vector", "weight"],
            )


def _vectors(rows: pa.Table) -> np.ndarray:
    flat = np.asarray(rows.column("vector").combine_chunks().flatten(), np.float64)
    return _unit(flat.reshape(len(rows), -1))


def _meet(left: pa.Table, right: pa.Table, cosine: float) -> pa.Table:
    """Counts and local components of the queries ``left`` against the natives ``right``.

    Products in single precision sort out all pairs but those within ``BAND`` of
    the threshold; those are decided in double precision.
    """
    queries, ids = (np.asarray(t.column("rep").combine_chunks()) for t in (left, right))
    counts, root, label = np.zeros(len(left), np.int64), queries.copy(), ids.copy()
    if len(left) and len(right):
        weight = np.asarray(right.column("weight").combine_chunks())
        x, y = _vectors(left), _vectors(right)
        y32 = y.astype(np.float32).T.copy()
        linked: list[tuple[np.ndarray, np.ndarray]] = []
        for a in range(0, len(left), 1024):
            rough = x[a : a + 1024].astype(np.float32) @ y32
            some = np.flatnonzero((rough >= cosine - BAND).any(axis=1))
            if not len(some):
                continue
            rough = rough[some]
            hit = rough >= cosine + BAND
            i, j = np.nonzero((rough >= cosine - BAND) & ~hit)
            for c in range(0, len(i), 1 << 16):
                u, v = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                hit[u, v] = np.einsum("ij,ij->i", x[some[u] + a], y[v]) >= cosine
            hit &= queries[some + a, None] != ids[None, :]
            counts[some + a] = hit @ weight
            keep = hit.any(axis=1)
            linked.append((some[keep] + a, hit[keep]))
        # every query and native gets the smallest id of its local component
        far, changed = np.iinfo(np.int64).max, True
        while changed:
            changed = False
            for rows, hit in linked:
                if not len(rows):
                    continue
                best = np.minimum(root[rows], np.where(hit, label[None, :], far).min(axis=1))
                down = np.where(hit, best[:, None], far).min(axis=0)
                changed |= bool((best < root[rows]).any() or (down < label).any())
                root[rows] = best
                label = np.minimum(label, down)
    some, moved = counts > 0, label != ids
    return pa.table(
        {
            "rep": np.append(queries[some], ids[moved]),
            "n": np.append(counts[some], np.zeros(moved.sum(), np.int64)),
            "root": np.append(root[some], label[moved]),
        }
    )


def embedding_range_join(vectors: DataFrame, cosine: float = 0.9, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row.

    Links are pairs of rows with ``cosine`` or more in double precision.  A vector
    that is null, zero, empty or holds a null or non-finite component links with nothing
    and is its own component.  Rows with a null ``vec_id`` take no part and
    get nulls.  Vectors of different lengths never link.  Equal vectors count as so many
    links.  Other columns are ignored; an empty table gives an empty result.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    spark = vectors.sparkSession
    reach = float(np.sqrt(2 - 2 * cosine))
    kind = "array<float>" if dict(vectors.dtypes).get("embedding") == "array<float>" else "array<double>"
    rows = vectors.select("vec_id", F.col("embedding").cast(kind).alias("vector"))
    # -0.0 becomes 0.0 so that equal vectors group together
    rows = rows.withColumn("vector", F.transform("vector", lambda v: v + F.lit(0.0).cast(kind[6:-1])))
    fine = F.expr("forall(vector, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(vector, v -> v <> 0)")
    rows = rows.withColumn("usable", F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())
    distinct = rows.where("usable").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    distinct = stored(distinct, "vectors")

    counts = None
    for width, n in ((r["width"], r["n"]) for r in distinct.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n")).collect()):
        part = distinct.where(F.size("vector") == width)
        met = _join_width(part, width, n, cosine, reach, cell_rows)
        counts = met if counts is None else counts.union(met)
    if counts is None:
        counts = spark.createDataFrame([], "rep long, n long, root long")
    met = stored(counts, "links")
    partners = met.groupBy("rep").agg(F.sum("n").alias("n"))
    edges = met.where("root <> rep").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    joined = components(edges).select(F.col("node").alias("rep"), F.col("component").alias("component_id"))
    by_vector = (
        distinct.join(partners, "rep", "left")
        .join(joined, "rep", "left")
        .select("vector", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    usable = rows.where("usable").select("vec_id", "vector").join(by_vector, "vector").select("vec_id", "n_links", "component_id")
    rest = rows.where("not usable").select("vec_id", F.when(F.col("vec_id").isNotNull(), F.lit(0).cast("long")).alias("n_links"), F.col("vec_id").alias("component_id"))
    return usable.union(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _join_width(rows: DataFrame, width: int, n: int, cosine: float, reach: float, cell_rows: int) -> DataFrame:
    """Counts (``rep``, ``n``) and local roots of the vectors of one length."""
    sc, kind = rows.sparkSession.sparkContext, dict(rows.dtypes)["vector"]
    wanted = int(min(MAX_PIVOTS, max(1, n // cell_rows)))
    picked = rows.orderBy(F.xxhash64("rep"), "rep").limit(wanted).select("vector").collect()  # at most MAX_PIVOTS vectors
    centre = _spaced(np.unique(_unit(np.array([r["vector"] for r in picked], np.float64)), axis=0), LEAST_GAP)
    pivots = sc.broadcast(centre)
    placed = stored(rows.mapInArrow(partial(_place, pivots=pivots, width=width), f"rep long, vector {kind}, weight long, home int, dist double"), "placed")
    ball, cut = np.zeros(len(centre)), np.zeros(len(centre), np.int64)
    for r in placed.groupBy("home").agg(F.max("dist").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # one row per pivot
        ball[r["home"]], cut[r["home"]] = r["far"], -(-r["n"] // CELL_BLOCK)
    known = dict(pivots=pivots, radius=sc.broadcast(ball), blocks=sc.broadcast(cut), width=width, reach=reach)
    # every visitor of a cell meets each of its blocks, so the visits of a cell say how often its natives are needed
    load = placed.select("vector", "home").mapInArrow(partial(_loads, **known), "cell int, visits long").groupBy("cell").agg(F.sum("visits").alias("visits"))
    times = np.ones(len(centre), np.int64)
    for r in load.collect():  # one row per pivot
        times[r["cell"]] = -(-r["visits"] // CHUNK_VISITS)
    visits = placed.mapInArrow(partial(_visits, **known), f"cell int, block int, rep long, vector {kind}, weight long")

    def of_cell(values: np.ndarray, cell: str) -> Column:
        return F.element_at(F.array(*[F.lit(int(max(1, v))) for v in values]), F.col(cell) + 1).cast("long")

    # a block of natives is copied to each chunk of its visitors, so a task holds two bounded sets
    block_of = F.pmod(F.xxhash64("rep"), of_cell(cut, "home")).cast("int")
    chunks = F.sequence(F.lit(0), (of_cell(times, "home") - 1).cast("int"))
    natives = placed.select(F.col("home").alias("cell"), block_of.alias("block"), F.explode(chunks).alias("chunk"), "rep", "vector", "weight")
    chunk_of = F.pmod(F.xxhash64("rep", F.lit(1)), of_cell(times, "cell")).cast("int")
    queries = visits.withColumn("chunk", chunk_of).select("cell", "block", "chunk", "rep", "vector", "weight")
    return (
        queries.groupBy("cell", "block", "chunk")
        .cogroup(natives.groupBy("cell", "block", "chunk"))
        .applyInArrow(partial(_meet, cosine=cosine), "rep long, n long, root long")
    )
