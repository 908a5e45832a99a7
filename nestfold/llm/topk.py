"""Exact top-k inner products by an impact-ordered index, score at a time.

The rows are dealt into blocks, and every block becomes an index: for each dimension
the rows in descending order of their component, cut into posting segments of equal
quantised impact (the component without its last ``SHIFT`` bits).  A query reads a dimension
from the top where its own component is positive and from the bottom where it is negative, so
its first segments add most.  Over all dimensions the segments are taken in descending order of
what they can add, ``|q| * impact``.

After some segments a row's score is at most its accumulator (impacts are rounded up)
plus what the next segment of every dimension could still add; what is left below zero adds nothing.  The best rows so far are
scored exactly, and the k-th of these scores is a lower bound of the result.  Rows
whose bound is lower are out: that is the proof.  Segments are read until scoring the rows still possible
costs less than reading on, or no segment adds anything; every row still possible is scored exactly from its integers.  So the
quantisation and the order decide the work, never the result.

Cells of (block of rows, chunk of queries) run independently and return k rows a query;
a window merges them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import chars
from .common import discard, stored

# Rows of an index block, queries that meet it in one task; small tables get blocks of LEAST_ROWS at least.
BLOCK_ROWS, QUERY_ROWS, LEAST_ROWS = 1 << 14, 1 << 13, 1 << 10
SHIFT = 4
# Postings per row of the block between two proofs.
STEP = 3


class Index:
    """Posting segments of one block: ``values`` is its int64 matrix (row, dimension)."""

    def __init__(self, values: np.ndarray, shift: int = SHIFT):
        self.values = values
        rows, width = values.shape
        level = values >> shift
        order = np.argsort(-level, axis=0, kind="stable")
        self.docs = np.ascontiguousarray(order.T).reshape(-1)
        sorted_level = np.take_along_axis(level, order, axis=0).T.reshape(-1)
        dim = np.repeat(np.arange(width), rows)
        new = np.ones(len(dim), bool)
        new[1:] = (dim[1:] != dim[:-1]) | (sorted_level[1:] != sorted_level[:-1])
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.append(self.start, len(dim)))
        self.dim = dim[self.start]
        # largest component of a segment, and largest negated one
        self.up = ((sorted_level[self.start] + 1) << shift) - 1
        self.down = -(sorted_level[self.start] << shift)

    def search(self, query: np.ndarray, k: int, skip: int = -1, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
        """Rows that can be among the best ``k`` (all rows that tie with the k-th included) and their exact scores; row ``skip`` takes no part."""
        rows, width = self.values.shape
        q = query.astype(np.int64)
        gain = np.where(q[self.dim] > 0, q[self.dim] * self.up, -q[self.dim] * self.down).astype(np.float64)
        use = np.flatnonzero(gain > 0)
        use = use[np.argsort(-gain[use], kind="stable")]
        # what dimensions can still add behind each segment of the order: the next gain of the same dimension
        behind = np.zeros(len(use))
        rest = 0.0
        if len(use):
            by_dim = np.argsort(self.dim[use], kind="stable")
            dims, gains = self.dim[use][by_dim], gain[use][by_dim]
            follows = np.append(np.where(dims[1:] == dims[:-1], gains[1:], 0.0), 0.0)
            drop = np.zeros(len(use))
            drop[by_dim] = gains - follows
            first = np.append(True, dims[1:] != dims[:-1])
            rest = float(gains[first].sum())
            behind = rest - np.cumsum(drop)
        upper = np.zeros(rows)
        if skip >= 0:
            upper[skip] = -np.inf
        cuts = np.searchsorted(np.cumsum(self.size[use]), np.arange(1, width // step + 2) * step * rows)
        done, best = 0, np.zeros(0, np.int64)
        slack = 1e-9 * (rest + 1)  # beyond the rounding of the float sums
        possible = np.arange(rows) if skip < 0 else np.delete(np.arange(rows), skip)
        while done < len(use):
            end = min(len(use), max(done + 1, int(cuts[0]) if len(cuts) else len(use)))
            cuts = cuts[1:]
            part = use[done:end]
            docs = chars.ragged(self.docs, self.start[part], self.size[part])
            upper += np.bincount(docs, np.repeat(gain[part], self.size[part]), rows)
            done = end
            left = max(0.0, float(behind[end - 1])) + slack
            if rows - (skip >= 0) <= k:
                continue
            best = np.union1d(best, np.argpartition(-upper, k)[: k + 1])
            best = best[best != skip]
            known = self.values[best] @ q
            floor = np.sort(known)[-k] if len(known) >= k else -np.inf
            best = best[np.argsort(-known, kind="stable")[: 2 * k]]
            possible = np.flatnonzero(upper + left >= floor)
            if len(possible) * width <= step * rows:  # scoring them costs no more than reading on
                break
        score = self.values[possible] @ q
        if len(score) > k:
            enough = score >= np.partition(score, -k)[-k]
            possible, score = possible[enough], score[enough]
        return possible, score


def _meet(key: tuple, rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """Best ``k`` rows of one block for each query of one chunk."""
    width = key[0].as_py()
    matrix = lambda t: np.asarray(t.column("ints").combine_chunks().flatten(), np.int64).reshape(len(t), width)
    whole = lambda t, c: np.asarray(t.column(c).combine_chunks())
    out: dict[str, list] = {"row": [], "vec_id": [], "score": []}
    if len(rows) and len(queries):
        rows = rows.sort_by("row")
        at, ids, index = whole(rows, "row"), whole(rows, "vec_id"), Index(matrix(rows))
        for row, q in zip(whole(queries, "row").tolist(), matrix(queries), strict=True):
            own = int(np.searchsorted(at, row))
            found, score = index.search(q, k, own if own < len(at) and at[own] == row else -1)
            top = np.lexsort((ids[found], -score))[:k]
            out["row"].append(np.full(len(top), row))
            out["vec_id"].append(ids[found][top])
            out["score"].append(score[top])
    return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for c, v in out.items()})


def top_inner_products(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` best rows for each row whose ``vec_id`` is divisible by ``every``.

    Components are scaled and floored to integers; the score is their inner product, ties
    go to the smaller ``vec_id``.  Every row but the query's own is a candidate, also one
    with the same id or the same vector; a query id that occurs twice is answered twice.  Rows whose
    ``vec_id`` is null, or whose ``embedding`` is null, empty or holds a null or non-finite component,
    take no part.  Vectors meet vectors of their own length only.  Integers have
    to be small enough that a score is exact in a long; the job stops otherwise.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    fine = F.expr("size(embedding) > 0 and forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))")
    ints = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long"))
    rows = stored(vectors.where(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("ints")), "integers")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("ints")).alias("width"), F.max(F.array_max(F.transform("ints", F.abs))).alias("largest")).first()
    if facts["n"] and facts["width"] * facts["largest"] ** 2 >= 1 << 52:
        raise ValueError("components are too large for exact scores")
    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, -(-facts["n"] // block_rows), min(2 * cores, facts["n"] // LEAST_ROWS))
    # the place of a row in the written table tells rows apart and deals them out
    numbered = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("width", F.size("ints"))
    numbered = stored(numbered.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")), "numbered")
    discard(rows)
    asked = numbered.where(F.col("vec_id") % every == 0)
    chunks = max(1, -(-asked.count() // query_rows))
    chunk = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(chunks)).cast("int")
    indexed = numbered.select("width", "block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "row", "vec_id", "ints")
    queries = asked.select("width", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), chunk.alias("chunk"), "row", "ints")
    cell = ("width", "block", "chunk")
    found = indexed.groupBy(*cell).cogroup(queries.groupBy(*cell)).applyInArrow(partial(_meet, k=k), "row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(asked.select("row", F.col("vec_id").alias("query_id")), "row").select("query_id", "rank", "vec_id", "score")
