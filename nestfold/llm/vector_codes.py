"""Product codes of vectors by exact integer k-means.

Components are scaled and floored to integers, vectors are cut into equal parts, and
every part has a codebook that a fixed number of rounds refines.  Distances are
whole numbers and have to be exact, so that ties go to the lowest entry on every machine.
A matrix product in float64 is exact only below 2**53: integers are split into
limbs small enough for that (``limb_dot``), the BLAS multiplies limbs, and the products are put together
in int64.  The squared distance's minimum is the first argmin of
``|c|**2 - 2 x.c``.

Each round is one pass over the written integer table.  A task folds its rows into one sum per
used entry, Spark adds these up, and only the codebooks (at most ``entries`` rows a part) come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, stored

ROWS = 4096  # rows of a part that meet the codebook at once


def limb_bits(width: int) -> int:
    """Largest limb size with ``width`` products of two limbs below 2**53."""
    return (53 - max(1, width).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Limbs of int64 values as float64, lowest first; only the last is signed.  ``x`` is their sum times powers of ``2**bits``."""
    out = []
    while True:
        if not len(x) or (x.min() >= -(1 << bits) and x.max() <= (1 << bits)):
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits


def limb_dot(x: np.ndarray, y: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Exact ``x @ y.T`` of int64 matrices whose result fits int64."""
    bits = limb_bits(x.shape[1]) if bits is None else bits
    total = np.zeros((len(x), len(y)), np.int64)
    right = limbs(y, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            if bits * (i + j) < 64:  # higher products are multiples of 2**64
                total += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return total


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the lowest among equals, and the squared distance."""
    index, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    norm = (book * book).sum(axis=1)
    for a in range(0, len(x), ROWS):
        part = x[a : a + ROWS]
        far = norm[None, :] - 2 * limb_dot(part, book)
        best = far.argmin(axis=1)
        index[a : a + ROWS] = best
        error[a : a + ROWS] = far[np.arange(len(part)), best] + (part * part).sum(axis=1)
    return index, error


def _parts(column: pa.Array, books: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    width = books[0].shape[1]
    rows = np.asarray(column.flatten(), np.int64).reshape(len(column), len(books) * width)
    for p, book in enumerate(books):
        yield p, rows[:, p * width : (p + 1) * width], book


def _sums(batches: Iterator[pa.RecordBatch], books) -> Iterator[pa.RecordBatch]:
    """Count and component sums of every used entry, once per task."""
    held = books.value
    count = [np.zeros(len(b), np.int64) for b in held]
    total = [np.zeros_like(b) for b in held]
    for batch in batches:
        for p, x, book in _parts(batch.column("parts"), held):
            index, _ = nearest(x, book)
            count[p] += np.bincount(index, minlength=len(book))
            order = np.argsort(index, kind="stable")
            some, first = np.unique(index[order], return_index=True)
            if len(some):
                total[p][some] += np.add.reduceat(x[order], first, axis=0)
    for p, (n, t) in enumerate(zip(count, total, strict=True)):
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(n[used]), pa.array(t[used].tolist(), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"],
        )


def _codes(batches: Iterator[pa.RecordBatch], books, digits: int) -> Iterator[pa.RecordBatch]:
    held = books.value
    text = np.array([f"{i:0{digits}x}" for i in range(max(map(len, held)))], object)
    for batch in batches:
        code, error = np.full(len(batch), "", object), np.zeros(len(batch), np.int64)
        for _, x, book in _parts(batch.column("parts"), held):
            index, far = nearest(x, book)
            code = code + text[index]
            error += far
        columns = [batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error)]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])


def codebooks(rows: DataFrame, seeds: list[list[int]], n_parts: int, rounds: int) -> list[np.ndarray]:
    """Refined codebooks, one int64 matrix per part; entries that no row takes stay."""
    start = np.array(seeds, np.int64)
    books = [np.ascontiguousarray(b) for b in np.split(start, n_parts, axis=1)]
    width = books[0].shape[1]
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(books)
        sums = rows.select("parts").mapInArrow(partial(_sums, books=shared), "part int, entry int, n long, sums array<long>")
        sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
        new = [b.copy() for b in books]
        for r in sums.toLocalIterator():  # at most one row per entry
            new[r["part"]][r["entry"]] = [s // r["n"] for s in r["sums"]]
        shared.destroy()
        books = new
    return books


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components, comma-joined, by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, scale: int = 1024, n_parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every usable row.

    Rows whose ``embedding`` is null, empty or holds a null or non-finite component are dropped.
    The codebooks start from the smallest ids (null ids last, repeated ids by their vectors).  All vectors need the length of the
    first one, and that length has to be a multiple of ``n_parts``; integers have to be small enough that
    a squared distance fits a long.  Both are checked, and the job stops otherwise.
    Labels may be null (nulls share one total); other columns are ignored; an empty
    table gives an empty result.
    """
    spark = vectors.sparkSession
    fine = F.expr("size(embedding) > 0 and forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))")
    rows = vectors.where(fine).select("vec_id", "label", F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("parts"))
    rows = stored(rows, "integers")
    facts = rows.agg(F.min(F.size("parts")).alias("low"), F.max(F.size("parts")).alias("high"), F.max(F.array_max(F.transform("parts", F.abs))).alias("largest")).first()
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if facts["low"] is None:
        return spark.createDataFrame([], schema)
    if facts["low"] != facts["high"] or facts["low"] % n_parts:
        raise ValueError(f"vectors need one length, a multiple of {n_parts}; found {facts['low']} to {facts['high']}")
    if facts["low"] * (2 * facts["largest"]) ** 2 >= 1 << 62:
        raise ValueError("components are too large for exact distances in a long")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).select("parts").collect()  # at most ``entries`` rows
    books = codebooks(rows, [r["parts"] for r in first], n_parts, rounds)
    digits = max(2, len(f"{entries - 1:x}"))
    kind = dict(rows.dtypes)
    coded = stored(
        rows.mapInArrow(partial(_codes, books=spark.sparkContext.broadcast(books), digits=digits), f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long"),
        "codes",
    )
    discard(rows)
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
