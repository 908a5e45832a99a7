"""Outer and inner folds of packed rows: the deal of ``folds`` on arrays instead of a row per coordinate.

Rows stay in blocks.  Per coordinate a block sends only digests, cut into buckets by their first bits;
a bucket is ranked by one task, and a row's fold is its rank there after the counted rows of the
buckets before.  What comes back per row and coordinate is one small number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .folds import INNER_SEED_BASE, INNER_SPLITS, OUTER_REPEATS, OUTER_SEED, OUTER_SPLITS

PLACE_ROWS = 200_000  # rows that one task assembles, about
BUCKET_ROWS = 100_000  # rows of a coordinate that are ranked together, about
TASK_ROWS = 4_000_000  # digests that one task ranks, about
BLOCK_ROWS = 10_000
SENT = [("place", pa.int32()), ("bid", pa.int64()), ("coord", pa.int32()), ("bucket", pa.int32()), ("idx", pa.binary()), ("digest", pa.binary()), ("y", pa.binary())]
RANKED = [*SENT[:5], ("y", pa.binary()), ("value", pa.binary()), ("label", pa.float64()), ("n", pa.int64())]
FOLDED = [("sample_id", pa.list_(pa.string())), ("y", pa.binary()), ("x", pa.binary()), ("fold_of", pa.binary()), ("inner_of", pa.binary()), ("n", pa.int32())]
KINDS = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary", pa.float64(): "double", pa.list_(pa.string()): "array<string>"}


def _schema(fields: list) -> str:
    return ", ".join(f"{n} {KINDS[t]}" for n, t in fields)


def _table(rows: list, fields: list) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], type=t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _digests(prefix: str, ids: list) -> np.ndarray:
    """First 96 bits of SHA-256 of ``prefix|id``; a missing id is left out of the text, as by ``key_hash``."""
    head, sha = f"{prefix}|".encode(), hashlib.sha256
    words = [sha(prefix.encode() if i is None else head + i.encode()).digest()[:12] for i in ids]
    return np.frombuffer(b"".join(words), dtype=np.uint8).reshape(-1, 12)


def _send(place: int, bid: int, coord: int, prefix: str, rows: np.ndarray, ids: list, y: np.ndarray, buckets: int):
    """Rows of ``SENT``: the digests of one block and coordinate by bucket; rows without a label are not dealt."""
    rows = rows[~np.isnan(y[rows])]
    if not len(rows):
        return
    digest = _digests(prefix, [ids[i] for i in rows])
    bucket = (digest[:, 0].astype(np.int64) * 256 + digest[:, 1]) * buckets >> 16
    order = np.argsort(bucket, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(bucket[order])) + 1, len(order))
    for a, b in zip(np.append(0, ends[:-1]), ends):
        at = order[a:b]
        yield place, bid, coord, int(bucket[at[0]]), rows[at].astype(np.int32).tobytes(), digest[at].tobytes(), y[rows[at]].tobytes()


def _order(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending order of 96-bit digests, and which are equal to the one before."""
    head = np.ascontiguousarray(digest[:, :8]).view(">u8").ravel().astype(np.uint64)
    order = np.argsort(head, kind="stable")
    if (head[order][1:] == head[order][:-1]).any():
        order = np.lexsort((np.ascontiguousarray(digest[:, 8:]).view(">u4").ravel(), head))
    return order, np.append(False, (digest[order][1:] == digest[order][:-1]).all(1))


def _ranked(sent: DataFrame, splits: int, tasks: int, unique: bool) -> DataFrame:
    """Rank of every sent row inside its bucket and class, modulo ``splits``, and one row of counts per bucket and class."""
    missing = {c: _digests(f"{OUTER_SEED}|{c}", [None])[0] for c in range(OUTER_REPEATS)}

    def run(batches):
        groups: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                groups.setdefault((r["coord"], r["bucket"]), []).append(r)
        for coord, bucket in list(groups):
            parts = groups.pop((coord, bucket))
            if coord < 0:  # folds that are known already
                out = [(r["place"], r["bid"], coord, bucket, None, None, r["digest"], None, None) for r in parts]
            else:
                y = np.concatenate([np.frombuffer(r["y"]) for r in parts])
                digest = np.concatenate([np.frombuffer(r["digest"], dtype=np.uint8).reshape(-1, 12) for r in parts])
                order, again = _order(digest)
                if unique and again.any() and (digest[order][again] != missing[coord]).any():
                    raise ValueError("a sample_id occurs more than once")
                value, counts = np.empty(len(y), dtype=np.int8), []
                for label in np.unique(y):
                    own = order[y[order] == label]
                    value[own] = np.arange(len(own)) % splits
                    counts.append((None, None, coord, bucket, None, None, None, float(label), len(own)))
                ends = np.cumsum([0, *[len(r["idx"]) // 4 for r in parts]])
                out = [
                    (r["place"], r["bid"], coord, bucket, r["idx"], r["y"], value[a:b].tobytes(), None, None) for r, a, b in zip(parts, ends[:-1], ends[1:])
                ] + counts
            yield from _table(out, RANKED).to_batches()

    return cut_lineage(sent.repartition(tasks, "coord", "bucket").mapInArrow(run, _schema(RANKED)))


def _starts(ranked: DataFrame) -> dict:
    """Rows dealt before a bucket's class: those of the classes before it and of the buckets before in its own."""
    counts: dict = {}
    for r in ranked.filter("label is not null").select("coord", "bucket", "label", "n").collect():  # coordinates x buckets x classes rows
        counts.setdefault(r["coord"], []).append((r["label"], r["bucket"], r["n"]))
    starts = {}
    for coord, found in counts.items():
        before = 0
        for label, bucket, n in sorted(found):
            starts[(coord, bucket, label)] = before
            before += n
    return starts


def _fill(folds: np.ndarray, part: dict, starts: dict, splits: int) -> None:
    """Write the folds of one returned part into its block's matrix (rows x coordinates)."""
    y = np.frombuffer(part["y"])
    labels, at = np.unique(y, return_inverse=True)
    offset = np.array([starts[(part["coord"], part["bucket"], float(v))] % splits for v in labels])[at]
    folds[np.frombuffer(part["idx"], dtype=np.int32), part["coord"]] = (np.frombuffer(part["value"], dtype=np.int8) + offset) % splits


def _by_block(table: pa.Table) -> dict:
    found: dict = {}
    for r in table.to_pylist():
        found.setdefault(r["bid"], []).append(r)
    return found


def with_folds(blocks: DataFrame, tasks: int) -> DataFrame:
    """Packed rows of ``FOLDED`` from written blocks ``(bid, sample_id, y, x, n)``, in ``tasks`` partitions or more.

    Folds are those of ``repeated_kfold`` and ``inner_folds``.  Rows without an id are dealt with the others and then
    left out; an id that occurs twice is an error.
    """
    spark = blocks.sparkSession
    sizes = sorted((r["bid"], r["n"]) for r in blocks.select("bid", "n").collect())  # one row per block
    total = sum(n for _, n in sizes)
    places = max(tasks, -(-total // PLACE_ROWS))
    buckets = max(1, min(4096, 1 << (total // BUCKET_ROWS).bit_length()))
    upto = np.cumsum([0, *[n for _, n in sizes]])
    # numbers that Spark deals to different partitions, one for each
    wanted = spark.range(64 * places).select("id", F.expr(f"pmod(hash(cast(id as int)), {places})").alias("p")).groupBy("p").agg(F.min("id").alias("id"))
    numbers = [r["id"] for r in wanted.orderBy("p").collect()]
    of = [(bid, int(numbers[int(at * len(numbers) // max(total, 1))])) for (bid, _), at in zip(sizes, upto)]
    placed = blocks.join(F.broadcast(spark.createDataFrame(of, "bid bigint, place int")), "bid")
    small = placed.select("place", "bid", "sample_id", "y")

    def outer(batches):
        for batch in batches:
            for r in batch.to_pylist():
                y = np.frombuffer(r["y"])
                rows = [p for c in range(OUTER_REPEATS) for p in _send(r["place"], r["bid"], c, f"{OUTER_SEED}|{c}", np.arange(len(y)), r["sample_id"], y, buckets)]
                yield from _table(rows, SENT).to_batches()

    def rank_tasks(rows: int) -> int:
        return max(tasks, -(-rows // TASK_ROWS))

    dealt = _ranked(small.mapInArrow(outer, _schema(SENT)), OUTER_SPLITS, rank_tasks(total * OUTER_REPEATS), True)
    outer_starts = spark.sparkContext.broadcast(_starts(dealt))

    def inner(left: pa.Table, right: pa.Table) -> pa.Table:
        parts, rows = _by_block(right), []
        for r in left.to_pylist():
            y = np.frombuffer(r["y"])
            folds = np.full((len(y), OUTER_REPEATS), -1, dtype=np.int8)
            for part in parts.get(r["bid"], []):
                _fill(folds, part, outer_starts.value, OUTER_SPLITS)
            rows.append((r["place"], r["bid"], -1, int(r["bid"] % 4096), None, folds.tobytes(), None))
            for c in range(OUTER_REPEATS * OUTER_SPLITS):
                repeat, fold = divmod(c, OUTER_SPLITS)
                train = np.flatnonzero((folds[:, repeat] != fold) & (folds[:, repeat] >= 0))
                rows += _send(r["place"], r["bid"], c, str(INNER_SEED_BASE + repeat * 100 + fold), train, r["sample_id"], y, buckets)
        return _table(rows, SENT)

    def grouped(df: DataFrame):
        return df.repartition(places, "place").groupBy("place")

    returned = dealt.filter("place is not null").drop("label", "n")
    sent = grouped(small).cogroup(grouped(returned)).applyInArrow(inner, _schema(SENT))
    dealt = _ranked(sent, INNER_SPLITS, rank_tasks(total * OUTER_REPEATS * (OUTER_SPLITS - 1)), False)
    inner_starts = spark.sparkContext.broadcast(_starts(dealt))

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        parts, done = _by_block(right), []
        for i in range(left.num_rows):
            y = np.frombuffer(left.column("y")[i].as_py())
            x = np.frombuffer(left.column("x")[i].as_py()).reshape(len(y), -1)
            ids = left.column("sample_id")[i].values
            fold_of, inner_of = None, np.full((len(y), OUTER_REPEATS * OUTER_SPLITS), -1, dtype=np.int8)
            for part in parts.get(left.column("bid")[i].as_py(), []):
                if part["coord"] < 0:
                    fold_of = np.frombuffer(part["value"], dtype=np.int8).reshape(len(y), OUTER_REPEATS)
                else:
                    _fill(inner_of, part, inner_starts.value, INNER_SPLITS)
            keep = (fold_of[:, 0] >= 0) & ids.is_valid().to_numpy(zero_copy_only=False)
            done.append((ids.filter(pa.array(keep)), y[keep], x[keep], fold_of[keep], inner_of[keep]))
        rows = []
        if done:
            ids = pa.concat_arrays([d[0] for d in done])
            arrays = [np.concatenate([d[i] for d in done]) for i in range(1, 5)]
            for a in range(0, len(ids), BLOCK_ROWS):
                part = [v[a : a + BLOCK_ROWS] for v in arrays]
                rows.append((ids[a : a + BLOCK_ROWS].to_pylist(), *[np.ascontiguousarray(v).tobytes() for v in part], len(part[0])))
        return _table(rows, FOLDED)

    returned = dealt.filter("place is not null").drop("label", "n")
    return cut_lineage(grouped(placed).cogroup(grouped(returned)).applyInArrow(assemble, _schema(FOLDED)))
