"""Exact Jaccard self-join on word shingles with token-combination prefixes.

1. One pass counts shingles in ``2**BUCKET_BITS`` hash buckets over all rows and gives
   every document the size and the hash of its set.  Rows with one set form a class;
   only classes are compared.
2. Tokens are ordered by the level of their bucket (0: a count that chance explains,
   then by powers of two), then by hash.  Two sets of similarity ``t`` share a token of their
   prefixes (``p = n - ceil(t n) + 1`` tokens).  If the shared ones are rare (level 0), one
   is indexed as a single token.  Otherwise both sets hold fewer rare tokens than a prefix and share
   none of them; then their prefixes, longer by ``g``, share ``g + 1`` frequent
   tokens, of which two fall into one of ``g`` token classes: all 2-token combinations within a class
   are indexed.  ``g`` follows the size level, so the combinations of a set grow
   linearly with its prefix.
3. Single tokens of prefixes extended to ``2 p`` are counted as well: similar sets share
   more than half of them, so a set with too few tokens that any other set has drops out
   (this removes texts that only share a passage).  Each remaining key links its sets to the
   smallest one (a star), which keeps the candidate graph linear; a set forgets the links
   that few keys support, less than half of what similar sets share, so that any two still
   keep a key in common.  The graph's connected
   components are clusters: no similar pair crosses two of them.
4. Each cluster is verified exactly: small ones many to a task, large ones in
   blocks against blocks.  A task emits the links of each set to one neighbour of its
   local component, never all pairs.

Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import chars
from .common import bitmap, components, stored

BUCKET_BITS = 18
SLICE = 4096
LEVEL_SHIFT = np.uint64(58)
CLASS_TOKENS = 5
SALTS = 16
# Bits of an index row: its salt (0: single token), whether it belongs to the prefix proper, then the count it needs.
SALT_MASK, HEAD = 31, 32
BITMAP_BITS = 24
BLOCK_SETS = 512
BLOCK_TOKENS = 1_000_000
SMALL_CLUSTER = 16

_PART = "doc_id long, n_shingles int, sid long, slice int, counts binary"


def ascii_words(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words between ASCII white space."""
    space = (cps == 32) | ((cps >= 9) & (cps <= 13))
    return chars.spans(np.where(space, chars.SPACE, chars.OTHER).astype(np.uint8), offsets, chars.SPACE)


def shingle_sets(texts: list[str], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z are lower-cased."""
    for a, b in chars.slabs(texts):
        cps, offsets = chars.codepoints(texts[a:b])
        cps = np.where((cps >= 65) & (cps <= 90), cps + np.uint32(32), cps)
        starts, ends = ascii_words(cps, offsets)
        words = chars.hash_spans(cps, starts, ends)
        at = np.searchsorted(starts, offsets)
        for x, y in zip(at[:-1], at[1:], strict=True):
            yield np.unique(chars.shingle_hashes(words[x:y], k))


def set_id(tokens: np.ndarray) -> int:
    total = np.array([int(tokens.sum(dtype=np.uint64)) ^ len(tokens)], np.uint64)
    return int(chars.mix(total).view(np.int64)[0])


def needed(n: int, num: int, den: int) -> int:
    """Smallest overlap with any set of similarity ``num / den`` or more."""
    return -(-num * n // den)


def size_level(n: int, num: int, den: int) -> int:
    """Sizes of similar sets lie on the same or on neighbouring levels."""
    return int(np.log(n) / np.log(1.0001 * den / num))


def class_count(level: int, num: int, den: int) -> int:
    """Token classes of pairs whose larger set is on ``level``; 0: too small, frequent tokens stay single."""
    base = 1.0001 * den / num
    least = max(1, int(np.ceil(base ** (level - 1))))
    g = max(1, int(np.ceil((1 - num / den) * base**level / CLASS_TOKENS)))
    return g if needed(least, num, den) >= g + 1 else 0


def shared_in_prefix(n: int, num: int, den: int) -> int:
    """Tokens that the extended prefixes of two similar sets share, if the smaller has ``n`` tokens."""
    p = n - needed(n, num, den) + 1
    return min(n, 2 * p) - p + 1


def index_keys(tokens: np.ndarray, levels: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Single keys of the prefix, single keys of its extension, combination keys, and the single keys that others must have."""
    n = len(tokens)
    level = levels[tokens >> np.uint64(64 - BUCKET_BITS)].astype(np.uint64)
    order = (level << LEVEL_SHIFT) | (tokens >> np.uint64(64 - int(LEVEL_SHIFT)))
    p = n - needed(n, num, den) + 1
    long = min(n, 2 * p)
    rare = int((level == 0).sum())
    need = shared_in_prefix(needed(n, num, den), num, den) - max(0, long - rare)
    if rare >= p:
        first = np.partition(order, sorted({p - 1, long - 1}))[:long]
        return first[:p], first[p : min(long, rare)] if rare >= long else np.sort(first)[p:rare], order[:0], need
    order.sort()
    combos: list[np.ndarray] = []
    at = size_level(n, num, den)
    for tag in (at, at + 1):
        g = class_count(tag, num, den)
        if not g:
            combos.append(order[rare:p])
            continue
        frequent = order[rare : p + g]
        group = (chars.mix(frequent) % np.uint64(g)).astype(np.int64)
        by = np.argsort(group, kind="stable")
        frequent, group = frequent[by], group[by]
        salt = np.uint64((tag + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        for lag in range(1, len(frequent)):
            same = group[lag:] == group[:-lag]
            if not same.any():
                break
            combos.append(chars.mix(chars.mix(frequent[:-lag][same] ^ salt) + frequent[lag:][same]))
    return order[:rare], order[:0], np.unique(np.concatenate(combos)) if combos else order[:0], need


# ---------------------------------------------------------------- passes over the texts


def _profile(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    names = ["doc_id", "n_shingles", "sid", "slice", "counts"]

    def count(held: list[np.ndarray]) -> None:
        if held:
            np.add(counts, np.bincount((np.concatenate(held) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts)), out=counts)

    for batch in batches:
        texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
        sizes, sids, held, size = [], [], [], 0
        for s in shingle_sets(texts, k):
            sizes.append(len(s))
            sids.append(set_id(s))
            held.append(s)
            size += len(s)
            if size > 1 << 21:
                count(held)
                held, size = [], 0
        count(held)
        none = pa.nulls(len(texts), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(sids, pa.int64()), none, pa.nulls(len(texts), pa.binary())], names=names)
    for s in range(len(counts) // SLICE):
        part = counts[s * SLICE : (s + 1) * SLICE]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([s], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=names)


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            v = np.frombuffer(c, np.int64)
            total[s] = total[s] + v if s in total else v
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["slice", "counts"])


def bucket_levels(profile: DataFrame) -> np.ndarray:
    """Level of every bucket; the counts that reach the driver have a fixed size (``2**BUCKET_BITS`` numbers)."""
    sums = profile.where("slice is not null").select("slice", "counts").repartition(16, "slice").mapInArrow(_sum_slices, "slice int, counts binary")
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in sums.toLocalIterator():
        counts[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] += np.frombuffer(r["counts"], np.int64)
    usual = float(np.median(counts))
    above = counts - usual
    return np.where(above > 6 * np.sqrt(usual) + 8, 1 + np.floor(np.log2(np.maximum(above, 1))), 0).astype(np.uint8)


def _entries(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, levels) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    table = levels.value

    def out(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([r[0] for r in rows]).view(np.int64)),
                pa.array(np.concatenate([r[1] for r in rows])),
                pa.array(np.repeat(np.array([r[2] for r in rows], np.int64), [len(r[0]) for r in rows])),
            ],
            names=["key", "meta", "sid"],
        )

    for batch in batches:
        rows, size = [], 0
        texts = [t for t, d in zip(batch.column("text").to_pylist(), batch.column("doc_id").to_pylist(), strict=True) if t and d is not None]
        for s in shingle_sets(texts, k):
            if len(s) < 2 or (sid := set_id(s)) in seen:  # a set of one token is only similar to itself
                continue
            seen.add(sid)
            first, more, combined, need = index_keys(s, table, num, den)
            meta = np.full(len(first) + len(more) + len(combined), max(0, need) << 6, np.int32)
            meta[: len(first)] |= HEAD
            meta[len(first) + len(more) :] |= HEAD | (1 + (sid & (SALTS - 1)))
            rows.append((np.concatenate([first, more, combined]), meta, sid))
            size += len(meta)
            if size > 1 << 18:
                yield out(rows)
                rows, size = [], 0
        if rows:
            yield out(rows)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by key and set, whose key another set has too; repeats go, salted rows all pass."""
    held = None
    for batch in batches:
        key, meta, sid = (np.asarray(batch.column(c)) for c in range(3))
        seen_before = False
        if held is not None:
            key, meta, sid = np.append(held[0], key), np.append(held[1], meta), np.append(held[2], sid)
            seen_before = held[3]
        new = np.append(True, (key[1:] != key[:-1]) | (sid[1:] != sid[:-1]))
        key, meta, sid = key[new], meta[new], sid[new]
        same = key[1:] == key[:-1]
        keep = (meta & SALT_MASK) > 0
        keep[1:] |= same
        keep[:-1] |= same
        keep[:1] |= seen_before
        # the last row waits for the next batch, together with the news that its key is shared already
        last = len(key) - 1
        if last < 0:
            continue
        held = (key[last:], meta[last:], sid[last:], bool(keep[last]))
        yield pa.RecordBatch.from_arrays([pa.array(x[:last][keep[:last]]) for x in (key, meta, sid)], names=["key", "meta", "sid"])
    if held is not None and held[3]:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[:3]], names=["key", "meta", "sid"])


def _candidate_sets(batches: Iterator[pa.RecordBatch], k: int, marked) -> Iterator[pa.RecordBatch]:
    bits = marked.value
    for batch in batches:
        texts = batch.column("text").to_pylist()
        docs = batch.column("doc_id").to_pylist()
        use = [i for i, (t, d) in enumerate(zip(texts, docs, strict=True)) if t and d is not None and bits[(d & ((1 << BITMAP_BITS) - 1)) >> 3] >> (d & 7) & 1]
        for a, b in chars.slabs([texts[i] for i in use], 1 << 21):
            part = use[a:b]
            sets = list(shingle_sets([texts[i] for i in part], k))
            yield pa.RecordBatch.from_arrays(
                [pa.array([docs[i] for i in part], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["doc_id", "sid", "tokens"],
            )


# ---------------------------------------------------------------- verification


def _local_roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id reachable within a symmetric boolean matrix."""
    label = ids.copy()
    far = np.iinfo(np.int64).max
    while True:
        near = np.where(linked, label[None, :], far).min(axis=1)
        new = np.minimum(label, near)
        if (new == label).all():
            return label
        label = new


def _similar(common: np.ndarray, total: np.ndarray, num: int, den: int) -> np.ndarray:
    return common * (num + den) >= num * total


def _dense(tokens: list[np.ndarray], ids: np.ndarray, num: int, den: int, left: np.ndarray | None) -> list[tuple[int, int]]:
    """Links of one cluster by products of 0/1 columns; ``left`` marks the rows of the first of two blocks."""
    m = len(tokens)
    owner = np.repeat(np.arange(m), [len(t) for t in tokens])
    _, at, counts = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    shared = counts >= 2
    column = (np.cumsum(shared) - 1)[at]
    keep = shared[at]
    owner, column = owner[keep], column[keep]
    common = np.zeros((m, m), np.int64)
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    width = 4096
    for c in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (c, c + width))
        grid = np.zeros((m, width), np.float32)
        grid[owner[a:b], column[a:b] - c] = 1
        common += (grid @ grid.T).astype(np.int64)
    sizes = np.array([len(t) for t in tokens], np.int64)
    linked = _similar(common, sizes[:, None] + sizes[None, :], num, den)
    np.fill_diagonal(linked, False)
    if left is not None:
        linked &= left[:, None] != left[None, :]
    root = _local_roots(linked, ids)
    return [(int(a), int(b)) for a, b in zip(ids, root, strict=True) if a != b]


def _sparse(clusters: np.ndarray, tokens: list[np.ndarray], ids: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links of many clusters of few sets by counting common tokens pair by pair."""
    m = len(tokens)
    sizes = np.array([len(t) for t in tokens], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    word = np.concatenate(tokens) ^ chars.mix(clusters.astype(np.int64).view(np.uint64))[owner]
    by = np.argsort(word, kind="stable")
    word, owner = word[by], owner[by]
    pairs = []
    for lag in range(1, m):
        same = word[lag:] == word[:-lag]
        if not same.any():
            break
        a, b = owner[:-lag][same], owner[lag:][same]
        keep = clusters[a] == clusters[b]
        pairs.append(a[keep] * m + b[keep])
    if not pairs:
        return []
    pair, common = np.unique(np.concatenate(pairs), return_counts=True)
    a, b = pair // m, pair % m
    ok = _similar(common, sizes[a] + sizes[b], num, den)
    return list(zip(ids[a[ok]].tolist(), ids[b[ok]].tolist(), strict=True))


def _verify(group: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    links: list[tuple[int, int]] = []
    group = group.drop_duplicates(["cluster", "sid"])
    tokens = [np.frombuffer(t, np.uint64) for t in group["tokens"]]
    ids, clusters = group["rep"].to_numpy(np.int64), group["cluster"].to_numpy(np.int64)
    i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
    if i != j:
        links = _dense(tokens, ids, num, den, (group["block"] == i).to_numpy())
    else:
        _, at, counts = np.unique(clusters, return_inverse=True, return_counts=True)
        few = np.flatnonzero(counts[at] <= SMALL_CLUSTER)
        if len(few):
            links += _sparse(clusters[few], [tokens[x] for x in few], ids[few], num, den)
        for c in np.flatnonzero(counts > SMALL_CLUSTER):
            rows = np.flatnonzero(at == c)
            links += _dense([tokens[x] for x in rows], ids[rows], num, den, None)
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


# ---------------------------------------------------------------- operator


def ngram_jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for every row.

    Two rows link when ``den * common >= num * union`` of their shingle sets; ``component_id``
    is the smallest ``doc_id`` reachable.  Null, empty and blank texts have an
    empty set and link with nothing, so they keep their own id.  A row with a null
    ``doc_id`` gets a null component and takes no part.  Repeated rows are one class.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    profile = stored(docs.mapInArrow(partial(_profile, k=k), _PART), "profile")
    rows = profile.where("slice is null").select("doc_id", "n_shingles", "sid")
    levels = spark.sparkContext.broadcast(bucket_levels(profile))

    entries = docs.mapInArrow(partial(_entries, k=k, num=num, den=den, levels=levels), "key long, meta int, sid long").withColumn("salt", F.expr(f"meta & {SALT_MASK}"))
    shared = entries.repartition("key", "salt").sortWithinPartitions("key", "sid").select("key", "meta", "sid").mapInArrow(_shared, "key long, meta int, sid long")
    shared = stored(shared, "shared")
    single = F.expr(f"meta & {SALT_MASK} = 0")
    alive = shared.groupBy("sid").agg(F.count_if(single).alias("have"), F.max(F.shiftright("meta", 6)).alias("need")).where("have >= need")
    keys = stored(shared.select("key", "sid", single.alias("single")).join(alive.select("sid", "need"), "sid"), "keys")
    leaders = keys.groupBy("key").agg(F.min("sid").alias("b"), F.max("sid").alias("top")).where("b <> top").select("key", "b")
    stars = keys.join(leaders, "key").where("sid <> b").select(F.col("sid").alias("a"), "b", "single", "need")
    # similar sets share ``need`` single keys, so each may forget less than half as many: the keys whose smallest set it meets least
    pairs = stars.groupBy("a", "b").agg(F.count_if("single").alias("singles"), F.count_if(~F.col("single")).alias("combined"), F.max("need").alias("need"))
    order = Window.partitionBy("a").orderBy("singles", "b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pairs = pairs.withColumn("forgotten", F.sum("singles").over(order))
    candidates = pairs.where("combined > 0 or forgotten > (need - 1) div 2").select("a", "b")
    clusters = components(candidates).select(F.col("node").alias("sid"), F.col("component").alias("cluster"))

    classes = rows.where("doc_id is not null and n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    members = stored(clusters.join(classes, "sid"), "members")
    marked = spark.sparkContext.broadcast(bitmap(members, f"pmod(rep, {1 << BITMAP_BITS})", BITMAP_BITS))
    sets = docs.mapInArrow(partial(_candidate_sets, k=k, marked=marked), "doc_id long, sid long, tokens binary")

    sized = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("tokens"))
    sized = sized.withColumn("blocks", F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int"))
    total = sized.where("blocks = 1").agg(F.sum("tokens")).first()[0] or 0
    bins = max(1, -(-total // BLOCK_TOKENS) * 2)
    sized_members = members.join(sized.select("cluster", "blocks"), "cluster").withColumnRenamed("rep", "doc_id")
    placed = (
        sets.join(sized_members, ["doc_id", "sid"])
        .withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks").cast("long")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.col("cluster")).alias("part"),
            (F.col("blocks") > 1).alias("large"),
            F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"),
            "block",
            "cluster",
            "sid",
            F.col("doc_id").alias("rep"),
            "tokens",
        )
    )
    links = placed.groupBy("part", "large", "i", "j").applyInPandas(partial(_verify, num=num, den=den), "a long, b long")
    joined = components(links).select(F.col("node").alias("rep"), F.col("component").alias("component_id"))

    by_class = classes.join(joined, "rep", "left").select("sid", F.coalesce("component_id", "rep").alias("component_id"))
    full = rows.where("doc_id is not null and n_shingles > 0").join(by_class, "sid").select("doc_id", "n_shingles", "component_id")
    rest = rows.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.union(rest).select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")
