"""Token ids as patched frame-of-reference blocks.

Documents are range-partitioned and sorted by id; every task writes the ids of
its range ("shard") as segments of whole documents.  A segment is one row of a
Parquet table, so Spark's committer publishes it and a lost task is simply run
again.  ``data`` holds a segment's ids in this layout, little-endian:

    magic b"PFB1" | block length u32 | number of ids u64 | block starts u32[blocks + 1] | blocks

and a block is

    minimum u32 | width u8 | exceptions u8 | bit-packed (id - minimum) | positions u8[] | values u32[]

The width is the number of bits that holds ``percentile`` of the block's
differences; a larger difference is an exception: its position and whole value
are listed, its packed bits are zero.  Block starts are byte offsets, so a block
is decoded without the ones before it.  ``doc_ids`` and ``doc_tokens`` list the
segment's documents, ``before`` the ids of the shard ahead of the segment.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import chars
from .common import stored

MAGIC = b"PFB1"
BLOCK = 128
PERCENTILE = 0.9
SEGMENT_TOKENS = 1 << 18
CACHE_WORDS = 250_000  # of each of two generations
GROUP_CHARS = 1 << 23
CONTRACTION = r"'(?:[stmd]|re|ve|ll)"
SEGMENTS = "shard int, segment int, before long, n_tokens long, doc_ids array<long>, doc_tokens array<int>, data binary"


# ---------------------------------------------------------------- blocks


def pack(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """Encode unsigned 32-bit ids; any length, also none."""
    if not 1 <= block <= 256 or block % 8:
        raise ValueError("block length must be a multiple of 8 up to 256")
    ids = np.asarray(ids, np.uint32)
    n = len(ids)
    count = -(-n // block)
    head = MAGIC + struct.pack("<IQ", block, n)
    if not n:
        return head + bytes(4)
    grid = np.full(count * block, ids[-1], np.uint32)  # the tail repeats an id; it is cut off when reading
    grid[:n] = ids
    grid = grid.reshape(count, block)
    low = grid.min(axis=1)
    diff = grid - low[:, None]
    rank = max(0, int(np.ceil(percentile * block)) - 1)
    at = np.partition(diff, rank, axis=1)[:, rank]
    width = np.where(at > 0, np.floor(np.log2(np.maximum(at, 1).astype(np.float64))).astype(np.int64) + 1, 0)
    over = diff.astype(np.uint64) >> width[:, None].astype(np.uint64) > 0
    diff[over] = 0
    body = width * (block // 8)
    exceptions = over.sum(axis=1)
    starts = np.zeros(count + 1, np.int64)
    np.cumsum(6 + body + 5 * exceptions, out=starts[1:])
    out = np.zeros(starts[-1], np.uint8)
    at = starts[:-1]
    out[at[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[at + 4] = width
    out[at + 5] = exceptions
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        bits = np.unpackbits(diff[rows].astype("<u4").view(np.uint8), axis=1, bitorder="little").reshape(len(rows), block, 32)
        packed = np.packbits(bits[:, :, :w].reshape(len(rows), -1), axis=1, bitorder="little")
        out[at[rows][:, None] + 6 + np.arange(packed.shape[1])] = packed
    row, col = np.nonzero(over)
    nth = np.arange(len(row)) - (np.cumsum(exceptions) - exceptions)[row]
    tail = at[row] + 6 + body[row]
    out[tail + nth] = col
    out[(tail + exceptions[row] + 4 * nth)[:, None] + np.arange(4)] = grid[row, col].astype("<u4").view(np.uint8).reshape(-1, 4)
    return head + starts.astype("<u4").tobytes() + out.tobytes()


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the positions ``[first, last)``; only the blocks that hold them are decoded."""
    if bytes(data[:4]) != MAGIC:
        raise ValueError("not a block segment")
    block, n = struct.unpack_from("<IQ", data, 4)
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    count = -(-n // block)
    starts = np.frombuffer(data, "<u4", count + 1, 16).astype(np.int64) + 16 + 4 * (count + 1)
    raw = np.frombuffer(data, np.uint8)
    use = np.arange(first // block, -(-last // block))
    at = starts[use]
    low = raw[at[:, None] + np.arange(4)].view("<u4")[:, 0]
    width, exceptions = raw[at + 4].astype(np.int64), raw[at + 5].astype(np.int64)
    out = np.repeat(low[:, None], block, axis=1)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        bits = np.zeros((len(rows), block, 32), np.uint8)
        packed = raw[at[rows][:, None] + 6 + np.arange(block // 8 * w)]
        bits[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), block, w)
        out[rows] += np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little").view("<u4")
    row = np.repeat(np.arange(len(use)), exceptions)
    nth = np.arange(len(row)) - (np.cumsum(exceptions) - exceptions)[row]
    tail = at[row] + 6 + width[row] * (block // 8)
    values = raw[(tail + exceptions[row] + 4 * nth)[:, None] + np.arange(4)].view("<u4")[:, 0] if len(row) else low[:0]
    out[row, raw[tail + nth]] = values
    return out.reshape(-1)[first - use[0] * block : last - use[0] * block]


# ---------------------------------------------------------------- encoding


def byte_level_spans(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens of a byte-level vocabulary: optional blank + letters, numbers or others; white space.

    Contractions are not split here; texts that hold one are encoded whole.
    """
    kinds = chars.char_classes()[cps]
    n = len(kinds)
    first = chars.runs(kinds, offsets)
    space = kinds == chars.SPACE
    ends_text = np.zeros(n, bool)
    inner = offsets[1:][offsets[1:] > 0] - 1
    ends_text[inner] = True
    before_word = np.zeros(n, bool)  # a white space directly ahead of a word of the same text
    before_word[:-1] = space[:-1] & ~space[1:] & ~ends_text[:-1]
    start = first.copy()
    start |= before_word
    absorbed = np.zeros(n, bool)
    absorbed[1:] = before_word[:-1] & (cps[:-1] == 32)
    start &= ~absorbed
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n)


def byte_chars() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others follow from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts by the tokenizers library; a word that was met before is not encoded again."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        special = [re.escape(t.content) for t in self.lib.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([CONTRACTION, *special]))
        self.hints = ("'", *(t.content for t in self.lib.get_added_tokens_decoder().values()))
        self.cache_words = cache_words
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.byte_chars = byte_chars()

    def encode(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        for a, b in chars.slabs(texts, GROUP_CHARS):
            part = texts[a:b]
            direct = [any(h in t for h in self.hints) and bool(self.whole.search(t)) for t in part]
            found: list = [None] * len(part)
            whole = [i for i, d in enumerate(direct) if d]
            for i, e in zip(whole, self.lib.encode_batch_fast([part[i] for i in whole], add_special_tokens=False), strict=True):
                found[i] = np.array(e.ids, np.uint32)
            split = [i for i, d in enumerate(direct) if not d]
            for i, ids in zip(split, self._by_word([part[i] for i in split]), strict=True):
                found[i] = ids
            yield from found

    def _by_word(self, texts: list[str]) -> Iterator[np.ndarray]:
        words, inverse, bounds = chars.distinct_words(texts, byte_level_spans)
        ids = self._ids(words)
        lens = np.array([len(x) >> 2 for x in ids], np.int64)
        lens_all = lens[inverse]
        out = chars.ragged(np.frombuffer(b"".join(ids), np.uint32), (np.cumsum(lens) - lens)[inverse], lens_all)
        bounds = np.append(0, np.cumsum(lens_all))[bounds]
        for i in range(len(texts)):
            yield out[bounds[i] : bounds[i + 1]]

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of single pre-tokens, by the library's model; words of the last two generations are remembered."""
        if len(self.known) > self.cache_words:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = []
        for w in words:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.append(w)
        if new:
            ids, ends, tokenize = [], [0], self.lib.model.tokenize
            for letters in self._byte_letters(new):
                ids += [t.id for t in tokenize(letters)]
                ends.append(4 * len(ids))
            data = np.array(ids, np.uint32).tobytes()
            known.update((w, data[a:b]) for w, a, b in zip(new, ends, ends[1:]))
        return [known[w] for w in words]

    def _byte_letters(self, words: list[str]) -> list[str]:
        """The words with a letter for each UTF-8 byte, all at once; a lone surrogate, which no text holds, parts them."""
        letters = lambda t: t.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.byte_chars)
        return letters("\ud800".join(words)).split(letters("\ud800"))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---------------------------------------------------------------- tables


def write_segments(docs: DataFrame, tokenizer: str, end_id: int = 0, name: str = "segments") -> DataFrame:
    """Encode ``text`` of all rows, write the segments and return the written table.

    Null and empty texts hold only the end id.  A null ``doc_id`` sorts first;
    rows with equal ids follow each other by a hash of their text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        docs_held: list = []
        state = {"segment": 0, "before": 0, "size": 0}

        def segment() -> pa.RecordBatch:
            lens = [len(x) for x in held]
            rows = pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([state["segment"]], pa.int32()),
                    pa.array([state["before"]], pa.int64()),
                    pa.array([state["size"]], pa.int64()),
                    pa.array([docs_held], pa.list_(pa.int64())),
                    pa.array([lens], pa.list_(pa.int32())),
                    pa.array([pack(np.concatenate(held))], pa.binary()),
                ],
                names=["shard", "segment", "before", "n_tokens", "doc_ids", "doc_tokens", "data"],
            )
            state.update(segment=state["segment"] + 1, before=state["before"] + state["size"], size=0)
            held.clear()
            docs_held.clear()
            return rows

        end = np.array([end_id], np.uint32)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(texts), strict=True):
                held.append(np.concatenate([ids, end]))
                docs_held.append(doc)
                state["size"] += len(held[-1])
                if state["size"] >= SEGMENT_TOKENS:
                    yield segment()
        if held:
            yield segment()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stored(ordered.mapInArrow(run, SEGMENTS), name)


def shard_starts(segments: DataFrame) -> DataFrame:
    """Ids ahead of each shard: one row per shard, that is per partition of the writer."""
    spark, total, rows = segments.sparkSession, 0, []
    for r in segments.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():
        rows.append((r["shard"], total))
        total += r["n"]
    return spark.createDataFrame(rows, "shard int, shard_start long")


def read_documents(segments: DataFrame) -> DataFrame:
    """Decode all segments: one row per document with ``start``, ``n_tokens`` and ``ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = [np.asarray(batch.column(c)) for c in ("before", "shard_start")]
            for i in range(len(batch)):
                ids = memoryview(unpack(batch.column("data")[i].as_buffer()).astype("<u4")).cast("B")
                lens = np.asarray(batch.column("doc_tokens")[i].values, np.int64)
                ends = np.cumsum(lens)
                begins = ends - lens
                sums = [zlib.crc32(ids[a:b]) for a, b in zip((4 * begins).tolist(), (4 * ends).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[i].values, pa.array(begins + starts[0][i] + starts[1][i]), pa.array(lens), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return (
        segments.join(F.broadcast(shard_starts(segments)), "shard")
        .select("before", "shard_start", "doc_ids", "doc_tokens", "data")
        .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write all documents as blocks and return what the written blocks hold.

    An empty table gives an empty result; extra columns are ignored.
    """
    return read_documents(write_segments(docs, tokenizer, end_id))
