"""Vectorised word splitting and hashing over code points (NumPy inside Spark tasks).

A list of texts becomes one array of code points with document offsets; words
are spans of that array.  Nothing is cut at a length: a slab holds whole texts,
so the memory of a slab is bounded by ``SLAB`` or by its single longest text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLAB = 1 << 18
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
# Unicode White_Space: fixed values.
WHITE_SPACE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_K = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_K1, _K2, _K3 = (np.uint64(k) for k in _K)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    signs = np.arange(sys.maxunicode + 1, dtype=np.uint32).view("<U1")
    letter = np.strings.isalpha(signs)
    out = np.where(letter, LETTER, OTHER).astype(np.uint8)
    out[np.strings.isnumeric(signs) & ~letter] = NUMBER
    out[list(WHITE_SPACE)] = SPACE
    return out


@lru_cache(maxsize=1)
def _weights() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 1 << 16, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit words so that every bit depends on all others."""
    h = (h ^ (h >> np.uint64(30))) * _K2
    h = (h ^ (h >> np.uint64(27))) * _K3
    return h ^ (h >> np.uint64(31))


def slabs(texts: Sequence[str], limit: int = SLAB) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about ``limit`` characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def codepoints(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text starts (one more entry at the end)."""
    texts = list(texts)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def runs(kinds: np.ndarray, offsets: np.ndarray, alone: int | None = None) -> np.ndarray:
    """Where a run of one kind starts; a text starts a run, and kind ``alone`` never joins."""
    first = np.empty(len(kinds), bool)
    if len(kinds):
        first[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=first[1:])
        if alone is not None:
            first |= kinds == alone
        inner = offsets[(offsets < len(kinds))]
        first[inner] = True
    return first


def spans(kinds: np.ndarray, offsets: np.ndarray, drop: int, alone: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs whose kind is not ``drop``."""
    starts = np.flatnonzero(runs(kinds, offsets, alone))
    ends = np.append(starts[1:], len(kinds))
    keep = kinds[starts] != drop if len(starts) else np.zeros(0, bool)
    return starts[keep], ends[keep]


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, one per position of a slab."""
    out = []
    for base in (_K[0], pow(_K[0], -1, 1 << 64)):
        p = np.full(SLAB + 1, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def hash_spans(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's code points (spans ascend and do not overlap).

    A polynomial in the scrambled code points: prefix sums over the slab give all
    spans at once.  A slab beyond ``SLAB`` (one very long text) takes the powers
    relative to each span instead; the hashes are the same.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers()
    value = (cps.astype(np.uint64) + np.uint64(1)) * _K1
    value ^= value >> np.uint64(32)
    value *= _K2
    total = np.zeros(len(cps) + 1, np.uint64)
    if len(cps) <= SLAB:
        value *= up[: len(cps)]
        np.cumsum(value, out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
    else:
        flag = np.zeros(len(cps), np.int8)
        flag[starts] = 1
        pos = np.arange(len(cps)) - starts[np.maximum(np.cumsum(flag, dtype=np.int64) - 1, 0)]
        far = np.full((len(cps) >> 16) + 2, int(up[1 << 16]), np.uint64)
        far[0] = 1
        value *= up[pos & 0xFFFF] * np.cumprod(far)[np.maximum(pos >> 16, 0)]
        np.cumsum(value, out=total[1:])
        h = total[ends] - total[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _K3)


def distinct_words(texts: Sequence[str], split) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of the texts by first appearance, the word of each span, and where each text's spans begin.

    ``split(cps, offsets)`` returns the spans of a slab.  The last array has one
    more entry than there are texts.
    """
    hashes, begins, lens, first, chars_before, words_before = [], [], [], [], 0, 0
    for a, b in slabs(texts):
        cps, offsets = codepoints(texts[a:b])
        starts, ends = split(cps, offsets)
        hashes.append(hash_spans(cps, starts, ends))
        begins.append(starts + chars_before)
        lens.append(ends - starts)
        first.append(np.searchsorted(starts, offsets[:-1]) + words_before)
        chars_before += len(cps)
        words_before += len(starts)
    bounds = np.append(np.concatenate(first), words_before) if first else np.zeros(1, np.int64)
    if not words_before:
        return [], np.zeros(0, np.int64), bounds
    begin, size = np.concatenate(begins), np.concatenate(lens)
    seen = pa.array(np.concatenate(hashes)).dictionary_encode()
    inverse = np.asarray(seen.indices, np.int64)
    at = np.empty(len(seen.dictionary), np.int64)
    at[inverse[::-1]] = np.arange(words_before)[::-1]  # the first span of each word is written last
    joined = "".join(texts)
    return [joined[s : s + n] for s, n in zip(begin[at].tolist(), size[at].tolist(), strict=True)], inverse, bounds


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` words; a shorter, non-empty sequence gives one hash."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(k, n)
    total = np.full(n - size + 1, size, np.uint64) * _K3
    w = _weights()
    for j in range(size):
        total = (total + words[j : n - size + 1 + j]) * w[j]
        total ^= total >> np.uint64(29)
    return mix(total)


def ragged(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenate ``values[starts[i] : starts[i] + lens[i]]``."""
    total = int(lens.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lens)
    return values[np.repeat(starts - (ends - lens), lens) + np.arange(total)]
