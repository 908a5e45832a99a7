"""Benchmark decontamination by templates.

Texts become template tokens: numbers, units after a number, and capitalised words inside a
sentence are typed placeholders (neighbours of one type count as one), other words
are lower-cased.  A second reading keeps the names as words, so a copy with other
capitals or without punctuation is met as well.  A third one takes capitalised words
that open a sentence as names too, so an item that starts with a name is met under another one.
A literal reading keeps everything as words; its windows are exact passages, the whole item where
it is short.  Short items, whose windows would hold by chance, are also met as whole frames: their template with operators
as tokens has to fill whole sentences of the document.  Characters of scripts written without spaces are tokens of their own.

Windows of template tokens are hashed.  A bitmap of fixed size holds the benchmark's windows; document
windows outside it are never sent, the others are joined on the hash.  Matches on
one diagonal form an alignment, and its slots have to be consistent: an item's
value always stands for the same document value and the other way round.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import chars
from .common import bitmap, stored

WINDOW = 8
# Templates of fewer tokens are met as frames of whole sentences; literal passages need so many words, or a sentence of their own.
LEAST_ITEM, LEAST_WORDS = 5, 3
# Words and operators that a frame with slots needs: 'What is 12 + 35?' is no more than a common form.
FRAME_WORDS = 4
# Passage that counts whatever its share of the item is: words, and characters where these are most of the tokens.
RUN, RUN_CHARS = 13, 26
# Share of an item that consistent alignments must cover, and of slots that must agree.
COVER = 0.5
AGREE = 0.8
BITMAP_BITS = 26
# Benchmark windows up to this number are sent to the tasks for the join; beyond it both sides are shuffled.
BROADCAST_WINDOWS = 100_000
NUMBER, UNIT, NAME = 1, 2, 3
# Readings: names inside a sentence are slots, no name is, every capitalised word is; nothing is a slot.
INNER, PLAIN, OPENING, LITERAL = 0, 1, 2, 3
# Whole sentences with operators.
FRAME = 4
STOPS, OPERATORS = ".!?:;\n", "+-*/=<>%^±×÷−√≤≥≠"
# Scripts written without spaces between words: Thai, Lao, Myanmar, Khmer, kana, Han.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
    (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
)
CHARACTER, OPERATOR = 4, 5
# Number words and units: fixed values.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces oz pound pounds lb lbs "
    "ml cl l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees meter meters metre metres kilometer kilometers kilometre kilometres mph kmh watt watts volt volts byte bytes kb mb gb"
).split()
ROWS = "variant int, size int, hash long, pos int, n_tokens int, slots array<long>"


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """Lower case of every code point that has one of a single letter."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(chars.char_classes() == chars.LETTER).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Class of every code point: letter, number, character of an unspaced script or other."""
    kinds = chars.char_classes()
    kinds = np.where((kinds == chars.LETTER) | (kinds == chars.NUMBER), kinds, chars.OTHER).astype(np.uint8)
    for a, b in UNSPACED:
        part = kinds[a : b + 1]
        part[part == chars.LETTER] = CHARACTER
    return kinds


def _codes(letters: str) -> np.ndarray:
    return np.array([ord(c) for c in letters], np.uint32)


@lru_cache(maxsize=2)
def _known(words: tuple[str, ...]) -> np.ndarray:
    cps, offsets = chars.codepoints(words)
    return np.sort(chars.hash_spans(cps, offsets[:-1], offsets[1:]))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def templates(texts: Sequence[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For every reading: variant, token hashes, slot values (0: word) and where each text's tokens begin."""
    cps, offsets = chars.codepoints(texts)
    kinds = _kinds()[cps]
    starts, ends = chars.spans(kinds, offsets, chars.OTHER, CHARACTER)
    low = _lower()[cps]
    words = chars.hash_spans(low, starts, ends)
    n = len(starts)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    number = (kinds[starts] == chars.NUMBER) | _among(words, _known(tuple(NUMBER_WORDS)))
    first = np.append(True, owner[1:] != owner[:-1])[:n]
    unit = np.zeros(n, bool)
    unit[1:] = number[:-1] & ~number[1:] & ~first[1:] & _among(words[1:], _known(tuple(UNITS)))
    stops = np.append(0, np.cumsum(np.isin(cps, _codes(STOPS))))
    opens = first.copy()
    if n:
        opens[1:] |= stops[starts[1:]] > stops[ends[:-1]]
    capital = (cps[starts] != low[starts]) & ~number & ~unit & (ends - starts > 1)
    for variant, name in ((INNER, capital & ~opens), (PLAIN, np.zeros(n, bool)), (OPENING, capital)):
        kind = np.select([number, unit, name], [NUMBER, UNIT, NAME], 0)
        begin = np.ones(n, bool)
        begin[1:] = (kind[1:] == 0) | (kind[1:] != kind[:-1]) | first[1:]
        at = np.flatnonzero(begin)
        slot = kind[at] > 0
        joined = np.add.reduceat(words, at) if n else words
        token = np.where(slot, chars.mix(kind[at].astype(np.uint64)), words[at])
        yield variant, token, np.where(slot, chars.mix(joined) | np.uint64(1), np.uint64(0)), np.searchsorted(owner[at], np.arange(len(texts) + 1))
    yield LITERAL, words, np.zeros(n, np.uint64), np.searchsorted(owner, np.arange(len(texts) + 1))


def frames(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens with operators: hashes, slot values, where each text's tokens begin, and whether a token opens or closes a sentence.

    Neighbouring slots stay apart, and only names inside a sentence are slots.
    """
    cps, offsets = chars.codepoints(texts)
    kinds = np.where(np.isin(cps, _codes(OPERATORS)), OPERATOR, _kinds()[cps]).astype(np.uint8)
    starts, ends = chars.spans(kinds, offsets, chars.OTHER, CHARACTER)
    n, low = len(starts), _lower()[cps]
    words = chars.hash_spans(low, starts, ends)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    number = (kinds[starts] == chars.NUMBER) | _among(words, _known(tuple(NUMBER_WORDS)))
    stops = np.append(0, np.cumsum(np.isin(cps, _codes(STOPS))))
    opens = np.append(True, owner[1:] != owner[:-1])[:n]
    if n:
        opens[1:] |= stops[starts[1:]] > stops[ends[:-1]]
    # a stop between digits ('3.5', '10:30') parts no sentences
    if n > 1:
        opens[1:] &= ~(number[1:] & number[:-1] & (starts[1:] - ends[:-1] == 1) & (owner[1:] == owner[:-1]))
    closes = np.append(opens[1:], True)[:n]
    unit = np.zeros(n, bool)
    unit[1:] = number[:-1] & ~number[1:] & ~opens[1:] & _among(words[1:], _known(tuple(UNITS)))
    name = (cps[starts] != low[starts]) & ~number & ~unit & ~opens & (ends - starts > 1)
    kind = np.select([number, unit, name], [NUMBER, UNIT, NAME], 0)
    token = np.where(kind > 0, chars.mix(kind.astype(np.uint64)), words)
    return token, np.where(kind > 0, chars.mix(words) | np.uint64(1), np.uint64(0)), np.searchsorted(owner, np.arange(len(texts) + 1)), opens, closes


def run_length(text: str) -> int:
    """Tokens of a passage of ``text`` that counts by itself."""
    kinds = _kinds()[chars.codepoints([text])[0]]
    n = len(chars.spans(kinds, np.array([0, len(kinds)]), chars.OTHER, CHARACTER)[0])
    return RUN_CHARS if 2 * int((kinds == CHARACTER).sum()) > n else RUN


def windows(token: np.ndarray, value: np.ndarray, begins: np.ndarray, size: int, share: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and text of the windows of ``size`` tokens of which at least one in ``share`` is a word."""
    if len(token) < size:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    h = chars.shingle_hashes(token, size)
    at = np.arange(len(h))
    text = np.searchsorted(begins, at, side="right") - 1
    word = np.append(0, np.cumsum(value == 0))
    ok = (at + size <= begins[text + 1]) & (share * (word[size:] - word[:-size]) >= size)
    return h[ok], at[ok], text[ok]


def _rows(ids: pa.Array, name: str, parts: list[tuple]) -> pa.RecordBatch:
    """Batch of windows given as (variant, size, hashes, starts, texts, values, begins)."""
    columns: list[list] = [[] for _ in range(7)]
    for variant, size, h, at, text, value, begins in parts:
        columns[0].append(text)
        columns[1].append(np.full(len(h), variant, np.int32))
        columns[2].append(np.full(len(h), size, np.int32))
        columns[3].append(h.view(np.int64))
        columns[4].append((at - begins[text]).astype(np.int32))
        columns[5].append((begins[text + 1] - begins[text]).astype(np.int32))
        columns[6].append((value[(at[:, None] + np.arange(size))].view(np.int64).reshape(-1), np.full(len(h), size)))
    flat = np.concatenate([c[0] for c in columns[6]])
    ends = np.append(0, np.cumsum(np.concatenate([c[1] for c in columns[6]])))
    slots = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
    plain = [pa.array(np.concatenate(c)) for c in columns[1:6]]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(columns[0]))), *plain, slots], names=[name, "variant", "size", "hash", "pos", "n_tokens", "slots"])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
        for i, t in enumerate(texts):
            parts, run, short = [], run_length(t), False
            for variant, token, value, begins in templates([t]):
                if len(token) >= (LEAST_WORDS if variant == LITERAL else LEAST_ITEM):
                    size = min(run if variant == LITERAL else WINDOW, len(token))
                    parts.append((variant, size, *windows(token, value, begins, size), value, begins))
                else:
                    short = True
            if short:
                token, value, begins, _, _ = frames([t])
                if (value == 0).sum() >= (FRAME_WORDS if value.any() else 1):
                    parts.append((FRAME, len(token), *windows(token, value, begins, len(token), len(token)), value, begins))
            parts = [p for p in parts if len(p[2])]
            if parts:
                rows = _rows(batch.column("item_id").slice(i, 1), "item_id", parts)
                yield rows.append_column("run", pa.array(np.full(len(rows), run, np.int32)))


def _document_windows(batches: Iterator[pa.RecordBatch], sizes: dict[int, list[int]], marked) -> Iterator[pa.RecordBatch]:
    bits = marked.value
    for batch in batches:
        texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
        for a, b in chars.slabs(texts):
            parts = []
            for variant, token, value, begins in templates(texts[a:b]):
                for size in sizes.get(variant, ()):
                    h, at, text = windows(token, value, begins, size)
                    bit = (h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                    hit = np.flatnonzero((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                    if len(hit):
                        parts.append((variant, size, h[hit], at[hit], text[hit], value, begins))
            if FRAME in sizes:
                token, value, begins, opens, closes = frames(texts[a:b])
                for size in sizes[FRAME]:
                    h, at, text = windows(token, value, begins, size, size)
                    bit = (h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                    hit = np.flatnonzero(opens[at] & closes[at + size - 1] & ((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool))
                    if len(hit):
                        parts.append((FRAME, size, h[hit], at[hit], text[hit], value, begins))
            if parts:
                yield _rows(batch.column("doc_id").slice(a, b - a), "doc_id", parts)


def contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, agree: float = AGREE) -> DataFrame:
    """One row per document and benchmark item that it holds.

    Consistent alignments have to cover the share ``cover`` of the item or hold a run of ``RUN``
    tokens without a gap (``RUN_CHARS`` characters).  Columns ``doc_id``, ``item_id``, ``covered`` (tokens of the item
    found in consistent alignments), ``item_tokens``, ``slots`` and ``changed`` (slots, and those with another value than
    the item's); they count template tokens, or words where only the literal reading
    finds the item.  Null and empty texts match nothing; rows with a null id are
    not reported; items below ``LEAST_ITEM`` template tokens are met as frames of whole
    sentences, items below ``LEAST_WORDS`` words only so; a frame with slots needs ``FRAME_WORDS`` words or operators, so a bare
    sum is met literally and an item of up to two numbers not at all; rows with the same
    ``doc_id`` count as one document.  Other columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null").select("item_id", "text").mapInArrow(_item_windows, "item_id long, " + ROWS + ", run int")
    items = stored(items.distinct(), "items")
    sizes: dict[int, list[int]] = {}
    for r in items.select("variant", "size").distinct().collect():  # at most RUN_CHARS values a reading, and the lengths of short items
        sizes.setdefault(r["variant"], []).append(r["size"])
    marked = spark.sparkContext.broadcast(bitmap(items, f"shiftrightunsigned(hash, {64 - BITMAP_BITS})", BITMAP_BITS))
    found = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(partial(_document_windows, sizes=sizes, marked=marked), "doc_id long, " + ROWS)
    found = found.drop("n_tokens").withColumnsRenamed({"pos": "doc_pos", "slots": "doc_slots"})
    if items.count() <= BROADCAST_WINDOWS:
        items = F.broadcast(items)
    hits = found.join(items, ["variant", "size", "hash"]).withColumn("diagonal", F.col("doc_pos") - F.col("pos"))
    # one cell per item token of an alignment
    key = ["doc_id", "item_id", "variant", "diagonal"]
    cells = hits.select(*key, "n_tokens", "run", "pos", F.explode(F.arrays_zip("slots", "doc_slots", F.sequence(F.lit(0), F.col("size") - 1).alias("j"))).alias("c"))
    cells = cells.select(*key, "n_tokens", "run", (F.col("pos") + F.col("c.j")).alias("at"), F.col("c.slots").alias("mine"), F.col("c.doc_slots").alias("theirs"))
    cells = stored(cells.groupBy(*key, "at").agg(*[F.min(c).alias(c) for c in ("n_tokens", "run", "mine", "theirs")]), "cells")
    pairs = cells.groupBy(*key, "mine", "theirs").agg(F.count(F.lit(1)).alias("c"))
    sides = []
    for side in ("mine", "theirs"):
        by_value = pairs.groupBy(*key, side).agg(F.max("c").alias("most"), F.sum("c").alias("all"))
        slot = F.col(side) != 0
        sides.append(by_value.groupBy(*key).agg(F.sum(F.when(slot, F.col("most")).otherwise(0)).alias(f"most_{side}"), F.sum(F.when(slot, F.col("all")).otherwise(0)).alias("slots_" + side)))
    fits = sides[0].join(sides[1], key).where(f"most_mine >= {agree} * slots_mine and most_theirs >= {agree} * slots_theirs").select(*key)
    # the cells of one alignment, at most an item's tokens, are numbered: along a run, place and number rise together
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("at"))
    consistent = cells.join(fits, key, "left_semi").withColumn("gap", F.col("at") - nth)
    long = F.count(F.lit(1)).over(Window.partitionBy(*key, "gap")) >= F.col("run")
    held = (
        consistent.withColumn("long", long)
        .groupBy("doc_id", "item_id", "variant", "at")
        .agg(F.max("long").alias("long"), F.max("n_tokens").alias("n"), F.max(F.expr("int(mine <> 0)")).alias("slot"), F.min(F.expr("int(mine <> theirs)")).alias("other"))
        .groupBy("doc_id", "item_id", "variant")
        .agg(F.count(F.lit(1)).alias("covered"), F.max("n").cast("long").alias("item_tokens"), F.sum("slot").alias("slots"), F.sum("other").alias("changed"), F.max("long").alias("long"))
        .where((F.col("covered") >= cover * F.col("item_tokens")) | F.col("long"))
    )
    best = held.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("covered", "item_tokens", "slots", "changed"), F.struct(F.col("variant") != LITERAL, "covered", -F.col("variant"))).alias("b"))
    return best.select("doc_id", "item_id", "b.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item; rows with a null id stay."""
    return docs.join(contaminated(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
