"""Spelling variants by an index of variable-length grams.

Words are padded at both ends and cut into grams of ``QMIN`` to ``QMAX`` letters.  A
gram grows by a letter as long as it is frequent: the dictionary holds all grams of
``QMIN`` letters and the extensions of frequent ones, so no list stays long where a
longer gram can split it.  At every position a word takes the longest gram of the
dictionary, unless an earlier gram covers it.

One edit touches few of these grams.  ``affected`` is the largest number that any
single edit of the word can change: those whose window of ``QMAX`` letters reaches the
edit, and those behind it that a gram across the edit could cover.  All others survive at the
same position, or one further.  So two near words share one of their ``affected + 1``
rarest grams, and only these are listed.  Lists are merged by a join on (gram,
position, length); every pair is verified by its edit distance inside the join.  A
list above ``LIST_BLOCK`` words is split into blocks that are merged separately.

With the padding a word of five or more letters always keeps a gram, so the lists are complete.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, stored

QMIN, QMAX = 2, 4
LEAST_LETTERS, LEAST_COUNT = 5, 3
# At most so many grams of one length are frequent, whatever the vocabulary's size: they go to every task.
FREQUENT = 1 << 14
LIST_BLOCK = 4096
# Padding signs, no letters: fixed values.
OPEN, CLOSE = "\x02\x02", "\x03\x03"
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, every: int = 97) -> DataFrame:
    """Counted words of all texts: ``word``, ``n``.

    A word is a run of letters with A-Z in lower case; where ``every`` divides its checksum
    with the document's id, one letter is deleted.  Words of fewer than five letters or with
    fewer than three occurrences do not count.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"),
    ).where(F.length("run") >= LEAST_LETTERS)
    hashed = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run")).alias("h"))
    cut = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), cut), F.col("run").substr(cut + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---------------------------------------------------------------- grams


def frequent_grams(words: DataFrame) -> dict[str, int]:
    """Grams that occur more often than one ``FREQUENT``-th of all grams of their length, with their counts."""
    padded = words.select(F.concat(F.lit(OPEN), "word", F.lit(CLOSE)).alias("p"))
    sizes = F.array(*[F.lit(q) for q in range(QMIN, QMAX + 1)])
    grams = padded.select("p", F.explode(sizes).alias("q")).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.length("p") - F.col("q") + 1), lambda i: F.substring("p", i, F.col("q")))).alias("gram")
    )
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(F.length("gram").alias("q")).agg(F.sum("n").alias("total"))
    often = counts.join(F.broadcast(totals), F.length("gram") == F.col("q")).where(F.col("n") * FREQUENT > F.col("total"))
    return {r["gram"]: r["n"] for r in often.select("gram", "n").toLocalIterator()}  # at most FREQUENT a length


def decompose(padded: str, frequent: dict[str, int]) -> list[tuple[int, str]]:
    """Position and text of every gram: the longest of the dictionary that no earlier gram covers."""
    out, size, reach = [], len(padded), 0
    for p in range(size - QMIN + 1):
        end = p + QMIN
        while end - p < QMAX and end < size and padded[p:end] in frequent:
            end += 1
        if end > reach:
            out.append((p, padded[p:end]))
            reach = end
    return out


def affected(grams: list[tuple[int, str]], size: int) -> int:
    """Most grams of a padded word of ``size`` letters that one inserted, deleted or replaced letter can change.

    An edit at ``i`` can change a gram that starts in the ``QMAX`` positions up to ``i``, and a later
    one that ends within ``QMAX`` letters of ``i``, as a gram across the edit may cover it.
    """
    change = [0] * (size + QMAX + 1)
    for p, g in grams:
        change[max(0, p + len(g) - QMAX)] += 1
        change[p + QMAX] -= 1
    most = now = 0
    for i in range(size - len(CLOSE)):
        now += change[i]
        if i >= len(OPEN):
            most = max(most, now)
    return most


def listed_grams(word: str, frequent: dict[str, int]) -> list[tuple[int, str]]:
    """The ``affected + 1`` rarest grams of a word; ties by text, then position."""
    padded = OPEN + word + CLOSE
    grams = decompose(padded, frequent)
    grams.sort(key=lambda x: (frequent.get(x[1], 0), x[1], x[0]))
    return grams[: affected(grams, len(padded)) + 1]


def _entries(batches: Iterator[pa.RecordBatch], frequent) -> Iterator[pa.RecordBatch]:
    """One row per listed gram of every word."""
    often = frequent.value
    for batch in batches:
        take, gram, pos = [], [], []
        for i, word in enumerate(batch.column("word").to_pylist()):
            for p, g in listed_grams(word, often):
                take.append(i)
                gram.append(g)
                pos.append(p)
        rows = pa.array(take, pa.int32())
        columns = [batch.column("word").take(rows), batch.column("n").take(rows), pa.array(gram, pa.string()), pa.array(pos, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "gram", "pos"])


# A bit for every letter that occurs, by its code point modulo 64; one edit changes two bits at most.
LETTERS = "aggregate(split(word, ''), 0L, (bits, c) -> bits | shiftleft(1L, ascii(c) % 64))"


def near_words(words: DataFrame) -> DataFrame:
    """Pairs of words of ``words`` (``word``, ``n``, distinct) at edit distance one: ``word``, ``other``, ``other_n``, both ways round."""
    spark = words.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_grams(words))
    entries = words.mapInArrow(partial(_entries, frequent=frequent), "word string, n long, gram string, pos int")
    size = F.length("word")
    entries = stored(entries.withColumn("letters", F.expr(LETTERS)), "grams")
    lists = entries.select(F.xxhash64("gram", "pos", size).alias("key"), "word", "n", "letters", size.alias("size"))
    # a word meets the lists of its own length, and those of one more letter at the same position and the next
    keys = F.array(*[F.xxhash64("gram", F.col("pos") + p, size + s) for p, s in ((0, 0), (0, 1), (1, 1))])
    probes = entries.select(F.explode(keys).alias("key"), F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("letters").alias("a_letters"), size.alias("a_size"))
    # few lists are long: each has more than LIST_BLOCK entries
    long_lists = stored(lists.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > LIST_BLOCK).select("key", F.ceil(F.col("m") / LIST_BLOCK).cast("int").alias("blocks")), "lists")
    if long_lists.isEmpty():
        lists, probes = lists.withColumn("block", F.lit(0)), probes.withColumn("block", F.lit(0))
    else:
        blocks = F.coalesce("blocks", F.lit(1))
        lists = lists.join(long_lists, "key", "left").withColumn("block", F.pmod(F.xxhash64("word"), blocks.cast("long")).cast("int")).drop("blocks")
        probes = probes.join(long_lists, "key", "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
    close = (
        ((F.col("a_size") < F.col("size")) | (F.col("a") < F.col("word")))
        & (F.bit_count(F.col("letters").bitwiseXOR(F.col("a_letters"))) <= 2)
        & (F.levenshtein("a", "word", 1) == 1)
    )
    met = probes.alias("p").join(lists.alias("l"), (F.col("p.key") == F.col("l.key")) & (F.col("p.block") == F.col("l.block")) & close)
    pairs = stored(met.select("a", "a_n", F.col("word").alias("b"), F.col("n").alias("b_n")).distinct(), "near")
    discard(entries)
    discard(long_lists)
    return pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))
    )


# ---------------------------------------------------------------- forms


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: the last word reached from ``word`` over rows (``word``, ``form``).

    A form occurs at least twice as often as its word, so chains end, and doubling the
    pointers reaches their ends in a number of rounds that grows with the logarithm of
    the logarithm of the largest count.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = moved
        if moved.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_forms(docs: DataFrame, every: int = 97) -> DataFrame:
    """Every counted word of ``docs`` with its more frequent spelling.

    Columns ``word``, ``form`` (the near word of largest count, the smallest in code-point order of
    equals, if it occurs at least twice as often; else null), ``root`` (the end of the chain of forms, the word
    itself if it has none), ``n``, ``n_near`` and ``form_n``.  Null and empty texts hold no words,
    a null ``doc_id`` counts as an empty id, repeated rows count as often as they
    occur, other columns are ignored, and an empty table gives an empty result.
    """
    words = stored(vocabulary(docs, every), "words")
    near = near_words(words)
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    around = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    enough = -F.col("best.n") >= 2 * F.col("n")
    judged = words.join(around, "word", "left").select(
        "word",
        F.when(enough, F.col("best.word")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, -F.col("best.n")).alias("form_n"),
    )
    judged = stored(judged, "forms")
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
