"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its lower-cased words and the first four and five letters of longer
words, hashed to ``TERM_BITS`` bits; a text is the set of its terms.  A sample of labelled
rows, bounded per class, gives document counts per term and class; terms that are
clearly unevenly spread become the inputs, and common evenly spread ones that may count in pairs.  ``pyspark.ml``'s factorization
machine learns a weight per input and, through the factor vectors, one per pair of
inputs, so that words harmless alone can count together.

Scoring reads whole texts in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, functions as F, types as T

from . import chars
from .common import stored

TERM_BITS = 20
PREFIXES = (4, 5)
# Bounds of the fit: labelled rows, inputs, and how uneven a term must be (in standard deviations).
MAX_LABELLED = 20_000
MAX_INPUTS = 1024
LEAST_DOCS = 5
FIT_TASKS = 4
LEAST_Z = 6.0
# With fewer toxic rows than this the two screens are relaxed, down to these values.
MANY_TOXIC = 100
FEW_DOCS, FEW_Z = 2, 3.0
# Common terms fed besides the uneven ones: at most so many, and one for so many toxic rows.
MAX_EVEN = 256
ROWS_PER_EVEN = 4
GROUP_CHARS = 1 << 22


@dataclass
class Machine:
    """Inputs (sorted term numbers) and what was learned; ``prior`` is used alone if there is no input."""

    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    bias: float = 0.0
    linear: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def score(self, rows: int, row: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Probability of each row; ``(row, term)`` are its distinct inputs by position."""
        raw = self.bias + np.bincount(row, self.linear[term], rows)
        for f in range(self.factors.shape[1]):
            v = self.factors[term, f]
            raw += 0.5 * (np.bincount(row, v, rows) ** 2 - np.bincount(row, v * v, rows))
        return 1 / (1 + np.exp(-np.clip(raw, -60, 60)))


def _words(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds = np.where(chars.char_classes()[cps] == chars.LETTER, chars.LETTER, chars.SPACE).astype(np.uint8)
    return chars.spans(kinds, offsets, chars.SPACE)


def word_terms(words: list[str]) -> np.ndarray:
    """Term numbers of each word: the word and its beginnings (-1 where it is too short)."""
    cps, offsets = chars.codepoints(words)
    starts, ends = offsets[:-1], offsets[1:]
    out = np.full((len(words), 1 + len(PREFIXES)), -1, np.int64)
    shift = np.uint64(64 - TERM_BITS)
    for a, b in _slices(starts):
        base = starts[a]
        piece = cps[base : ends[b - 1]]
        s, e = starts[a:b] - base, ends[a:b] - base
        out[a:b, 0] = (chars.hash_spans(piece, s, e) >> shift).astype(np.int64)
        for c, n in enumerate(PREFIXES, 1):
            long = e - s > n
            if long.any():
                h = chars.mix(chars.hash_spans(piece, s[long], s[long] + n) + np.uint64(n))
                out[np.flatnonzero(long) + a, c] = (h >> shift).astype(np.int64)
    return out


def _slices(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of words with about a slab of characters each."""
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + chars.SLAB // 2)))
        yield a, b
        a = b


def _pairs(texts: list[str], terms: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, term) pairs, sorted; with ``terms`` only those, by their position."""
    words, inverse, bounds = chars.distinct_words([t.lower() for t in texts], _words)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = word_terms(words)
    if terms is not None:
        at = np.searchsorted(terms, found)
        hit = (found >= 0) & (terms[np.minimum(at, len(terms) - 1)] == found) if len(terms) else np.zeros(found.shape, bool)
        found = np.where(hit, at, -1)
    useful = (found >= 0).any(axis=1)
    where = np.flatnonzero(useful[inverse])
    row = np.searchsorted(bounds, where, side="right") - 1
    term = found[inverse[where]]
    row, term = np.repeat(row, term.shape[1]), term.reshape(-1)
    keep = term >= 0
    key = np.unique(row[keep] << TERM_BITS | term[keep])
    return key >> TERM_BITS, key & ((1 << TERM_BITS) - 1)


def _term_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
        for a, b in chars.slabs(texts, GROUP_CHARS):
            row, term = _pairs(texts[a:b], None)
            begins = np.searchsorted(row, np.arange(b - a + 1))
            lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(term, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(a, b - a), lists], names=["toxic", "terms"])


def labelled_sample(labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[DataFrame, float]:
    """At most ``limit`` labelled ids outside the held-out fifth, by hash order, and the log of how much likelier toxic ones are taken.

    Each class has half of the rows; what one leaves free goes to the other.  Rows with a
    null id or label are left out; a repeated id counts once, as toxic if any of its rows is.
    """
    usable = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    train = usable.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    bad, good = train.agg(F.expr("count_if(toxic = 1)"), F.expr("count_if(toxic <> 1)")).first()
    take_bad = min(bad, max(limit // 2, limit - good))
    take_good = min(good, limit - take_bad)
    part = lambda rows, n: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ratio = float(np.log((take_bad / bad) / (take_good / good))) if take_bad and take_good else 0.0
    return part(train.where("toxic = 1"), take_bad).union(part(train.where("toxic <> 1"), take_good)), ratio


def held_out(column: str = "doc_id"):
    """Whether a row belongs to the fifth that no fit may see (false without an id)."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, factor_size: int = 4, limit: int = MAX_LABELLED) -> Machine:
    """Learn from the texts of a bounded sample of labelled rows.

    Without rows of both classes or without any term the machine returns the share of toxic rows.
    """
    sample, ratio = labelled_sample(labels, limit)
    sample = F.broadcast(sample)  # at most ``limit`` rows of two numbers
    # one text per labelled id, however often the id occurs: the fit stays bounded
    rows = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    rows = stored(rows.mapInArrow(_term_lists, "toxic int, terms array<int>"), "terms")
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    prior = Machine(bias=float(np.log((bad + 0.1) / (good + 0.9))) - ratio)
    if not bad or not good:
        return prior
    counts = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad"))
    share = F.col("n") / float(bad + good)
    z = (F.col("bad") / float(bad) - (F.col("n") - F.col("bad")) / float(good)) / F.sqrt(share * (1 - share) * (1 / bad + 1 / good))
    least_docs = min(LEAST_DOCS, max(FEW_DOCS, LEAST_DOCS * bad // MANY_TOXIC))
    least_z = min(LEAST_Z, max(FEW_Z, LEAST_Z * float(np.sqrt(bad / MANY_TOXIC))))
    spread = stored(counts.where(F.col("n") >= least_docs).where(share < 1).withColumn("z", F.abs(z)), "spread")
    telling = spread.where(F.col("z") >= least_z).orderBy(F.desc("z"), "term").limit(MAX_INPUTS)
    even = spread.where(F.col("z") < least_z).orderBy(F.desc(share * (1 - share)), "term").limit(min(MAX_EVEN, -(-bad // ROWS_PER_EVEN)))
    terms = sorted(r["term"] for r in telling.union(even).select("term").collect())  # at most MAX_INPUTS + MAX_EVEN numbers
    if not terms:
        return prior
    sparse = CountVectorizerModel.from_vocabulary([str(t) for t in terms], inputCol="words", outputCol="features", minTF=1.0).setBinary(True)
    train = sparse.transform(rows.select(F.col("toxic").cast("double").alias("label"), F.col("terms").cast("array<string>").alias("words")))
    train = train.select("label", "features").coalesce(FIT_TASKS).persist(StorageLevel.MEMORY_AND_DISK)
    learner = FMClassifier(factorSize=factor_size, fitLinear=True, regParam=1e-4, initStd=0.01, stepSize=0.1, maxIter=80, tol=1e-5, seed=7)
    model = learner.fit(train)
    train.unpersist()
    return Machine(np.array(terms, np.int64), float(model.intercept) - ratio, model.linear.toArray(), model.factors.toArray())


def _score(batches: Iterator[pa.RecordBatch], machine) -> Iterator[pa.RecordBatch]:
    m: Machine = machine.value
    for batch in batches:
        texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
        for a, b in chars.slabs(texts, GROUP_CHARS):
            row, term = _pairs(texts[a:b], m.terms)
            score = m.score(b - a, row, term)
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, "toxic_score"])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """All columns of ``docs`` and ``toxic_score``; null texts score as empty ones.

    A column ``toxic_score`` of the input is replaced.
    """
    docs = docs.drop("toxic_score")
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # at most MAX_INPUTS + MAX_EVEN weights and factor vectors
    schema = T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType())])
    return docs.mapInArrow(partial(_score, machine=sent), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row, learned outside the held-out fifth.

    Empty tables give empty results; repeated rows get equal scores; other columns are ignored.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted")
    )


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, with their columns; a row with a null text cannot be judged and stays."""
    return score(docs, fit(docs, labels)).where(F.col("text").isNull() | (F.col("toxic_score") < threshold)).select(*docs.columns)
