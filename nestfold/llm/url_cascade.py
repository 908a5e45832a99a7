"""URL rules by Bloom filter cascades (DataFrame functions only).

A rule is a host, which also covers its subdomains, and the start of a path.  A URL's
candidate keys are its host suffixes joined with the starts of its path that have the
length of some rule path; every other key is unlisted.  The distinct candidate
keys of all URLs are the complete key universe of the corpus.

A cascade encodes a list against that universe: level 1 holds the listed keys,
level 2 the unlisted keys that level 1 lets through, level 3 the listed keys
that level 2 lets through, and so on until none is left.  Membership is then exact
for every key of the universe, and a URL is judged by arithmetic on literals, without a join.
One cascade holds all listed keys, a second one the blocked keys among them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import discard, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bounds of what becomes a literal: rules and bits of one filter.
MAX_RULES = 100_000
MAX_BITS = 1 << 22
MAX_LEVELS = 64


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits in 64-bit words and the number of hashes."""

    words: tuple[int, ...]
    hashes: int
    seed: int

    @property
    def bits(self) -> int:
        return 64 * len(self.words)

    def holds(self, key: Column) -> Column:
        found = F.lit(True)
        table = F.array(*[F.lit(w).cast("long") for w in self.words])
        for at in positions(key, self.hashes, self.seed, self.bits):
            word = F.element_at(table, (F.shiftright(at, 6) + 1).cast("int"))
            found = found & (F.expr("1L") == F.call_function("shiftrightunsigned", word, (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")))
        return found


def positions(key: Column, hashes: int, seed: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed * 64 + i)), F.lit(bits).cast("long")) for i in range(hashes)]


def member(cascade: Sequence[Level], key: Column) -> Column:
    """Whether a key of the universe is listed."""
    found = F.lit(False)
    for level in reversed(cascade):
        found = level.holds(key) & ~found
    return found


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """Filter of ``n`` keys with about this rate of false positives; only its words reach the driver."""
    bits = max(64, -(-int(n * math.log(1 / rate) / math.log(2) ** 2 + 1) // 64) * 64)
    if bits > MAX_BITS:
        raise ValueError(f"a filter of {bits} bits exceeds MAX_BITS")
    hashes = max(1, round(bits / n * math.log(2))) if n else 1
    at = keys.select(F.explode(F.array(*positions(F.col("key"), min(hashes, 16), seed, bits))).alias("at"))
    masks = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("mask"))
    words = [0] * (bits // 64)
    for r in masks.groupBy("word").agg(F.bit_or("mask").alias("mask")).collect():  # at most MAX_BITS / 64 rows
        words[r["word"]] = r["mask"]
    return Level(tuple(words), min(hashes, 16), seed)


def build(listed: DataFrame, universe: DataFrame, n_listed: int, n_universe: int) -> list[Level]:
    """Cascade that separates ``listed`` from the rest of ``universe`` (both have a distinct column ``key``).

    The first level's rate follows the ratio of the two, so the keys that pass it are
    about as many as the listed ones; the later levels let half of them through.
    """
    levels: list[Level] = []
    inside, outside = listed, universe.join(F.broadcast(listed), "key", "left_anti")  # at most MAX_RULES keys
    n = n_listed
    rate = min(0.5, max(1, n_listed) * math.sqrt(0.5) / max(1, n_universe))
    while n:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade does not end")
        level = _level(inside, n, rate, len(levels))
        levels.append(level)
        # what passes this level by mistake is bounded by the rate: a small table
        passed = stored(outside.where(level.holds(F.col("key"))), "passed")
        inside, outside, n, rate = passed, inside, passed.count(), 0.5
    return levels


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, labels: int, lengths: Sequence[int]) -> Column:
    """Candidate keys, longest first (a longer host first on ties)."""
    parts = F.split(host, "\\.")
    suffixes = F.array(*[F.array_join(F.slice(parts, -i, i), ".") for i in range(1, labels + 1)])
    suffixes = F.slice(suffixes, 1, F.least(F.size(parts), F.lit(labels)))
    starts = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    pairs = F.flatten(
        F.transform(suffixes, lambda s: F.transform(F.filter(starts, lambda p: p.isNotNull()), lambda p: F.struct((-F.length(s) - F.length(p)).alias("a"), (-F.length(s)).alias("b"), F.concat(s, p).alias("key"))))
    )
    return F.transform(F.array_sort(pairs), lambda k: k["key"])


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every row.

    ``rules`` are (host, path start, "allow" or "block"); the longest that fits
    wins.  A URL whose keys are all unlisted gets no rule and the verdict ``default``, as
    does a null or empty URL.  Repeated rows stay; other columns are ignored.
    """
    spark: SparkSession = pages.sparkSession
    keys = {h.translate(str.maketrans(UPPER, LOWER)) + p: v for h, p, v in rules}
    if len(keys) > MAX_RULES:
        raise ValueError("too many rules for a literal filter")
    if any(v not in ("allow", "block") for v in keys.values()):
        raise ValueError("a verdict is allow or block")
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not keys:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels, lengths = max(h.count(".") + 1 for h, _, _ in rules), sorted({len(p) for _, p, _ in rules})
    rows = rows.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), labels, lengths))
    listed = spark.createDataFrame([(k, v) for k, v in keys.items()], "key string, verdict string")
    # the listed keys belong to the universe even if no URL has them
    universe = stored(rows.select(F.explode("keys").alias("key")).union(listed.select("key")).distinct(), "universe")
    n, blocked = universe.count(), [k for k, v in keys.items() if v == "block"]
    any_rule = build(listed.select("key"), universe, len(keys), n)
    block = build(listed.where("verdict = 'block'").select("key"), universe, len(blocked), n)
    discard(universe)
    rule = F.element_at(F.filter("keys", lambda k: member(any_rule, k)), 1)
    fits = F.when(F.size(F.filter("keys", lambda k: member(any_rule, k))) > 0, rule)
    rows = rows.withColumn("rule", fits)
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(member(block, F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
