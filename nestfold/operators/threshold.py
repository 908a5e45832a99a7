"""Operating-threshold choice from cumulative counts: O(n log n), grouped by any keys."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .linear import partial_frame, sum_partials, SUM_SCHEMA
from .metrics import ranked_scores

RANGE_ROWS = 500_000  # probabilities of one key that are ranked together, about
CELLS = 4096  # counted cells of the unit interval; ranges are runs of cells


def threshold_candidates(scored: DataFrame, keys: Sequence[str], prob: str = "prob") -> DataFrame:
    """Zero and every distinct probability, per key; values outside [0, 1] are an error."""
    distinct = scored.select(*keys, F.col(prob).alias("threshold")).distinct()
    zero = scored.select(*keys).distinct().withColumn("threshold", F.lit(0.0))
    both = distinct.unionByName(zero).distinct()
    outside = (F.col("threshold") < 0) | (F.col("threshold") > 1) | F.isnan("threshold") | F.col("threshold").isNull()
    checked = F.when(outside, F.raise_error(F.lit("probability outside [0, 1]")).cast("double")).otherwise(F.col("threshold"))
    return both.select(*keys, checked.alias("threshold"))


def choose_threshold(scored: DataFrame, keys: Sequence[str], prob: str = "prob", label: str = "y") -> DataFrame:
    """Best balanced accuracy, then sensitivity, then closeness to 0.5, then smallest.

    A row is predicted positive when its probability is at least the threshold.
    """
    ranked = ranked_scores(scored, keys, prob, label)
    at = ranked.select(*keys, F.col(prob).alias("t"), "cum_pos", "cum_neg", "tot_pos", "tot_neg")
    # Threshold 0 accepts every row.
    everything = ranked.groupBy(*keys).agg(
        F.lit(0.0).alias("t"),
        F.max("tot_pos").alias("cum_pos"),
        F.max("tot_neg").alias("cum_neg"),
        F.max("tot_pos").alias("tot_pos"),
        F.max("tot_neg").alias("tot_neg"),
    )
    rows = at.unionByName(everything)
    sens = F.col("cum_pos") / F.col("tot_pos")
    spec = (F.col("tot_neg") - F.col("cum_neg")) / F.col("tot_neg")
    ba = (sens + spec) / 2
    best = F.min(
        F.struct(
            (-ba).alias("neg_ba"),
            (-sens).alias("neg_sens"),
            F.abs(F.col("t") - 0.5).alias("away"),
            F.col("t").alias("threshold"),
            F.col("cum_pos").alias("tp"),
            F.col("cum_neg").alias("fp"),
            F.col("tot_pos").alias("n_pos"),
            F.col("tot_neg").alias("n_neg"),
        )
    )
    out = rows.groupBy(*keys).agg(best.alias("b"))
    return out.select(
        *keys,
        "b.threshold",
        (-F.col("b.neg_ba")).alias("balanced_accuracy"),
        (-F.col("b.neg_sens")).alias("sensitivity"),
        (F.col("b.n_neg") - F.col("b.fp")).alias("tn"),
        "b.fp",
        (F.col("b.n_pos") - F.col("b.tp")).alias("fn"),
        "b.tp",
    )


def choose_from_blocks(blocks: DataFrame, places: Sequence[tuple], sigmoids: Sequence[tuple], keys: Sequence[tuple[str, str]], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``choose_threshold`` of packed scores (``calibrate.BLOCK_SCHEMA``, one group number per block).

    Group ``k`` belongs to the key ``places[k]`` and its probabilities come from ``sigmoids[k] = (a, b)``.
    A pass counts both classes in cells of the probability; runs of cells become ranges of about
    ``range_rows`` rows, and one task ranks a range after the counted rows of the ranges above it.
    Equal probabilities are in one cell.
    """
    spark = blocks.sparkSession
    listed = list(dict.fromkeys(places))
    number = {p: i for i, p in enumerate(listed)}
    of = np.array([number[p] for p in places])
    shared = spark.sparkContext.broadcast((of, list(sigmoids)))

    def probabilities(batch):
        of, sigmoids = shared.value
        for k, score, y in zip(batch.column("k").to_pylist(), batch.column("score").to_pylist(), batch.column("y").to_pylist()):
            k = int(np.frombuffer(k, dtype=np.int32)[0])
            a, b = sigmoids[k]
            prob = 1.0 / (1.0 + np.exp(-(a * np.frombuffer(score) + b)))
            yield of[k], prob, np.frombuffer(y) == 1, np.minimum((prob * CELLS).astype(np.int64), CELLS - 1)

    def count(batches):
        sums: dict = {}
        for batch in batches:
            for key, _, hit, cell in probabilities(batch):
                n = np.concatenate([np.bincount(cell[hit], minlength=CELLS), np.bincount(cell[~hit], minlength=CELLS)])
                sums[key] = sums[key] + n if key in sums else n
        yield pa.RecordBatch.from_pandas(partial_frame({str(k): v for k, v in sums.items()}), schema=pa.schema([("key", pa.string()), ("v", pa.list_(pa.float64()))]), preserve_index=False)

    cuts, before, totals = {}, {}, {}
    for key, v in sum_partials(blocks.mapInArrow(count, SUM_SCHEMA)).items():
        key, pos, neg = int(key), v[:CELLS], v[CELLS:]
        above = np.concatenate([[0.0], np.cumsum((pos + neg)[::-1])])[:-1]
        cuts[key] = np.unique((above // range_rows).astype(int)[::-1], return_inverse=True)[1]  # 0 holds the highest cells
        sums = [np.bincount(cuts[key], weights=n) for n in (pos, neg)]
        before[key] = [np.cumsum(n) - n for n in sums]
        totals[key] = pos.sum(), neg.sum()
    ranges = spark.sparkContext.broadcast((cuts, before, totals))

    def deal(batches):
        for batch in batches:
            out = []
            for key, prob, hit, cell in probabilities(batch):
                at = ranges.value[0][key][cell]
                out.extend((int(key), int(j), prob[at == j].tobytes(), hit[at == j].tobytes()) for j in np.unique(at))
            kinds = pa.int32(), pa.int32(), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=t) for i, t in enumerate(kinds)], ["key", "j", "prob", "hit"])

    def choose(batches):
        found: dict = {}
        for batch in batches:
            for key, j, prob, hit in zip(*[batch.column(c).to_pylist() for c in ("key", "j", "prob", "hit")]):
                found.setdefault((key, j), []).append((np.frombuffer(prob), np.frombuffer(hit, dtype=bool)))
        _, before, totals = ranges.value
        rows = []
        for key, j in list(found):
            prob, hit = (np.concatenate(v) for v in zip(*found.pop((key, j))))
            order = np.argsort(-prob)
            prob, hit = prob[order], hit[order]
            last = np.append(np.flatnonzero(prob[1:] != prob[:-1]), len(prob) - 1)
            cum_pos = np.cumsum(hit)[last].astype(float)
            cum_neg = last + 1 - cum_pos + before[key][1][j]
            rows.append((key, *_best(prob[last], cum_pos + before[key][0][j], cum_neg, *totals[key])))
        kinds = [pa.int32(), *[pa.float64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([float(r[i]) if i else r[i] for r in rows], type=t) for i, t in enumerate(kinds)], ["key", "threshold", "ba", "sens", "tp", "fp"])

    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = blocks.mapInArrow(deal, "key int, j int, prob binary, hit binary").repartition(n_tasks, "key", "j")
    best: dict = {}
    for r in dealt.mapInArrow(choose, "key int, threshold double, ba double, sens double, tp double, fp double").collect():  # one row per range
        best.setdefault(r["key"], []).append(r[1:])
    rows = []
    for key, found in sorted(best.items()):
        pos, neg = totals[key]
        found = [*found, _best(*(np.array([v]) for v in (0.0, pos, neg)), pos, neg)]  # threshold 0 accepts every row
        t, ba, sens, tp, fp = min(found, key=lambda r: (-r[1], -r[2], abs(r[0] - 0.5), r[0]))
        rows.append((*listed[key], float(t), float(ba), float(sens), int(neg - fp), int(fp), int(pos - tp), int(tp)))
    schema = ", ".join(f"{k} {kind}" for k, kind in keys)
    return spark.createDataFrame(rows, f"{schema}, threshold double, balanced_accuracy double, sensitivity double, tn bigint, fp bigint, fn bigint, tp bigint")


def _best(t: np.ndarray, pos: np.ndarray, neg: np.ndarray, tot_pos: float, tot_neg: float) -> tuple:
    """The first by balanced accuracy, sensitivity, closeness to 0.5 and size: threshold, both values, true and false positives."""
    sens, spec = pos / tot_pos, (tot_neg - neg) / tot_neg
    ba = (sens + spec) / 2
    at = np.lexsort((t, np.abs(t - 0.5), -sens, -ba))[0] if len(t) > 1 else 0
    return t[at], ba[at], sens[at], pos[at], neg[at]


def recount(scored: DataFrame, chosen: DataFrame, keys: Sequence[str], prob: str = "prob", label: str = "y") -> DataFrame:
    """Check stored choices by applying each threshold to its rows, without ranks.

    ``chosen`` has one row per key.  Returns the keys, the threshold, the recounted cells and
    ``equal``: whether cells, sensitivity and balanced accuracy agree with the stored ones.
    """
    cells = ("tn", "fp", "fn", "tp")
    stored = chosen.select(*keys, "threshold", F.struct(*cells, "sensitivity", "balanced_accuracy").alias("_stored"))
    said, real = F.col(prob) >= F.col("threshold"), F.col(label) == 1
    counted = (
        scored.select(*keys, prob, label)
        .join(stored, list(keys))
        .groupBy(*keys)
        .agg(
            F.first("threshold").alias("threshold"),
            F.first("_stored").alias("_stored"),
            F.count_if(~said & ~real).alias("tn"),
            F.count_if(said & ~real).alias("fp"),
            F.count_if(~said & real).alias("fn"),
            F.count_if(said & real).alias("tp"),
        )
    )
    sens, spec = F.col("tp") / (F.col("tp") + F.col("fn")), F.col("tn") / (F.col("tn") + F.col("fp"))
    same = (F.abs(F.col("_stored.sensitivity") - sens) < 1e-12) & (F.abs(F.col("_stored.balanced_accuracy") - (sens + spec) / 2) < 1e-12)
    for c in cells:
        same = same & (F.col(f"_stored.{c}") == F.col(c))
    return counted.select(*keys, "threshold", *cells, F.coalesce(same, F.lit(False)).alias("equal"))


def differences(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], digits: int = 9) -> DataFrame:
    """Rows of either side without an equal partner on the other (doubles rounded)."""

    def rounded(df: DataFrame) -> DataFrame:
        return df.select(
            *[
                (F.round(F.col(c), digits) if t in ("double", "float") else F.col(c)).alias(c)
                for c, t in ((f.name, f.dataType.simpleString()) for f in stored.schema.fields)
            ]
        )

    a, b = rounded(stored), rounded(recomputed)
    return (
        a.exceptAll(b).withColumn("side", F.lit("stored"))
        .unionByName(b.exceptAll(a).withColumn("side", F.lit("recomputed")))
    )
