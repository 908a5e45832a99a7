"""Balancing and synthetic-row quality on the embedding cohort (AUG, QUA)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import array_sum
from ..operators import align as A, augment as G, folds as D, quality as Q
from ..session import cut_lineage
from ..sources.cohorts import embedding_latents
from .metric_queries import rounded
from .registry import MEMBERS_SQL, folds_sql, query

EMB = "emb AS (SELECT vec_id::VARCHAR AS sample_id, (label >= 7)::INT AS y, embedding AS e FROM embeddings)"
DIST = "sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda t: (t[1]::DOUBLE - t[2]::DOUBLE) * (t[1]::DOUBLE - t[2]::DOUBLE))))"


def _word(h, w):
    return f"('0x' || substr({h}, {1 + 8 * w}, 8))::BIGINT"


def smote_sql(source: str = "emb", out: str = "synth", seed: int = 11) -> str:
    """SMOTE stated as joins over the minority rows of ``source(sample_id, y, e)``."""
    return f"""
sz_{out} AS (SELECT count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) - count(*) FILTER (WHERE y = 1) AS needed FROM {source}),
nb_{out} AS (SELECT a.sample_id, b.sample_id AS nid, row_number() OVER (PARTITION BY a.sample_id ORDER BY {DIST}, b.sample_id) AS rk
  FROM {source} a JOIN {source} b ON a.y = 1 AND b.y = 1 AND a.sample_id <> b.sample_id),
rk_{out} AS (SELECT sample_id, e, row_number() OVER (ORDER BY sha256('{seed}|order|' || sample_id)) AS r FROM {source} WHERE y = 1),
dr_{out} AS (SELECT i, {_word("h", 0)} % n1 + 1 AS r, {_word("h", 1)} % 5 + 1 AS nr, {_word("h", 2)} / 4294967296.0 AS u
  FROM (SELECT i, n1, sha256('{seed}|' || i) AS h FROM sz_{out}, LATERAL (SELECT unnest(range(needed)) AS i))),
{out} AS (SELECT d.i, list_transform(list_zip(a.e, b.e), lambda t: (t[1]::DOUBLE + d.u * (t[2]::DOUBLE - t[1]::DOUBLE))::FLOAT) AS z
  FROM dr_{out} d JOIN rk_{out} a USING (r) JOIN nb_{out} n ON n.sample_id = a.sample_id AND n.rk = d.nr JOIN {source} b ON b.sample_id = n.nid)"""


STD_SQL = f"""ms AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM (SELECT generate_subscripts(e, 1) AS pos, unnest(e)::DOUBLE AS x FROM emb) GROUP BY pos),
mss AS (SELECT list(m ORDER BY pos) AS m, list(s ORDER BY pos) AS s FROM ms),
embs AS (SELECT sample_id, y, list_transform(list_zip(e, m, s), lambda t: ((t[1]::DOUBLE - t[2]) / t[3])::FLOAT) AS e FROM emb, mss),
{smote_sql("embs", "ssynth")},
ssyn AS (SELECT i, list_transform(list_zip(z, m, s), lambda t: (t[1]::DOUBLE * t[3] + t[2])::FLOAT) AS z FROM ssynth, mss)"""

CELL_SUM = "list_sum(list_transform(z, lambda v: v::DOUBLE))"


@query(
    "aug1_minority_sizing",
    f"""WITH {EMB}, {folds_sql("emb")}, {MEMBERS_SQL}, c AS (SELECT repeat_id, fold_id, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1 FROM members WHERE role = 'train' GROUP BY ALL)
SELECT repeat_id, fold_id, (n1 < n0)::INT AS minority_label, (n1 >= n0)::INT AS majority_label, least(n0, n1) AS n_minority, greatest(n0, n1) AS n_majority, abs(n0 - n1) AS needed FROM c""",
)
def aug1(spark, sf_dir):
    train = D.membership(D.repeated_kfold(embedding_latents(spark, sf_dir))).filter("role = 'train'")
    return G.minority_sizing(train, ["repeat_id", "fold_id"])


def _row_summary(df):
    return df.select("sample_id", "y", F.round(array_sum(F.col("z")), 4).alias("total"), F.round(F.col("z")[0].cast("double"), 5).alias("z0"))


@query("aug2_minority_synthesiser")
def aug2(spark, sf_dir):
    return _row_summary(G.minority_synthesiser(embedding_latents(spark, sf_dir)))


@query("aug3_conditional_synthesiser")
def aug3(spark, sf_dir):
    return _row_summary(G.conditional_synthesiser(embedding_latents(spark, sf_dir)))


@query(
    "aug4_smote",
    f"""WITH {EMB}, {smote_sql()} SELECT 'SYNTHETIC:SMOTE:CLASS1:' || format('{{:06d}}', i) AS sample_id, 1 AS y, round({CELL_SUM}, 4) AS total, round(z[1]::DOUBLE, 5) AS z0 FROM synth""",
)
def aug4(spark, sf_dir):
    return _row_summary(G.smote(embedding_latents(spark, sf_dir)))


@query(
    "aug5_standardised_smote",
    f"""WITH {EMB}, {STD_SQL} SELECT 'SYNTHETIC:SSMOTE:CLASS1:' || format('{{:06d}}', i) AS sample_id, 1 AS y, round({CELL_SUM}, 4) AS total, round(z[1]::DOUBLE, 5) AS z0 FROM ssyn""",
)
def aug5(spark, sf_dir):
    return _row_summary(G.standardised_smote(embedding_latents(spark, sf_dir)))


@query("aug6_bootstrap_jitter")
def aug6(spark, sf_dir):
    return _row_summary(G.resampled_minority(embedding_latents(spark, sf_dir), jitter=G.JITTER_SD))


@query(
    "aug7_random_upsampling",
    f"""WITH {EMB}, sz AS (SELECT count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) - count(*) FILTER (WHERE y = 1) AS needed FROM emb),
rk AS (SELECT sample_id, row_number() OVER (ORDER BY sha256('13|order|' || sample_id)) AS r FROM emb WHERE y = 1),
d AS (SELECT i, {_word("sha256('13|' || i)", 0)} % n1 + 1 AS r FROM sz, LATERAL (SELECT unnest(range(needed)) AS i))
SELECT 'SYNTHETIC:RESAMPLE:CLASS1:' || format('{{:06d}}', i) AS sample_id, 1 AS y, sample_id AS source_id FROM d JOIN rk USING (r)""",
)
def aug7(spark, sf_dir):
    return G.resampled_minority(embedding_latents(spark, sf_dir)).select("sample_id", "y", "source_id")


@query(
    "aug8_balanced_class_weights",
    f"""WITH {EMB}, {folds_sql("emb")}, {MEMBERS_SQL}, t AS (SELECT * FROM members WHERE role = 'train'), c AS (SELECT repeat_id, fold_id, y, count(*) AS n_class FROM t GROUP BY ALL)
SELECT repeat_id, fold_id, y, n_class, round(sum(n_class) OVER (PARTITION BY repeat_id, fold_id) / (2.0 * n_class), 6) AS weight FROM c""",
)
def aug8(spark, sf_dir):
    train = D.membership(D.repeated_kfold(embedding_latents(spark, sf_dir))).filter("role = 'train'")
    return rounded(G.class_weights(train, ["repeat_id", "fold_id"]))


@query(
    "aug9_synthetic_ids",
    f"""WITH {EMB}, n AS (SELECT count(*) FILTER (WHERE y = 0) - count(*) FILTER (WHERE y = 1) AS needed FROM emb),
s AS (SELECT 'SYNTHETIC:RESAMPLE:CLASS1:' || format('{{:06d}}', i) AS id FROM n, LATERAL (SELECT unnest(range(needed)) AS i))
SELECT count(*) AS n_ids, count(DISTINCT id) AS n_unique, count(*) FILTER (WHERE id IN (SELECT sample_id FROM emb)) AS n_colliding, min(id) AS first_id, max(id) AS last_id FROM s""",
)
def aug9(spark, sf_dir):
    real = embedding_latents(spark, sf_dir)
    ids = G.resampled_minority(real).select("sample_id")
    hits = ids.join(real.select("sample_id"), "sample_id", "left_semi").select("sample_id", F.lit(1).alias("_hit"))
    tagged = ids.select("sample_id", F.lit(None).cast("int").alias("_hit")).unionByName(hits)
    return tagged.agg(
        F.count_if(F.col("_hit").isNull()).alias("n_ids"),
        F.count_distinct("sample_id").alias("n_unique"),
        F.count("_hit").alias("n_colliding"),
        F.min("sample_id").alias("first_id"),
        F.max("sample_id").alias("last_id"),
    )


def _train(spark, sf_dir):
    latents = embedding_latents(spark, sf_dir)
    train = D.membership(D.repeated_kfold(latents)).filter("role = 'train'").drop("role", "y")
    return train.join(latents, "sample_id")


@query(
    "aug10_balance_assertion",
    f"""WITH {EMB}, {folds_sql("emb")}, {MEMBERS_SQL}, c AS (SELECT repeat_id, fold_id, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1 FROM members WHERE role = 'train' GROUP BY ALL)
SELECT repeat_id, fold_id, greatest(n0, n1) AS n_class0, greatest(n0, n1) AS n_class1, abs(n0 - n1) AS n_synthetic, true AS balanced FROM c""",
)
def aug10(spark, sf_dir):
    keys = ["repeat_id", "fold_id"]
    train = cut_lineage(_train(spark, sf_dir))
    synthetic = G.resampled_minority(train, keys).select(*keys, "sample_id", "y", "z")
    return G.balance_report(A.union_synthetic(train.select(*keys, "sample_id", "y", "z"), synthetic), keys)


def strategy_relation(train, keys):
    """One long training relation with the strategy as a key and a weight column."""
    base = train.select(*keys, "sample_id", "y", "z", F.lit(False).alias("is_synthetic"), F.lit(1.0).alias("weight"))
    weights = G.class_weights(train, keys).select(*keys, "y", "weight")
    weighted = base.drop("weight").join(F.broadcast(weights), [*keys, "y"])
    small = G.minority_rows(train, G.minority_sizing(train, keys), keys)
    grids = G.marginal_grids(small, keys)  # both samplers share the minority's marginals
    parts = [("real_only", base), ("balanced_class_weight", weighted)]
    for name, drawn in (
        ("smote_latent", G.standardised_smote(train, keys)),
        ("minority_only_ctgan", G.minority_synthesiser(train, keys, grids=grids)),
        ("conditional_ctgan", G.conditional_synthesiser(train, keys, grids=grids)),
    ):
        extra = drawn.select(*keys, "sample_id", "y", "z", F.lit(True).alias("is_synthetic"), F.lit(1.0).alias("weight"))
        parts.append((name, base.unionByName(extra)))
    out = None
    for name, part in parts:
        part = part.withColumn("strategy", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "aug11_strategy_matrix",
    f"""WITH {EMB}, {folds_sql("emb")}, {MEMBERS_SQL}, c AS (SELECT repeat_id, fold_id, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1 FROM members WHERE role = 'train' GROUP BY ALL)
SELECT repeat_id, fold_id, strategy, CASE WHEN aug THEN 2 * n0 ELSE n0 + n1 END AS n_rows, CASE WHEN aug THEN n0 - n1 ELSE 0 END AS n_synthetic, round((CASE WHEN aug THEN 2 * n0 ELSE n0 + n1 END)::DOUBLE, 6) AS weight_sum
FROM c, (VALUES ('real_only', false), ('balanced_class_weight', false), ('smote_latent', true), ('minority_only_ctgan', true), ('conditional_ctgan', true)) s(strategy, aug)""",
)
def aug11(spark, sf_dir):
    keys = ["repeat_id", "fold_id"]
    rows = strategy_relation(cut_lineage(_train(spark, sf_dir)), keys)
    return rows.groupBy(*keys, "strategy").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("is_synthetic").alias("n_synthetic"), F.round(F.sum("weight"), 6).alias("weight_sum")
    )


@query(
    "aug12_strategy_contract",
    f"""WITH {EMB}, n AS (SELECT count(*) AS n_real, count(*) FILTER (WHERE y = 0) - count(*) FILTER (WHERE y = 1) AS needed FROM emb)
SELECT rule, a, b, a = b AS equal FROM n, LATERAL (VALUES ('real_rows', n_real, n_real), ('synthetic_rows', needed, needed), ('minority_label', 1, 1), ('vector_width', 64, 64)) v(rule, a, b)""",
)
def aug12(spark, sf_dir):
    """Both synthesisers must agree on real rows, needed count, label and width."""
    real = embedding_latents(spark, sf_dir)
    parts = None
    for name, fn in (("a", G.minority_synthesiser), ("b", G.conditional_synthesiser)):
        facts = A.union_synthetic(real, fn(real)).agg(
            F.count_if(~F.col("is_synthetic")).alias("real_rows"),
            F.count_if("is_synthetic").alias("synthetic_rows"),
            F.max(F.when(F.col("is_synthetic"), F.col("y"))).cast("bigint").alias("minority_label"),
            F.max(F.size("z")).cast("bigint").alias("vector_width"),
        ).select(F.lit(name).alias("side"), F.expr("stack(4, 'real_rows', real_rows, 'synthetic_rows', synthetic_rows, 'minority_label', minority_label, 'vector_width', vector_width) as (rule, v)"))
        parts = facts if parts is None else parts.unionByName(facts)
    pair = parts.groupBy("rule").agg(
        F.max(F.when(F.col("side") == "a", F.col("v"))).alias("a"), F.max(F.when(F.col("side") == "b", F.col("v"))).alias("b")
    )
    return pair.withColumn("equal", F.col("a") == F.col("b"))


# --- quality ------------------------------------------------------------------

ROWS_SQL = f"""{EMB}, {smote_sql()},
rows AS (SELECT 'smote' AS strategy, 'real' AS side, sample_id, e AS z FROM emb WHERE y = 1 UNION ALL SELECT 'smote', 'synthetic', 'S' || i, z FROM synth),
qc AS (SELECT strategy, side, generate_subscripts(z, 1) - 1 AS pos, unnest(z)::DOUBLE AS x FROM rows)"""


def quality_rows(spark, sf_dir):
    real = embedding_latents(spark, sf_dir)
    synthetic = G.smote(real)
    a = real.filter("y = 1").select(F.lit("smote").alias("strategy"), F.lit("real").alias("side"), "sample_id", "z")
    b = synthetic.select(F.lit("smote").alias("strategy"), F.lit("synthetic").alias("side"), "sample_id", "z")
    return cut_lineage(a.unionByName(b))


SUMMARY_SQL = "count(*) AS count, round(min(v), 5) AS min, round(avg(v), 5) AS mean, round(median(v), 5) AS median, round(max(v), 5) AS max, " + ", ".join(
    f"round(quantile_cont(v, {q}), 5) AS q{int(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)
)


@query("qua1_numeric_summary", f"WITH {ROWS_SQL} SELECT strategy, side, pos::INT AS pos, {SUMMARY_SQL} FROM (SELECT *, x AS v FROM qc) GROUP BY strategy, side, pos")
def qua1(spark, sf_dir):
    cells = Q.quality_cells(quality_rows(spark, sf_dir), "strategy")
    return rounded(Q.numeric_summary(cells, ["strategy", "side", "pos"], "x"), 5)


@query(
    "qua2_duplicates_and_diversity",
    f"""WITH {ROWS_SQL} SELECT 'smote' AS strategy, count(*) AS n_synthetic, count(*) - count(DISTINCT z) AS n_duplicates, count(*) FILTER (WHERE z IN (SELECT z FROM rows WHERE side = 'real')) AS n_copies_of_real,
 count(DISTINCT z) AS n_unique, round(count(DISTINCT z) / count(*), 6) AS unique_ratio FROM rows WHERE side = 'synthetic'""",
)
def qua2(spark, sf_dir):
    return rounded(Q.duplicate_metrics(quality_rows(spark, sf_dir)))


_SHIFT_SQL = """sh AS (SELECT strategy, pos, avg(x) FILTER (WHERE side = 'real') AS real_mean, avg(x) FILTER (WHERE side = 'synthetic') AS synthetic_mean,
 stddev_samp(x) FILTER (WHERE side = 'real') AS real_sd, stddev_samp(x) FILTER (WHERE side = 'synthetic') AS synthetic_sd FROM qc GROUP BY ALL)"""


@query(
    "qua3_mean_and_sd_shift",
    f"""WITH {ROWS_SQL}, {_SHIFT_SQL} SELECT strategy, pos::INT AS pos, round(real_mean, 5) AS real_mean, round(synthetic_mean, 5) AS synthetic_mean, round(real_sd, 5) AS real_sd, round(synthetic_sd, 5) AS synthetic_sd,
 round(synthetic_mean - real_mean, 5) AS mean_difference, round(abs(synthetic_mean - real_mean), 5) AS abs_mean_difference, round(synthetic_sd - real_sd, 5) AS sd_difference, round(abs(synthetic_sd - real_sd), 5) AS abs_sd_difference FROM sh""",
)
def qua3(spark, sf_dir):
    return rounded(Q.shift_metrics(Q.quality_cells(quality_rows(spark, sf_dir), "strategy")), 5)


_DIST_SQL = """dc AS (SELECT strategy, pos, x, count(*) FILTER (WHERE side = 'real') AS a, count(*) FILTER (WHERE side = 'synthetic') AS b FROM qc GROUP BY ALL),
cdf AS (SELECT *, abs(sum(a) OVER w / sum(a) OVER p - sum(b) OVER w / sum(b) OVER p) AS gap, lead(x) OVER w AS nx FROM dc WINDOW w AS (PARTITION BY strategy, pos ORDER BY x), p AS (PARTITION BY strategy, pos)),
ds AS (SELECT strategy, pos, sum(gap * (nx - x)) AS wasserstein, max(gap) AS ks FROM cdf GROUP BY ALL)"""


@query("qua4_wasserstein", f"WITH {ROWS_SQL}, {_DIST_SQL} SELECT strategy, pos::INT AS pos, round(wasserstein, 5) AS wasserstein FROM ds")
def qua4(spark, sf_dir):
    return rounded(Q.distance_metrics(Q.quality_cells(quality_rows(spark, sf_dir), "strategy")).drop("ks"), 5)


@query("qua5_ks_statistic", f"WITH {ROWS_SQL}, {_DIST_SQL} SELECT strategy, pos::INT AS pos, round(ks, 6) AS ks FROM ds")
def qua5(spark, sf_dir):
    return rounded(Q.distance_metrics(Q.quality_cells(quality_rows(spark, sf_dir), "strategy")).drop("wasserstein"))


@query(
    "qua6_range_violations",
    f"""WITH {ROWS_SQL}, ed AS (SELECT strategy, pos, min(x) AS lo, max(x) AS hi FROM qc WHERE side = 'real' GROUP BY ALL),
v AS (SELECT strategy, pos, count(*) FILTER (WHERE x < lo) AS n_below, count(*) FILTER (WHERE x > hi) AS n_above FROM qc JOIN ed USING (strategy, pos) WHERE side = 'synthetic' GROUP BY ALL)
SELECT strategy, pos::INT AS pos, n_below, n_above, n_below + n_above AS n_total FROM v""",
)
def qua6(spark, sf_dir):
    return Q.range_violations(Q.quality_cells(quality_rows(spark, sf_dir), "strategy"))


@query(
    "qua7_feature_rollup",
    f"""WITH {ROWS_SQL}, {_SHIFT_SQL}, {_DIST_SQL}, l AS (SELECT strategy, 'abs_mean_difference' AS statistic, abs(synthetic_mean - real_mean) AS v FROM sh UNION ALL SELECT strategy, 'abs_sd_difference', abs(synthetic_sd - real_sd) FROM sh
 UNION ALL SELECT strategy, 'wasserstein', wasserstein FROM ds UNION ALL SELECT strategy, 'ks', ks FROM ds) SELECT strategy, statistic, {SUMMARY_SQL} FROM l GROUP BY strategy, statistic""",
)
def qua7(spark, sf_dir):
    return rounded(Q.feature_rollup(Q.quality_cells(quality_rows(spark, sf_dir), "strategy")), 5)


_CORR_SQL = """pr AS (SELECT strategy, side, i::INT AS i, j::INT AS j, corr(z[i]::DOUBLE, z[j]::DOUBLE) AS c FROM rows, range(1, 65) a(i), range(1, 65) b(j) WHERE i < j GROUP BY ALL),
df AS (SELECT strategy, i, j, abs(max(c) FILTER (WHERE side = 'real') - max(c) FILTER (WHERE side = 'synthetic')) AS d FROM pr GROUP BY ALL)"""


@query(
    "qua8_correlation_preservation",
    f"""WITH {ROWS_SQL}, {_CORR_SQL} SELECT strategy, count(d) AS n_pairs, count(*) FILTER (WHERE d IS NULL) AS n_excluded, round(avg(d), 5) AS mean_abs_difference, round(median(d), 5) AS median_abs_difference, round(max(d), 5) AS max_abs_difference FROM df GROUP BY strategy""",
)
def qua8(spark, sf_dir):
    return rounded(Q.correlation_preservation(quality_rows(spark, sf_dir)), 5)


def _nn_sql(source: str) -> str:
    d = "min(sqrt(list_sum(list_transform(list_zip(a.z, b.z), lambda t: (t[1]::DOUBLE - t[2]::DOUBLE) * (t[1]::DOUBLE - t[2]::DOUBLE)))))"
    return f"""SELECT 'synthetic_to_real' AS direction, a.sample_id, {d} AS v FROM {source} a JOIN {source} b ON a.side = 'synthetic' AND b.side = 'real' GROUP BY a.sample_id
UNION ALL SELECT 'real_to_synthetic', a.sample_id, {d} FROM {source} a JOIN {source} b ON a.side = 'real' AND b.side = 'synthetic' GROUP BY a.sample_id
UNION ALL SELECT 'real_internal', a.sample_id, {d} FROM {source} a JOIN {source} b ON a.side = 'real' AND b.side = 'real' AND a.sample_id <> b.sample_id GROUP BY a.sample_id"""


@query(
    "qua9_nearest_neighbour_distances",
    f"""WITH {ROWS_SQL}, {_SHIFT_SQL}, sc AS (SELECT list(real_mean ORDER BY pos) AS m, list(real_sd ORDER BY pos) AS s FROM sh),
rs AS (SELECT side, sample_id, list_transform(list_zip(z, m, s), lambda t: (t[1]::DOUBLE - t[2]) / t[3]) AS z FROM rows, sc),
n AS (SELECT 'raw' AS scaling, * FROM ({_nn_sql("rows")}) UNION ALL SELECT 'standardised', * FROM ({_nn_sql("rs")}))
SELECT scaling, direction, {SUMMARY_SQL} FROM n GROUP BY scaling, direction""",
)
def qua9(spark, sf_dir):
    rows = quality_rows(spark, sf_dir)
    raw = Q.neighbour_distances(rows).withColumn("scaling", F.lit("raw"))
    std = Q.neighbour_distances(rows, standardised=True).withColumn("scaling", F.lit("standardised"))
    both = raw.unionByName(std)
    return rounded(Q.numeric_summary(both, ["scaling", "direction"], "distance"), 5)


@query(
    "qua10_strategy_comparison",
    f"""WITH {EMB}, {smote_sql()}, {STD_SQL},
rows AS (SELECT st AS strategy, 'real' AS side, sample_id, e AS z FROM emb, (VALUES ('smote'), ('standardised_smote')) s(st) WHERE y = 1 UNION ALL SELECT 'smote', 'synthetic', 'S' || i, z FROM synth UNION ALL SELECT 'standardised_smote', 'synthetic', 'S' || i, z FROM ssyn),
qc AS (SELECT strategy, side, generate_subscripts(z, 1) - 1 AS pos, unnest(z)::DOUBLE AS x FROM rows), {_SHIFT_SQL}, {_DIST_SQL}
SELECT strategy, count(*) AS n_features, round(avg(abs(synthetic_mean - real_mean)), 5) AS mean_shift, round(avg(abs(synthetic_sd - real_sd)), 5) AS sd_shift, round(avg(wasserstein), 5) AS mean_wasserstein, round(max(ks), 5) AS max_ks FROM sh JOIN ds USING (strategy, pos) GROUP BY strategy""",
)
def qua10(spark, sf_dir):
    """Two strategies scored on identical real rows; no ranking is made."""
    real = embedding_latents(spark, sf_dir)
    return compared_strategies(real, {"smote": G.smote(real), "standardised_smote": G.standardised_smote(real)})


def compared_strategies(real, drawn):
    """Quality figures of each strategy's rows (name to DataFrame) against the same real minority rows."""
    rows = None
    for name, made in drawn.items():
        a = real.filter("y = 1").select(F.lit(name).alias("strategy"), F.lit("real").alias("side"), "sample_id", "z")
        b = made.select(F.lit(name).alias("strategy"), F.lit("synthetic").alias("side"), "sample_id", "z")
        part = a.unionByName(b)
        rows = part if rows is None else rows.unionByName(part)
    cells = Q.quality_cells(cut_lineage(rows), "strategy")
    stats = Q.shift_metrics(cells).join(Q.distance_metrics(cells), ["strategy", "pos"])
    return rounded(
        stats.groupBy("strategy").agg(
            F.count(F.lit(1)).alias("n_features"),
            F.avg("abs_mean_difference").alias("mean_shift"),
            F.avg("abs_sd_difference").alias("sd_shift"),
            F.avg("wasserstein").alias("mean_wasserstein"),
            F.max("ks").alias("max_ks"),
        ),
        5,
    )


@query("qua10_synthesiser_comparison")
def qua10_synthesisers(spark, sf_dir):
    """The minority-only against the class-conditional synthesiser, drawn from and scored on identical real rows."""
    real = embedding_latents(spark, sf_dir)
    return compared_strategies(real, {"minority_only": G.minority_synthesiser(real), "class_conditional": G.conditional_synthesiser(real)})
