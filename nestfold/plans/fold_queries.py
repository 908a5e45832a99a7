"""Fold assignment and identities (FLD, ID, JOI5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import attach_row, hash_word, key_hash
from ..operators import align as A, folds as D, identity as I
from ..session import cut_lineage
from ..sources.cohorts import MODALITIES, ORDERS_FEATURES, orders_cohort, table
from .registry import COHORT_SQL, INNER_SQL, MEMBERS_SQL, folds_sql, query, words_sql

LABEL_SQL = "cohort AS (SELECT o_orderkey::VARCHAR AS sample_id, (o_orderstatus = 'F')::INT AS y FROM orders)"


def orders_labels(spark, sf_dir):
    """``(sample_id, y)`` straight from the orders scan: three columns are read."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("sample_id"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"),
    )


def orders_folds(spark, sf_dir):
    return D.repeated_kfold(orders_labels(spark, sf_dir))


@query(
    "joi5_partition_materialisation",
    f"""WITH {COHORT_SQL}, {folds_sql()}, {MEMBERS_SQL}
SELECT m.repeat_id, m.fold_id, m.role, count(*) AS n_rows, round(sum(c.mdm[1]), 3) AS price_sum, count(c.mge[1]) AS n_q
FROM members m JOIN cohort c USING (sample_id) GROUP BY ALL""",
)
def joi5(spark, sf_dir):
    cohort = orders_cohort(spark, sf_dir)
    # joined once per repeat; the copies per coordinate are made after the join
    rows = D.with_roles(A.materialise_partition(cohort, orders_folds(spark, sf_dir)))
    return rows.groupBy("repeat_id", "fold_id", "role").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.sum(F.col("mdm")[0]), 3).alias("price_sum"),
        F.count(F.col("mge")[0]).alias("n_q"),
    )


@query("fld1_repeated_stratified_kfold", f"WITH {LABEL_SQL}, {folds_sql()} SELECT repeat_id, fold_id, sample_id, y FROM folds")
def fld1(spark, sf_dir):
    return orders_folds(spark, sf_dir)


@query(
    "fld2_nested_inner_kfold",
    f"""WITH {LABEL_SQL}, {folds_sql()}, {MEMBERS_SQL}, {INNER_SQL}
SELECT repeat_id, fold_id, inner_fold_id, y, count(*) AS n, sum(sample_id::BIGINT)::BIGINT AS key_sum, min(sample_id) AS first_id, max(sample_id) AS last_id
FROM inner_folds GROUP BY ALL""",
)
def fld2(spark, sf_dir):
    inner = D.inner_folds(orders_folds(spark, sf_dir))
    return inner.groupBy("repeat_id", "fold_id", "inner_fold_id", "y").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("sample_id").cast("bigint")).alias("key_sum"),
        F.min("sample_id").alias("first_id"),
        F.max("sample_id").alias("last_id"),
    )


@query(
    "fld3_fit_stop_split",
    f"""WITH {LABEL_SQL}, {folds_sql()}, {MEMBERS_SQL},
s AS (SELECT repeat_id, fold_id, sample_id, y,
  row_number() OVER (PARTITION BY repeat_id, fold_id, y ORDER BY sha256('7|' || repeat_id || '|' || fold_id || '|' || sample_id)) AS rk,
  count(*) OVER (PARTITION BY repeat_id, fold_id, y) AS n FROM members WHERE role = 'train')
SELECT repeat_id, fold_id, y, CASE WHEN rk <= round(n * 0.2) THEN 'stop' ELSE 'fit' END AS part, count(*) AS n, sum(sample_id::BIGINT)::BIGINT AS key_sum
FROM s GROUP BY ALL""",
)
def fld3(spark, sf_dir):
    # the split reads its rows three times
    train = D.membership(cut_lineage(orders_folds(spark, sf_dir))).filter("role = 'train'").drop("role")
    split = D.shuffle_split(train, ["repeat_id", "fold_id"], seed=7)
    return split.groupBy("repeat_id", "fold_id", "y", "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("sample_id").cast("bigint")).alias("key_sum")
    )


@query(
    "fld4_stratified_holdout",
    f"""WITH {LABEL_SQL}, s AS (SELECT sample_id, y, row_number() OVER (PARTITION BY y ORDER BY sha256('42|' || sample_id)) AS rk, count(*) OVER (PARTITION BY y) AS n FROM cohort)
SELECT sample_id, y, CASE WHEN rk <= round(n * 0.2) THEN 'stop' ELSE 'fit' END AS part FROM s""",
)
def fld4(spark, sf_dir):
    return D.shuffle_split(orders_labels(spark, sf_dir), [], seed=42).select("sample_id", "y", "part")


def _plain_sql(k, out):
    return f"""SELECT {k}::INT AS n_splits, ((row_number() OVER (ORDER BY sha256('42|0|' || sample_id)) - 1) % {k})::INT AS fold_id, sample_id FROM cohort"""


@query("fld5_plain_kfold", f"WITH {LABEL_SQL} {_plain_sql(10, 'a')} UNION ALL {_plain_sql(5, 'b')}")
def fld5(spark, sf_dir):
    labels = orders_labels(spark, sf_dir)
    out = None
    for k in (10, 5):
        part = D.repeated_kfold(labels, n_splits=k, n_repeats=1, stratified=False)
        part = part.select(F.lit(k).alias("n_splits"), "fold_id", "sample_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "fld6_fold_manifest",
    f"""WITH {LABEL_SQL}, {folds_sql()}, {MEMBERS_SQL}
SELECT repeat_id, fold_id, role, count(*) AS sample_count, count(*) FILTER (WHERE y = 0) AS n_class0, count(*) FILTER (WHERE y = 1) AS n_class1,
 {words_sql("sha256(sample_id)")} AS ids_sha256 FROM members GROUP BY repeat_id, fold_id, role""",
)
def fld6(spark, sf_dir):
    return D.manifest(orders_folds(spark, sf_dir))


@query(
    "fld7_outer_validation",
    f"""WITH {LABEL_SQL}, {folds_sql()}, {MEMBERS_SQL},
per AS (SELECT c.sample_id, count(f.repeat_id) AS n, count(DISTINCT f.repeat_id) AS r FROM cohort c FULL JOIN folds f USING (sample_id) GROUP BY 1),
sz AS (SELECT repeat_id, fold_id, role, count(*) FILTER (WHERE y = 0) AS c0, count(*) FILTER (WHERE y = 1) AS c1 FROM members GROUP BY ALL)
SELECT 'each_sample_once_per_repeat' AS rule, count(*) FILTER (WHERE n <> 5 OR r <> 5) AS violations FROM per
UNION ALL SELECT 'unknown_sample', count(*) FROM folds WHERE sample_id NOT IN (SELECT sample_id FROM cohort)
UNION ALL SELECT 'fold_id_in_range', count(*) FILTER (WHERE fold_id < 0 OR fold_id >= 5) FROM folds
UNION ALL SELECT 'both_classes_in_every_part', count(*) FILTER (WHERE c0 = 0 OR c1 = 0) FROM sz
UNION ALL SELECT 'all_parts_present', 50 - count(*) FROM sz""",
)
def fld7(spark, sf_dir):
    return D.validate_folds(orders_labels(spark, sf_dir), orders_folds(spark, sf_dir))


@query(
    "fld8_inner_validation",
    f"""WITH {LABEL_SQL}, {folds_sql()}, {MEMBERS_SQL}, {INNER_SQL},
tr AS (SELECT repeat_id, fold_id, sample_id FROM members WHERE role = 'train'), te AS (SELECT repeat_id, fold_id, sample_id FROM members WHERE role = 'test')
SELECT 'inner_outside_train' AS rule, (SELECT count(*) FROM inner_folds i ANTI JOIN tr USING (repeat_id, fold_id, sample_id)) AS violations
UNION ALL SELECT 'inner_meets_test', (SELECT count(*) FROM inner_folds i SEMI JOIN te USING (repeat_id, fold_id, sample_id))
UNION ALL SELECT 'train_not_covered', (SELECT count(*) FROM tr ANTI JOIN inner_folds USING (repeat_id, fold_id, sample_id))
UNION ALL SELECT 'validated_more_than_once', (SELECT count(*) FROM (SELECT 1 FROM inner_folds GROUP BY repeat_id, fold_id, sample_id HAVING count(*) > 1))
UNION ALL SELECT 'class_missing_in_inner_fold', (SELECT count(*) FROM (SELECT 1 FROM inner_folds GROUP BY repeat_id, fold_id, inner_fold_id HAVING count(DISTINCT y) < 2))""",
)
def fld8(spark, sf_dir):
    folds = cut_lineage(orders_folds(spark, sf_dir))
    return D.validate_inner(folds, D.inner_folds(folds, written=True))


@query(
    "fld9_coordinate_plan",
    f"""WITH {LABEL_SQL}, {folds_sql()}
SELECT (r.r)::INT AS repeat_id, (k.f)::INT AS fold_id, (r.r * 5 + k.f)::INT AS coordinate, (SELECT count(*) FROM folds x WHERE x.repeat_id = r.r AND x.fold_id = k.f) AS n_test
FROM range(5) r(r), range(5) k(f)""",
)
def fld9(spark, sf_dir):
    """The planned coordinates with the number of rows each will score."""
    sizes = orders_folds(spark, sf_dir).groupBy("repeat_id", "fold_id").agg(F.count(F.lit(1)).alias("n_test"))
    plan = D.coordinate_plan(spark=spark)
    return plan.join(sizes, ["repeat_id", "fold_id"], "left").select(
        "repeat_id",
        "fold_id",
        (F.col("repeat_id") * 5 + F.col("fold_id")).cast("int").alias("coordinate"),
        F.coalesce("n_test", F.lit(0)).alias("n_test"),
    )


@query(
    "fld10_partition_feasibility",
    f"""WITH {LABEL_SQL}, {folds_sql()}, {MEMBERS_SQL}, s AS (SELECT repeat_id, fold_id, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1 FROM members WHERE role = 'train' GROUP BY ALL),
b AS (SELECT *, (least(500, n0, n1) // 10) * 10 AS batch FROM s)
SELECT repeat_id, fold_id, n0 AS n_class0, n1 AS n_class1, n0 <> n1 AS strictly_imbalanced, batch::BIGINT AS batch_size, batch >= 10 AND batch % 2 = 0 AND n0 <> n1 AS feasible FROM b""",
)
def fld10(spark, sf_dir):
    return D.feasibility(orders_folds(spark, sf_dir))


@query(
    "fld11_bootstrap_resample",
    f"""WITH {LABEL_SQL}, m AS (SELECT * FROM cohort WHERE y = 1), t AS (SELECT count(*) AS n FROM m),
rk AS (SELECT sample_id, y, row_number() OVER (ORDER BY sha256('5|order|' || sample_id)) AS r FROM m),
d AS (SELECT i AS draw, (('0x' || substr(sha256('5|' || i), 1, 8))::BIGINT % n) + 1 AS r FROM t, LATERAL (SELECT unnest(range(n)) AS i))
SELECT draw, sample_id, y FROM d JOIN rk USING (r)""",
)
def fld11(spark, sf_dir):
    minority = orders_labels(spark, sf_dir).filter("y = 1")
    return D.bootstrap(minority, minority.count(), seed=5)


@query(
    "id1_id_set_identity",
    f"""WITH {LABEL_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY sample_id::BIGINT) AS pos FROM cohort)
SELECT y, {words_sql("sha256(sample_id)")} AS set_sha256, {words_sql("sha256(pos || '|' || sample_id)")} AS list_sha256 FROM p GROUP BY y""",
)
def id1(spark, sf_dir):
    from ..operators.ranking import prefix_sums

    labels = orders_labels(spark, sf_dir)
    keyed = labels.select("y", F.col("sample_id").cast("bigint").alias("k"), F.lit(1).cast("bigint").alias("one"))
    placed = prefix_sums(keyed, ["y"], "k", ["one"]).select("y", F.col("k").cast("string").alias("sample_id"), F.col("cum_one").alias("pos"))
    sets = I.set_identity(labels, ["y"], "sample_id", "set_sha256")
    return sets.join(I.list_identity(placed, ["y"], "sample_id", "pos", "list_sha256"), "y")


def _content_sql(m, names):
    text = ",".join(names)
    return f"""SELECT '{m}' AS modality, '{text}' AS names, sha256(sample_id || '|' || array_to_string(list_transform({m}, lambda v: coalesce(round(v * 1000000000.0)::BIGINT::VARCHAR, 'null')), ',')) AS d FROM cohort"""


@query(
    "id2_matrix_content_identity",
    f"""WITH {COHORT_SQL}, h AS ({" UNION ALL ".join(_content_sql(m, ns) for m, ns in ORDERS_FEATURES.items())}),
g AS (SELECT modality, names, count(*) AS row_count, {words_sql("d")} AS content FROM h GROUP BY ALL)
SELECT modality, row_count, len(string_split(names, ','))::INT AS feature_count, sha256(names) AS schema_sha256, sha256(names || '|' || row_count || '|' || content) AS content_sha256 FROM g""",
)
def id2(spark, sf_dir):
    # the cohort's features are defined to nine decimals
    return I.matrix_identity(orders_cohort(spark, sf_dir), MODALITIES, ORDERS_FEATURES, digits=9)


def run_provenance(cohort):
    """One row binding data, label, schema and protocol identities."""
    matrices = I.matrix_identity(cohort, MODALITIES, ORDERS_FEATURES)
    one = matrices.groupBy().agg(
        *[F.max(F.when(F.col("modality") == m, F.col("content_sha256"))).alias(f"{m}_sha256") for m in MODALITIES],
        *[F.max(F.when(F.col("modality") == m, F.col("schema_sha256"))).alias(f"{m}_schema_sha256") for m in MODALITIES],
    )
    labels = cohort.select(F.concat_ws("|", "sample_id", "y").alias("t"))
    bound = I.set_identity(labels.withColumn("_one", F.lit(1)), ["_one"], "t", "label_sha256")
    protocol = key_hash(D.OUTER_SPLITS, D.OUTER_REPEATS, D.INNER_SPLITS, D.OUTER_SEED, D.INNER_SEED_BASE)
    joined = attach_row(one, bound.drop("_one")).withColumn("protocol_sha256", protocol)
    return joined.withColumn("run_sha256", key_hash(*[F.col(c) for c in joined.columns]))


@query("id3_run_provenance")
def id3(spark, sf_dir):
    """The record computed twice from the tables, compared field by field."""
    first = run_provenance(orders_cohort(spark, sf_dir))
    again = run_provenance(orders_cohort(spark, sf_dir).repartition(13, "sample_id"))
    paired = attach_row(first, again.select(*[F.col(c).alias(f"_{c}") for c in first.columns]))
    same = F.lit(True)
    for c in first.columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return paired.select(*first.columns, same.alias("recomputed_equal"))


@query(
    "id4_derived_seeds",
    f"""WITH {LABEL_SQL}, {folds_sql()}, n AS (SELECT repeat_id, fold_id, count(*) AS n_test FROM folds GROUP BY ALL)
SELECT repeat_id, fold_id, component, ('0x' || substr(sha256('42|' || repeat_id || '|' || fold_id || '|' || component || '|' || n_test), 1, 8))::BIGINT AS seed
FROM n, (VALUES ('split'), ('encoder'), ('synthesiser'), ('classifier')) c(component)""",
)
def id4(spark, sf_dir):
    """Every component seed of every coordinate, bound to the data by the fold size."""
    sizes = orders_folds(spark, sf_dir).groupBy("repeat_id", "fold_id").agg(F.count(F.lit(1)).alias("n_test"))
    names = F.explode(F.array(*[F.lit(c) for c in ("split", "encoder", "synthesiser", "classifier")]))
    keyed = sizes.withColumn("component", names)
    seed = I.derived_seed(42, F.col("repeat_id"), F.col("fold_id"), F.col("component"), F.col("n_test"))
    return keyed.select("repeat_id", "fold_id", "component", seed.alias("seed"))
