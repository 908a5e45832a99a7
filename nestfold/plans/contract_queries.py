"""Sources, sinks, data contract and joins (SRC, SNK, CON, JOI)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions.columns import array_sum, attach_row, is_infinite, missing_to_null
from ..operators import align as A, contract as C
from ..operators.neighbours import nearest_distance
from ..sources import sinks, tables as S
from ..sources.cohorts import (
    MODALITIES,
    ORDERS_FEATURES,
    document_cohort,
    embedding_latents,
    modality_cells,
    orders_cohort,
    orders_modalities,
    table,
)
from .registry import CELLS_SQL, COHORT_SQL, MODALITY_SQL, query


def _mdm_csv(spark, sf_dir: str) -> str:
    """The order modality written as a headed CSV, as a study would receive it."""
    path = sinks.scratch_path(spark, "mdm")
    rows = orders_modalities(spark, sf_dir)["mdm"]
    wide = rows.select(
        F.col("sample_id").alias("SAMPLE_ID"),
        F.col("label_raw").alias("CLASS"),
        *[F.col("features")[i].alias(n) for i, n in enumerate(ORDERS_FEATURES["mdm"])],
    )
    sinks.write_csv(wide, path, wide.columns)
    return path


@query(
    "src1_modality_table_scan",
    f"""WITH {MODALITY_SQL}
SELECT sample_id, label_raw, features[1] AS price, features[2] AS year, features[5] AS priority FROM t_mdm""",
)
def src1(spark, sf_dir):
    scanned = S.read_modality(spark, _mdm_csv(spark, sf_dir))
    return scanned.select(
        "sample_id",
        "label_raw",
        F.col("features")[0].alias("price"),
        F.col("features")[1].alias("year"),
        F.col("features")[4].alias("priority"),
    )


@query("src2_header_contract")
def src2(spark, sf_dir):
    path = _mdm_csv(spark, sf_dir)
    names = S.read_header(spark, path)
    listed = F.array(*[F.lit(n) for n in names])
    rows = S.read_modality_text(spark, path).agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.select(F.posexplode(listed).alias("position", "column_name"), "n_rows")


@query("src3_source_fingerprint")
def src3(spark, sf_dir):
    return S.fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in ("orders", "lineitem", "customer")])


EVENT_STREAM = "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE"


@query(
    "src4_record_stream_scan",
    """SELECT event_type, count(*) AS n_records, count(DISTINCT event_id) AS n_keys, round(sum(value), 2) AS total
FROM events GROUP BY event_type""",
)
def src4(spark, sf_dir):
    path = sinks.scratch_path(spark, "events")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    sinks.write_jsonl(events, path)
    rows = S.read_records(spark, path, EVENT_STREAM, expected_count=events.count(), unique_key=["event_id"])
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_distinct("event_id").alias("n_keys"),
        F.round(F.sum("value"), 2).alias("total"),
    )


@query("snk1_jsonl_sink")
def snk1(spark, sf_dir):
    path = sinks.scratch_path(spark, "jsonl")
    sinks.write_jsonl(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path)
    return spark.read.text(path)


@query("snk2_csv_sink")
def snk2(spark, sf_dir):
    path = sinks.scratch_path(spark, "csv")
    rows = orders_cohort(spark, sf_dir).select("sample_id", "y", F.col("mge")[0].alias("q_sum"))
    sinks.write_csv(rows, path, ["y", "q_sum", "sample_id"])
    return spark.read.text(path)


@query("snk3_create_once_publication")
def snk3(spark, sf_dir):
    from .fold_queries import orders_folds

    root = sinks.scratch_path(spark, "study")
    folds = orders_folds(spark, sf_dir)
    path = sinks.publish_all(folds, root, "orders", "scoring")
    try:
        sinks.publish_all(folds, root, "orders", "scoring")
        refused = False
    except AnalysisException as error:  # the second write must fail on the existing folder
        refused = error.getCondition() == "PATH_ALREADY_EXISTS"
    return spark.read.parquet(path).groupBy("repeat_id", "fold_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(refused).alias("second_write_refused")
    )


@query("snk4_aggregate_report_set")
def snk4(spark, sf_dir):
    from .report_queries import report_tables

    root = sinks.scratch_path(spark, "report")
    tables = report_tables(spark, sf_dir)
    absent = "metric_summary"
    first = sinks.write_report_set({k: v for k, v in tables.items() if k != absent}, root)
    second = sinks.write_report_set(tables, root)
    out = None
    for name in sorted(tables):
        run = 1 if name in first else 2 if name in second else 0
        row = spark.read.parquet(f"{root}/aggregate/{name}").agg(F.count(F.lit(1)).alias("n_rows"))
        row = row.select(F.lit(name).alias("table_name"), "n_rows", F.lit(run).alias("written_in_run"))
        out = row if out is None else out.unionByName(row)
    return out


# --- contract ---------------------------------------------------------------


@query(
    "con1_blank_ids",
    """SELECT count(*) AS n_rows, count(*) FILTER (WHERE url IS NULL OR trim(url) = '') AS n_blank FROM pages""",
)
def con1(spark, sf_dir):
    return table(spark, sf_dir, "pages").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(C.is_blank("url")).alias("n_blank")
    )


@query(
    "con2_duplicate_ids",
    """WITH d AS (SELECT l_orderkey::VARCHAR AS sample_id, count(*) AS n_rows FROM lineitem GROUP BY 1 HAVING count(*) > 1),
tot AS (SELECT sum(n_rows)::BIGINT AS n_duplicate_rows FROM d)
SELECT sample_id, n_rows, n_duplicate_rows FROM d, tot ORDER BY sample_id LIMIT 10""",
)
def con2(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("sample_id"))
    dup = C.duplicate_ids(ids)
    total = dup.agg(F.sum("n_rows").alias("n_duplicate_rows"))
    return attach_row(dup.orderBy("sample_id").limit(10), total)


@query(
    "con3_label_domain",
    """SELECT substr(o_orderpriority, 1, 1) AS bad_label, count(*) AS n_rows FROM orders
WHERE try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE) NOT IN (1, 2) OR try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE) IS NULL GROUP BY 1""",
)
def con3(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).alias("CLASS"))
    return C.label_violations(rows, "CLASS")


@query(
    "con4_label_mapping",
    f"""WITH {MODALITY_SQL} SELECT sample_id, label_raw, (label_raw = 2)::INT AS y FROM t_mdm""",
)
def con4(spark, sf_dir):
    rows = orders_modalities(spark, sf_dir)["mdm"]
    return rows.select("sample_id", "label_raw", C.label_to_binary("label_raw").alias("y"))


@query(
    "con5_numeric_coercion",
    """WITH v AS (SELECT event_type, props::JSON->>'$.k' AS k, event_type AS t FROM events),
long AS (SELECT 'k' AS feature, k AS txt FROM v UNION ALL SELECT 'event_type', t FROM v)
SELECT feature, count(*) AS n_rows,
 count(*) FILTER (WHERE txt IS NULL OR trim(txt) = '') AS n_missing,
 count(*) FILTER (WHERE try_cast(txt AS DOUBLE) IS NULL AND NOT (txt IS NULL OR trim(txt) = '')) AS n_not_numeric,
 round(coalesce(sum(try_cast(txt AS DOUBLE)), 0), 3) AS total FROM long GROUP BY feature""",
)
def con5(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("k"), "event_type")
    long = events.select(F.expr("stack(2, 'k', k, 'event_type', event_type) as (feature, txt)"))
    number = F.col("txt").try_cast("double")
    return long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(C.is_blank("txt")).alias("n_missing"),
        F.count_if(C.unparsable(F.col("txt"))).alias("n_not_numeric"),
        F.round(F.coalesce(F.sum(number), F.lit(0.0)), 3).alias("total"),
    )


@query(
    "con6_infinity_and_nan",
    """WITH r AS (SELECT event_type, CASE WHEN value < 5 THEN 'nan'::DOUBLE WHEN value > 40 THEN 'inf'::DOUBLE ELSE value END AS v FROM events)
SELECT event_type, count(*) FILTER (WHERE isinf(v)) AS n_infinite, count(*) FILTER (WHERE isnan(v)) AS n_missing,
 round(avg(v) FILTER (WHERE NOT isnan(v) AND NOT isinf(v)), 6) AS mean_finite FROM r GROUP BY event_type""",
)
def con6(spark, sf_dir):
    v = F.col("value")
    marked = F.when(v < 5, float("nan")).when(v > 40, float("inf")).otherwise(v)
    rows = table(spark, sf_dir, "events").select("event_type", missing_to_null(marked).alias("v"))
    infinite = F.coalesce(is_infinite(F.col("v")), F.lit(False))
    return rows.groupBy("event_type").agg(
        F.count_if(infinite).alias("n_infinite"),
        F.count_if(F.col("v").isNull()).alias("n_missing"),
        F.round(F.avg(F.when(~infinite, F.col("v"))), 6).alias("mean_finite"),
    )


def _audit_sql(names):
    return " UNION ALL ".join(
        f"""SELECT '{m}' AS modality, count(*) AS n_rows, count(DISTINCT sample_id) AS n_ids, max(len(features))::BIGINT AS n_features,
 sum(len(features) - list_count(features))::BIGINT AS n_missing, 0::BIGINT AS n_duplicate_rows FROM {t}"""
        for m, t in names
    )


@query(
    "con7_table_audit",
    f"""WITH {COHORT_SQL}, a1 AS (SELECT sample_id, mge AS features FROM cohort)
{_audit_sql([("mge", "a1"), ("mdm", "t_mdm"), ("mcna", "t_mcna")])}""",
)
def con7(spark, sf_dir):
    cohort = orders_cohort(spark, sf_dir)
    parts = orders_modalities(spark, sf_dir)
    return C.table_audit(
        {"mge": cohort.select("sample_id", F.col("mge").alias("features")), "mdm": parts["mdm"], "mcna": parts["mcna"]}
    )


_NAMES_SQL = ", ".join(f"'{m}': {ns!r}" for m, ns in ORDERS_FEATURES.items())


@query(
    "con8_target_leakage_guard",
    f"""WITH {COHORT_SQL}, {CELLS_SQL},
nm AS (SELECT modality, generate_subscripts(ns, 1) - 1 AS pos, unnest(ns) AS feature FROM (VALUES
 {", ".join(f"('{m}', {ns!r})" for m, ns in ORDERS_FEATURES.items())}) v(modality, ns))
SELECT modality, feature, regexp_matches(lower(feature), 'class|sample_id|target|label|synthetic|real') OR lower(feature) = 'y' AS forbidden_name,
 round(corr(x, y), 6) AS label_corr, count(*) FILTER (WHERE x = y) AS n_equal, count(*) FILTER (WHERE x = y) = count(x) AS copies_label
FROM cells JOIN nm USING (modality, pos) GROUP BY modality, feature""",
)
def con8(spark, sf_dir):
    report = C.leakage_report(orders_cohort(spark, sf_dir), ORDERS_FEATURES)
    return report.withColumn("label_corr", F.round("label_corr", 6))


@query(
    "con9_feature_projection",
    f"""WITH {COHORT_SQL}
SELECT sample_id, len(mge)::INT AS n_mge, mdm[1] AS price, mdm[6] AS weekday, mcna[3] AS segment,
 sha256('{",".join(ORDERS_FEATURES["mdm"])}') AS schema_sha256 FROM cohort""",
)
def con9(spark, sf_dir):
    names = ORDERS_FEATURES["mdm"]
    rows = orders_cohort(spark, sf_dir)
    return rows.select(
        "sample_id",
        F.size("mge").alias("n_mge"),
        F.col("mdm")[0].alias("price"),
        F.col("mdm")[names.index("weekday")].alias("weekday"),
        F.col("mcna")[2].alias("segment"),
        F.sha2(F.lit(",".join(names)), 256).alias("schema_sha256"),
    )


@query(
    "con10_class_counts",
    """WITH dom(label) AS (VALUES (0), (1)), q AS (SELECT 1 - quality AS label, 'quality' AS kind FROM labels UNION ALL SELECT toxic, 'toxic' FROM labels)
SELECT kind, label::INT AS label, (SELECT count(*) FROM q WHERE q.kind = k.kind AND q.label = dom.label) AS n
FROM dom, (VALUES ('quality'), ('toxic')) k(kind)""",
)
def con10(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("y", 1 - F.col("quality"))
    return (
        C.class_counts(labels, "y").withColumn("kind", F.lit("quality"))
        .unionByName(C.class_counts(labels, "toxic").withColumn("kind", F.lit("toxic")))
    )


@query(
    "con11_row_completeness",
    f"""WITH {COHORT_SQL}
SELECT sample_id, round((list_count(mge) + list_count(mdm) + list_count(mcna)) / (len(mge) + len(mdm) + len(mcna))::DOUBLE, 9) AS completeness FROM cohort""",
)
def con11(spark, sf_dir):
    return orders_cohort(spark, sf_dir).select("sample_id", F.round(C.completeness(), 9).alias("completeness"))


@query(
    "con12_missingness_band",
    f"""WITH {COHORT_SQL}, c AS (SELECT (list_count(mge) + list_count(mdm) + list_count(mcna)) / (len(mge) + len(mdm) + len(mcna))::DOUBLE AS s FROM cohort)
SELECT CASE WHEN s < 0.8 THEN 'high_missingness_detected' WHEN s < 0.95 THEN 'moderate_missingness_detected' ELSE 'none' END AS band, count(*) AS n FROM c GROUP BY 1""",
)
def con12(spark, sf_dir):
    rows = orders_cohort(spark, sf_dir).select(C.missingness_band(C.completeness()).alias("band"))
    return rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


# --- joins ------------------------------------------------------------------


@query(
    "joi1_id_set_equality",
    f"""WITH {MODALITY_SQL}, miss AS (SELECT sample_id FROM t_mdm WHERE sample_id NOT IN (SELECT sample_id FROM t_mge))
SELECT 'mge' AS modality, 'missing' AS kind, count(*) AS n_ids,
 array_to_string(list_slice(list(sample_id ORDER BY sample_id), 1, 10), ',') AS first_ids FROM miss HAVING count(*) > 0
UNION ALL
SELECT 'mcna', 'missing', count(*), array_to_string(list_slice(list(sample_id ORDER BY sample_id), 1, 10), ',')
FROM t_mdm WHERE sample_id NOT IN (SELECT sample_id FROM t_mcna) HAVING count(*) > 0""",
)
def joi1(spark, sf_dir):
    return A.difference_report(A.id_set_differences(orders_modalities(spark, sf_dir), "mdm"))


@query(
    "joi2_three_way_align",
    f"""WITH {MODALITY_SQL}
SELECT g.sample_id, g.features[1] AS q_sum, d.features[1] AS price, c.features[1] AS balance
FROM t_mge g JOIN t_mdm d USING (sample_id) JOIN t_mcna c USING (sample_id)""",
)
def joi2(spark, sf_dir):
    rows = A.align(orders_modalities(spark, sf_dir))
    return rows.select(
        "sample_id",
        F.col("mge")[0].alias("q_sum"),
        F.col("mdm")[0].alias("price"),
        F.col("mcna")[0].alias("balance"),
    )


@query(
    "joi3_label_agreement",
    f"""WITH {MODALITY_SQL}
SELECT g.sample_id, g.label_raw AS label_mge, CASE WHEN c.features[1] < 0 THEN 1 ELSE c.label_raw END AS label_mcna
FROM t_mge g JOIN t_mcna c USING (sample_id) WHERE g.label_raw <> CASE WHEN c.features[1] < 0 THEN 1 ELSE c.label_raw END""",
)
def joi3(spark, sf_dir):
    """The third table relabels customers in debt as class 1; the disagreeing ids are listed."""
    parts = orders_modalities(spark, sf_dir)
    relabelled = F.when(F.col("features")[0] < 0, 1).otherwise(F.col("label_raw"))
    parts["mcna"] = parts["mcna"].withColumn("label_raw", relabelled)
    bad = A.label_disagreements(A.align(parts), list(parts))
    return bad.select("sample_id", "label_mge", "label_mcna")


@query(
    "joi4_common_ids",
    f"""WITH {MODALITY_SQL}
SELECT sample_id FROM t_mge INTERSECT SELECT sample_id FROM t_mdm INTERSECT SELECT sample_id FROM t_mcna""",
)
def joi4(spark, sf_dir):
    return A.common_ids(orders_modalities(spark, sf_dir))


@query(
    "joi7_nearest_neighbour",
    """WITH z AS (SELECT vec_id::VARCHAR AS sample_id, label >= 7 AS minority, embedding AS e FROM embeddings)
SELECT a.sample_id, round(min(sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda t: (t[1]::DOUBLE - t[2]::DOUBLE) * (t[1]::DOUBLE - t[2]::DOUBLE))))), 5) AS distance
FROM z a JOIN z b ON b.minority AND a.sample_id <> b.sample_id GROUP BY a.sample_id""",
)
def joi7(spark, sf_dir):
    rows = embedding_latents(spark, sf_dir)
    found = nearest_distance(rows, rows.filter("y = 1"))
    return found.select("sample_id", F.round("distance", 5).alias("distance"))


@query(
    "joi8_real_union_synthetic",
    """WITH real AS (SELECT vec_id::VARCHAR AS sample_id, (label >= 7)::INT AS y, list_sum(list_transform(embedding, lambda v: v::DOUBLE)) AS s FROM embeddings)
SELECT sample_id, y, round(s, 5) AS s, false AS is_synthetic FROM real
UNION ALL SELECT 'SYNTHETIC:COPY:' || sample_id, y, round(s, 5), true FROM real WHERE y = 1""",
)
def joi8(spark, sf_dir):
    real = embedding_latents(spark, sf_dir)
    copies = real.filter("y = 1").withColumn("sample_id", F.concat(F.lit("SYNTHETIC:COPY:"), "sample_id"))
    both = A.union_synthetic(real, copies)
    return both.select("sample_id", "y", F.round(array_sum(F.col("z")), 5).alias("s"), "is_synthetic")


@query(
    "joi9_exact_copy_membership",
    f"""WITH {COHORT_SQL}, f AS (SELECT sample_id, y, mcna::FLOAT[] AS z FROM cohort)
SELECT y, count(*) AS n_rows, count(*) FILTER (WHERE z IN (SELECT z FROM f WHERE y = 1)) AS n_copies FROM f GROUP BY y""",
)
def joi9(spark, sf_dir):
    rows = orders_cohort(spark, sf_dir).select("sample_id", "y", F.col("mcna").cast("array<float>").alias("z"))
    return A.copy_counts(rows, rows.filter("y = 1"), ["y"])
