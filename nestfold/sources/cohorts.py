"""Cohorts: ``sample_id STRING, y INT`` and one ``ARRAY<DOUBLE>`` per modality.

Three cohorts are built on the given tables: orders (every order; line-item
aggregates are missing where an order has no line), embeddings and documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import missing_to_null

MODALITIES = ("mge", "mdm", "mcna")

ORDERS_FEATURES = {
    "mge": ["q_sum", "q_avg", "q_min", "q_max", "p_sum", "p_avg", "d_avg", "d_max", "t_avg", "n_lines"],
    "mdm": ["price", "year", "month", "day", "priority", "weekday"],
    "mcna": ["balance", "abs_balance", "segment", "nation", "region"],
}
# Customer market segments in the order of their codes.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

EMBEDDING_SLICES = {"mge": (0, 24), "mdm": (24, 48), "mcna": (48, 64)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modality_cells(cohort: DataFrame, *keep: str) -> DataFrame:
    """Long form ``(modality, pos, x)`` plus the kept columns, one row per cell."""
    stacked = F.array(*[F.struct(F.lit(m).alias("modality"), F.col(m).alias("values")) for m in MODALITIES])
    return (
        cohort.select(*keep, F.explode(stacked).alias("s"))
        .select(*keep, F.col("s.modality").alias("modality"), F.posexplode("s.values").alias("pos", "x"))
    )


def _r9(x) -> Column:
    return F.round(x, 9)


def orders_modalities(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three raw tables ``(sample_id, label_raw 1/2, features)`` before alignment."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    keyed = orders.select(
        F.col("o_orderkey"),
        F.col("o_orderkey").cast("string").alias("sample_id"),
        F.when(F.col("o_orderstatus") == "F", 2).otherwise(1).alias("label_raw"),
        "o_custkey",
        "o_totalprice",
        "o_orderdate",
        "o_orderpriority",
    )
    per_order = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array(
            _r9(F.sum("l_quantity")),
            _r9(F.avg("l_quantity")),
            _r9(F.min("l_quantity")),
            _r9(F.max("l_quantity")),
            _r9(F.sum("l_extendedprice") / 1000),
            _r9(F.avg("l_extendedprice") / 1000),
            _r9(F.avg("l_discount")),
            _r9(F.max("l_discount")),
            _r9(F.avg("l_tax")),
            F.count(F.lit(1)).cast("double"),
        ).alias("features")
    )
    mge = keyed.select("o_orderkey", "sample_id", "label_raw").join(per_order, "o_orderkey")
    mdm = keyed.withColumn(
        "features",
        F.array(
            _r9(F.col("o_totalprice") / 1000),
            F.year("o_orderdate").cast("double"),
            F.month("o_orderdate").cast("double"),
            F.dayofmonth("o_orderdate").cast("double"),
            F.substring("o_orderpriority", 1, 1).cast("double"),
            (F.weekday("o_orderdate") + 1).cast("double"),
        ),
    )
    segment = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment")).cast("double")
    per_customer = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").alias("o_custkey"),
        F.array(
            _r9(F.col("c_acctbal") / 1000),
            _r9(F.abs(F.col("c_acctbal")) / 1000),
            segment,
            F.col("c_nationkey").cast("double"),
            F.col("n_regionkey").cast("double"),
        ).alias("features"),
    )
    mcna = keyed.select("o_custkey", "sample_id", "label_raw").join(per_customer, "o_custkey")
    cols = ["sample_id", "label_raw", "features"]
    return {"mge": mge.select(*cols), "mdm": mdm.select(*cols), "mcna": mcna.select(*cols)}


def orders_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders; a modality absent for an order becomes missing cells."""
    parts = orders_modalities(spark, sf_dir)
    base = parts["mdm"].withColumnRenamed("features", "mdm")
    for m in ("mge", "mcna"):
        other = parts[m].select("sample_id", F.col("features").alias(m))
        empty = F.array_repeat(F.lit(None).cast("double"), len(ORDERS_FEATURES[m]))
        base = base.join(other, "sample_id", "left").withColumn(m, F.coalesce(m, empty))
    return base.select("sample_id", (F.col("label_raw") - 1).alias("y"), *MODALITIES)


def embedding_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("sample_id"),
        F.when(F.col("label") >= 7, 1).otherwise(0).alias("y"),
        F.transform("embedding", missing_to_null).alias("e"),
    )
    return rows.select(
        "sample_id",
        "y",
        *[F.slice("e", a + 1, b - a).alias(m) for m, (a, b) in EMBEDDING_SLICES.items()],
    )


def embedding_latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample_id, y, z ARRAY<FLOAT>)``: the whole vector as a fused latent."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("sample_id"),
        F.when(F.col("label") >= 7, 1).otherwise(0).alias("y"),
        F.col("embedding").alias("z"),
    )


def document_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with whole-text statistics; ``y = 1 - quality``."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    letters = F.length(F.regexp_replace("text", "[^a-z]", ""))
    digits = F.length(F.regexp_replace("text", "[^0-9]", ""))
    spaces = F.length(F.regexp_replace("text", "[^ ]", ""))
    lines = F.length(F.regexp_replace("text", "[^\n]", ""))
    size = F.length("text")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("sample_id"),
        (1 - F.col("quality")).alias("y"),
        F.col("toxic"),
        F.col("lang"),
        F.col("source"),
        F.array(size.cast("double"), letters.cast("double"), digits.cast("double")).alias("mge"),
        F.array(spaces.cast("double"), lines.cast("double")).alias("mdm"),
        F.array(_r9(F.try_divide(letters, size)), _r9(F.try_divide(digits, size))).alias("mcna"),
    )
