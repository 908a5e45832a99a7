"""Helpers of this package: tables, scratch tables and connected components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.sinks import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bitmap(df: DataFrame, value: str, bits: int) -> np.ndarray:
    """Bit ``value`` (a long expression from 0 to ``2**bits - 1``) of every row, as bytes.

    At most ``2**bits / 8`` small rows reach the driver, whatever the table's size.
    """
    parts = df.select(F.expr(f"int(({value}) div 8)").alias("byte"), F.expr(f"shiftleft(1, int(({value}) % 8))").alias("mask"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts.groupBy("byte").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
        out[r["byte"]] = r["mask"]
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where a lambda uses it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sum(sizes: Column) -> Column:
    """Sum of the elements before each one: within chunks of 64, plus the sum of the chunks before."""
    size = 64
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    ahead = lambda a: F.transform(a, lambda _, i: total(F.slice(a, F.lit(1), i)))
    cut = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int")), lambda c: F.slice(a, c * size + 1, F.lit(size)))

    def join(chunks: Column) -> Column:
        before = lambda sums: F.flatten(F.transform(chunks, lambda chunk, c: let(F.get(sums, c), lambda s: F.transform(ahead(chunk), lambda x: x + s))))
        return let(let(F.transform(chunks, total), ahead), before)

    return let(sizes, lambda a: F.when(F.size(a) > 0, let(cut(a), join)).otherwise(F.array().cast("array<bigint>")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node: columns ``node``, ``component``.

    ``edges`` has long columns ``a`` and ``b``; loops and repeats are allowed, rows
    with a null end are ignored.  Alternates "every larger neighbour points to
    the smallest one" with "every smaller neighbour points to the smallest one"
    until the edges no longer change.  Minima are pre-aggregated per task, the
    joins are plain sort-merge joins that adaptive execution may split at hot
    nodes, and each round is a written table.  Nodes that have no edge to another
    node are not returned.
    """
    cur = stored(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    seen = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # ``large`` holds (larger, smaller) only: point the smaller neighbours of each node to the smallest
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = stored(small.union(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        facts = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(cur)
        cur = nxt
        if tuple(facts) == seen:
            break
        seen = tuple(facts)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
