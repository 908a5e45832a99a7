"""Typed readers for modality tables and JSON record streams."""

from __future__ import annotations

import csv
import hashlib
import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import missing_to_null

ID_COLUMN = "SAMPLE_ID"
LABEL_COLUMN = "CLASS"
BAD_ROW = "_bad_row"
INLINE_BYTES = 1 << 28  # files up to this size are one row of the reader
DIGEST_BLOCK = 1 << 23


NOT_SPACE = re.compile(r"[^ \t\r\n]")


class ContractError(ValueError):
    """The input breaks the data contract."""


def header_of(line: str, path: str) -> list[str]:
    names = next(csv.reader([line.lstrip("\ufeff")]), [])
    if not "".join(names).strip():
        raise ContractError(f"{path}: empty file or no header")
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ContractError(f"{path}: duplicate columns {repeated}")
    absent = [n for n in (ID_COLUMN, LABEL_COLUMN) if n not in names]
    if absent:
        raise ContractError(f"{path}: missing required columns {absent}")
    if len(names) == 2:
        raise ContractError(f"{path}: no feature columns")
    return names


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Header names that all CSV files below ``path`` share; duplicates, absences and differing files are errors.

    Spark's CSV reader renames duplicate columns silently and reads later files by
    position, so the raw first line of every file is checked before the typed read.
    """
    lines = (
        spark.read.text(path)
        .select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
        .where("file_block_start = 0")
        .groupBy("file_path")
        .agg(F.min_by("value", "at").alias("line"))
    )
    firsts = [r["line"] for r in lines.groupBy("line").count().orderBy("line").limit(2).collect()]
    if not firsts:
        raise ContractError(f"{path}: empty file or no header")
    names = header_of(firsts[0], path)
    if len(firsts) > 1 and header_of(firsts[1], path) != names:
        raise ContractError(f"{path}: files with different headers {firsts}")
    return names


def read_modality_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, for the contract checks; header must be valid.

    A short row ends in missing cells; a row with more cells than the header stops the job.
    """
    names = read_header(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, BAD_ROW]])
    # without column pruning the length of a row is checked whatever columns are used
    options = {"header": True, "enforceSchema": True, "columnNameOfCorruptRecord": BAD_ROW, "mode": "PERMISSIVE", "quote": "\"", "escape": "\"", "columnPruning": False}
    rows = spark.read.options(**options).schema(schema).csv(path)
    # only rows of an unexpected length carry their text; cells are counted outside quotes
    bare = F.regexp_replace(BAD_ROW, '"([^"]|"")*"', "")
    cells = F.length(bare) - F.length(F.replace(bare, F.lit(","))) + 1
    long = F.coalesce(cells > len(names), F.lit(False))
    message = F.concat(F.lit(f"{path}: more than {len(names)} cells in the row of "), F.coalesce(ID_COLUMN, F.lit("")), F.lit(": "), F.col(BAD_ROW))
    return rows.where(F.when(long, F.raise_error(message).cast("boolean")).otherwise(True)).select(*[f"`{n}`" for n in names])


def parse_modality(raw: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """``(sample_id, label_raw, features ARRAY<DOUBLE>)``; names go into column metadata.

    A label that is not a whole number is missing, never rounded.
    """
    names = list(features) if features else [c for c in raw.columns if c not in (ID_COLUMN, LABEL_COLUMN)]
    packed = F.array(*[missing_to_null(F.expr(f"try_cast(`{n}` as double)")) for n in names])
    return raw.select(
        F.col(ID_COLUMN).alias("sample_id"),
        F.expr(f"if(try_cast({LABEL_COLUMN} as double) = floor(try_cast({LABEL_COLUMN} as double)), try_cast(try_cast({LABEL_COLUMN} as double) as int), null)").alias("label_raw"),
        packed.alias("features", metadata={"names": names}),
    )


def read_modality(spark: SparkSession, path: str) -> DataFrame:
    """Scan one modality CSV with explicit types (id string, label, double features); a broken contract raises."""
    from ..operators.contract import validate_text_table

    raw = read_modality_text(spark, path)
    validate_text_table(raw, path)
    return parse_modality(raw)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record of files that hold concatenated objects or arrays of them, as compact text."""
    decoder = json.JSONDecoder()
    for batch in batches:
        for name, text in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
            text, held = text.lstrip("\ufeff"), []
            at = _skip(text, 0)
            while at < len(text):
                try:
                    value, at = decoder.raw_decode(text, at)
                except json.JSONDecodeError as error:
                    raise ContractError(f"{name}: not a JSON record at character {at}: {error.msg}") from error
                held += value if isinstance(value, list) else [value]
                at = _skip(text, at)
                if len(held) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array([json.dumps(v) for v in held])], names=["value"])
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps(v) for v in held])], names=["value"])


def _skip(text: str, at: int) -> int:
    """Position of the next character that is no white space."""
    found = NOT_SPACE.search(text, at)
    return found.start() if found else len(text)


def read_records(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    expected_count: int | None = None,
    unique_key: Sequence[str] = (),
    pretty: bool = False,
) -> DataFrame:
    """JSON-lines (or pretty JSON) records; malformed, empty, miscounted or repeated keys fail.

    A pretty file holds objects one after the other, or arrays of them; all are read, and text that is
    no record stops the job.
    """
    if pretty:
        files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
        texts = files.mapInArrow(_decoded, "value string")
        rows = texts.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    else:
        rows = spark.read.schema(schema).json(path, mode="FAILFAST")
    key = list(unique_key)
    facts = [F.count(F.lit(1)).alias("n")]
    if key:
        any_null = F.lit(False)
        for k in key:
            any_null = any_null | F.col(k).isNull()
        facts += [F.count_if(any_null).alias("nulls"), F.count_distinct(F.struct(*key)).alias("distinct")]
    got = rows.agg(*facts).first()
    if got["n"] == 0:
        raise ContractError(f"{path}: no records")
    if expected_count is not None and got["n"] != expected_count:
        raise ContractError(f"{path}: {got['n']} records, expected {expected_count}")
    if key and (got["nulls"] or got["distinct"] != got["n"]):
        raise ContractError(f"{path}: null or duplicate keys {key}")
    return rows


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each listed file, read in blocks of fixed size."""
    for batch in batches:
        digests = []
        for path in batch.column("path").to_pylist():
            if path.startswith("file:"):
                system, name = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
            else:
                system, name = fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with system.open_input_stream(name) as stream:
                while block := stream.read(DIGEST_BLOCK):
                    digest.update(block)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(digests, pa.string())], names=["path", "length", "sha256"])


def fingerprint(spark: SparkSession, paths: str | Sequence[str], inline_bytes: int = INLINE_BYTES) -> DataFrame:
    """SHA-256 and length of every file; each file is hashed by one task.

    Files up to ``inline_bytes`` are hashed by Spark's reader.  A larger one, also above the
    2 GB that fit a row, is streamed by one task in blocks of ``DIGEST_BLOCK`` bytes; its file system has to be one
    that Arrow opens (local, HDFS, S3, GCS) from the executors.
    """
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    small = files.filter(F.col("length") <= inline_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > inline_bytes).select("path", "length")
    streamed = large.repartition("path").mapInArrow(_digests, "path string, length bigint, sha256 string")
    return small.unionByName(streamed).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("n_bytes"), "sha256")
