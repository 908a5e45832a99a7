"""Content-addressed archive of WARC records.

An archive is two tables: ``payloads`` holds each payload's bytes once under its
SHA-256, ``headers`` holds the exact bytes ahead of the payload (WARC header and
HTTP header) of every record with the digest of its payload.  A join on the digest gives
the records back byte by byte.  Both are written by Spark's committer.

Reading recomputes both digests of each stored payload and compares them with the
address and the record header; a difference stops the job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.sinks import scratch_path

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
HTTP = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "


def base32(digest_hex: Column) -> Column:
    """Upper-case base32 of a 160-bit digest given in hex."""
    letters = []
    for part in range(4):
        forty = F.conv(F.substring(digest_hex, 1 + 10 * part, 10), 16, 10).cast("long")
        for i in range(8):
            at = F.shiftright(forty, 35 - 5 * i).bitwiseAND(F.lit(31).cast("long")).cast("int")
            letters.append(F.substr(F.lit(BASE32), at + 1, F.lit(1)))
    return F.concat(*letters)


@dataclass(frozen=True)
class Archive:
    """Where an archive lies."""

    path: str

    def headers(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("address string, header binary").parquet(f"{self.path}/headers")

    def payloads(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("address string, payload binary").parquet(f"{self.path}/payloads")


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> Archive:
    """Write one record per row of ``pages`` (``page_id``, ``url``, ``html``).

    The payload is the html in UTF-8 (null: empty).  Of records with equal payloads of
    at least ``min_bytes`` bytes the one with the smallest ``page_id`` is a response and the
    others revisit it; smaller payloads and rows with a null ``page_id`` are always responses.
    A repeated ``page_id`` with an equal payload is a response again.  Line
    breaks in a URL are percent-encoded, a null URL leaves the field empty.  Other columns are ignored.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"), payload.alias("payload"))
    facts = rows.select("page_id", "url", F.sha2("payload", 256).alias("address"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    # narrow rows only; minima are pre-aggregated, so a payload that most rows share is one row per task
    first = facts.groupBy("address").agg(F.min("page_id").alias("first"))
    known = facts.join(first, "address")
    revisit = (F.col("size") >= min_bytes) & (F.col("page_id") != F.col("first"))
    revisit = F.coalesce(revisit, F.lit(False))
    block = F.concat(F.lit(HTTP), F.col("size").cast("string"), F.lit(CRLF * 2))
    length = F.octet_length(block) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(CRLF + "WARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">" + CRLF + "WARC-Target-URI: "),
        F.col("url"),
        F.lit(CRLF + "Content-Type: application/http; msgtype=response" + CRLF + "WARC-Payload-Digest: sha1:"),
        base32(F.col("sha1")),
        F.when(
            revisit,
            F.concat(
                F.lit(CRLF + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF + "WARC-Refers-To: <urn:page:"),
                F.col("first").cast("string"),
                F.lit(">"),
            ),
        ).otherwise(F.lit("")),
        F.lit(CRLF + "Content-Length: "),
        length.cast("string"),
        F.lit(CRLF * 2),
        block,
    )
    known.select("address", F.encode(header, "UTF-8").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    # the bytes of each payload once; every task first keeps one copy of its own
    once = rows.select(F.sha2("payload", 256).alias("address"), "payload").groupBy("address").agg(F.first("payload").alias("payload"))
    once.write.option("compression", "zstd").parquet(f"{path}/payloads")
    return Archive(path)


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """Whole records as bytes: ``address``, ``record`` (header, payload, closing line breaks), ``header_bytes`` and ``record_type``.

    A response joins its payload by address; a revisit has none and is not joined.
    """
    kind = F.regexp_extract(F.decode("header", "UTF-8"), "^WARC/1.1\r\nWARC-Type: ([a-z]+)\r\n", 1)
    heads = archive.headers(spark).select("address", "header", F.octet_length("header").alias("header_bytes"), kind.alias("record_type"))
    end = F.lit((CRLF * 2).encode())
    columns = ("address", "record", "header_bytes", "record_type")
    full = heads.where("record_type <> 'revisit'").join(archive.payloads(spark), "address").withColumn("record", F.concat("header", "payload", end))
    short = heads.where("record_type = 'revisit'").withColumn("record", F.concat("header", end))
    return full.select(*columns).union(short.select(*columns))


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` and ``url`` of every record.

    All fields come from the reconstructed records: a response's size and digest from its own bytes,
    a revisit's from its header.  Every stored payload is checked against its address, and what a record says against the payload.
    """
    stored = archive.payloads(spark).select(
        F.when(F.sha2("payload", 256) == F.col("address"), F.col("address"))
        .otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("address"))))
        .alias("address"),
        F.octet_length("payload").cast("long").alias("size"),
        base32(F.sha1("payload")).alias("digest"),
    )
    head = F.decode(F.substring("record", F.lit(1), F.col("header_bytes")), "UTF-8")
    body = F.substring("record", F.col("header_bytes") + 1, F.octet_length("record") - F.col("header_bytes") - len(CRLF * 2))
    field = lambda name: F.regexp_extract(head, f"\r\n{name}: ([^\r\n]*)\r\n", 1)
    number = lambda c: F.nullif(F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1), F.lit("")).cast("long")
    said_bytes = F.regexp_extract(head, "\r\nContent-Length: ([0-9]+)\r\n\r\n$", 1).cast("long")
    response = F.col("record_type") == "response"
    fields = records(spark, archive).select(
        "address",
        number(field("WARC-Record-ID")).alias("page_id"),
        "record_type",
        number(field("WARC-Refers-To")).alias("refers_to"),
        field("WARC-Target-URI").alias("url"),
        F.substring(field("WARC-Payload-Digest"), 6, 32).alias("said"),
        F.when(response, F.octet_length(body).cast("long")).otherwise(said_bytes).alias("payload_bytes"),
        F.when(response, base32(F.sha1(body))).alias("own"),
    )
    joined = fields.join(stored, "address")
    right = (F.col("said") == F.col("digest")) & (F.coalesce("own", "said") == F.col("said")) & (F.col("payload_bytes") == F.col("size"))
    digest = F.when(right, F.col("said")).otherwise(F.raise_error(F.concat(F.lit("wrong digest in the record of "), F.col("address"))))
    return joined.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to", "url")


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder and read it back; an empty table gives an empty result."""
    spark = pages.sparkSession
    return read_archive(spark, write_archive(pages, scratch_path(spark, "warc"), min_bytes))
