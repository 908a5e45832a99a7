import base64
import hashlib

import pytest

from nestfold.llm import warc
from nestfold.sources.sinks import scratch_path

PAGES = [
    (5, "http://a/1", "<p>same é</p>"), (2, "http://a/2", "<p>same é</p>"), (9, "http://a\r\nX: 1", "<p>same é</p>"), (4, None, None), (3, "http://e", ""), (7, "u", "line\r\n\r\nWARC/1.1\r\n\r\n"),
    (8, "u", "x" * 200_000), (None, "n", "nameless"), (None, "n", "nameless"), (6, "d", "twice"), (6, "d", "twice"), (None, "m", "<p>same é</p>"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, address string, size int")


def want(rows, least):
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        first = min(same) if same else None
        revisit = i is not None and len(body) >= least and i != first
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, least):
    rows = warc.archive_round_trip(pages(spark), least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in rows), key=str) == want(PAGES, least)


def test_payload_once_and_records_exact(spark):
    archive = warc.write_archive(pages(spark), scratch_path(spark, "warc"))
    stored = archive.payloads(spark).collect()
    assert len(stored) == len({(h or "") for _, _, h in PAGES})
    got = [bytes(r.record) for r in warc.records(spark, archive).collect()]
    assert len(got) == len(PAGES)
    for record in got:
        head, block = record.split(b"\r\n\r\n", 1)
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        body = block[: int(fields[b"Content-Length"])]
        assert block[len(body) :] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
        assert b"X" not in fields
        payload = body.split(b"\r\n\r\n", 1)[1]
        if fields[b"WARC-Type"] == b"response":
            assert b"sha1:" + base64.b32encode(hashlib.sha1(payload).digest()) == fields[b"WARC-Payload-Digest"]
        else:
            assert payload == b"" and b"WARC-Refers-To" in fields


def test_damage_is_noticed(spark):
    archive = warc.write_archive(pages(spark), scratch_path(spark, "warc"))
    bad = archive.payloads(spark).selectExpr("address", "concat(payload, cast('x' as binary)) as payload")
    other = scratch_path(spark, "warc")
    archive.headers(spark).write.parquet(f"{other}/headers")
    bad.write.parquet(f"{other}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, warc.Archive(other)).collect()


def test_empty(spark):
    assert warc.archive_round_trip(pages(spark, [])).collect() == []
