import hashlib

import pytest

from basketlens.llm.common import scratch
from basketlens.llm.warc import read_archive, reconstruct, write_archive

BIG = "x" * 1500
ROWS = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (9, "http://a/9\r\nWARC-Type: fake", BIG), (9, "http://a/9", BIG), (3, None, "small"),
    (4, "http://a/4", "small"), (5, "http://a/5", None), (6, "http://a/6", ""), (None, "http://a/n", BIG), (7, "http://é/ü", "é" * 500),
    (8, "http://é/ü", "é" * 500), (None, "u", "y" * 2000), (None, "u", "y" * 2000), (10, "l", "long" * 500_000), (11, "l\u2028", "a\r\n\r\nWARC/1.1\r\n" * 100),
]


@pytest.fixture(scope="module")
def archive(spark):
    folder = scratch(spark, "warc-test")
    frame = spark.createDataFrame([(*r, "clash", 5) for r in ROWS], "page_id long, url string, html string, digest string, n_bytes int")
    write_archive(frame, folder)
    return folder


def test_records(spark, archive):
    newest = {}
    for p, _, h in ROWS:
        newest[h or ""] = max(newest.get(h or "", -1), -1 if p is None else p)
    want = []
    for p, _, h in ROWS:
        body, last = (h or "").encode(), newest[h or ""]
        revisit = len(body) >= 1000 and (-1 if p is None else p) != last
        kind = ("revisit", last) if revisit else ("response", None)
        want.append((p, len(body), hashlib.sha1(body).hexdigest(), *kind))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_archive(spark, archive).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_each_payload_is_stored_once(spark, archive):
    assert spark.read.parquet(f"{archive}/payloads").count() == len({h or "" for _, _, h in ROWS})


def test_exact_round_trip(spark, archive):
    rows = reconstruct(spark, archive).collect()
    assert sorted(bytes(r.payload) for r in rows) == sorted((h or "").encode() for _, _, h in ROWS)
    for r in rows:
        head, block = bytes(r.record).split(b"\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n")
        assert block.endswith(b"\r\n\r\n") and len(block) - 4 == int(fields["Content-Length"])
        assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(bytes(r.payload)).hexdigest()
        assert (fields["WARC-Type"] == "response") == (block[:-4] == bytes(r.payload) or not r.payload)


def test_damage_is_found(spark, archive):
    folder = scratch(spark, "warc-damaged")
    store = spark.read.parquet(f"{archive}/payloads")
    store.selectExpr("digest", "sha1", "n_bytes", "response_id", "concat(payload, X'00') AS payload").write.parquet(f"{folder}/payloads")
    spark.read.parquet(f"{archive}/headers").write.parquet(f"{folder}/headers")
    with pytest.raises(Exception, match="damaged payload"):
        read_archive(spark, folder).collect()


def test_empty(spark):
    folder = scratch(spark, "warc-empty")
    write_archive(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert read_archive(spark, folder).count() == 0 and reconstruct(spark, folder).count() == 0
