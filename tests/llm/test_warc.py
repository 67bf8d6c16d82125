"""WARC archives: round trip, foreign records, damage, and the assembly of captures."""

import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from keyloom.llm import warc

SCHEMA = "page_id long, url string, html string"
ROWS = [
    (1, "http://a/1", "<p>same"),
    (2, "http://a/2", "<p>same"),
    (3, "http://a/3", "é🎉\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"),
    (4, None, ""),
    (5, "http://a/5", None),
    (6, "http://a/6\r\nWARC-Type: evil", "<p>x</p>\r\n\r\n"),
    (7, "http://a/7", "long " * 200_000),
    (7, "http://a/7", "long " * 200_000),
    (None, "http://a/none", "<p>same"),
]


@pytest.fixture(scope="module")
def captures(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "files")
    pages = spark.createDataFrame(ROWS, SCHEMA).withColumn("digest", F.lit("clash")).withColumn("row", F.lit(0))
    source = str(tmp_path_factory.mktemp("pages") / "pages.parquet")
    pages.repartition(2).write.parquet(source)
    warc.write_archives(spark.read.parquet(source), path, pages_per_file=2)
    return path, warc.assemble(warc.read_archives(spark, path))


def test_round_trip(spark, captures):
    path, assembled = captures
    out = assembled.collect()
    assert len(out) == len(ROWS)
    by_page = {}
    for c in out:
        assert c["request"] is not None and c["response"] is not None and c["metadata"] is not None
        page = c["metadata"]["fields"].removeprefix("page-id: ").strip()
        by_page.setdefault(int(page) if page else None, []).append(c)
    for page, url, html in ROWS:
        raw = (html or "").encode()
        for c in by_page[page]:
            r = c["response"]
            assert (c["url"] or None) == (url and url.replace("\r", " ").replace("\n", " "))
            assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
            assert r["type"] == "revisit" or bytes(r["payload"]) == raw
    kinds = {p: sorted(c["response"]["type"] for c in cs) for p, cs in by_page.items()}
    assert kinds == {1: ["revisit"], 2: ["response"], 3: ["response"], 4: ["revisit"], 5: ["response"], 6: ["response"], 7: ["response", "revisit"], None: ["revisit"]}
    response = {c["capture_id"]: p for p, cs in by_page.items() for c in cs if c["response"]["type"] == "response"}
    refers = {p: [response[c["response"]["refers_to"]] for c in cs if c["response"]["type"] == "revisit"] for p, cs in by_page.items()}
    assert refers == {1: [2], 2: [], 3: [], 4: [5], 5: [], 6: [], 7: [7], None: [2]}


def test_small_payloads_are_all_responses(spark, tmp_path):
    source = str(tmp_path / "pages.parquet")
    spark.createDataFrame(ROWS[:5], SCHEMA).write.parquet(source)
    warc.write_archives(spark.read.parquet(source), str(tmp_path / "w"), least_bytes=5)
    kinds = sorted(r["type"] for r in warc.read_archives(spark, str(tmp_path / "w")).filter("type in ('response', 'revisit')").collect())
    assert kinds == ["response"] * 4 + ["revisit"]


def test_empty(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "w"))
    assert warc.assemble(warc.read_archives(spark, str(tmp_path / "w"))).count() == 0


def record(kind, block, **headers):
    lines = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Binary payloads, members gzipped one by one, records without partners, and captures spread over files."""
    payload = bytes(range(256)) * 3
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + payload
    app = "application/http;msgtype=response"
    one = record("warcinfo", b"software: x", WARC_Record_ID="<i>") + record("response", http, WARC_Record_ID="<r>", Content_Type=app)
    two = record("request", b"GET / HTTP/1.1\r\n\r\n", WARC_Record_ID="<q>", WARC_Concurrent_To="<r>", Content_Type="application/http;msgtype=request") + record("metadata", b"a: b", WARC_Record_ID="<m>", WARC_Concurrent_To="<r>")
    lone = record("request", b"GET / HTTP/1.1\r\n\r\n", WARC_Record_ID="<z>", WARC_Concurrent_To="<gone>")
    (tmp_path / "a.warc").write_bytes(one)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (two, lone)))
    out = {r["capture_id"]: r for r in warc.assemble(warc.read_archives(spark, str(tmp_path))).collect()}
    assert set(out) == {"<i>", "<r>", "<gone>"}
    assert bytes(out["<r>"]["response"]["payload"]) == payload and out["<r>"]["request"]["record_id"] == "<q>" and out["<r>"]["metadata"]["fields"] == "a: b"
    assert out["<gone>"]["response"] is None and out["<gone>"]["request"] is not None


@pytest.mark.parametrize("data", [b"junk\r\n", record("response", b"abc")[:-6], record("resource", b"abc", WARC_Payload_Digest="sha1:AAAA")])
def test_damage(data):
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(data)))


def test_base32(spark):
    for text in ("", "a", "abc" * 100):
        raw = hashlib.sha1(text.encode()).digest()
        assert spark.range(1).select(warc.base32_of_hex(F.lit(raw.hex())).alias("x")).first()["x"] == base64.b32encode(raw).decode()
