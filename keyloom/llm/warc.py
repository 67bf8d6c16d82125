"""WARC: write pages as archives, read archives back, and assemble the records of each capture.

A capture is a request, a response (or a revisit, if an earlier record has the same payload) and a metadata record; the
first and the last name the response's record in WARC-Concurrent-To.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import attach, cut, remove, shared_folder, table

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages to an archive file, and fewer where so many have more than these bytes of payload on average. A file is read as a
#: whole (so no one file of 2 GB or more can be), and unpacked record by record.
PAGES_PER_FILE, BYTES_PER_FILE = 10_000, 100_000_000
FLUSH_BYTES = 16_000_000


def base32_of_hex(digest: Column) -> Column:
    """Base32 of 20 bytes given as 40 hex digits: each five digits are four characters."""
    group = lambda i: F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
    letter = lambda n, shift: F.substring(F.lit(BASE32), F.shiftright(n, shift).bitwiseAND(31) + 1, F.lit(1))
    four = lambda n: F.concat(*[letter(n, s) for s in (15, 10, 5, 0)])
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: four(group(i))), "")


def _record_id(kind: str, row: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + ":"), row))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit(CRLF)]
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", pages_per_file: int = PAGES_PER_FILE) -> None:
    """Write the capture of each row of pages to gzipped WARC files in the folder path.

    The payload is the html in UTF-8; null is the empty payload. Of captures with equal payloads of at least least_bytes
    bytes the one with the largest id is a response and all others are revisits of it; of rows that repeat this id, one.
    Null ids are below all others. A null url leaves its header out; line breaks in a url are written as spaces.
    Other columns are ignored; an empty table writes a folder without records.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.regexp_replace(F.col(url_col).cast("string"), r"[\r\n]", " ").alias("url"),
        html.alias("html"),
        F.sha1(F.encode(html, "UTF-8")).alias("digest"),
    )
    ids = rows.groupBy("digest", "id").agg(F.count("*").alias("same"), F.first(F.octet_length("html")).alias("bytes"))
    groups = ids.groupBy("digest").agg(F.max(F.struct("id", "same")).alias("best"), F.sum("same").alias("n"), F.first("bytes").alias("bytes"))
    groups = cut(groups.select("digest", "n", F.col("best.id").alias("best_id"), F.col("best.same").alias("same"), "bytes", (F.col("bytes") >= least_bytes).alias("joins")))
    total, payload = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("bytes")), F.lit(0))).first()
    pages_per_file = max(min(pages_per_file, BYTES_PER_FILE * total // max(payload, 1)), 1)
    # rows are told apart within this one job only: another reading may deal them into other partitions
    joined = attach(rows.withColumn("row", F.monotonically_increasing_id()), groups, "digest", "n", total)
    best = F.col("id").eqNullSafe(F.col("best_id"))
    if groups.filter("joins and same > 1").isEmpty():
        joined = joined.withColumn("chosen", best)
    else:  # the largest id is repeated: one of its rows is chosen
        several = best & (F.col("same") > 1)
        place = F.row_number().over(Window.partitionBy("digest").orderBy("row"))
        joined = joined.filter(~several).withColumn("chosen", best).unionByName(joined.filter(several).withColumn("chosen", place == 1))
    revisit = F.col("joins") & ~F.col("chosen")
    own = F.concat_ws(":", "digest", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("row").cast("string"))
    response_id = F.when(F.col("joins") & F.col("chosen"), _record_id("response", F.col("digest"))).otherwise(_record_id("row", own))
    length = F.octet_length("html").cast("string")
    payload_digest = F.concat(F.lit("sha1:"), base32_of_hex(F.col("digest")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length, F.lit(CRLF + CRLF))
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(date))]
    response = _record(
        F.when(revisit, "revisit").otherwise("response"),
        [
            ("WARC-Record-ID", response_id),
            *common,
            ("WARC-Payload-Digest", payload_digest),
            ("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
            ("WARC-Refers-To", F.when(revisit, _record_id("response", F.col("digest")))),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html"))),
    )
    side = [*common, ("WARC-Concurrent-To", response_id)]
    request = _record("request", [("WARC-Record-ID", _record_id("request", own)), *side, ("Content-Type", F.lit("application/http;msgtype=request"))], F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{CRLF}{CRLF}")))
    fields = F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit(CRLF)), F.lit(""))
    metadata = _record("metadata", [("WARC-Record-ID", _record_id("metadata", own)), *side, ("Content-Type", F.lit("application/warc-fields"))], fields)
    records = joined.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", 3 * pages_per_file).text(path)


RECORD = "record_id string, type string, concurrent_to string, refers_to string, url string, date string, headers map<string,string>, http_headers map<string,string>, payload binary, payload_bytes long, payload_digest string"
_KINDS = [pa.string()] * 6 + [pa.map_(pa.string(), pa.string())] * 2 + [pa.binary(), pa.int64(), pa.string()]


def parse(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """The records of an uncompressed archive, one after another, as rows of RECORD."""

    def head(read) -> list[tuple[str, str]]:
        out = []
        while line := read().rstrip(b"\r\n"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            out.append((name.strip().lower(), value.strip()))
        return out

    while first := stream.readline():
        if not first.strip():
            continue  # between records
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:80]!r}")
        headers = head(stream.readline)
        h = dict(headers)
        length = int(h["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError("a record is cut short")
        http: list[tuple[str, str]] = []
        if h.get("content-type", "").startswith("application/http"):
            inner = io.BytesIO(block)
            inner.readline()
            http = head(inner.readline)
            payload = block[inner.tell() :]
        else:
            payload = block
        if h["warc-type"] == "revisit":  # its payload is elsewhere
            told = dict(http).get("content-length")
            size, digest, payload = int(told) if told is not None else None, h.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
        else:
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            stated = h.get("warc-payload-digest")
            if stated is not None and stated.startswith("sha1:") and stated != "sha1:" + digest:
                raise ValueError(f"the payload of {h.get('warc-record-id')} does not have its digest")
        yield (h.get("warc-record-id"), h["warc-type"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), list(h.items()), list(dict(http).items()), payload, size, digest)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in RECORD.replace("map<string,string>", "map").split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names)

    for batch in batches:
        for content in batch.column(0):
            raw = io.BytesIO(content.as_buffer())
            stream = gzip.GzipFile(fileobj=raw) if content.as_buffer()[:2].to_pybytes() == b"\x1f\x8b" else raw
            rows, held = [], 0
            for record in parse(stream):
                rows.append(record)
                held += len(record[8] or b"") + 500
                if held >= FLUSH_BYTES:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row of RECORD for each record of the WARC files in path, gzipped or not. Digests are checked against payloads."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parsed, RECORD)


def assemble(records: DataFrame, payloads: bool = True) -> DataFrame:
    """One nested row for each capture: capture_id, url, date, request, response (with its payload if payloads) and metadata.

    Records belong together when they name the same record in concurrent-to; the one named belongs with them. Of several
    records of one kind in a capture the one with the largest record id is taken; a kind that is missing is null.
    Records without an identifier, and so without a capture, are captures of their own.
    """
    key = F.coalesce("concurrent_to", "record_id", F.uuid())
    of = lambda kinds, names: F.max(F.when(F.col("type").isin(*kinds), F.struct("record_id", *names)))
    return (
        records.groupBy(key.alias("capture_id"))
        .agg(
            F.max("url").alias("url"),
            F.max("date").alias("date"),
            of(["request"], ["payload_bytes"]).alias("request"),
            of(["response", "revisit"], ["type", "refers_to", "payload_bytes", "payload_digest", *["payload"] * payloads]).alias("response"),
            of(["metadata"], ["payload"]).alias("metadata"),
        )
        .withColumn("metadata", F.when(F.col("metadata").isNotNull(), F.struct(F.col("metadata.record_id"), F.decode("metadata.payload", "UTF-8").alias("fields"))))
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    captures = assemble(read_archives(spark, path), payloads=False)
    page = F.regexp_extract("metadata.fields", r"page-id: (-?\d+)", 1)
    flat = cut(
        captures.select(
            "capture_id",
            F.when(page != "", page.cast("long")).alias("page_id"),
            F.col("response.payload_bytes").alias("payload_bytes"),
            F.col("response.payload_digest").alias("payload_digest"),
            F.col("response.type").alias("record_type"),
            F.col("response.refers_to").alias("named"),
        )
    )
    remove(spark, path)
    total = flat.count()
    revisits = flat.filter("named is not null")
    named = revisits.groupBy("named").agg(F.count("*").alias("n"))
    named = named.join(flat.select(F.col("capture_id").alias("named"), F.col("page_id").alias("refers_to")), "named")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    out = attach(revisits, named, "named", "n", total).select(*columns, "refers_to")
    return out.unionByName(flat.filter("named is null").select(*columns, F.lit(None).cast("long").alias("refers_to")))


_digit = lambda i: f"'0x' || substr(h, {5 * i + 1}, 5)"
_letters = " || ".join(f"substr('{BASE32}', ((({_digit(i)})::BIGINT >> {s}) & 31)::INT + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
OP5_SQL = f"""
WITH hashed AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {_letters} AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER g THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> max(page_id) OVER g THEN max(page_id) OVER g END AS refers_to
FROM hashed WINDOW g AS (PARTITION BY html)
"""
