"""WARC archives of pages: writing, reading back, and assembly of captures.

Every capture is a response or revisit record, a request and a metadata record; the latter two name the first in
``WARC-Concurrent-To``. Spark's text writer makes the files: a record is a row, and the line separator is the pair of
empty lines that ends a record. Files are compressed and read back whole, so the writer bounds their records; the
reader steps through a file by ``Content-Length``, so payloads may hold anything.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.llm.storage import staged
from millrace.llm.words import rows_of

LEAST_REVISIT = 1000  # bytes; smaller payloads are always written
RECORDS_PER_FILE = 3_000
END = "\r\n\r\n"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = (
    "record_id string, type string, concurrent_to string, refers_to string, page_id long, uri string, date string, "
    "digest string, digest_ok boolean, http string, payload_bytes long, payload binary"
)


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], content_type: str, body: Column) -> Column:
    """One record, without the empty lines that end it. A header whose value is NULL is left out."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), record_id)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), body)


def _clean(value: Column) -> Column:
    """A header value: on one line."""
    return F.trim(F.regexp_replace(value, r"[\x00-\x20\x7F]+", " "))


def write_warc(pages: DataFrame, path: str, least: int = LEAST_REVISIT, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Archive ``page_id``, ``url`` and ``html`` of every row below ``path``.

    Of rows with equal payloads of at least ``least`` bytes, that with the largest ``page_id`` is a response and the others
    are revisits of it. NULL html is an empty payload. Rows without ``page_id``, and rows that repeat the largest one, are responses.
    """
    digest = F.sha1(F.encode(F.col("html"), "UTF-8"))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", digest)
    large = rows.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    repeated = (
        large.groupBy("digest").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first"))
        .where("first < last").select("digest", "last")
    )
    revisits = large.join(staged(repeated, "repeated"), "digest").where("page_id < last")
    revisits = revisits.select("page_id", F.unhex("digest").alias("sha1"), "last").distinct()
    # written, so that Catalyst knows its size and moves it rather than the pages while it is small
    rows = rows.withColumn("sha1", F.unhex("digest")).join(staged(revisits, "revisits"), ["page_id", "sha1"], "left")
    name = F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "digest")

    def urn(kind: str, of: Column) -> Column:
        """A record's name follows from what it archives, so that revisits can name their response."""
        h = F.md5(F.concat(F.lit(kind), of))
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))

    uri = F.coalesce(F.nullif(_clean(F.col("url")), F.lit("")), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))))
    date = F.lit("2024-01-01T00:00:00Z")
    revisit = F.col("last").isNotNull()
    own = F.when(revisit, urn("revisit", name)).otherwise(urn("response", name))
    common = [("WARC-Date", date), ("WARC-Target-URI", uri), ("X-Page-ID", F.col("page_id").cast("string"))]
    payload = [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))]
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
        F.octet_length("html").cast("string"), F.lit(END),
    )
    response = _record("response", own, [*common, *payload], "application/http;msgtype=response", F.concat(http, "html"))
    refers = [("WARC-Profile", F.lit(_REVISIT_PROFILE)), ("WARC-Refers-To", urn("response", F.concat_ws("-", F.col("last").cast("string"), "digest")))]
    revisited = _record("revisit", own, [*common, *payload, *refers], "application/http;msgtype=response", http)
    concurrent = [*common, ("WARC-Concurrent-To", own)]
    request = _record("request", urn("request", name), concurrent, "application/http;msgtype=request", F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1" + END)))
    metadata = _record("metadata", urn("metadata", name), concurrent, "application/warc-fields", F.concat(F.lit("payloadLength: "), F.octet_length("html").cast("string"), F.lit("\r\n")))
    records = rows.select(F.explode(F.array(F.when(revisit, revisited).otherwise(response), request, metadata)).alias("value"))
    records.write.options(lineSep=END, maxRecordsPerFile=records_per_file, compression="gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (by lower-case name) and content of the records of one file."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            if data[at:].strip():
                raise ValueError("a record's headers do not end")
            return
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        start = end + 4
        stop = start + int(headers["content-length"])
        if stop > len(data):
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, data[start:stop]
        at = stop + 4 if data[stop : stop + 4] == b"\r\n\r\n" else stop


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record. ``digest_ok`` says whether a response's payload has the digest it declares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        types = [{"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}.get(c.split()[1], pa.string()) for c in RECORDS.split(", ")]
        for batch in batches:
            for (data,) in rows_of(batch, "content"):
                out = []
                for h, content in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    kind = h["warc-type"]
                    head, _, payload = content.partition(b"\r\n\r\n") if kind in ("response", "revisit") else (content, b"", b"")
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    full = kind == "response"
                    out.append((
                        h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), int(h["x-page-id"]) if "x-page-id" in h else None,
                        h.get("warc-target-uri"), h.get("warc-date"), hashlib.sha1(payload).hexdigest() if full else digest,
                        hashlib.sha1(payload).hexdigest() == digest if full else None, head.decode("utf-8", "replace"),
                        len(payload) if full else None, payload if full else None,
                    ))
                columns = zip(*out) if out else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``record_id``, ``page_id``, ``uri``, and the structs ``response``, ``request``, ``metadata``.

    Request and metadata join the record they are concurrent to; a capture without one of them has NULL there. ``response`` has the
    type, the digest, the payload's length and, for a revisit, the capture it refers to; revisits take the length from there.
    """
    main = records.where("type in ('response', 'revisit')").select(
        "record_id", "page_id", "uri", "type", "digest", "digest_ok", "http", "payload_bytes", "refers_to"
    )
    main = staged(main, "responses")
    sides = staged(
        records.where("type in ('request', 'metadata')").groupBy("concurrent_to").pivot("type", ["request", "metadata"]).agg(
            F.first(F.struct("record_id", "http"))
        ),
        "concurrent",
    ).withColumnRenamed("concurrent_to", "record_id")
    target = main.where("type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(
        F.max("page_id").alias("target_page"), F.max("payload_bytes").alias("target_bytes")
    )
    joined = main.join(staged(target, "targets"), "refers_to", "left").join(sides, "record_id", "left")
    return joined.select(
        "record_id", "page_id", "uri",
        F.struct(
            "type", "digest", "digest_ok", "http", F.coalesce("payload_bytes", "target_bytes").alias("payload_bytes"),
            "refers_to", F.col("target_page").alias("refers_to_page"),
        ).alias("response"),
        "request", "metadata",
    )
