"""Operator 7: WARC records in ZIP packages, written with payload deduplication and read back by range, nothing extracted."""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, opened
from .zipread import ZipRanges

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads shorter than this are never written as revisits.
MIN_REVISIT = 100


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, stamp: str) -> bytes:
    """One WARC 1.1 record. A revisit holds the HTTP head alone, whose Content-Length is that of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {stamp}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if refers_to is not None:
        fields += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields (lower-case names), its type and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) < n:
        raise ValueError("the record is cut short")
    return {"fields": fields, "block": rest[:n]}


def with_first(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """pages with __digest (hex SHA-256 of the payload) and __first, the smallest id that has the payload; null for short or single payloads.

    Ids alone are grouped, with partial minima before the shuffle, and only payloads that occur twice come back to the
    join; Spark broadcasts them if they are small and else splits hot payloads (AQE skew join).
    """
    p = pages.withColumn("__payload", F.coalesce(F.col(html), F.lit("")).cast("binary")).withColumn("__digest", F.sha2("__payload", 256))
    firsts = p.where(F.octet_length("__payload") >= MIN_REVISIT).groupBy("__digest").agg(F.min(page_id).alias("__first"), F.count("*").alias("__n")).where("__n > 1").select(F.col("__digest").alias("__d"), "__first")
    return p.join(firsts, F.col("__digest") == F.col("__d"), "left").drop("__d")


def write(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> list[str]:
    """Write a record per row; returns the packages' URIs, one per partition with rows.

    Each task streams one package: a stored member of gzip records and a stored index (a JSON line per record: page id,
    offset, length, type). A task that is tried again writes another file; only files of tasks that ended count, so a
    lost executor leaves at most an unlisted file. Null html is an empty payload, a null url an empty one, a null id
    stays null and is never referred to. Rows with the smallest id of their payload are all responses.
    """
    schema_in = with_first(pages.select(F.col(page_id).alias("i"), F.col(url).alias("u"), F.col(html).alias("h")), "i", "h").select("i", "u", "__payload", "__digest", "__first")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        uri = f"{folder}/{uuid.uuid4().hex}.wacz"
        fs, path = opened(uri)
        stamp = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        index, at, n = [], 0, 0
        with fs.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as data:
                for b in (y for x in ([first], batches) for y in x):
                    for i, u, payload, digest, ref in zip(*(c.to_pylist() for c in b.columns), strict=True):
                        ref = None if ref is None or ref == i else ref
                        raw = gzip.compress(record(i, u, payload, digest, ref, stamp), 1, mtime=0)
                        data.write(raw)
                        index.append(json.dumps({"page_id": i, "offset": at, "length": len(raw), "type": "response" if ref is None else "revisit"}))
                        at, n = at + len(raw), n + 1
            with z.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as data:
                data.write("\n".join(index).encode())
        yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], ["uri", "n"])

    return [r["uri"] for r in schema_in.mapInArrow(pack, "uri string, n long").collect()]  # a line per package, never per record


def read(spark: SparkSession, packages: list[str]) -> DataFrame:
    """A row per record: page_id, url, record_type, refers_to, payload_digest, payload_bytes (of the full payload) and payload (null for revisits).

    One task per package: it parses the package's directory, reads the stored index, then each record by its range.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                fs, path = opened(packages[k])
                with fs.open_input_file(path) as f:
                    z = ZipRanges(f)
                    start, rows = z.start(DATA), []
                    for line in z.read(INDEX).splitlines():
                        e = json.loads(line)
                        r = parse(gzip.decompress(z.at(start + e["offset"], e["length"])))
                        d = r["fields"]
                        head, _, payload = r["block"].partition(b"\r\n\r\n")
                        size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        page, ref, kind = d["x-page-id"], d.get("x-refers-to-page-id"), d["warc-type"]
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != d["warc-payload-digest"].removeprefix("sha256:")):
                            raise ValueError(f"{packages[k]}: the payload of page {page} is not what its digest says")
                        rows.append((int(page) if page else None, d.get("warc-target-uri"), kind, int(ref) if ref else None, d["warc-payload-digest"].removeprefix("sha256:"), size, payload if kind == "response" else None))
                        if len(rows) == 500:
                            yield batch(rows)
                            rows = []
                    yield batch(rows)

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names)

    n = len(packages)
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    return spark.range(0, n, 1, max(1, n)).mapInArrow(unpack, schema)


def pack_and_read(pages: DataFrame) -> DataFrame:
    """Write pages to packages in the shared folder and read them back."""
    spark = pages.sparkSession
    return read(spark, write(pages, fresh_dir(spark, "warc")))
