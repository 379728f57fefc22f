"""Operator 8: WARC archives, written and read sequentially.

One gzip member per record. Archives are rows (archive, content) of bounded size, so
Spark's own Parquet writer puts them into any store; ``read_archives`` takes the same
two columns, also from ``spark.read.format("binaryFile")``. The reader inflates in
fixed steps, frames records by Content-Length and verifies both digests.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import materialize, small_batches, text_of

LEAST_REVISIT = 100
_STEP = 64 << 10
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>")
    head.append("WARC-Date: 1970-01-01T00:00:00Z")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
        head.append("X-Source-Url: " + json.dumps(url))
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def _write(level: int, segment_bytes: int):
    schema = pa.schema([("archive", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            content = b"".join(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(content).hexdigest()[:24] + ".warc.gz"]), pa.array([content], pa.binary())], schema=schema)

        for batch in batches:
            page_id, url, html, digest, first = batch.columns
            for k in range(batch.num_rows):
                payload = html[k].as_py()
                m = _member(_record(page_id[k].as_py(), url[k].as_py(), payload, digest[k].as_py(), first[k].as_py()), level)
                held.append(m)
                size += len(m)
                if size >= segment_bytes:
                    size = 0
                    yield flush()
        if held:
            yield flush()

    return run


def write_archives(pages: DataFrame, level: int = 1, segment_bytes: int = 4 << 20) -> DataFrame:
    """(archive, content) rows: a record per page, payload the html in UTF-8 (null: empty).

    Of pages with equal payloads of at least 100 bytes, those of the smallest page_id are responses and the
    others revisit it; if none of them has a page_id, all are responses. A very long page is one record; repeated rows
    are repeated records; other columns are ignored; an empty table gives no archives.
    """
    small_batches(pages.sparkSession)
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").cast("binary").alias("html"))
    src = src.withColumn("digest", F.sha2("html", 256))
    small = src.filter(F.length("html") < LEAST_REVISIT).withColumn("first", F.lit(None).cast("long"))  # never revisits
    src = src.filter(F.length("html") >= LEAST_REVISIT)
    same = src.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).filter("n > 1")
    marked = src.join(same.select("digest", "first"), "digest", "left")  # html moves once; a hot digest is one row on the right, so AQE may split the left
    first = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    marked = marked.select("page_id", "url", "html", "digest", first.alias("first")).unionByName(small)
    return marked.mapInArrow(_write(level, segment_bytes), "archive string, content binary")


def members(content: bytes) -> Iterator[bytes]:
    """The inflated gzip members, one at a time, inflated in steps of 64 KiB."""
    at, view = 0, memoryview(content)
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            step = view[at : at + _STEP]
            if not len(step):
                raise ValueError("gzip member ends early")
            parts.append(z.decompress(step))
            at += len(step)
        at -= len(z.unused_data)
        yield b"".join(parts)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record, framed by its Content-Length."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't frame the record")
    return headers, rest[:n]


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("verified", pa.bool_())])


def _page(ref: str | None) -> int | None:
    text = (ref or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def _row(headers: dict[str, str], block: bytes, keep: bool) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = headers["warc-type"] == "revisit"
    said = headers["warc-payload-digest"].removeprefix("sha256:")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    good = headers["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
    if not revisit:
        good = good and len(payload) == length and hashlib.sha256(payload).hexdigest() == said
    url = json.loads(headers["x-source-url"]) if "x-source-url" in headers else headers.get("warc-target-uri")
    return _page(headers.get("warc-record-id")), url, length, said, headers["warc-type"], _page(headers.get("warc-refers-to")), payload if keep and not revisit else None, good


def _read(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for m in members(content.as_py() or b""):
                    headers, block = parse_record(m)
                    rows.append(_row(headers, block, keep))
                    size += len(block) if keep else 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ.types)], schema=_READ)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ.types)], schema=_READ)

    return run


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of (…, content) rows: ids, url, digests, type, the payload of responses, and whether both digests hold.

    A member that is cut short, or a Content-Length that doesn't frame its record, fails the job.
    """
    out = archives.select("content").mapInArrow(_read(payloads), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, verified boolean")
    return out if payloads else out.drop("payload")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = materialize(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")), "archives")
    return read_archives(archives, payloads=False)
