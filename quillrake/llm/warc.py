"""WARC archives: written with request, response or revisit, and metadata records; read back as captures.

A capture is one transaction: its request and metadata name the response's (or revisit's) record id in
WARC-Concurrent-To. Assembly groups records by that id, so the three meet in one shuffle and a capture is one
nested row. Records are gzip members of their own; files are written and read by tasks as streams.

Payloads equal by SHA-256 and length, of ``min_bytes`` at least, are stored once: the largest page id is the
response and the others are revisits that refer to it. Only (hash, largest id) of repeated payloads is joined back.

Null pages are empty payloads; null URLs leave out the target, control characters in URLs are percent-encoded.
Null page ids are kept as captures without an id, and never chosen as a response that others refer to while their
group has an id. Rows that repeat a page id are captures of their own: of those with equal payloads one is the response
(the smallest URL, nulls first) and the others revisit it; those with different payloads are responses each. A response
that can be referred to is named by its page id and digest, which no other response shares; every other record is named
by its file and place. An empty table gives no records. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import opened, write_part
from .shared import byte_slices, cut

DATE = "2024-01-01T00:00:00Z"
RECORD = "file string, place long, kind string, record_id string, concurrent_to string, refers_to string, target string, page_id long, payload_bytes long, payload_digest string, payload binary, block binary"
_FIELDS = ["file", "place", "kind", "record_id", "concurrent_to", "refers_to", "target", "page_id", "payload_bytes", "payload_digest", "payload", "block"]


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*name: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5('/'.join(map(str, name)).encode()).digest(), version=3)}>"


def _record(kind: str, ident: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}", "", ""]
    press = zlib.compressobj(5, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + press.flush()


def capture_records(page: int | None, url: str | None, payload: bytes, refers_to: int | None, serial: str, sole: bool = True) -> bytes:
    """The three records of one capture. ``sole``: no other response has this page id and payload, so both name it; else ``serial`` does."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url) if url else None
    try:
        parts = urlsplit(target or "")
    except ValueError:
        parts = urlsplit("")
    kind, sha1 = "response" if refers_to is None else "revisit", digest32(payload)
    main = record_id("response", page, sha1) if kind == "response" and sole and page is not None else record_id("capture", serial)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    request = f"GET {parts.path or '/'}{'?' + parts.query if parts.query else ''} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n".encode()
    fields = f"page-id: {'' if page is None else page}\r\n".encode()
    digest = ("WARC-Payload-Digest", f"sha1:{sha1}")
    out = _record("request", record_id("request", main), [("WARC-Target-URI", target), ("WARC-Concurrent-To", main), ("Content-Type", "application/http;msgtype=request")], request)
    if kind == "response":
        out += _record(kind, main, [("WARC-Target-URI", target), digest, ("Content-Type", "application/http;msgtype=response")], head + payload)
    else:
        refers = [("WARC-Refers-To", record_id("response", refers_to, sha1)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        out += _record(kind, main, [("WARC-Target-URI", target), digest, *refers, ("Content-Type", "application/http;msgtype=response")], head)
    return out + _record("metadata", record_id("metadata", main), [("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")], fields)


def _write(folder: str, min_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part = 0, TaskContext.get().partitionId()

        def fill(out) -> None:
            nonlocal n
            for batch in byte_slices(batches, "html", 1 << 22):
                cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")]
                for page, url, html, refers in zip(*cols, strict=True):
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    out.write(capture_records(page, url, payload, refers, f"{folder}/{part}/{n}", len(payload) >= min_bytes))
                    n += 1

        uri = write_part(folder, ".warc.gz", fill)
        yield pa.RecordBatch.from_pydict({"file": [uri], "captures": pa.array([n], pa.int64())})

    return write


def revisit_targets(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with ``refers_to``: the response's page id for revisits, else null.

    Whether several rows share a payload and the largest page id is known once the groups are counted. Only such rows are numbered,
    by URL, so tables without them pay nothing for it.
    """
    base = pages.withColumn("body", F.coalesce("html", F.lit(""))).withColumn("size", F.octet_length("body"))
    base = base.withColumn("sha", F.unhex(F.sha2("body", 256))).drop("body")
    top = F.max(F.col("page_id"))
    same = base.where(F.col("size") >= min_bytes).groupBy("sha", "size", "page_id").agg(F.count("*").alias("n"))
    same = same.groupBy("sha", "size").agg(top.alias("first"), F.sum("n").alias("n"), F.max(F.struct("page_id", "n")).alias("x")).where("n > 1 AND first IS NOT NULL")
    same, _ = cut(same.select(F.col("sha").alias("same_sha"), F.col("size").alias("same_size"), "first", F.col("x.n").alias("ties")), "payloads")
    out = base.join(same, (F.col("sha") == F.col("same_sha")) & (F.col("size") == F.col("same_size")), "left")
    first = F.col("page_id").eqNullSafe(F.col("first"))
    refers = F.when(~first, F.col("first")).alias("refers_to")
    if same.where("ties > 1").isEmpty():
        return out.select("page_id", "url", "html", refers)
    tied = first & (F.col("ties") > 1)
    numbered = out.where(tied).withColumn("at", F.row_number().over(Window.partitionBy("sha", "size").orderBy("url")))
    others = out.where(~F.coalesce(tied, F.lit(False))).select("page_id", "url", "html", refers)
    return others.unionByName(numbered.select("page_id", "url", "html", F.when(F.col("at") > 1, F.col("first")).alias("refers_to")))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> str:
    """Write archives into ``folder``; returns the path of the table that lists them."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = revisit_targets(rows, min_bytes)
    rows.mapInArrow(_write(folder, min_bytes), "file string, captures long").where("captures > 0").write.parquet(f"{folder}/files")
    return f"{folder}/files"


def _members(stream) -> Iterator[tuple[int, bytes]]:
    """(place in the file, content) of each gzip member."""
    at, data, press, parts = 0, b"", None, []
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                break
        if press is None:
            press, parts, start = zlib.decompressobj(31), [], at
        parts.append(press.decompress(data))
        at += len(data) - len(press.unused_data)
        data = press.unused_data
        if press.eof:
            yield start, b"".join(parts)
            press = None
    if press is not None:
        raise ValueError("an archive ends inside a record")


def parse_record(content: bytes) -> dict:
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(h["content-length"])]
    out = {"kind": h["warc-type"], "record_id": h["warc-record-id"], "concurrent_to": h.get("warc-concurrent-to"), "refers_to": h.get("warc-refers-to"), "target": h.get("warc-target-uri"), "block": block}
    if out["kind"] in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = h.get("warc-payload-digest", "").removeprefix("sha1:")
        if out["kind"] == "response":
            out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest32(payload), "block": http}
            if stated and stated != out["payload_digest"]:
                raise ValueError(f"{out['record_id']}: the payload differs from its digest")
        else:
            size = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
            out |= {"payload_bytes": int(size[1]) if size else None, "payload_digest": stated}
    elif out["kind"] == "metadata" and (m := re.search(rb"page-id: (-?\d+)", block)):
        out["page_id"] = int(m[1])
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(f, pa.int64() if f in ("place", "page_id", "payload_bytes") else pa.binary() if f in ("payload", "block") else pa.string()) for f in _FIELDS])
    for batch in batches:
        for uri in batch.column("file").to_pylist():
            system, path = opened(uri)
            rows, held = [], 0
            with system.open_input_stream(path, compression=None) as stream:
                for place, content in _members(stream):
                    rows.append({"file": uri, "place": place} | parse_record(content))
                    held += len(content)
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)


def read_warc_records(spark: SparkSession, listed: str) -> DataFrame:
    files = spark.read.parquet(listed)
    return files.select("file").repartition(max(1, files.count())).mapInArrow(_read, RECORD)


def assemble_captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, request, response (a response or revisit) and metadata structs.

    Of several records of a kind for one capture the first (file, place) counts. A request or metadata whose
    response is missing gives a row with a null response.
    """
    spot = ["file", "place"]
    kinds = {"request": ("request",), "response": ("response", "revisit"), "metadata": ("metadata",)}
    rows = records.withColumn("capture", F.when(F.col("kind").isin("response", "revisit"), F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")))
    one = lambda ks: F.min(F.when(F.col("kind").isin(*ks), F.struct(*spot, *[c for c in _FIELDS if c not in spot])))
    return rows.groupBy(F.col("capture").alias("record_id")).agg(*[one(ks).alias(k) for k, ks in kinds.items()])
