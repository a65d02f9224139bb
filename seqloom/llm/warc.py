"""WARC archives: records written by Spark's text writer, read back whole, segments reassembled."""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import new_path, ref, stage

#: Payloads above this are sent in chunks of it; record blocks above SEGMENT are segmented.
CHUNK = 2 << 10
SEGMENT = 4 << 10
#: Records in a file, at most: with SEGMENT this bounds a file, which is read as one row.
PER_FILE = 2000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"  # after each record; the text writer's line separator
RECORD = "record_id string, type string, page_id long, refers_to long, digest string, origin string, number int, total long, block binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken or cut short."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def _head(fields: list[tuple[str, str | int | None]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def make_records(row: int, page_id: int | None, url: str | None, payload: bytes, first_row: int, first_page: int | None, chunk: int = CHUNK, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page, without their end marks: a response (in segments if it is large) or a revisit."""
    name = f"<urn:seqloom:record:{row}>"
    url = None if url is None else " ".join(url.split())
    digest = "sha1:" + base32_sha1(payload)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url), ("X-Page-ID", page_id), ("WARC-Payload-Digest", digest)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    kind = ("Content-Type", "application/http;msgtype=response")
    if row != first_row:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload)
        return [_head([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:seqloom:record:{first_row}>"), ("X-Refers-To-Page", first_page), kind, ("Content-Length", len(block))]) + block]
    if len(payload) > chunk:
        block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    else:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [_head([("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("WARC-Segment-Number", 1 if len(parts) > 1 else None), kind, ("Content-Length", len(parts[0]))]) + parts[0]]
    for k, part in enumerate(parts[1:], 2):
        out.append(_head([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:seqloom:record:{row}:{k}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None), ("Content-Length", len(part))]) + part)
    return out


def split_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive; lengths decide, not what a block contains."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield head, block
        at = end + 8 + size


def payload_of(block: bytes) -> tuple[bytes, int]:
    """Payload of an HTTP response, and its length by the header (its own, if that has none)."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        body = dechunked(body)
        return body, len(body)
    return body, int(fields.get(b"content-length", len(body)))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk: int = CHUNK, segment: int = SEGMENT, per_file: int = PER_FILE) -> None:
    """Write gzipped archives: of rows with equal payloads that with the smallest id (nulls last; then the first row) is a response, the others revisit it."""
    rows = pages.select(ref(id_col).cast("long").alias("page_id"), ref(url_col).cast("string").alias("url"), F.coalesce(ref(html_col), F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row")).withColumn("digest", F.sha1("html"))
    rows = stage(rows, "pages")  # from here on a row keeps its number, whatever is computed again
    first = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("void"), "page_id", "row")).alias("f"))
    # payloads that occur once are left out, and the rest is written first: its size decides how Spark joins it
    first = stage(first.where("n > 1").select("digest", F.col("f.row").alias("first_row"), F.col("f.page_id").alias("first_page")), "repeated-payloads")
    placed = rows.join(first, "digest", "left").select("row", "page_id", "url", "html", F.coalesce("first_row", "row").alias("first_row"), "first_page")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            for row, page, url, html, first_row, first_page in zip(*(b.column(c).to_pylist() if c != "html" else b.column(c).cast(pa.binary()).to_pylist() for c in ("row", "page_id", "url", "html", "first_row", "first_page"))):
                out += make_records(row, page, url, html, first_row, first_page, chunk, segment)
                if len(out) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    records = placed.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.option("lineSep", END).option("maxRecordsPerFile", str(per_file)).option("compression", "gzip").text(path)


def _read(segments: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content").to_pylist():
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows = []
                for head, block in split_records(data):
                    if ("warc-segment-number" in head) != segments:
                        continue
                    number = lambda k: int(head[k]) if k in head else None  # noqa: E731, B023
                    rows.append({"record_id": head.get("warc-record-id"), "type": head.get("warc-type"), "page_id": number("x-page-id"), "refers_to": number("x-refers-to-page"), "digest": head.get("warc-payload-digest", "").removeprefix("sha1:"), "origin": head.get("warc-segment-origin-id", head.get("warc-record-id")), "number": number("warc-segment-number"), "total": number("warc-segment-total-length"), "block": block})
                yield from pa.Table.from_pylist(rows, schema=_SCHEMA).to_batches()

    return run


_SCHEMA = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = {k: [] for k in ("payload", "payload_bytes", "payload_digest", "problem")}
        for kind, digest, parts in zip(b.column("type").to_pylist(), b.column("digest").to_pylist(), b.column("parts").to_pylist()):
            payload, size, problem = b"", None, None
            try:
                if parts[0]["number"] is not None:
                    if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] is None:
                        raise ValueError("segments are missing")
                    if sum(len(p["block"]) for p in parts) != parts[-1]["total"]:
                        raise ValueError("segments differ from the total length")
                payload, size = payload_of(b"".join(p["block"] for p in parts))
                if kind == "response":
                    found = base32_sha1(payload)
                    if digest and found != digest:
                        raise ValueError("payload differs from its digest")
                    digest = found
            except ValueError as e:
                problem = str(e)
            for k, v in (("payload", payload), ("payload_bytes", size), ("payload_digest", digest), ("problem", problem)):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([b.column("record_id"), b.column("type"), b.column("page_id"), b.column("refers_to"), pa.array(out["payload"], pa.binary()), pa.array(out["payload_bytes"], pa.int64()), pa.array(out["payload_digest"], pa.string()), pa.array(out["problem"], pa.string())], ["record_id", "record_type", "page_id", "refers_to", "payload", "payload_bytes", "payload_digest", "problem"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Whole records of a folder of archives: record_id, record_type, page_id, refers_to, payload, payload_bytes, payload_digest, problem.

    Continuations are grouped by their origin, ordered by number and checked against the
    total length; chunked framing is taken off. A record with missing segments, a wrong
    length or digest, or broken framing has its problem named and payload_bytes null.
    Only segmented records are shuffled.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    part = F.struct("number", "total", "block")
    whole = files.mapInArrow(_read(False), RECORD).select("record_id", "type", "page_id", "refers_to", "digest", F.array(part).alias("parts"))
    segments = files.mapInArrow(_read(True), RECORD).groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("number", "total", "block"))).alias("parts"), F.max(F.struct((F.col("number") == 1).alias("head"), "type", "page_id", "refers_to", "digest")).alias("h"))
    segments = segments.select(F.col("origin").alias("record_id"), "h.type", "h.page_id", "h.refers_to", "h.digest", "parts")
    return whole.unionByName(segments).mapInArrow(_decode, "record_id string, record_type string, page_id long, refers_to long, payload binary, payload_bytes long, payload_digest string, problem string")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as archives in the shared folder and read them back; see write_warc() and read_warc().

    Null html: an empty payload. Null url: no target. Null id: null again. Repeated rows:
    the first is the response, the others revisit it. An empty table gives no records.
    """
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path, id_col, url_col, html_col)
    return read_warc(pages.sparkSession, path)
