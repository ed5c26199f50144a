"""WARC archives of pages, with an index of every record, and reads through that index.

Writing gives one gzip member per record and one index row per record (file,
offset, length, URL, digest). Reading takes index rows, orders them by file and
offset, joins neighbouring byte ranges into one request, and unpacks the members
in it; nothing else of the archives is read.

A payload is a page's html in UTF-8. Of equal payloads that with the smallest
page_id is written as a response, the others as revisits that name it and keep
the HTTP header alone.

Defined results: a null html is an empty payload; a null URL is an empty one; a
row without page_id is a revisit of an equal payload that has one, else a
response; rows of equal page_id and payload are all written as the first is;
other columns are ignored; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, file_system, row_tasks
from .tokens import batches

#: Bytes of an archive after which the next one begins.
ARCHIVE_BYTES = 1 << 30
#: A gap that is read over, and the most that one request fetches unless a single record is larger.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Records of one archive within so many bytes are read by one task.
STRIPE_BYTES = 64 << 20
#: Bytes of payloads that a task holds at once, unless a single one is larger.
BATCH_BYTES = 8 << 20
#: Smaller payloads are always written in full.
LEAST_BYTES = 0
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:framewright:page:"

INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def one_line(text: str) -> str:
    """A header value can't hold line breaks: they are percent-encoded."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in text or "\n" in text else text


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = f"<{PAGE}{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest + url)}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{PAGE}{refers_to}>", f"WARC-Refers-To-Target-URI: {one_line(refers_url or '')}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of an unpacked record."""
    head, rest = data.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    warc = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(warc["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    return warc, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def page_of(name: str | None) -> int | None:
    return int(name[len(PAGE) + 1 : -1]) if name and name.startswith(f"<{PAGE}") else None


def marked(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, and the page and URL that the payload was first seen at (null: here).

    Equal payloads are counted before the shuffle, and only those that occur again
    are looked up, each in SALTS tasks, so a payload that a third of all pages have
    is no task's burden.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html")).withColumns({"sha": F.sha1("html"), "size": F.octet_length("html")})
    first = F.min_by(F.struct("page_id", "url"), F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("url"))).alias("first")
    again = keyed.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "size", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    again = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return salted.join(again, ["sha", "size", "salt"], "left").select("page_id", "url", "html", "first_id", "first_url")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write the pages' records under a folder; returns the index. Only files in the index count."""

    def write(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, path = file_system(folder)
        store.create_dir(path, recursive=True)
        out, name, at, k = None, "", 0, 0
        try:
            for batch in batches(incoming, BATCH_BYTES, "html"):
                rows = []
                for page_id, url, html, first_id, first_url in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first_id", "first_url"))):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"part-{TaskContext.get().partitionId():06d}-{k:04d}-{uuid.uuid4().hex}.warc.gz"
                        out, at, k = store.open_output_stream(f"{path}/{name}", compression=None), 0, k + 1
                        info = b"software: framewright\r\nformat: WARC File Format 1.1\r\n"
                        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                        data = member(head.encode() + info + b"\r\n\r\n")
                        out.write(data)
                        at += len(data)
                    digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
                    revisit = first_id is not None and first_id != page_id
                    data = member(record(page_id, url, html, digest, first_id, first_url, revisit))
                    out.write(data)
                    rows.append((page_id, f"{folder}/{name}", at, len(data), url, digest, "revisit" if revisit else "response"))
                    at += len(data)
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["page_id", "file", "offset", "length", "url", "digest", "record_type"])
        finally:
            if out is not None:
                out.close()

    return marked(pages, least_bytes).mapInArrow(write, INDEX)


def ranges(rows: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(first row, end row, bytes) of requests over (offset, length) in order."""
    out, a = [], 0
    for k in range(1, len(rows) + 1):
        if k == len(rows) or rows[k][0] - sum(rows[k - 1]) > GAP_BYTES or sum(rows[k]) - rows[a][0] > READ_BYTES:
            out.append((a, k, sum(rows[k - 1]) - rows[a][0]))
            a = k
    return out


def read_records(index: DataFrame, payloads: bool = False) -> DataFrame:
    """The records that the index rows name, parsed; with payloads also those (null for revisits). Responses' digests are verified."""

    def read(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, handle = None, None
        for batch in incoming:
            files = batch.column("file").to_pylist()
            places = list(zip(batch.column("offset").to_pylist(), batch.column("length").to_pylist()))
            start = 0
            while start < len(files):
                end = start
                while end < len(files) and files[end] == files[start]:
                    end += 1
                if opened != files[start]:
                    store, path = file_system(files[start])
                    opened, handle = files[start], store.open_input_file(path)
                for a, b, size in ranges(places[start:end]):
                    base = places[start + a][0]
                    handle.seek(base)
                    data = handle.read(size)
                    rows = []
                    for offset, length in places[start + a : start + b]:
                        warc, http, payload = parse(zlib.decompress(data[offset - base : offset - base + length], 31))
                        revisit, digest = warc["WARC-Type"] == "revisit", warc["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"payload digest differs in {opened} at {offset}")
                        row = (page_of(warc["WARC-Record-ID"]), int(http["Content-Length"]), digest, warc["WARC-Type"], page_of(warc.get("WARC-Refers-To")), warc["WARC-Target-URI"])
                        rows.append((*row, None if revisit else payload) if payloads else row)
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names[: len(rows[0])])
                start = end

    stripe = F.floor(F.col("offset") / STRIPE_BYTES)
    ordered = index.select("file", "offset", "length").repartition(row_tasks(index.sparkSession), "file", stripe).sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(read, RECORDS + (", payload binary" if payloads else ""))


def archive_round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write all pages and read every record back through the index."""
    scratch = Scratch(pages.sparkSession, "warc")
    index = scratch.write(write_archives(pages, scratch.uri("archives"), least_bytes), "index")
    return read_records(index)
