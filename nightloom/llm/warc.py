"""Web archives: an index of records first, then coalesced byte-range reads of the selected ones.

Writing: each task writes one archive of gzip members (one for each record) to a shared folder and
returns an index row for each: file, offset, length, URL, digest. A lost task writes another file;
the index names only files of tasks that ended well. Reading: selected index rows are range-sorted by
file and offset, neighbours become one read, and each task reads its own ranges only.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, functions as F

from .shared import cut, own_dir

#: Bytes of one coalesced read, and the gap that is read over rather than sought.
READ, GAP = 8 << 20, 64 << 10
CRLF = b"\r\n"


def payload_digest(payload: Column) -> Column:
    """Bare base32 SHA-1 of a binary column: ten hexadecimal digits at a time are eight of base 32."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to) of pages (page_id, url, html).

    Of records with equal payloads of at least `least` bytes the smallest page_id is the response,
    others refer to it. Only digests that repeat are joined back, as a narrow table.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": payload_digest(F.col("payload"))})
    same = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = same.where("n > 1 and first is not null").select("payload_digest", "payload_bytes", "first")
    first = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return rows.join(repeated, ["payload_digest", "payload_bytes"], "left").select("page_id", "url", "payload", "payload_bytes", "payload_digest", first.alias("refers_to"))


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One record of WARC 1.1: a response with its payload, or a revisit with the same HTTP head and none."""
    http = b"HTTP/1.1 200 OK" + CRLF + b"Content-Type: text/html; charset=utf-8" + CRLF + b"Content-Length: %d" % len(payload) + CRLF * 2
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return CRLF.join([*(h.encode() for h in head), b"Content-Length: %d" % len(block), b"", b""]) + block + CRLF * 2


def parse(raw: bytes) -> dict:
    """What a record says; a response's payload is measured and digested anew."""
    head, _, rest = raw.partition(CRLF * 2)
    lines = dict(x.split(b": ", 1) if b": " in x else (x.rstrip(b":"), b"") for x in head.split(CRLF)[1:])
    block = rest[: int(lines[b"Content-Length"])]
    http, _, payload = block.partition(CRLF * 2)
    told = dict(x.split(b": ", 1) for x in http.split(CRLF)[1:])
    kind = lines[b"WARC-Type"].decode()
    digest = lines[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError("a payload doesn't fit its digest")
    own, other = (x.decode().removeprefix("<urn:page:").rstrip(">") for x in (lines[b"WARC-Record-ID"], lines.get(b"WARC-Refers-To", b"")))
    return {
        "page_id": int(own) if own else None, "url": lines.get(b"WARC-Target-URI", b"").decode(), "payload": payload if kind == "response" else None,
        "payload_bytes": len(payload) if kind == "response" else int(told[b"Content-Length"]), "payload_digest": digest, "record_type": kind, "refers_to": int(other) if other else None,
    }


INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string())])
INDEX_DDL = "file string, offset long, length long, page_id long, url string, payload_digest string"
RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
RECORD_DDL = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        name, out, at, index = f"{path}/{uuid.uuid4().hex}.warc.gz", None, 0, []
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                out = fs.open_output_stream(name, compression=None) if out is None else out
                packer = zlib.compressobj(6, wbits=31)
                raw = packer.compress(record(x["page_id"], x["url"], x["payload"], x["payload_digest"], x["refers_to"])) + packer.flush()
                out.write(raw)
                rows.append({"file": name, "offset": at, "length": len(raw), "page_id": x["page_id"], "url": x["url"], "payload_digest": x["payload_digest"]})
                at += len(raw)
            index.append(pa.RecordBatch.from_pylist(rows, schema=INDEX))
        if out is not None:
            out.close()
        yield from index  # an archive is whole before its index goes on

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0) -> tuple[DataFrame, str]:
    """(index, folder): archives of all pages under the folder, which driver and executors share.

    A null html is an empty payload; equal payloads are one response and revisits (see resolve); rows
    that repeat a page_id with an equal payload are all responses if it is the smallest. Null URLs are
    kept as such; a null id is never the smallest: its record revisits the smallest id's, if there is one. An empty table gives an empty index. The index is written before it is used.
    """
    folder = folder or own_dir(pages.sparkSession, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    return cut(resolve(pages, least).mapInArrow(_write(folder), INDEX_DDL)), folder


def _read(folder: str, read: int, gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        name = file = None
        for batch in batches:
            ranges = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            i = 0
            while i < len(ranges):
                j, (own, start, length) = i + 1, ranges[i]
                end = start + length
                while j < len(ranges) and ranges[j][0] == own and ranges[j][1] - end <= gap and ranges[j][1] + ranges[j][2] - start <= max(read, length):
                    end = max(end, ranges[j][1] + ranges[j][2])
                    j += 1
                if own != name:
                    name, file = own, fs.open_input_file(own)
                file.seek(start)
                chunk = memoryview(file.read(end - start))
                records = [parse(zlib.decompress(chunk[s - start : s - start + n], wbits=31)) for _, s, n in ranges[i:j]]
                yield pa.RecordBatch.from_pylist(records, schema=RECORD)
                i = j

    return run


def read_archives(index: DataFrame, folder: str, read: int = READ, gap: int = GAP, partitions: int | None = None) -> DataFrame:
    """The records of the index rows given (a selection or all), one row each, payload checked against its digest."""
    n = partitions or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(_read(folder, read, gap), RECORD_DDL)
