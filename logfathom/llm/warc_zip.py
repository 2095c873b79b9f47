"""WARC records in ZIP packages: written by Spark tasks, found through the packages' directories, read by byte ranges.

A package is a ZIP file with two stored (not compressed) members: ``archive/data.warc.gz``, whose records are gzip
members of their own, and ``indexes/index.cdxj``, a line of JSON for each record with its offset and length there. The
reader takes the end of a package, its central directory (ZIP64 too) and the index, and then only the bytes of records;
nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfathom.llm._shared import fresh_path, stage

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Forward:
    """What zipfile needs of an output that can't seek."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def write(self, data) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def seek(self, *_):
        raise OSError("forward only")

    def flush(self) -> None:
        pass


def directory(read_at, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (first byte, length) of the stored members of a ZIP file, given read_at(offset, length) and its size.

    Reads the end record (behind a comment of any length), the ZIP64 end record if a field overflowed, the central
    directory with its ZIP64 extra fields, and 30 bytes of each member's local header.
    """
    tail_at = max(0, size - 65557)
    tail = read_at(tail_at, size - tail_at)
    at = tail.rfind(b"PK\5\6", 0, max(0, len(tail) - 18))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise ValueError("not a ZIP file")
    entries, length, start = struct.unpack_from("<HII", tail, at + 10)
    end = tail_at + at
    if entries == 0xFFFF or 0xFFFFFFFF in (length, start):
        mark, _, wide_at = struct.unpack_from("<4sIQ", read_at(end - 20, 20))
        if mark != b"PK\6\7":
            raise ValueError("ZIP64 locator is missing")
        mark, entries, length, start = struct.unpack_from("<4s28xQQQ", read_at(wide_at, 56))
        if mark != b"PK\6\6":
            raise ValueError("ZIP64 end record is missing")
    raw, at, out = read_at(start, length), 0, {}
    for _ in range(entries):
        mark, flags, method, packed, plain, n_name, n_extra, n_note, local = struct.unpack_from("<4s4xHH8xIIHHH8xI", raw, at)
        if mark != b"PK\1\2":
            raise ValueError("central directory is damaged")
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # the 64-bit values of just those fields that are full, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                plain, packed, local = (next(wide) if x == 0xFFFFFFFF else x for x in (plain, packed, local))
            e += 4 + n
        at += 46 + n_name + n_extra + n_note
        if method == 0 and not name.endswith("/"):
            head = read_at(local, 30)
            if head[:4] != b"PK\3\4":
                raise ValueError(f"{name}: local header is missing")
            n_name, n_extra = struct.unpack_from("<HH", head, 26)
            out[name] = (local + 30 + n_name + n_extra, packed)
    return out


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record as a gzip member; a revisit has the HTTP head alone, whose Content-Length is the full payload's."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {name(refers_to)}")
        lines.append(f"Refers-To-Page-ID: {refers_to}")
    else:
        block += payload
    head = "\r\n".join([*lines, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"])
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse_record(packed: bytes) -> dict:
    """page_id, url, payload (null for a revisit), payload_bytes, payload_digest, record_type and refers_to of a record."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    said = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and digest(payload) != said:
        raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
    n = len(payload) if kind == "response" else int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("page-id"), "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None, "payload_bytes": n, "payload_digest": said, "record_type": kind, "refers_to": number("refers-to-page-id")}


def write_packages(pages: DataFrame, path: str, revisit_from: int = 0, date: str = "2024-01-01T00:00:00Z", most_bytes: int = 1 << 30) -> DataFrame:
    """Write a WARC record for every page (page_id, url, html) into ZIP packages under path; returns their files.

    Of pages with equal payloads of ``revisit_from`` bytes or more, the one with the smallest page_id is a response and
    the others revisit it; repeated rows with that page_id are all responses, and so are pages whose equals all have no
    page_id. A null html is an empty payload. Extra columns are ignored; an empty table gives no packages. A task that
    runs again writes files of its own, and the result names only those of tasks that ended well.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    equals = rows.filter(F.octet_length("html") >= revisit_from).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    placed = rows.join(equals.select("sha", "first"), "sha", "left").select("page_id", "url", "html", "first", revisit.alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, package = TaskContext.get(), 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if package is None:
                    where, inner = _files(path)
                    where.create_dir(inner, recursive=True)
                    name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{number}.zip"
                    number, index, at = number + 1, [], 0
                    sink = where.open_output_stream(f"{inner}/{name}")
                    package = zipfile.ZipFile(_Forward(sink), "w", zipfile.ZIP_STORED)
                    data = package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
                record = make_record(row["page_id"], row["url"], row["html"], row["first"], row["revisit"], date)
                data.write(record)
                index.append(json.dumps({"page_id": row["page_id"], "offset": at, "length": len(record)}))
                at += len(record)
                if at >= most_bytes:
                    yield close(package, data, sink, index, f"{path}/{name}")
                    package = None
        if package is not None:
            yield close(package, data, sink, index, f"{path}/{name}")

    def close(package, data, sink, index: list[str], file: str) -> pa.RecordBatch:
        data.close()
        package.writestr(zipfile.ZipInfo(INDEX), "\n".join(index))
        package.close()
        sink.close()
        return pa.RecordBatch.from_pylist([{"file": file, "records": len(index)}])

    return stage(placed.mapInArrow(write, "file string, records long"), "packages")


def read_packages(packages: DataFrame, payloads: bool = False, slab: int = 8 << 20) -> DataFrame:
    """One row for each record of the ZIP packages named by ``file``: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to and, with payloads, payload. Indexes are read first; then tasks share the records out by
    slabs of packages and read their bytes, neighbours in one go. A digest that doesn't fit its payload is an error."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                where, inner = _files(file)
                with where.open_input_file(inner) as f:
                    members = directory(lambda at, n: f.read_at(n, at), f.size())
                    (base, _), (at, n) = members[DATA], members[INDEX]
                    lines = [json.loads(x) for x in f.read_at(n, at).decode().splitlines()]
                starts = [base + x["offset"] for x in lines]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(lines), pa.string()), pa.array(starts, pa.int64()), pa.array([x["length"] for x in lines], pa.int64())], names=["file", "at", "length"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True)), []
            file, f, data, base = None, None, b"", 0
            for i, (name, at, n) in enumerate(rows):
                if name != file:
                    if f is not None:
                        f.close()
                    where, inner = _files(name)
                    f, file, data, base = where.open_input_file(inner), name, b"", 0
                if not base <= at or at + n > base + len(data):
                    end = at + n
                    for other, a, m in rows[i + 1 :]:
                        if other != name or a != end or a + m - at > 1 << 22:
                            break
                        end = a + m
                    data, base = f.read_at(end - at, at), at
                out.append(parse_record(data[at - base : at - base + n]))
            if f is not None:
                f.close()
            yield pa.RecordBatch.from_arrays([pa.array([x[k.name] for x in out], k.type) for k in schema], schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads)
    n = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = packages.select("file").repartition(n, "file").mapInArrow(locate, "file string, at long, length long")
    slabs = spread.repartition(n, "file", F.floor(F.col("at") / slab))
    return slabs.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def archive_pages(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Write pages to packages in the shared folder and read their records back."""
    return read_packages(write_packages(pages, fresh_path(pages.sparkSession, "warc"), revisit_from))
