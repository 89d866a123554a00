"""WARC records in ZIP packages: a writer, and a reader that never extracts a package.

A package is a ZIP file with two stored members: WARC records, each a gzip member of its own, and an index of their
places (one JSON line each). The reader parses the central directory, with its ZIP64 records, finds both members, and
reads the records by ranges. Paths are URIs of the shared folder, opened through pyarrow's file systems.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import attach, materialise, shared_dir

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: A package is closed at this many bytes of records; a reading task's range has about that many.
PACKAGE_BYTES, RANGE_BYTES = 256 << 20, 8 << 20


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") or "://" not in uri:
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


# --- ZIP directories ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int  # 0: stored
    size: int  # as packed
    header: int  # place of its local header


def _at(f: pa.NativeFile, at: int, n: int) -> bytes:
    f.seek(at)
    data = f.read(n)
    if len(data) < n:
        raise ValueError("the package ends early")
    return data


def directory(f: pa.NativeFile, size: int) -> list[Member]:
    """The members of a ZIP file, from its central directory alone."""
    tail_at = max(0, size - 22 - 65535)
    tail = _at(f, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (len(tail) - end < 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)  # such bytes may stand in the comment
    if end < 0:
        raise ValueError("no end of a central directory: not a ZIP file")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = _at(f, tail_at + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = _at(f, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of the central directory")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    data, members, at = _at(f, start, length), [], 0
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("a damaged central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, plain = struct.unpack_from("<II", data, at + 20)
        n, extra, comment = struct.unpack_from("<HHH", data, at + 28)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        x, stop = at + 46 + n, at + 46 + n + extra
        while x + 4 <= stop:
            kind, width = struct.unpack_from("<HH", data, x)
            if kind == 1:  # 64-bit values of those fields that are full, in this order
                y = x + 4
                if plain == 0xFFFFFFFF:
                    y += 8
                if packed == 0xFFFFFFFF:
                    packed, y = struct.unpack_from("<Q", data, y)[0], y + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack_from("<Q", data, y)[0]
            x += 4 + width
        members.append(Member(name, method, packed, header))
        at = stop + comment
    return members


def data_at(f: pa.NativeFile, member: Member) -> int:
    """The place of a stored member's first byte."""
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored")
    head = _at(f, member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


# --- records -----------------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """A response or revisit record, gzipped. A revisit has the HTTP header of the full payload and no body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{_name(page_id)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{_name(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    return gzip.compress(head + block + b"\r\n\r\n", 4, mtime=0)


def _name(page_id: int | None) -> str:
    return "null" if page_id is None else str(page_id)


def _id(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else int(name)


def parsed(data: bytes) -> dict:
    """The fields of one record. The payload of a response is held against its digest."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x[16:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))
    digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} is not that of its digest")
    refers = _id(fields["warc-refers-to"]) if kind == "revisit" else None
    return {"page_id": _id(fields["warc-record-id"]), "url": fields["warc-target-uri"], "payload": payload, "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": refers}


def gzip_members(data: bytes) -> Iterator[bytes]:
    while data:
        one = zlib.decompressobj(31)
        yield one.decompress(data) + one.flush()
        data = one.unused_data


# --- operators ---------------------------------------------------------------------------------------------------


def roles(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to of every page. See round_trip for its rules."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    equal = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id")).filter("n > 1")
    equal = materialise(equal, "warc-equal")
    out = attach(rows, equal, "digest", "n", F.xxhash64("page_id", "url"))
    revisit = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return out.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes the rows of roles() as packages below folder and returns their table: path, bytes, records.

    Every attempt of a task has packages of its own; those of attempts that were lost are not in the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        made: list[tuple[str, int, int]] = []
        package = member = out = None
        lines: list[str] = []
        at = 0

        def close() -> None:
            nonlocal package, at
            member.close()
            package.writestr(INDEX, "".join(lines))
            package.close()
            out.close()
            made.append((path, fs.get_file_info(f"{root}/{path}").size, len(lines)))
            package, at = None, 0
            lines.clear()

        for batch in batches:
            for page_id, url, payload, digest, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if package is None:
                    path = f"{uuid.uuid4().hex}.wacz"
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{path}")
                    package = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                    member = package.open(ARCHIVE, "w", force_zip64=True)
                data = record(page_id, url, payload, digest, kind, refers_to)
                member.write(data)
                lines.append(json.dumps({"id": page_id, "offset": at, "length": len(data)}) + "\n")
                at += len(data)
                if at >= package_bytes:
                    close()
        if package is not None:
            close()
        if made:
            paths, sizes, records = zip(*made)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{p}" for p in paths]), pa.array(sizes, pa.int64()), pa.array(records, pa.int64())], names=["path", "bytes", "records"])

    return materialise(pages.mapInArrow(run, "path string, bytes long, records long"), "warc-packages")


def ranges(packages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, start, length, records: runs of whole records of each package, from its directory and index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, int, int]] = []
            for path in batch.column(0).to_pylist():
                fs, at = file_system(path)
                with fs.open_input_file(at) as f:
                    members = {m.name: m for m in directory(f, f.size())}
                    base = data_at(f, members[ARCHIVE])
                    index = _at(f, data_at(f, members[INDEX]), members[INDEX].size)
                start = length = n = 0
                for entry in map(json.loads, index.splitlines()):
                    if n and length + entry["length"] > range_bytes:
                        out.append((path, base + start, length, n))
                        start, length, n = entry["offset"], 0, 0
                    length, n = length + entry["length"], n + 1
                if n:
                    out.append((path, base + start, length, n))
            columns = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["path", "start", "length", "records"])

    return packages.select("path").repartition("path").mapInArrow(run, "path string, start long, length long, records long")


RECORD = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
RECORD_SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_packages(packages: DataFrame, columns: list[str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of packages (a table with their path), read by ranges; only the named columns leave the tasks."""
    names = columns or list(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, length, n in zip(*(c.to_pylist() for c in batch.columns)):
                fs, at = file_system(path)
                with fs.open_input_file(at) as f:
                    rows = [{c: r[c] for c in names} for r in map(parsed, gzip_members(_at(f, start, length)))]
                if len(rows) != n:
                    raise ValueError(f"{path} has {len(rows)} records where its index has {n}")
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, RECORD[c]) for c in names]))

    kinds = dict(x.split(" ") for x in RECORD_SCHEMA.split(", "))
    found = ranges(packages, range_bytes)
    # a row stands for megabytes of records: a stated number of partitions is not merged for being small
    tasks = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(tasks, "path", "start").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes a record per page, reads the packages back, and returns page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload. Of records with equal payloads of LEAST_REVISIT bytes or more, that of the smallest
    page_id (null ids aside) is the response and the others revisit it; rows that repeat this page_id are responses too,
    and where all ids of equal payloads are null, all are responses. A null url is empty. An empty table gives no rows;
    columns other than page_id, url and html are not read.
    """
    packages = write_packages(roles(pages), f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}")
    return read_packages(packages, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
