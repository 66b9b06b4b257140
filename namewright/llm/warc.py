"""WARC records in ZIP packages, read by range without extraction.

A package is a ZIP whose members are stored, not deflated: `archive/data.warc.gz` (every record a
gzip member of its own, so that a byte range is a record) and `indexes/index.cdxj` (a JSON line for
each record with its range).  The reader finds the end record, the ZIP64 end record if there is one,
and the central directory, looks up the two members, and reads single records by range.  Packages go
to any store that pyarrow.fs opens.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.llm.common import scratch, stored, utf8

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
MIN_REVISIT = 1000
ROLL_BYTES = 256 << 20
READ_AHEAD = 1 << 20
DATE = "2020-01-01T00:00:00Z"
#: Fixed values of the ZIP format: signatures and layouts (APPNOTE 4.3).
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"

Range = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int


def members(read: Range, size: int) -> dict[str, Member]:
    """The central directory of a ZIP of `size` bytes, of which read(offset, length) gives ranges."""
    start = max(0, size - (1 << 16) - 22)
    tail = read(start, size - start)
    at = tail.rfind(END)
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail) and (before := tail.rfind(END, 0, at)) >= 0:
        at = before
    if at < 0:
        raise ValueError("no end of a central directory: not a ZIP package")
    count, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if (count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF) and start + at >= 20:
        locator = read(start + at - 20, 20)
        if locator[:4] == LOCATOR64:
            end = read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end[:4] != END64:
                raise ValueError("the ZIP64 locator points at no ZIP64 end record")
            count, length, offset = struct.unpack_from("<QQQ", end, 32)
    directory, found, at = read(offset, length), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("the central directory is broken")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, full, name_len, extra_len, comment_len = struct.unpack_from("<IIHHH", directory, at + 20)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + name_len].decode("utf-8")
        extra = directory[at + 46 + name_len : at + 46 + name_len + extra_len]
        full, packed, header = _wide(extra, full, packed, header)
        found[name] = Member(name, method, full, packed, header)
        at += 46 + name_len + extra_len + comment_len
    return found


def _wide(extra: bytes, *values: int) -> list[int]:
    """Values that are all ones stand in the ZIP64 extra field, in this order."""
    out, at = list(values), 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            place = at + 4
            for i, v in enumerate(out):
                if v == 0xFFFFFFFF:
                    out[i] = struct.unpack_from("<Q", extra, place)[0]
                    place += 8
        at += 4 + length
    return out


def data_offset(read: Range, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed by method {member.method}; only stored members have ranges")
    head = read(member.header, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"{member.name} has no local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC record: a response with its payload, or a revisit with the HTTP header alone."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict[str, object]:
    """page_id, url, payload (None for a revisit), payload_bytes, payload_digest, record_type, refers_to."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = fields["WARC-Type"]
    number = lambda v: int(v) if (v := v.removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload": payload if kind == "response" else None,
        "payload_bytes": len(payload) if kind == "response" else length,
        "payload_digest": hashlib.sha1(payload).hexdigest() if kind == "response" else fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": kind, "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None,
    }


class Package:
    """One package being written."""

    def __init__(self, uri: str) -> None:
        self.uri = uri
        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.sink = store.open_output_stream(path, compression=None)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.index: list[str] = []
        self.size = 0

    def add(self, page: int | None, raw: bytes) -> None:
        packed = gzip.compress(raw, 3, mtime=0)
        self.member.write(packed)
        self.index.append(json.dumps({"page": page, "offset": self.size, "length": len(packed)}))
        self.size += len(packed)

    def close(self) -> dict[str, object]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.close()
        self.sink.close()
        return {"package": self.uri, "records": len(self.index)}


def records(uri: str) -> Iterator[dict[str, object]]:
    """All records of a package, each read by its range."""
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:

        def read(offset: int, length: int) -> bytes:
            f.seek(offset)
            return f.read(length)

        found = members(read, f.size())
        index = found[INDEX]
        lines = read(data_offset(read, index), index.size).decode().splitlines()
        base = data_offset(read, found[ARCHIVE])
        held, at = b"", 0
        for line in lines:
            entry = json.loads(line)
            start, length = entry["offset"], entry["length"]
            if start < at or start + length > at + len(held):
                held, at = read(base + start, max(length, min(READ_AHEAD, found[ARCHIVE].size - start))), start
            yield parse(zlib.decompress(held[start - at : start - at + length], wbits=31))


def write_packages(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write every row as a record and return the manifest (package, records), already stored.

    Of rows with equal payloads of min_revisit bytes or more, those with the largest id are
    responses and the rest revisit it.  Null payloads are empty; ids may be null (then never
    referred to, unless no id is there: those are responses); a null URL is left out; rows of one id
    all get records.  A task that is run again writes a new package and only the finished one is
    listed.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    long = rows.where(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.count("*").alias("n"), F.max("page").alias("keep"))
    copies = stored(long.where("n > 1 and keep is not null").select("digest", "keep"), "warc-copies")
    told = rows.join(copies, "digest", "left").withColumn("refers_to", F.when(F.col("keep").isNotNull() & ~F.col("page").eqNullSafe(F.col("keep")), F.col("keep")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        package, done = None, []
        for pdf in batches:
            for page, url, text, refers_to in zip(pdf["page"], pdf["url"], pdf["payload"], pdf["refers_to"], strict=True):
                package = package or Package(f"{root}/{uuid.uuid4().hex}.wacz")
                page, refers_to = (None if pd.isna(x) else int(x) for x in (page, refers_to))
                package.add(page, record(page, url, utf8(text), refers_to))
                if package.size >= ROLL_BYTES:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        if done:
            yield pd.DataFrame(done)

    chosen = told.select(*(F.col(c).cast("string").alias(c) for c in ("page", "refers_to")), "url", "payload")
    return stored(chosen.mapInPandas(run, "package string, records long"), "warc-manifest")


def read_packages(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row for each record of the packages: page_id, payload_bytes, payload_digest, record_type,
    refers_to, and with_payload url and payload."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["url", "payload"] * with_payload
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * with_payload

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri in pdf["package"]:
                rows, size = [], 0
                for r in records(uri):
                    rows.append([r[n] for n in names])
                    size += 200 + (r["payload_bytes"] if with_payload else 0)
                    if size > 8 << 20:
                        yield _frame(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _frame(rows, names)

    return manifest.select("package").repartition(max(1, manifest.count())).mapInPandas(run, schema)


def _frame(rows: list[list], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write pages as packages in the shared folder and read them back."""
    root = scratch(pages.sparkSession, "warc")
    return read_packages(write_packages(pages, root, id_col, url_col, payload_col))
