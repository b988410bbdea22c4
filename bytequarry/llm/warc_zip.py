"""WARC records in ZIP packages, read by range.

A package is a ZIP file whose members are stored, not deflated:
archive/data.warc.gz (a gzip member for each record), indexes/index.cdxj (a
line for each record: key, time, JSON with offset and length) and
datapackage.json. Packages of other writers may index by CDX lines instead,
and pack their indexes by gzip.
The reader finds the central directory from the file's end, with ZIP64 records
where 32 bits don't do, takes the archive's place from the member's local
header, and reads each record by its range; no member is ever extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import nullcontext
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import BinaryIO
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits, fresh_path, marked, spread_join, staged, text_of

#: Payloads shorter than this are always written in full.
REVISIT_FROM = 100
#: A package is closed once its archive has so many bytes.
PACKAGE_BYTES = 64 << 20
#: Records that one row of the reader's plan asks for.
RECORDS_A_READ = 2000
#: Ends of the names of indexes by record; others, such as .idx, point into these.
INDEXES = (".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")
MAX32, MAX16 = 0xFFFFFFFF, 0xFFFF


# --- ZIP ---------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int
    crc: int


class ZipDirectory:
    """The central directory of a ZIP file, from a seekable file object."""

    def __init__(self, f: BinaryIO) -> None:
        self.f = f
        size = f.seek(0, io.SEEK_END)
        tail_at = max(0, size - 22 - MAX16)
        f.seek(tail_at)
        tail = f.read(size - tail_at)
        at = len(tail)
        while True:  # a comment may hold the signature too: its length must fit the file's end
            at = tail.rfind(b"PK\x05\x06", 0, at)
            if at < 0:
                raise ValueError("no end of central directory")
            if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                break
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        end = tail_at + at
        if count == MAX16 or MAX32 in (length, start):
            f.seek(max(0, end - 20))
            locator = f.read(20)
            if locator[:4] == b"PK\x06\x07":
                f.seek(struct.unpack_from("<Q", locator, 8)[0])
                record = f.read(56)
                if record[:4] != b"PK\x06\x06":
                    raise ValueError("no ZIP64 end record at its place")
                count, length, start = struct.unpack_from("<QQQ", record, 32)
        f.seek(start)
        self.members = self._entries(f.read(length), count)

    @staticmethod
    def _entries(data: bytes, count: int) -> dict[str, Member]:
        out, at = {}, 0
        for _ in range(count):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("bad central directory entry")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            crc, packed, size, name_n, extra_n, comment_n = struct.unpack_from("<IIIHHH", data, at + 16)
            header = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + 46 + name_n : at + 46 + name_n + extra_n]
            x = 0
            while x + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, x)
                if kind == 1:  # the wide values stand there in this order, where the narrow ones are all ones
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, x + 4))
                    size = next(wide) if size == MAX32 else size
                    packed = next(wide) if packed == MAX32 else packed
                    header = next(wide) if header == MAX32 else header
                x += 4 + n
            out[name] = Member(name, method, size, packed, header, crc)
            at += 46 + name_n + extra_n + comment_n
        return out

    def start(self, m: Member) -> int:
        """Where a stored member's bytes begin."""
        if m.method:
            raise ValueError(f"{m.name} is not stored")
        return self._begin(m)

    def _begin(self, m: Member) -> int:
        self.f.seek(m.header)
        head = self.f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("bad local header")
        return m.header + 30 + sum(struct.unpack_from("<HH", head, 26))

    def content(self, m: Member) -> bytes:
        """A member's bytes, stored or deflated."""
        self.f.seek(self._begin(m))
        data = self.f.read(m.packed)
        if m.method not in (0, 8):
            raise ValueError(f"{m.name} is packed by method {m.method}")
        return zlib.decompress(data, -15) if m.method else data

    def read(self, m: Member) -> bytes:
        self.f.seek(self.start(m))
        return self.f.read(m.size)


class StoredZipWriter:
    """A ZIP file of stored members, written front to back. wide: ZIP64 records even where 32 bits do."""

    def __init__(self, f: BinaryIO, wide: bool = False) -> None:
        self.f, self.wide, self.at, self.entries = f, wide, 0, []

    def _put(self, data: bytes) -> None:
        self.f.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, header = name.encode(), zlib.crc32(data), self.at
        wide = self.wide or len(data) >= MAX32
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        n = MAX32 if wide else len(data)
        self._put(struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45 if wide else 20, 0x800, 0, 0, 33, crc, n, n, len(raw), len(extra)) + raw + extra)
        self._put(data)
        self.entries.append((raw, crc, len(data), header))

    def close(self) -> None:
        start = self.at
        for raw, crc, n, header in self.entries:
            wide = [x for x in (n, n, header) if self.wide or x >= MAX32]
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            small = lambda x: MAX32 if self.wide or x >= MAX32 else x
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, small(n), small(n), len(raw), len(extra), 0, 0, 0, 0, small(header)) + raw + extra)
        length, count = self.at - start, len(self.entries)
        if self.wide or count >= MAX16 or start >= MAX32 or length >= MAX32:
            end = self.at
            self._put(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, length, start))
            self._put(struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
            count, length, start = MAX16, MAX32, MAX32
        self._put(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, count, count, length, start, 0))


# --- WARC --------------------------------------------------------------------

DATE = datetime(2024, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_uri(page_id: int | None) -> str:
    """The record's id: the page's, or one of its own where the page has none."""
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def uri_page(uri: str | None) -> int | None:
    number = uri[10:-1] if uri and uri.startswith("<urn:page:") else ""
    return int(number) if number.lstrip("-").isdigit() else None


def sort_key(url: str) -> str:
    """The address as indexes sort it: host parts from the last, then path and query, in lower case."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return quote(url.lower(), safe="")
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(f"{','.join(reversed(host.split('.')))}{f':{port}' if port else ''}){rest}".lower(), safe=":/?#[]@!$&()*+,;=%~")


def index_line(url: str, uri: str, digest: str, offset: int, length: int, filename: str) -> str:
    """A CDXJ line: key, time, JSON."""
    said = {"url": url, "digest": f"sha256:{digest}", "mime": "text/html", "status": "200", "offset": str(offset), "length": str(length), "filename": filename, "recordId": uri}
    return f"{sort_key(url)} {DATE.translate(str.maketrans('', '', '-:TZ'))} {json.dumps(said)}"


def index_spans(data: bytes) -> list[tuple[str, int, int] | str]:
    """(file name, offset, length) of the lines of an index, packed by gzip or not: CDXJ (key, time, JSON; the time may lack), or CDX, whose first line names its fields by letters. A line that doesn't say them gives what is wrong with it."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    fields: list[bytes] = []
    out: list[tuple[str, int, int] | str] = []
    for number, line in enumerate(data.splitlines(), 1):
        try:
            if line.lstrip().startswith(b"CDX "):
                fields = line.split()[1:]
            elif fields and line.strip():
                x = dict(zip(fields, line.split(), strict=False))
                out.append(_span(x[b"g"].decode(), x[b"V"], x[b"S"]))
            elif line.strip() and not line.startswith(b"!"):
                parts = line.split(b" ", 2)
                said = json.loads(parts[2] if len(parts) == 3 and parts[1].isdigit() else line.partition(b" ")[2])
                out.append(_span(said["filename"], said["offset"], said["length"]))
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            out.append(f"line {number}: {type(e).__name__} {e}")
    return out


def _span(name: str, offset: bytes | str | int, length: bytes | str | int) -> tuple[str, int, int]:
    found = name.rpartition("/")[2], int(offset), int(length)
    if found[1] < 0 or found[2] <= 0:
        raise ValueError("a place out of the archive")
    return found


def write_record(kind: str, uri: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC/1.1 record. A revisit has the HTTP head only; digest and length are of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {uri}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _head(data: bytes) -> tuple[str, dict[str, str], bytes]:
    top, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = top.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, rest


def _digest_fits(said: str, payload: bytes) -> bool:
    """Whether a digest header (algorithm:value, hexadecimal or base 32) is that of the payload; one of an unknown algorithm says nothing."""
    kind, _, value = said.partition(":")
    kind = kind.lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha256", "sha512"):
        return True
    got = hashlib.new(kind, payload).digest()
    return value.lower() == got.hex() or value.upper().rstrip("=") == base64.b32encode(got).decode().rstrip("=")


def read_record(data: bytes) -> dict:
    """type, uri, refers_to, url, payload_bytes, payload_digest, payload (None for a revisit) and error of a record's bytes.

    error says what is unsound: no record, a block cut short, or a payload
    whose digest is not the header's.
    """
    first, warc, rest = _head(data)
    if not first.startswith("WARC/"):
        return {"type": None, "uri": None, "refers_to": None, "url": None, "payload_bytes": None, "payload_digest": None, "payload": None, "error": "no WARC record"}
    size = int(warc.get("content-length", "0"))
    block, error = rest[:size], None if len(rest) >= size else "block is cut short"
    kind, said = warc.get("warc-type"), warc.get("warc-payload-digest", "")
    http, payload = ({}, block) if "application/http" not in warc.get("content-type", "") else _head(block)[1:]
    known = said.partition(":")[2].lower() if said.lower().startswith("sha256:") else None
    out = {"type": kind, "uri": warc.get("warc-record-id"), "refers_to": warc.get("warc-refers-to"), "url": warc.get("warc-target-uri"), "payload": None, "error": error}
    if kind == "revisit":
        length = http.get("content-length", "")
        return out | {"payload_bytes": int(length) if length.isdigit() else None, "payload_digest": known}
    if error is None and not _digest_fits(said, payload):
        out["error"] = "payload is not what its digest says"
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}


# --- Spark -------------------------------------------------------------------


def _opener(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


class _Package:
    """An open package and what goes into its archive."""

    def __init__(self, folder: str) -> None:
        self.uri = f"{folder}/{uuid.uuid4().hex}.wacz"
        self.archive, self.index = bytearray(), []

    def add(self, record: bytes, url: str, uri: str, digest: str) -> None:
        packed = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = packed.compress(record) + packed.flush()
        self.index.append(index_line(url, uri, digest, len(self.archive), len(data), "data.warc.gz"))
        self.archive += data

    def close(self, wide: bool) -> tuple[str, int]:
        fs, path = _opener(self.uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        lines = "".join(f"{x}\n" for x in sorted(self.index)).encode()
        with fs.open_output_stream(path) as f:
            z = StoredZipWriter(f, wide)
            z.add("archive/data.warc.gz", bytes(self.archive))
            z.add("indexes/index.cdxj", lines)
            z.add("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1"}).encode())
            z.close()
        return self.uri, len(self.index)


def write_packages(pages: DataFrame, folder: str, wide: bool = False, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every row as a record into packages under folder; a staged table (package, records) of what was written.

    Of records with equal payloads of REVISIT_FROM bytes or more, those with
    the smallest id are responses and the others revisit it. Rows that repeat
    the smallest id are all responses, for nothing tells them apart; a null id
    counts as larger than any other and is never referred to, so equal
    payloads with null ids alone are all responses. Equality is that of
    SHA-256 and length. A package a retried task left behind is in no list.
    Rows that share an id share their record's id too.
    """
    html, url = text_of(html_col), text_of(url_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size"))
    firsts = rows.select("digest", "size", "page_id").filter(f"size >= {REVISIT_FROM}").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = staged(firsts, "first-payloads")
    revisits = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to")
    if fits(firsts):
        told = rows.join(F.broadcast(firsts), "digest", "left").select("page_id", "url", "html", "digest", revisits)
    else:  # digests move, and what they say goes back to the rows by their numbers
        copy = staged(rows.withColumn("uid", F.monotonically_increasing_id()), "held-pages")
        said = spread_join(copy.select("uid", "page_id", "digest"), firsts, "digest", "uid").select("uid", revisits).filter("refers_to IS NOT NULL")
        told = marked(copy, staged(said, "revisits")).select("page_id", "url", "html", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for b in batches:
            for page, url, html, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                package = package or _Package(folder)
                uri = record_uri(page)
                package.add(write_record("revisit" if refers is not None else "response", uri, url, html.encode(), digest, record_uri(refers) if refers is not None else None), url, uri, digest)
                if len(package.archive) >= PACKAGE_BYTES:
                    done.append(package.close(wide))
                    package = None
        if package:
            done.append(package.close(wide))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["package", "records"])

    return staged(told.mapInArrow(run, "package string, records long"), "packages")


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per package: where its archives begin and the ranges its indexes name, in rows of RECORDS_A_READ; what is unsound gives a row with its error."""

    def row(uri: str, spans: list[tuple[int, int]], error: str | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([[s for s, _ in spans]], pa.list_(pa.int64())), pa.array([[n for _, n in spans]], pa.list_(pa.int64())), pa.array([error], pa.string())], names=["package", "starts", "lengths", "error"])

    for b in batches:
        for uri in b.column(0).to_pylist():
            try:
                fs, path = _opener(uri)
                with fs.open_input_file(path) as f:
                    spans, errors = package_spans(f)
            except (OSError, ValueError, struct.error, KeyError, IndexError, StopIteration, pa.ArrowException) as e:
                spans, errors = [], [f"package: {e or type(e).__name__}"]
            for i in range(0, len(spans), RECORDS_A_READ):
                yield row(uri, spans[i : i + RECORDS_A_READ])
            for e in errors:
                yield row(uri, [], e)


def package_spans(f: BinaryIO) -> tuple[list[tuple[int, int]], list[str]]:
    """(place in the package, length) of each record that its indexes name, and what is unsound in them: an index that can't be read, a line without a place, an archive that isn't there or isn't stored."""
    z, starts, spans, errors = ZipDirectory(f), {}, [], []
    for name, m in z.members.items():
        if name.startswith("archive/"):
            try:
                starts[name.rpartition("/")[2]] = z.start(m), m.size
            except (ValueError, struct.error) as e:
                errors.append(f"{name}: {e}")
    for name, m in z.members.items():
        if not (name.startswith("indexes/") and name.endswith(INDEXES)):
            continue
        try:
            data = z.content(m)
            lines = index_spans(data)
        except (ValueError, OSError, EOFError, struct.error, zlib.error) as e:
            errors.append(f"{name}: {e or type(e).__name__}")
            continue
        for said in lines:
            if isinstance(said, str):
                errors.append(f"{name}: {said}")
            elif said[0] not in starts:
                errors.append(f"{name}: no archive {said[0]}")
            elif said[1] + said[2] > starts[said[0]][1]:
                errors.append(f"{name}: a place beyond the end of {said[0]}")
            else:
                spans.append((starts[said[0]][0] + said[1], said[2]))
    return spans, errors


def _unpacked(data: bytes) -> dict:
    try:
        return read_record(zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data)
    except (zlib.error, ValueError) as e:
        return read_record(b"") | {"error": str(e)}


def _fetch(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, starts, lengths, error in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, path = _opener(uri)
                with nullcontext() if error else fs.open_input_file(path) as f:
                    for i in range(0, max(len(starts), 1), 100):
                        found = [read_record(b"") | {"error": error}] if error else []
                        for at, n in zip(starts[i : i + 100], lengths[i : i + 100], strict=True):
                            f.seek(at)
                            found.append(_unpacked(f.read(n)))
                        cols = [pa.array([uri_page(r["uri"]) for r in found], pa.int64()), pa.array([r["url"] for r in found], pa.string()), pa.array([r["payload_bytes"] for r in found], pa.int64()), pa.array([r["payload_digest"] for r in found], pa.string()), pa.array([r["type"] for r in found], pa.string()), pa.array([uri_page(r["refers_to"]) for r in found], pa.int64()), pa.array([r["uri"] for r in found], pa.string()), pa.array([r["error"] for r in found], pa.string())]
                        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "error"]
                        if with_payload:
                            cols, names = [*cols, pa.array([r["payload"] for r in found], pa.binary())], [*names, "payload"]
                        yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def read_packages(packages: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of the packages (column package: their URIs): page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id, error, and the payload if asked for.

    The ranges are spread over the tasks, so a large package is read by many.
    A response's digest is taken from its payload and held against its header;
    a revisit's digest and length are those its headers give. page_id and
    refers_to are null for ids that write_packages did not make. An unsound
    record gives a row with `error`, and so does a file that is no package, an
    index that can't be read, an index line without a place, or one that names
    an archive that is absent or packed; the other records are read.
    """
    spans = packages.select("package").mapInArrow(_plan, "package string, starts array<long>, lengths array<long>, error string").repartition(packages.sparkSession.sparkContext.defaultParallelism)
    more = ", payload binary" if with_payload else ""
    return spans.mapInArrow(_fetch(with_payload), f"page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, error string{more}")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as packages into the shared folder and read the records back.

    One row per row of pages. A null html is an empty payload, a null url an
    empty target. An empty table writes no package and gives an empty result.
    Other columns are not read.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    return read_packages(write_packages(pages, folder, id_col=id_col, url_col=url_col, html_col=html_col))
