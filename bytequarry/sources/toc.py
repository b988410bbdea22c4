"""Archive directories: one file to entries (name, offset, size, codec) and their payloads.

A Layout says where the fields are; one interpreter reads them all. Layouts
below cover flat tables, sizes by the next offset, parallel arrays, name
pointers, sector units, sentinels, flags that choose a codec, and a companion
data file.
"""

from __future__ import annotations

import re
import struct
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import CODECS, inflate_bytes
from .archives import Reader
from .blobs import gathered

#: (offset, type), or (offset of a pointer, what to add to it, type).
Field = tuple[int, str] | tuple[int, int, str]
#: Integer fields: bytes and byte order ("=": that of the layout).
_INTS = {"u8": (1, "="), "u16": (2, "="), "u24": (3, "="), "u32": (4, "="), "u64": (8, "="), "u16be": (2, "big"), "u32be": (4, "big"), "u16le": (2, "little"), "u32le": (4, "little")}


@dataclass(frozen=True)
class Layout:
    """Where an archive keeps its directory.

    count, table: a number, or a field of the header. stride and fields: a
    table of fixed records. arrays: a field of the header that points to an
    array of a type, for each entry field. inline: records of variable length,
    fields read one after the other; ("z", "p8", "p16", "p32": text up to a
    NUL, or after its length). unit and base: offsets are unit * value + base.
    sized: "field", "next" (up to the next offset) or "next_unit". names: a
    header field or number that name_at is relative to. skip: offsets that
    stand for no entry. codecs: from the values of the flag field. only: values
    that fields must have. relative: offsets count from the entry's own place.
    once: entries that repeat an offset go. find: the directory begins at this
    mark, wherever it stands, and offsets count from it. swapped: the signature
    of the other byte order. arrays may hold "sized" texts (their length stands
    before the first) and "zz" (two pointers to texts that make one name).
    """

    magic: bytes = b""
    big: bool | str = False
    count: int | Field | None = None
    table: int | Field = 0
    stride: int | Field = 0
    fields: dict[str, Field] = field(default_factory=dict)
    arrays: dict[str, tuple[int, str]] = field(default_factory=dict)
    inline: tuple[tuple[str, str], ...] = ()
    unit: int = 1
    base: int | Field = 0
    sized: str = "field"
    names: int | Field = 0
    skip: tuple[int, ...] = ()
    codecs: dict[int, str] = field(default_factory=dict)
    packed_codec: str = ""
    guess_at: int = 4
    only: dict[str, int] = field(default_factory=dict)
    relative: bool = False
    once: bool = False
    find: bytes = b""
    swapped: bytes = b""


class _View:
    def __init__(self, data: bytes, big: bool, partial: bool = False) -> None:
        self.data, self.order, self.partial = data, "big" if big else "little", partial

    def read(self, at: int, kind: str):
        if kind[0] == "s":
            n = int(kind[1:])
            self._within(at, n)
            return self.data[at : at + n].split(b"\0")[0].decode("utf-8", "replace")
        if kind == "z":
            end = self.data.find(b"\0", at)
            if end < 0 and self.partial:
                raise ValueError("text out of the data")
            return self.data[at : end if end >= 0 else len(self.data)].decode("utf-8", "replace")
        n, order = _INTS[kind]
        self._within(at, n)
        return int.from_bytes(self.data[at : at + n], self.order if order == "=" else order)

    def element(self, start: int, i: int, kind: str):
        """The i-th element of an array."""
        if kind == "sized":
            n = self.read(start, "u32")
            return self.read(start + 4 + i * n, f"s{n}")
        if kind == "zz":
            return "".join(self.read(self.read(start + 8 * i + 4 * k, "u32"), "z") for k in (0, 1))
        return self.read(start + i * (int(kind[1:]) if kind[0] == "s" else _INTS[kind][0]), kind)

    def _within(self, at: int, n: int) -> None:
        if at < 0 or at + n > len(self.data):
            raise ValueError("field out of the data")

    def either(self, x: int | Field | None) -> int:
        if isinstance(x, int):
            return x
        return self.read(*x) if len(x) == 2 else self.read(self.read(x[0], "u32") + x[1], x[2])


def read_entries(layout: Layout, data: bytes, payload_size: int | None = None, partial: bool = False) -> list[dict]:
    """The directory's entries. Raises ValueError where the data is not of this layout. partial: data is but the beginning of the file, and a text that it doesn't end raises as well."""
    mark = data.find(layout.find) if layout.find else 0
    if mark < 0:
        raise ValueError("no directory mark")
    whole, data = len(data), data[mark:]
    big = layout.big
    if layout.swapped and data.startswith(layout.swapped):
        big = not big
    elif layout.magic and not data.startswith(layout.magic):
        raise ValueError("other signature")
    if big == "guess":
        v = data[layout.guess_at : layout.guess_at + 4]
        big = int.from_bytes(v, "big") < int.from_bytes(v, "little")
    view = _View(data, bool(big), partial)
    size = whole if payload_size is None else payload_size
    count = view.either(layout.count) if layout.count is not None else None
    at, rows = view.either(layout.table), []
    if count is not None and count > len(data):
        raise ValueError("more entries than bytes")
    while count is None or len(rows) < count:
        i = len(rows)
        if layout.arrays:
            rows.append({k: view.element(view.read(p, "u32"), i, t) for k, (p, t) in layout.arrays.items()})
        elif layout.inline:
            if count is None and at >= len(data):
                break
            row = {}
            for name, kind in layout.inline:
                if kind in ("p8", "p16", "p32"):
                    n = view.read(at, "u" + kind[1:])
                    at += int(kind[1:]) // 8
                    row[name] = view.read(at, f"s{n}")
                    at += n
                elif kind == "z":
                    row[name] = view.read(at, "z")
                    at += len(row[name].encode()) + 1
                else:
                    row[name] = view.read(at, kind)
                    at += int(kind[1:]) if kind[0] == "s" else _INTS[kind][0]
            rows.append(row)
        else:
            if count is None and at + view.either(layout.stride) > len(data):
                break
            rows.append({k: view.read(at + o, t) for k, (o, t) in layout.fields.items()} | {"place": at})
            at += view.either(layout.stride)
    base, names = view.either(layout.base) + mark, view.either(layout.names)
    ends = _ends(layout, rows, base, size) if layout.sized != "field" else []
    out, seen = [], set()
    for i, r in enumerate(rows):
        raw = r.get("offset", 0)
        if raw in layout.skip or layout.once and raw in seen or any(r.get(k) != v for k, v in layout.only.items()):
            continue
        seen.add(raw)
        offset = raw * layout.unit + base + (r["place"] if layout.relative else 0)
        n = r["size"] if layout.sized == "field" else ends[i] - offset
        name = view.read(names + r["name_at"], "z") if "name_at" in r else r.get("name", f"{i:08d}")
        codec = layout.codecs.get(r["flag"], "copy") if "flag" in r else layout.packed_codec if layout.packed_codec and r.get("packed", n) != r.get("full", n) else "copy"
        out.append({"idx": i, "name": name, "offset": offset, "size": n, "packed": r.get("packed", n), "codec": codec})
    return out


def _ends(layout: Layout, rows: list[dict], base: int, size: int) -> list[int]:
    """Where each entry ends: at the next entry's offset, or (once) at the next larger one; the last at the data's end."""
    if layout.once:
        known = sorted({r["offset"] for r in rows})
        return [known[k] * layout.unit + base if (k := bisect_right(known, r["offset"])) < len(known) else size for r in rows]
    out, end = [0] * len(rows), size
    for i in range(len(rows) - 1, -1, -1):
        out[i] = end
        if rows[i]["offset"] not in layout.skip:
            end = rows[i]["offset"] * layout.unit + base
    return out


SCHEMA = "idx int, name string, offset long, size long, packed long, codec string, payload binary, error string"


def found_entries(layout: Layout | Reader, toc: bytes, body: bytes) -> list[dict]:
    """The entries of a directory by its layout, or by a reader of its own."""
    if isinstance(layout, Layout):
        return read_entries(layout, toc, len(body))
    return [{"idx": i, "name": name, "offset": offset, "size": size, "packed": packed, "codec": codec} for i, (name, offset, size, packed, codec) in enumerate(layout(toc, body))]


def entries(files: DataFrame, path: str, content: str, layout: Layout | Reader | str, data: str | None = None, keep: str | None = None, payload: bool = True) -> DataFrame:
    """One row per entry: path and SCHEMA.

    layout: a Layout, a reader, or the column that holds the name of one of
    the known ones. data: the column that holds the payloads, where it is
    another file's. keep: a pattern that names must hold, tested before a
    payload is cut out or decoded. A file of another layout gives one row with
    the error; a codec that is not at hand, or damaged data, a null payload
    and an error.
    """
    wanted = re.compile(keep) if keep else None
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def rows_of(form: Layout | Reader, toc: bytes, body: bytes) -> Iterator[tuple]:
        try:
            found = found_entries(form, toc, body)
        except (ValueError, KeyError, IndexError, struct.error) as e:
            yield (None, None, None, None, None, None, None, str(e))
            return
        for e in found:
            if wanted and not wanted.search(e["name"]):
                continue
            cut, error = None, None
            if not 0 <= e["offset"] <= len(body) or e["packed"] < 0 or e["offset"] + e["packed"] > len(body):
                error = "slice out of the data"
            elif payload:
                cut = body[e["offset"] : e["offset"] + e["packed"]]
                if e["codec"] != "copy":
                    cut = inflate_bytes(cut, e["codec"])
                    if cut is None:
                        error = "bad data" if e["codec"] in CODECS else "unsupported_codec"
            yield (e["idx"], e["name"], e["offset"], e["size"], e["packed"], e["codec"], cut, error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if isinstance(layout, str):
            from .layouts import LAYOUTS

        def rows(b: pa.RecordBatch) -> Iterator[tuple]:
            bodies, forms = (b.column("body") if data else None), (b.column("layout") if isinstance(layout, str) else None)
            for i in range(b.num_rows):
                toc = b.column(1)[i].as_py()
                if toc is None:
                    continue
                body = (bodies[i].as_py() or b"") if data else toc
                form = LAYOUTS.get(forms[i].as_py()) if isinstance(layout, str) else layout
                got = rows_of(form, toc, body) if form else iter([(None, None, None, None, None, None, None, "unknown layout")])
                key = b.column(0)[i].as_py()
                for row in got:
                    yield (key, *row)

        for b in batches:
            yield from gathered(rows(b), [b.schema.field(0).type, *types], [path, *names])

    kind = files.schema[path].dataType.simpleString()
    more = ([F.col(data).alias("body")] if data else []) + ([F.col(layout).alias("layout")] if isinstance(layout, str) else [])
    return files.select(F.col(path), F.col(content), *more).mapInArrow(run, f"{path} {kind}, {SCHEMA}")


def tree_entries(data: bytes, root: int, names: int, children: int) -> Iterator[tuple[str, int, int, str]]:
    """(path, offset, size, codec) of a tree of 12-byte nodes (name, flags and length, offset), little-endian: bit 31 a folder of that many nodes from `children` on, bit 30 deflated."""

    def walk(at: int, above: str, depth: int) -> Iterator[tuple[str, int, int, str]]:
        if depth > 64:
            raise ValueError("folders too deep")
        name_at, flags, offset = struct.unpack_from("<III", data, at)
        end = data.index(b"\0", names + name_at)
        path, n = above + data[names + name_at : end].decode("utf-8", "replace"), flags & 0x0FFFFFFF
        if flags >> 31:
            for i in range(n):
                yield from walk(children + offset + 12 * i, f"{path}/", depth + 1)
        else:
            yield path, offset, n, "zlib" if flags >> 30 & 1 else "copy"

    yield from walk(root, "", 0)


#: The library's own flat archive: magic, count, records of name pointer, offset and size.
FLAT = Layout(magic=b"FLT1", count=(4, "u32"), table=12, stride=12, fields={"name_at": (0, "u32"), "offset": (4, "u32"), "size": (8, "u32")}, names=(8, "u32"))


def build_flat(items: list[tuple[str, bytes]]) -> bytes:
    names, spots = bytearray(), []
    for n, _ in items:
        spots.append(len(names))
        names.extend(n.encode() + b"\0")
    names_at = 12 + 12 * len(items)
    at, table = names_at + len(names), bytearray()
    for spot, (_, p) in zip(spots, items, strict=True):
        table += struct.pack("<III", spot, at, len(p))
        at += len(p)
    return b"FLT1" + struct.pack("<II", len(items), names_at) + bytes(table) + bytes(names) + b"".join(p for _, p in items)


def packed(df: DataFrame, path: str, name: str, payload: str) -> DataFrame:
    """(path, content): a flat archive of each path's payloads, in the order of their names. A path is one file, so its size is the caller's to bound."""
    run = F.udf(lambda items: build_flat([(x["n"], bytes(x["p"])) for x in items]), "binary")
    rows = df.groupBy(path).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(payload).alias("p")))).alias("x"))
    return rows.select(path, run("x").alias("content"))
