"""Self-describing big-endian tables (signature @UTF): header, typed columns, rows, string and data heaps.

A table becomes long rows, one per cell, so tables of any schema share one
DataFrame; cells that hold a table are descended into, with the way there in
table_path.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blobs import gathered

MAGIC = b"@UTF"
# Fixed values of the format: storage bits of a column's flag byte, and value types by code.
NAMED, DEFAULT, ROW, UNDEFINED = 0x10, 0x20, 0x40, 0x80
TYPES = {0: ("u8", ">B"), 1: ("s8", ">b"), 2: ("u16", ">H"), 3: ("s16", ">h"), 4: ("u32", ">I"), 5: ("s32", ">i"), 6: ("u64", ">Q"), 7: ("s64", ">q"), 8: ("f32", ">f"), 9: ("f64", ">d"), 10: ("string", ">I"), 11: ("data", ">II"), 12: ("u128", ">16s")}
CODES = {name: code for code, (name, _) in TYPES.items()}


@dataclass
class Table:
    name: str
    columns: list[tuple[str, str, str]] = field(default_factory=list)  # name, type, storage
    rows: list[list] = field(default_factory=list)

    def column(self, name: str) -> int:
        """The first column of that name, or -1."""
        return next((i for i, c in enumerate(self.columns) if c[0] == name), -1)

    def value(self, row: int, name: str, kind: str | None = None):
        """A cell, or None if there is no such row or column or (kind) its type is another; strict for every type."""
        at = self.column(name)
        if at < 0 or not 0 <= row < len(self.rows) or kind and self.columns[at][1] != kind:
            return None
        return self.rows[row][at]


def parse(data: bytes, at: int = 0) -> Table:
    """The table at an offset. Raises ValueError on one that is not sound."""
    if data[at : at + 4] != MAGIC or at + 0x20 > len(data):
        raise ValueError("no table")
    size, version, rows_at, strings_at, data_at, name_at, n_cols, width, n_rows = struct.unpack_from(">IHHIIIHHI", data, at + 4)
    end, rows_at, strings_at, data_at = size + 8, rows_at + 8, strings_at + 8, data_at + 8
    if version not in (0, 1):
        raise ValueError(f"version {version}")
    if at + end > len(data) or max(rows_at, strings_at, data_at) > end or data_at <= strings_at or not n_cols or rows_at < 0x20:
        raise ValueError("offsets out of the table")

    def text(offset: int) -> str:
        begin = at + strings_at + offset
        stop = data.find(b"\0", begin, at + data_at)
        return data[begin : stop if stop >= 0 else at + data_at].decode("utf-8", "replace")

    def read(kind: str, form: str, where: int):
        if where + struct.calcsize(form) > len(data):
            raise ValueError("cell out of the data")
        got = struct.unpack_from(form, data, where)
        if kind == "string":
            return text(got[0])
        if kind == "data":
            begin = at + data_at + got[0]
            return data[begin : begin + got[1]]
        return got[0]

    table, plan, cursor, in_row = Table(text(name_at)), [], at + 0x20, 0
    for _ in range(n_cols):
        flag, offset = struct.unpack_from(">BI", data, cursor)
        cursor += 5
        if flag & UNDEFINED or not flag & NAMED:
            raise ValueError("column without a name or of unknown storage")
        if flag & 15 not in TYPES:
            raise ValueError(f"type {flag & 15}")
        kind, form = TYPES[flag & 15]
        storage = "default" if flag & DEFAULT else "row" if flag & ROW else "none"
        table.columns.append((text(offset), kind, storage))
        if flag & DEFAULT:
            plan.append((kind, form, cursor, True))
            cursor += struct.calcsize(form)
        elif flag & ROW:
            plan.append((kind, form, in_row, False))
            in_row += struct.calcsize(form)
        else:
            plan.append((kind, form, None, True))
    if in_row > width or at + rows_at + n_rows * width > len(data):
        raise ValueError("rows out of the table")
    for r in range(n_rows):
        base = at + rows_at + r * width
        table.rows.append([None if where is None else read(k, f, where if fixed else base + where) for k, f, where, fixed in plan])
    return table


def build(name: str, columns: list[tuple[str, str, str]], rows: list[list], defaults: dict[str, object] | None = None, version: int = 1) -> bytes:
    """A table's bytes. columns: (name, type, storage row or default)."""
    strings, blobs = bytearray(b"<NULL>\0"), bytearray()

    def text(s: str) -> int:
        at = len(strings)
        strings.extend(s.encode() + b"\0")
        return at

    def put(kind: str, value) -> bytes:
        form = TYPES[CODES[kind]][1]
        if kind == "string":
            return struct.pack(form, text(value))
        if kind == "data":
            at = len(blobs)
            blobs.extend(value)
            return struct.pack(form, at, len(value))
        return struct.pack(form, value)

    name_at, schema, width = text(name), b"", 0
    for col, kind, storage in columns:
        flag = CODES[kind] | NAMED | (DEFAULT if storage == "default" else ROW)
        schema += struct.pack(">BI", flag, text(col)) + (put(kind, (defaults or {})[col]) if storage == "default" else b"")
        width += struct.calcsize(TYPES[CODES[kind]][1]) if storage == "row" else 0
    body = b"".join(put(k, v) for row in rows for (_, k, s), v in zip([c for c in columns if c[2] == "row"], row, strict=True))
    rows_at = 0x20 + len(schema)
    strings_at = rows_at + len(body)
    data_at = strings_at + len(strings)
    size = data_at + len(blobs) - 8
    head = struct.pack(">4sIHHIIIHHI", MAGIC, size, version, rows_at - 8, strings_at - 8, data_at - 8, name_at, len(columns), width, len(rows))
    return head + schema + body + bytes(strings) + bytes(blobs)


CELLS = "table_path array<string>, table string, row long, col_no int, name string, type string, storage string, int_value decimal(20,0), float_value double, text_value string, data_value binary, error string"
_TYPES = [pa.list_(pa.string()), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.decimal128(20, 0), pa.float64(), pa.string(), pa.binary(), pa.string()]


def _cells(data: bytes, path: list[str], at: int = 0) -> Iterator[tuple]:
    """Cells of a table, each nested table's after the cell that holds it, at any depth."""
    held = [(len(data), path, _own_cells(data, path, at))]
    while held:
        size, path, cells_left = held[-1]
        row = next(cells_left, None)
        if row is None:
            held.pop()
            continue
        yield row
        name, kind, v = row[4], row[5], row[10]
        if kind == "data" and v and v[:4] == MAGIC:
            inner = [*path, f"{name}[{row[2]}]"]
            if len(v) < size:
                held.append((len(v), inner, _own_cells(v, inner, 0)))
            else:
                yield (inner, None, None, None, None, None, None, None, None, None, None, "a table that holds itself")


def _own_cells(data: bytes, path: list[str], at: int) -> Iterator[tuple]:
    from decimal import Decimal

    try:
        t = parse(data, at)
    except (ValueError, struct.error) as e:
        yield (path, None, None, None, None, None, None, None, None, None, None, str(e))
        return
    for r, row in enumerate(t.rows):
        for c, ((name, kind, storage), v) in enumerate(zip(t.columns, row, strict=True)):
            whole = kind[0] in "us" and kind not in ("string", "u128")
            yield (path, t.name, r, c, name, kind, storage, Decimal(v) if whole and v is not None else None, v if kind in ("f32", "f64") else None, v if kind == "string" else None, v if kind in ("data", "u128") else None, None)


def cells(files: DataFrame, id_col: str = "path", content: str = "content", skip_crid: bool = True) -> DataFrame:
    """One row per cell of the tables in files, nested ones too: id and CELLS. An unsound table gives one row with its error; a null content none."""
    kind = files.schema[id_col].dataType.simpleString()

    names = [c.split(" ")[0] for c in CELLS.split(", ") if " " in c]

    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        for k, content in zip(b.column(0), b.column(1), strict=True):
            data, key = content.as_py(), k.as_py()
            if data is not None:
                for row in _cells(data, [], 0x20 if skip_crid and data[:4] == b"CRID" else 0):
                    yield (key, *row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from gathered(rows(b), [b.schema.field(0).type, *_TYPES], [id_col, *names])

    return files.select(id_col, content).mapInArrow(run, f"{id_col} {kind}, {CELLS}")


def cue_sheets(files: DataFrame, id_col: str = "path", content: str = "content") -> DataFrame:
    """(id, name, kind, wave_md5) of cue sheets, tables named Header: kind is acb or acf by the format that the file names, else unk; wave_md5 is that of its wave file, from the cell StreamAwbHash or the table in it, null where it is all zeros."""
    found = cells(files, id_col, content)
    top = found.filter((F.size("table_path") == 0) & (F.col("table") == "Header")).groupBy(id_col).agg(F.max(F.when(F.col("name") == "Name", F.trim("text_value"))).alias("name"), F.max(F.when((F.col("name") == "StreamAwbHash") & (F.length("data_value") == 16), F.lower(F.hex("data_value")))).alias("own"))
    inner = found.filter((F.size("table_path") == 1) & F.startswith(F.get("table_path", F.lit(0)), F.lit("StreamAwbHash[")) & (F.col("table") == "StreamAwb") & (F.col("name") == "Hash")).groupBy(id_col).agg(F.max(F.lower(F.hex("data_value"))).alias("inner"))
    kind = files.select(id_col, F.when(F.contains(F.col(content), F.lit(b"ACB Format")), "acb").when(F.contains(F.col(content), F.lit(b"ACF Format")), "acf").otherwise("unk").alias("kind"))
    md5 = F.coalesce("own", "inner")
    return top.join(inner, id_col, "left").join(kind, id_col).select(id_col, "name", "kind", F.when(md5 != "0" * 32, md5).alias("wave_md5"))


def pivoted(cell_rows: DataFrame, id_col: str, names: list[str]) -> DataFrame:
    """Top-level rows side by side: id, row and a text column for each name."""
    value = F.coalesce(F.col("text_value"), F.col("int_value").cast("string"), F.col("float_value").cast("string"))
    return cell_rows.filter(F.size("table_path") == 0).groupBy(id_col, "row").pivot("name", names).agg(F.first(value))


def packed(names: Column, values: Column) -> Column:
    """A table of one row of strings for each row."""

    @F.pandas_udf("binary")
    def run(n: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([build("row", [(x, "string", "row") for x in a], [list(b)]) for a, b in zip(n, v, strict=True)])

    return run(names, values)
