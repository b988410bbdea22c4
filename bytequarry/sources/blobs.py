"""Files as blobs, and the one way in which parsers turn a blob into rows."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.textx import matches_any

#: Rows that a parser's batch holds, and bytes of values after which it is full.
ROWS, BYTES = 4096, 4 << 20


def gathered(rows: Iterable[tuple], types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows, of however many files, as batches of at most ROWS rows and about BYTES bytes; a batch for each small file would cost more than its rows."""
    held, size = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes | str))
        if len(held) >= ROWS or size >= BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def parsed(files: DataFrame, path: str, content: str, parser: Callable[[bytes], Iterable[tuple]], schema: str) -> DataFrame:
    """One row per row that parser gives for each blob: path, then schema.

    The last column of schema is `error string`: a blob on which the parser
    raises ValueError or struct.error gives one row with it after those it
    gave before. Null blobs give none.
    """
    fields = T._parse_datatype_string(schema).fields
    names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]
    key = files.schema[path].dataType.simpleString()

    def rows_of(data: bytes) -> Iterator[tuple]:
        try:
            for row in parser(data):
                yield (*row, None)
        except (ValueError, struct.error, IndexError) as e:
            yield (*[None] * (len(names) - 1), str(e) or "bad data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = ((k.as_py(), *row) for k, data in zip(b.column(0), b.column(1), strict=True) if data.is_valid for row in rows_of(data.as_py()))
            yield from gathered(rows, [b.schema.field(0).type, *types], [path, *names])

    return files.select(path, content).mapInArrow(run, f"{path} {key}, {schema}")


def scan(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime, content) of files; content is read only where it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of all files below a folder, in order; contents are not read."""
    return scan(spark, folder).select("path").orderBy("path")


def filtered(files: DataFrame, include: list[str], without: tuple[str, ...] = ()) -> DataFrame:
    """Distinct files whose base name fits a pattern and whose extension is not listed."""
    name = F.substring_index("path", "/", -1)
    keep = matches_any(name, include)
    for ext in without:
        keep &= ~F.lower(name).endswith(f".{ext.lower()}")
    return files.filter(keep).dropDuplicates(["path"])


def unique_by_case(files: DataFrame) -> DataFrame:
    """One file for each path, case aside: the first by path."""
    return files.groupBy(F.upper("path").alias("key")).agg(F.min("path").alias("path")).select("path")


def head(content: Column, n: int = 0x60) -> Column:
    return F.substring(content, 1, n)


def from_list(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Files that a pattern of a list names; # starts a comment. lines: (line). Lists of any length meet the files by their literals (operators.patterns)."""
    from ..operators.patterns import selected

    listed = lines.select(F.trim("line").alias("pattern")).filter("pattern <> '' AND NOT startswith(pattern, '#')")
    return selected(files.withColumn("__base", F.substring_index("path", "/", -1)), "__base", listed).drop("__base")


def in_pieces(files: DataFrame, size: int = 1 << 20) -> DataFrame:
    """(path, piece, content) of files in pieces of `size` bytes."""
    n = F.greatest(F.lit(1), F.ceil(F.length("content") / size)).cast("int")
    return files.select("path", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"), "content").select("path", "piece", F.substring("content", F.col("piece") * size + 1, F.lit(size)).alias("content"))


# --- JSON and XML ---------------------------------------------------------------


def json_bytes(files: DataFrame, text: str, name: str = "RawData") -> DataFrame:
    """files with `content`: the bytes that a JSON document holds as a list of numbers."""
    numbers = F.from_json(F.col(text), f"`{name}` array<int>")[name]
    return files.withColumn("content", F.unhex(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x.bitwiseAND(255)), 2, "0")), "")))


def json_urls(files: DataFrame, text: str, field: str, old: str = "", new: str = "") -> DataFrame:
    """(url): entries of a JSON list that begin with http, with a base replaced."""
    each = files.select(F.explode(F.from_json(F.col(text), f"`{field}` array<string>")[field]).alias("url")).filter(F.col("url").startswith("http"))
    return each.select(F.replace("url", F.lit(old), F.lit(new)).alias("url")) if old else each


def json_toc(files: DataFrame, text: str, content: str = "content") -> DataFrame:
    """(path, group, name, offset, size, payload) of a JSON directory Groups[].OrderedEntries[] over a blob."""
    schema = "Groups array<struct<Name:string,OrderedEntries:array<struct<Name:string,Offset:bigint,Size:bigint>>>>"
    g = files.select("path", content, F.explode(F.from_json(F.col(text), schema)["Groups"]).alias("g"))
    e = g.select("path", content, F.col("g.Name").alias("group"), F.explode("g.OrderedEntries").alias("e"))
    return e.select("path", "group", F.col("e.Name").alias("name"), F.col("e.Offset").alias("offset"), F.col("e.Size").alias("size"), F.substring(F.col(content), F.col("e.Offset").cast("int") + 1, F.col("e.Size").cast("int")).alias("payload"))


def xml_files(docs: DataFrame, text: str) -> DataFrame:
    """(crc, path) of File elements with the attributes CrcHex and Path."""
    pairs = F.arrays_zip(F.xpath(F.col(text), F.lit("//File/@CrcHex")).alias("crc"), F.xpath(F.col(text), F.lit("//File/@Path")).alias("path"))
    return docs.select(F.explode(pairs).alias("p")).select(F.conv("p.crc", 16, 10).cast("bigint").alias("crc"), F.col("p.path").alias("path"))
