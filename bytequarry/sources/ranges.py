"""Files of any size by byte ranges: a source of blocks, a source of archive members that reads only what is asked for, and a sink with a commit.

All are Python data sources of Spark. Files are opened through pyarrow's file
systems, so a path is one that all executors share, or a URI that pyarrow
knows; nothing is read whole.
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

#: Bytes of a block, and bytes that one task reads.
BLOCK, TASK = 1 << 20, 128 << 20
#: Places of needles that a task gives at once, and rows that a writer takes at once.
PLACES, WRITE_ROWS = 1 << 14, 256
#: First bytes of an archive that are read for its directory; twice as many each time until they hold it.
HEAD = 64 << 10


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that a path names: itself, all below a folder, or those that fit a pattern in its last part."""
    head, _, last = path.rpartition("/")
    pattern = last if any(c in last for c in "*?[") else None
    fs, root = opened(head if pattern else path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [(root, info.size)]
    found = fs.get_file_info(pafs.FileSelector(root, recursive=not pattern))
    shown = [x for x in found if x.type == pafs.FileType.File and not x.base_name.startswith(("_", "."))]
    return sorted((x.path, x.size) for x in shown if pattern is None or fnmatch.fnmatchcase(x.base_name, pattern))


class _Tests:
    """Filters on one text column, as a test of a value; what it can't take is handed back."""

    def __init__(self, column: str):
        self.column, self.tests = column, []

    def take(self, filters: Iterable[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == (self.column,) and isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith | StringContains):
                self.tests.append(f)
            else:
                yield f

    def __call__(self, text: str) -> bool:
        def holds(f: Filter) -> bool:
            if isinstance(f, EqualTo):
                return text == f.value
            if isinstance(f, In):
                return text in f.value
            return text.startswith(f.value) if isinstance(f, StringStartsWith) else text.endswith(f.value) if isinstance(f, StringEndsWith) else f.value in text

        return all(map(holds, self.tests))


def _known(spark: SparkSession, source: type[DataSource]) -> None:
    """The session knows the source, and hands filters on."""
    spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# --- blocks ------------------------------------------------------------------------


class BlockSource(DataSource):
    """byte_blocks: (path, block_no, offset, content, ahead) of files. Options: path; block, bytes of a block; ahead, bytes after it that come along."""

    @classmethod
    def name(cls) -> str:
        return "byte_blocks"

    def schema(self) -> str:
        return "path string, block_no long, offset long, content binary, ahead binary"

    def reader(self, schema) -> DataSourceReader:
        return BlockReader(dict(self.options))


class BlockReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.block, self.ahead = options["path"], int(options.get("block", BLOCK)), int(options.get("ahead", 0))
        self.wanted = _Tests("path")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return list(self.wanted.take(filters))

    def partitions(self) -> list[InputPartition]:
        """Ranges of whole blocks, of about TASK bytes."""
        step = max(1, TASK // self.block)
        out = []
        for path, size in files_of(self.path):
            if self.wanted(path):
                blocks = -(-size // self.block)
                out += [InputPartition((path, i, min(i + step, blocks))) for i in range(0, blocks, step)]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, first, last = partition.value
        fs = opened(self.path.rpartition("/")[0])[0]
        with fs.open_input_file(path) as f:
            f.seek(first * self.block)
            held = f.read(self.block + self.ahead)
            for i in range(first, last):
                now, ahead = held[: self.block], held[self.block : self.block + self.ahead]
                row = [pa.array([path]), pa.array([i], pa.int64()), pa.array([i * self.block], pa.int64()), pa.array([now], pa.binary()), pa.array([ahead], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["path", "block_no", "offset", "content", "ahead"])
                held = held[self.block :] + (f.read(self.block) if i + 1 < last else b"")


def blocks(spark: SparkSession, path: str, block: int = BLOCK, ahead: int = 0) -> DataFrame:
    """Files in blocks (BlockSource). A file may have any size; no row holds more than block + ahead bytes."""
    _known(spark, BlockSource)
    return spark.read.format("byte_blocks").option("block", block).option("ahead", ahead).load(path)


def needle_places(blocks_df: DataFrame, needles: list[bytes]) -> DataFrame:
    """(path, needle, place): where each needle (by its number) begins, also across seams. blocks_df was read with ahead of at least the longest needle less one."""
    wanted = [bytes(n) for n in needles]
    kinds = (pa.string(), pa.int32(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[list, list, list] = ([], [], [])
        for b in batches:
            for i in range(b.num_rows):  # a batch may hold thousands of blocks: one at a time becomes Python's
                path, offset, content, ahead = (c[i].as_py() for c in b.columns)
                for k, n in enumerate(wanted):
                    text = content + ahead[: max(0, len(n) - 1)]
                    at = text.find(n) if n else -1
                    while at >= 0:
                        for c, x in zip(found, (path, k, offset + at), strict=True):
                            c.append(x)
                        at = text.find(n, at + 1)
                    if len(found[0]) >= PLACES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, kinds, strict=True)], names=["path", "needle", "place"])
                        found = ([], [], [])
        if found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, kinds, strict=True)], names=["path", "needle", "place"])

    return blocks_df.select("path", "offset", "content", "ahead").mapInArrow(run, "path string, needle int, place long")


# --- members of archives --------------------------------------------------------------


class MemberSource(DataSource):
    """archive_members: (path, idx, name, offset, size, payload, error) of archives whose directory stands first. Options: path; layout, the name of a known Layout; payloads, false for directories alone."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "path string, idx int, name string, offset long, size long, payload binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return MemberReader(dict(self.options))


class MemberReader(DataSourceReader):
    """Reads a directory, then the ranges of those members whose names the pushed filters keep."""

    def __init__(self, options: dict[str, str]):
        self.path, self.layout, self.payloads = options["path"], options["layout"], options.get("payloads", "true").lower() != "false"
        self.named, self.wanted = _Tests("name"), _Tests("path")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return list(self.named.take(self.wanted.take(filters)))

    def partitions(self) -> list[InputPartition]:
        """An archive is cut by bytes: a task has the members that begin in its range."""
        out = [InputPartition((path, size, i)) for path, size in files_of(self.path) if self.wanted(path) for i in range(0, max(size, 1), TASK)]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, size, begin = partition.value
        fs = opened(self.path.rpartition("/")[0])[0]
        with fs.open_input_file(path) as f:
            try:
                found = directory(f, size, self.layout)
            except (ValueError, KeyError, IndexError) as e:
                if begin == 0:
                    yield _members([(path, None, None, None, None, None, str(e) or type(e).__name__)])
                return
            for m in found:
                if not begin <= m["offset"] < begin + TASK or not self.named(m["name"]):
                    continue
                whole, error = 0 <= m["offset"] and 0 <= m["size"] and m["offset"] + m["size"] <= size, None
                payload = None
                if not whole:
                    error = "member out of the file"
                elif self.payloads:
                    f.seek(m["offset"])
                    payload = f.read(m["size"])
                yield _members([(path, m["idx"], m["name"], m["offset"], m["size"], payload, error)])


def directory(f, size: int, layout: str) -> list[dict]:
    """The entries of an archive's directory from its first bytes, as many as it takes."""
    from .layouts import LAYOUTS
    from .toc import Layout, read_entries

    form = LAYOUTS[layout]
    if not isinstance(form, Layout) or form.count is None or form.find:
        raise ValueError(f"{layout} has no counted directory at its start")
    n = HEAD
    while True:
        f.seek(0)
        try:
            return read_entries(form, f.read(min(n, size)), size, n < size)
        except ValueError:
            if n >= size:
                raise
        n *= 2


def _members(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "idx", "name", "offset", "size", "payload", "error"])


def members(spark: SparkSession, path: str, layout: str, payloads: bool = True) -> DataFrame:
    """Members of archives (MemberSource); filters on name and path reach the source."""
    _known(spark, MemberSource)
    return spark.read.format("archive_members").option("layout", layout).option("payloads", str(payloads).lower()).load(path)


# --- a sink with a commit ----------------------------------------------------------------


class KeyedSink(DataSource):
    """keyed_files: rows (name, payload) become files below `path`; rows of one name are appended as they come. Nothing is seen before all is written."""

    @classmethod
    def name(cls) -> str:
        return "keyed_files"

    def schema(self) -> str:
        return "name string, payload binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return KeyedWriter(self.options["path"], overwrite)


class Written(WriterCommitMessage):
    def __init__(self, attempt: str, names: list[str]):
        self.attempt, self.names = attempt, names


def safe_name(name: str | None) -> str:
    """A relative path without parts that lead elsewhere."""
    return "/".join(x for x in (name or "").split("/") if x not in ("", ".", ".."))


class KeyedWriter(DataSourceWriter):
    """Each attempt of a task writes into a folder of its own; the driver moves the files of the attempts that count, or removes all."""

    def __init__(self, path: str, replace: bool):
        self.path, self.replace, self.job = path, replace, f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        fs, root = opened(self.path)
        attempt, made, now, out = f"{root}/{self.job}/{uuid.uuid4().hex}", [], None, None
        done: set[str] = set()
        try:
            for row in iterator:
                name = safe_name(row["name"])
                if not name:
                    raise ValueError("a row without a name")
                if name != now:
                    if out:
                        out.close()
                    if name in done:
                        raise ValueError(f"rows of {name} don't stand together")
                    fs.create_dir(f"{attempt}/{name}".rpartition("/")[0], recursive=True)
                    out, now = fs.open_output_stream(f"{attempt}/{name}"), name
                    done.add(name)
                    made.append(name)
                out.write(bytes(row["payload"] or b""))
        finally:
            if out:
                out.close()
        return Written(attempt, made)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Names that two tasks wrote, or that stand there already, are refused before any file is moved."""
        fs, root = opened(self.path)
        names = [(n, m.attempt) for m in messages if m for n in m.names]
        try:
            if len({n for n, _ in names}) < len(names):
                raise ValueError("two tasks wrote one name")
            there = [x.path for x in fs.get_file_info([f"{root}/{n}" for n, _ in names]) if x.type != pafs.FileType.NotFound]
            if there and not self.replace:
                raise FileExistsError(f"{len(there)} names stand there already, such as {there[0]}")
            for folder in sorted({f"{root}/{n}".rpartition("/")[0] for n, _ in names}):
                fs.create_dir(folder, recursive=True)
            for n, attempt in names:
                if self.replace and f"{root}/{n}" in there:
                    fs.delete_file(f"{root}/{n}")
                fs.move(f"{attempt}/{n}", f"{root}/{n}")
        finally:
            self._cleared(fs, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._cleared(*opened(self.path))

    def _cleared(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.job}")


def write_keyed(df: DataFrame, folder: str, name: str = "name", payload: str = "payload", order: list[str] | None = None, replace: bool = False) -> None:
    """Write a file for each name below folder, payloads appended in `order`. Names that stand there already make it fail unless replace is set, and then nothing has changed; a failed job leaves no file either."""
    df.sparkSession.dataSource.register(KeyedSink)
    rows = df.repartition(name).sortWithinPartitions(name, *(order or [])).select(F.col(name).cast("string").alias("name"), F.col(payload).cast("binary").alias("payload"))
    # a batch of rows is in a writer's memory three times over, and ten thousand rows of payloads may be any size
    conf, at_once = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(at_once)
    conf.set(at_once, WRITE_ROWS)
    try:
        rows.write.format("keyed_files").mode("overwrite" if replace else "append").save(folder)
    finally:
        conf.set(at_once, before)
