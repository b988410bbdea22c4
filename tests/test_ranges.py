import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringStartsWith

from bytequarry.sources import ranges, toc


def table(batches):
    return [r for b in batches for r in pa.Table.from_batches([b]).to_pylist()]


@pytest.fixture
def files(tmp_path):
    r = random.Random(1)
    made = {"a.bin": bytes(r.choices(b"ab", k=5000)), "b.bin": b"", "sub/c.bin": b"x" * 64, "_hidden": b"no"}
    for name, data in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return tmp_path, {str(tmp_path / n): d for n, d in made.items() if n[0] != "_"}


@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
def test_blocks_make_up_the_files(spark, files, block, monkeypatch):
    folder, made = files
    monkeypatch.setattr(ranges, "TASK", 50)
    reader = ranges.BlockReader({"path": str(folder), "block": str(block), "ahead": "3"})
    rows = [r for p in reader.partitions() for r in table(reader.read(p))]
    assert len(reader.partitions()) > 1 and max(len(r["content"]) for r in rows) <= block
    for path, data in made.items():
        own = sorted((r for r in rows if r["path"] == path), key=lambda r: r["block_no"])
        assert b"".join(r["content"] for r in own) == data
        assert all(r["offset"] == r["block_no"] * block and r["ahead"] == data[(r["block_no"] + 1) * block :][:3] for r in own)


def test_needles_across_seams(spark, files):
    folder, made = files
    needles = [b"ab", b"aabb", b"x" * 10, b"", b"zz"]
    got = sorted((r.path, r.needle, r.place) for r in ranges.needle_places(ranges.blocks(spark, str(folder), 13, 9), needles).collect())
    assert got == sorted((p, k, i) for p, d in made.items() for k, n in enumerate(needles) if n for i in range(len(d)) if d.startswith(n, i))
    assert {r.path for r in ranges.blocks(spark, f"file://{folder}/*.bin", 100).collect()} == {f"{folder}/a.bin"}


def test_places_and_payloads_come_in_small_batches(spark, tmp_path, monkeypatch):
    sizes, kept = [], spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    data = spark.range(3000).select(F.lit("a").alias("path"), (F.col("id") * 9).alias("offset"), F.lit(b"ab" * 4 + b"a").alias("content"), F.lit(b"b").alias("ahead"))
    monkeypatch.setattr(type(data), "mapInArrow", lambda df, run, schema: sizes.extend(b.num_rows for b in run(iter(df.toArrow().to_batches()))), raising=False)
    ranges.needle_places(data, [b"ab"])
    assert sum(sizes) == 15000 and max(sizes) <= 1 << 14
    monkeypatch.setattr(ranges, "PLACES", 100, raising=False)
    sizes.clear()
    ranges.needle_places(data, [b"ab"])
    assert sum(sizes) == 15000 and max(sizes) < 110
    ranges.write_keyed(spark.range(1000).select(F.lit("x").alias("name"), F.lit("é").alias("payload")), str(tmp_path / "o"))
    assert (tmp_path / "o/x").read_text() == "é" * 1000 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == kept


class Counting:
    """A file that counts what is read from it."""

    read_bytes = 0

    def __init__(self, f):
        self.f = f

    def __enter__(self):
        return self

    def __exit__(self, *e):
        self.f.close()

    def seek(self, n):
        self.f.seek(n)

    def read(self, n):
        data = self.f.read(n)
        Counting.read_bytes += len(data)
        return data


def test_members_are_read_by_range(spark, tmp_path, monkeypatch):
    items = [(f"m{i:03d}", bytes([i % 251]) * 10_000) for i in range(300)]
    (tmp_path / "x.arc").write_bytes(toc.build_flat(items))
    (tmp_path / "bad.arc").write_bytes(b"FLT1\xff\xff")
    (tmp_path / "cut.arc").write_bytes(toc.build_flat([("one", b"1" * 50), ("two", b"2" * 50)])[:-20])
    got = ranges.members(spark, str(tmp_path), "flat").filter((F.col("name") == "m007") | (F.col("name") == "m299"))
    assert sorted((r.name, bytes(r.payload)) for r in got.collect()) == [items[7], items[299]]
    kept = ranges.members(spark, str(tmp_path / "x.arc"), "flat").filter(F.col("name").startswith("m00"))
    assert "StartsWith" not in str(kept._jdf.queryExecution().executedPlan().toString()).split("BatchScan")[0]
    assert sorted(r.name for r in kept.collect()) == [f"m{i:03d}" for i in range(10)]
    odd = {(r.path[len(str(tmp_path)) + 1 :], r.name, r.error is not None) for r in ranges.members(spark, str(tmp_path), "flat").filter(~F.col("path").endswith("x.arc")).collect()}
    assert odd == {("bad.arc", None, True), ("cut.arc", "one", False), ("cut.arc", "two", True)}

    real = ranges.opened

    def counted(path):
        fs, root = real(path)
        return type("Fs", (), {"open_input_file": lambda self, p: Counting(fs.open_input_file(p)), "get_file_info": lambda self, x: fs.get_file_info(x)})(), root

    monkeypatch.setattr(ranges, "opened", counted)
    for filters, most in (([EqualTo(("name",), "m250")], ranges.HEAD + 10_000), ([StringStartsWith(("name",), "m01")], ranges.HEAD + 100_000), ([EqualTo(("path",), "elsewhere")], 0)):
        reader = ranges.MemberReader({"path": str(tmp_path / "x.arc"), "layout": "flat"})
        Counting.read_bytes = 0
        assert list(reader.pushFilters(filters)) == []
        rows = [r for p in reader.partitions() for r in table(reader.read(p))]
        assert Counting.read_bytes <= most and len(rows) == most // 10_000 - ranges.HEAD // 10_000 * (most > 0)


def test_keyed_files_appear_together_or_not_at_all(spark, tmp_path):
    rows = spark.createDataFrame([("a.txt", 2, b"two"), ("a.txt", 1, b"one"), ("d/b.txt", 1, None), ("../c", 1, b"c")], "name string, n int, payload binary").repartition(3)
    folder = tmp_path / "out"
    ranges.write_keyed(rows, str(folder), order=["n"])
    shown = lambda: {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()}
    want = {"a.txt": b"onetwo", "d/b.txt": b"", "c": b"c"}
    assert shown() == want
    with pytest.raises(Exception, match="stand there already"):
        ranges.write_keyed(spark.createDataFrame([("new", b"n"), ("c", b"x")], "name string, payload binary"), str(folder))
    assert shown() == want
    ranges.write_keyed(spark.createDataFrame([("c", b"x")], "name string, payload binary"), f"file://{folder}", replace=True)
    assert shown() == want | {"c": b"x"}
    failing = spark.range(40).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("boom")).cast("binary")).otherwise(F.lit(b"y")).alias("payload"))
    with pytest.raises(Exception, match="boom"):
        ranges.write_keyed(failing, str(folder))
    with pytest.raises(Exception, match="without a name"):
        ranges.write_keyed(spark.createDataFrame([("z", b"n"), (None, b"x")], "name string, payload binary"), str(folder))
    assert shown() == want | {"c": b"x"}
    assert [p.name for p in folder.iterdir() if p.name.startswith("_")] == []


def test_two_writers_of_one_name_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([("same", b"1")], "name string, payload binary")
    spark.dataSource.register(ranges.KeyedSink)
    with pytest.raises(Exception, match="two tasks wrote one name"):
        rows.union(rows).write.format("keyed_files").mode("append").save(str(tmp_path / "two"))
    assert [p for p in (tmp_path / "two").rglob("*")] == []


@pytest.mark.parametrize("n", [2500, 3200, 5400])
def test_names_that_go_on_after_the_first_read(n, tmp_path):
    """The first read holds all of the records, but part of the names or none."""
    items = [(f"name{i:05d}", b"%d" % i) for i in range(n)]
    (tmp_path / "x.arc").write_bytes(toc.build_flat(items))
    reader = ranges.MemberReader({"path": str(tmp_path / "x.arc"), "layout": "flat"})
    rows = [r for p in reader.partitions() for r in table(reader.read(p))]
    assert [(r["name"], r["payload"]) for r in rows] == items
