"""Tables of short rows that Python turns into blobs: work for all cores, and batches of many files."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bytequarry.operators import staging
from bytequarry.plans import formats, samples
from bytequarry.sources import blobs, chunks, records, toc, utf_table


@pytest.fixture
def part(spark):
    return spark.range(3000).coalesce(1).select(F.col("id").alias("p_partkey"), F.concat(F.lit("a "), "id").alias("p_name"), F.lit("KIND").alias("p_type"))


def test_small_tables_are_dealt_to_all_cores(spark, part):
    tasks = spark.sparkContext.defaultParallelism
    assert part.rdd.getNumPartitions() == 1 and staging.spread(part, "p_partkey").rdd.getNumPartitions() == tasks
    assert staging.spread(part, "p_partkey", rows=100).rdd.getNumPartitions() == 30
    sizes = [n for (n,) in formats.files_of(part).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == tasks and sum(sizes) == 500


def test_rows_of_many_files_are_all_there(spark, part):
    files = formats.files_of(part)
    made = lambda write: files.select("path", formats.written(lambda x: write(formats._pairs(x)), F.col("items")).alias("content")).coalesce(1)
    each = [
        (toc.entries(made(lambda x: samples.spk(x)[0]).withColumn("lay", F.lit("spk")), "path", "content", "lay"), 3000),
        (chunks.walk(made(lambda x: samples.blocks([p for _, p in x])), "path", "content", chunks.BLOCKS), None),
        (records.read(made(samples.ogg), "ogg_pages"), 3000),
        (utf_table.cells(made(lambda x: utf_table.build("t", [("a", "u8", "row")], [[1]] * len(x))), "path", "content"), 3000),
    ]

    for rows, want in each:
        found = rows.count()
        assert want in (None, found) and found >= 3000


def test_batches_are_full_by_rows_or_by_bytes():
    rows = [("k", b"x" * 10) for _ in range(blobs.ROWS * 2 + 5)]
    kinds = [pa.string(), pa.binary()]
    assert [b.num_rows for b in blobs.gathered(iter(rows), kinds, ["k", "v"])] == [blobs.ROWS, blobs.ROWS, 5]
    assert [b.num_rows for b in blobs.gathered([("k", b"x" * blobs.BYTES)] * 3, kinds, ["k", "v"])] == [1, 1, 1]
    assert list(blobs.gathered([], kinds, ["k", "v"])) == []
