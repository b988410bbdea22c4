"""Shared plumbing of the training-data operators: staged and numbered tables, guarded broadcasts, joins that no hot key gathers in one task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes that a broadcast table may take in an executor's memory, by row_bytes(); a larger one joins by shuffle.
BROADCAST_BYTES = 16 << 20
#: A key of more rows than this, and of more than a HOT_SHARE of all, is dealt to several tasks.
HOT_ROWS, HOT_SHARE = 10_000, 50_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only in local mode where none is configured."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="bytequarry-")
        atexit.register(shutil.rmtree, local, True)
        spark.sparkContext.setCheckpointDir(place := f"file://{local}")
    return place.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/bytequarry/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """Staged table (uid, row): each row of docs as a struct, with a number of its own.

    The numbers are stored with the rows, so every later plan sees the same
    ones, however docs was made; names of docs' columns can't clash with any.
    """
    return staged(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), name)


def column_of(row: str, col: str):
    return F.col(f"{row}.`{col}`")


def row_bytes(schema: T.StructType) -> int:
    """About what a row takes in a hash relation."""
    return 48 + sum(8 if isinstance(f.dataType, T.NumericType | T.BooleanType) else 64 for f in schema)


def fits(table: DataFrame) -> bool:
    """Whether a staged table, counted, may be broadcast."""
    return table.count() * row_bytes(table.schema) <= BROADCAST_BYTES


def spread_join(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner", rows: str = "n", least: int = HOT_ROWS) -> DataFrame:
    """left joined with the staged table right, which has each key once and in `rows` how many rows left has for it.

    right is broadcast where it fits. Else both shuffle by the key; a key of
    more than `least` rows and more than a HOT_SHARE of all is dealt by a hash
    of left's column `spread`, and repeated as often on the right. There are
    at most HOT_SHARE such keys, so they can be broadcast to tell left's rows.
    """
    if fits(right):
        return left.join(F.broadcast(right), key, how)
    whole = right.agg(F.sum(rows)).first()[0] or 0
    limit = max(least, whole // HOT_SHARE)
    deals = F.ceil(F.col(rows) / F.lit(limit)).cast("int")
    hot = right.filter(F.col(rows) > limit).select(key, deals.alias("__deals"))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("__deal", F.pmod(F.xxhash64(spread), F.coalesce("__deals", F.lit(1)).cast("long")).cast("int")).drop("__deals")
    told = right.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.greatest(deals, F.lit(1)) - 1)))
    return dealt.join(told, [key, "__deal"], how).drop("__deal")


def marked(held: DataFrame, marks: DataFrame, how: str = "left") -> DataFrame:
    """Rows of a staged, numbered table (uid and others) with what the staged table marks (uid once each, and plain columns) says of them; left_semi and left_anti keep those with or without a mark. No row of held is shuffled.

    Marks are broadcast where they fit. Else they are written by the task that
    numbered their rows (the high bits of uid), and each task reads the marks
    of the rows that it holds, which are at most as many as those.
    """
    more = [f for f in marks.schema if f.name != "uid"]
    if fits(marks):
        return held.join(F.broadcast(marks), "uid", how)
    place = fresh_path(held.sparkSession, "marks")
    marks.withColumn("part", F.shiftright("uid", 33)).repartition("part").sortWithinPartitions("part", "uid").write.partitionBy("part").parquet(place)
    schema = T.StructType([*held.schema, *(T.StructField(f.name, f.dataType) for f in more if how == "left")])
    return held.mapInArrow(_beside(place, {f.name: to_arrow_type(f.dataType) for f in more}, how), schema)


def _beside(place: str, names: dict[str, pa.DataType], how: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(place)
        known, table, uids = None, None, np.zeros(0, np.int64)
        for b in batches:
            uid = b.column(b.schema.get_field_index("uid")).to_numpy()
            cuts = np.flatnonzero(np.diff(uid >> 33, prepend=-1))
            for i, j in zip(cuts, [*cuts[1:], len(uid)], strict=True):
                if (part := int(uid[i] >> 33)) != known:
                    known, folder = part, f"{root}/part={part}"
                    there = fs.get_file_info(folder).type == pafs.FileType.Directory
                    table = ds.dataset(folder, filesystem=fs, format="parquet").to_table(columns=["uid", *names]).sort_by("uid") if there else None
                    uids = table.column("uid").to_numpy() if there else np.zeros(0, np.int64)
                rows, at = b.slice(i, j - i), np.searchsorted(uids, uid[i:j])
                hit = (at < len(uids)) & (uids[np.minimum(at, len(uids) - 1)] == uid[i:j]) if len(uids) else np.zeros(j - i, bool)
                if how != "left":
                    rows = rows.filter(pa.array(hit if how == "left_semi" else ~hit))
                    if rows.num_rows:
                        yield rows
                    continue
                take = pa.array(np.where(hit, at, 0), pa.int64(), mask=~hit)
                extra = [table.column(n).combine_chunks().cast(kind).take(take) if table is not None else pa.nulls(j - i, kind) for n, kind in names.items()]
                yield pa.RecordBatch.from_arrays([*rows.columns, *extra], names=[*rows.schema.names, *names])

    return run


def text_of(col: str):
    """The text as a string, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
