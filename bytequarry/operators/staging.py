"""Tables that later passes read again: checkpointed below the folder that the cluster names."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that a broadcast table may take in an executor's memory, by its rows' estimated size.
BROADCAST_BYTES = 16 << 20

#: Rows that a task takes of a table of short rows that Python works on.
TASK_ROWS = 6000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one only in local mode where none is configured."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="bytequarry-")
        atexit.register(shutil.rmtree, local, True)
        spark.sparkContext.setCheckpointDir(place := f"file://{local}")
    return place.rstrip("/")


def held(df: DataFrame) -> DataFrame:
    """df checkpointed, so that each pass reads what the one before wrote, whatever executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def row_bytes(schema: T.StructType) -> int:
    """About what a row takes in a hash relation; for strings and nested values a guess, so keep long ones out of what is broadcast."""
    return 48 + sum(8 if isinstance(f.dataType, T.NumericType | T.BooleanType | T.DatetimeType) else 64 for f in schema)


def light(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is counted small enough, else as it is, to be shuffled."""
    most = BROADCAST_BYTES // row_bytes(df.schema)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame, *by: str, rows: int = TASK_ROWS) -> DataFrame:
    """df dealt by its columns `by` to as many tasks as run at once, and to so many that none has many more than `rows` rows.

    A small file of many rows is one task to Spark; where each row costs Python
    time, or grows into a blob, the work needs more of them, and a batch that
    goes to Python is never larger than a task's rows.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *by)
