"""Demultiplexing: chunk rows to one payload for each stream, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytesx import concat_in_order

#: Types of BLOCKS that open and close streams.
OPEN, CLOSE, PADDING = "00000010", "000000f0", "00000000"


def streams(chunk_rows: DataFrame, keys: list[str], payload: str = "payload", seq: str = "seq") -> DataFrame:
    """(keys, payload): payloads of each stream joined by seq. A stream is one output file, whose size bounds the group."""
    rows = chunk_rows.filter(F.col(payload).isNotNull()).groupBy(*keys).agg(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(payload).alias("payload"))).alias("x"))
    return rows.select(*keys, concat_in_order(F.col("x")).alias("payload"))


def block_streams(blocks: DataFrame, path: str, kind: int = -1, subtype: int = -1, padded: tuple[int, ...] = ()) -> DataFrame:
    """BLOCKS rows with data to their streams: (path, stream, part, seq, payload).

    An open block starts a part of its stream; a close block ends all. kind and
    subtype (the low and high halves of the stream's number; -1: any) filter.
    Streams in `padded` have padding blocks of id 0 after their first data,
    which go. Data of a stream that is not open gives an error row.
    """
    number = F.when(F.col("id") == OPEN, F.col("type")).when(~F.col("id").isin(CLOSE, PADDING), F.conv("id", 16, 10).cast("bigint"))
    w = Window.partitionBy(path).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.withColumn("stream", number).withColumn("closed", F.sum(F.when(F.col("id") == CLOSE, 1).otherwise(0)).over(w))
    s = Window.partitionBy(path, "stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    here = Window.partitionBy(path, "stream", "closed").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.when(F.col("id") == OPEN, 1).otherwise(0)
    rows = rows.withColumn("part", F.sum(opens).over(s) - 1).withColumn("open", F.sum(opens).over(here) > 0)
    data = rows.filter(~F.col("id").isin(OPEN, CLOSE, PADDING))
    if kind >= 0:
        data = data.filter(F.col("stream").bitwiseAND(0xFFFF) == kind)
    if subtype >= 0:
        data = data.filter(F.shiftright("stream", 16).bitwiseAND(0xFFFF) == subtype)
    first = F.row_number().over(Window.partitionBy(path, "stream", "closed").orderBy("seq")) == 1
    data = data.withColumn("first", first)
    if padded:
        data = data.filter(F.col("first") | (F.col("type") != 0) | ~F.col("stream").isin(*padded))
    error = F.when(~F.col("open"), "stream is not open")
    return data.select(path, "stream", "part", "seq", F.when(F.col("open"), F.col("payload")).alias("payload"), error.alias("error"))


def sector_streams(sectors: DataFrame, path: str) -> DataFrame:
    """Audio SECTORS with the number of their part: (path, channel, part, seq, payload).

    Audio: submode bit 4 without 2 and 8. A part of a channel ends with submode
    bit 0x80, or where the head (submode aside) changes.
    """
    from .ordered import islands_on_change

    submode = F.shiftright("type", 8).bitwiseAND(255)
    audio = sectors.filter((submode.bitwiseAND(0x0E) == 4)).withColumn("head", F.col("type").bitwiseAND(F.lit(0xFFFF00FF))).withColumn("eof", submode.bitwiseAND(0x80) != 0)
    return islands_on_change(audio, [path, "channel"], ["seq"], F.col("head"), F.col("eof"), "part").select(path, "channel", (F.col("part") - 1).alias("part"), "seq", "payload")


def joined_files(parts: DataFrame, path: str, content: str, pattern: str = r"^(.*)-(\d{3})$") -> DataFrame:
    """Files name-001, name-002 ... as one: (stem, content)."""
    rows = parts.select(F.regexp_extract(path, pattern, 1).alias("stem"), F.regexp_extract(path, pattern, 2).cast("int").alias("seq"), F.col(content).alias("payload")).filter("stem <> ''")
    return streams(rows, ["stem"]).withColumnRenamed("payload", "content")


def deblocked(df: DataFrame, content: str, block: int = 0x4000, first: int = 0x3D40, head: int = 8) -> DataFrame:
    """df with `content` less the head of each block; the first block is shorter."""
    data = F.col(content)
    n = F.greatest(F.lit(0), F.ceil((F.length(data) - first) / block)).cast("int")
    starts = F.concat(F.array(F.lit(0)), F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i < n), lambda i: i * block + first))
    pieces = F.transform(starts, lambda s: F.substring(data, s + head + 1, F.when(s == 0, first).otherwise(block) - head))
    return df.withColumn(content, F.unhex(F.array_join(F.transform(pieces, lambda x: F.hex(x)), "")))
