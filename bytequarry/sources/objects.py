"""Versioned objects: a small table says where each version keeps its fields; files meet it by their version, and their fields are native reads.

The companions of an object (its streamed data, the part that is kept ahead of
it, and the items of a sequence) are ids, resolved by joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytesx

# Fixed values of the formats: version, then where entries, audio's id, flag and prefetch size, layer's id, flag and prefetch size, a sequence's count stand.
VERSIONS = [
    (0x001B0100, 0xA4, 0x44, 0x50, 0x9C, 0x74, 0x54, 0x78, 0x54),
    (0x001F0010, 0xA4, 0x44, 0x50, 0x9C, 0x28, 0x54, 0x78, 0x54),
    (0x0025010A, 0xB4, 0x4C, 0x54, 0xA0, 0x28, 0x58, 0x7C, 0x5C),
    (0x0025011D, 0xB4, 0x4C, 0x54, 0xA0, 0x28, 0x58, 0x7C, 0x5C),
]
#: In little-endian files of this version entries stand 4 bytes before.
LATE_VERSION = 0x0025011D
CLASS, HEADER, TYPE, ITEM = 0x20, 0x28, 0x2C, 0x14
OBJECT, AUDIO, SEQUENCE, LAYER, NONE = 0x20000000, 1, 5, 6, 8
#: Of the first version the id of what is kept ahead has this class; of others it is the stream's.
AHEAD_CLASS = 0x30000000


def layouts(spark: SparkSession) -> DataFrame:
    names = ["version", "entries", "audio_id", "audio_flag", "audio_ahead", "layer_id", "layer_flag", "layer_ahead", "items"]
    return spark.createDataFrame(VERSIONS, ", ".join(f"{n} int" for n in names))


def objects(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row per file of a known version and class: path, version, big, id, type, companion, streamed, ahead, items (ids of a sequence).

    The byte order is that in which the class has its high byte. A word of 0,
    1 or all ones before the entries is passed over. Files of other versions,
    classes or types give a row with `error` alone.
    """
    data = F.col(content)
    version = bytesx.u32(data, 0, True).bitwiseAND(F.lit(0x00FFFFFF))
    rows = files.select(F.col(path), data.alias(content), version.cast("int").alias("version"))
    rows = rows.join(F.broadcast(layouts(files.sparkSession)), "version", "left")
    first = bytesx.u32(data, CLASS, True)
    rows = rows.withColumn("big", first.bitwiseAND(F.lit(0xFF000000)) != 0)

    def word(at: int | Column) -> Column:
        return F.when(F.col("big"), bytesx.u32(data, at, True)).otherwise(bytesx.u32(data, at))

    early = F.when((F.col("version") == LATE_VERSION) & ~F.col("big"), F.col("entries") - 4).otherwise(F.col("entries"))
    rows = rows.withColumn("entries", early)
    gap = word(F.col("entries"))
    rows = rows.withColumn("entries", F.when(gap.isin(0, 1, 0xFFFFFFFF), F.col("entries") + 4).otherwise(F.col("entries"))).withColumn("type", word(TYPE)).withColumn("kind", word(CLASS))
    of = lambda name: F.when(F.col("type") == AUDIO, word(F.col(f"audio_{name}"))).when(F.col("type") == LAYER, word(F.col(f"layer_{name}")))
    n = F.when(F.col("type") == SEQUENCE, word(F.col("items"))).otherwise(0).cast("int")
    room = F.greatest(F.lit(0), F.floor((F.length(data) - F.col("entries") - 4) / ITEM) + 1).cast("int")
    place = lambda i: (F.col("entries") + i * ITEM).cast("int")
    items = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.least(n, room), F.lit(0))), lambda i: i < F.least(n, room)), lambda i: F.when(F.col("big"), bytesx.u32(data, place(i), True)).otherwise(bytesx.u32(data, place(i))))
    error = F.when(F.col("entries").isNull(), "unknown version").when(F.col("kind") != OBJECT, "unknown class").when(~F.col("type").isin(AUDIO, SEQUENCE, LAYER, NONE), "unknown type").when(F.col("type").isNull(), "cut short")
    out = rows.select(path, "version", "big", word(HEADER).alias("id"), "type", of("id").alias("companion"), (of("flag") != 0).alias("streamed"), (of("ahead") != 0).alias("ahead"), items.alias("items"), error.alias("error"))
    blank = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    return out.select(path, *[blank(c) for c in ("version", "big", "id", "type", "companion", "streamed", "ahead", "items")], "error")


def companions(found: DataFrame) -> DataFrame:
    """(id, role, needs): what each object needs, by id: its stream, the part ahead of it, or (role item0, item1 ...) its sequence's items in order."""
    ahead_id = F.when(F.col("version") == VERSIONS[0][0], F.col("companion").bitwiseAND(F.lit(0x0FFFFFFF)).bitwiseOR(F.lit(AHEAD_CLASS))).otherwise(F.col("companion"))
    one = F.array_compact(F.array(F.when(F.col("streamed"), F.struct(F.lit("stream").alias("role"), F.col("companion").alias("needs"))), F.when(F.col("ahead") & (F.col("id") != F.col("companion")), F.struct(F.lit("ahead").alias("role"), ahead_id.alias("needs")))))
    many = F.transform("items", lambda x, i: F.struct(F.concat(F.lit("item"), i.cast("string")).alias("role"), x.alias("needs")))
    return found.filter("error IS NULL").select("id", F.explode(F.concat(one, many)).alias("x")).select("id", "x.role", "x.needs")
