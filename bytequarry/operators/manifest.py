"""Rows to ordered text lines, and the sinks that write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import held


def lines(df: DataFrame, group: list[str], order: str, lines_col: str, per: int) -> DataFrame:
    """One row per line of arrays of at most `per` lines: group, seq (order * per + place), line."""
    return df.select(*group, order, F.posexplode(lines_col).alias("place", "line")).select(*group, (F.col(order) * per + F.col("place")).alias("seq"), "line")


def playlist(tags: DataFrame, group: list[str], order: list[str], file: str, values: dict[str, str]) -> DataFrame:
    """(group, seq, line): for each file its tags as `# %NAME% value` lines, then the file; tags that a whole group shares come once, at its top.

    A tag is promoted when every file of the group has it with one value, case
    aside. seq orders the lines within the group.
    """
    from pyspark.sql import Window

    whole = tags.groupBy(*group).agg(F.count("*").alias("__n"), *[F.struct(F.count_distinct(F.upper(c)).alias("k"), F.count(c).alias("have"), F.min_by(c, F.struct(*order)).alias("v")).alias(f"__{c}") for c in values])
    shared = lambda c: (F.col(f"__{c}.k") == 1) & (F.col(f"__{c}.have") == F.col("__n"))
    tag = lambda mark, name, v: F.concat(F.lit(f"# {mark}{name}{mark} "), v)
    head = whole.select(*group, F.lit(0).alias("__f"), F.array_compact(F.array(*[F.when(shared(c), tag("@", n, F.col(f"__{c}.v"))) for c, n in values.items()])).alias("__l"))
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    body = tags.withColumn("__f", n).join(whole, group).select(*group, "__f", F.array_compact(F.array(*[F.when(~shared(c), tag("%", n_, F.col(c))) for c, n_ in values.items()], F.col(file))).alias("__l"))
    out = head.unionByName(body).select(*group, "__f", F.posexplode("__l").alias("__p", "line"))
    return out.select(*group, (F.col("__f") * (len(values) + 1) + F.col("__p")).alias("seq"), "line")


def write_text(lines_df: DataFrame, path: str, order: list[str], line: str = "line", bom: bool = False, crlf: bool = False) -> None:
    """Write lines in order as text; one file, for a manifest is a report. bom marks the first line, crlf ends lines so."""
    rows = lines_df.orderBy(*order).select(F.col(line).alias("value"), F.monotonically_increasing_id().alias("n"))
    if bom:
        first = rows.agg(F.min("n")).first()[0]
        rows = rows.withColumn("value", F.when(F.col("n") == first, F.concat(F.lit("﻿"), "value")).otherwise(F.col("value")))
    rows.coalesce(1).sortWithinPartitions("n").select("value").write.option("lineSep", "\r\n" if crlf else "\n").text(path)


def write_payloads(df: DataFrame, folder: str, name: str = "name", payload: str = "payload") -> DataFrame:
    """Write each payload under folder as its name, all or nothing (sources.ranges.KeyedSink); gives (name, size) of what was written. folder: a URI or a path that all executors share."""
    from ..sources.ranges import write_keyed

    rows = held(df.select(F.col(name).alias("name"), F.col(payload).alias("payload")))
    write_keyed(rows, folder)
    return rows.groupBy("name").agg(F.sum(F.coalesce(F.octet_length("payload"), F.lit(0))).cast("long").alias("size"))


def moves(df: DataFrame, src: Column, dst: Column) -> DataFrame:
    """(src, dst) of files that a rule would rename; files go before the folders that hold them. The engine moves nothing itself."""
    rows = df.select(src.alias("src"), dst.alias("dst")).filter(F.col("src") != F.col("dst"))
    return rows.orderBy(F.size(F.split("src", "/")).desc(), "src")


def loop_command(file: Column, start: Column, end: Column) -> Column:
    """A text command that plays a file with loop points, or null without them."""
    return F.when(end.isNotNull() & (end > 0), F.format_string("%s #I %d %d", file, start, end))


def sheet_renames(sheets: DataFrame, waves: DataFrame) -> DataFrame:
    """(file, line): commands that give cue sheets and their wave files the sheet's name; what has none, or its own already, is a remark. Several wave files of one content are told apart by [1], [2] ... in the order of their names. sheets: (file, name, kind, wave_md5); waves: (file, wave_md5)."""
    from .ordered import numbered

    def command(file: Column, new: Column, fine: Column) -> Column:
        return F.concat(F.when(fine, "REM #").otherwise(""), F.lit("ren "), file, F.lit(" "), new)

    nameless = F.coalesce(F.col("name"), F.lit("")).isin("", "?")
    own = F.concat(F.coalesce("name", F.lit("")), F.lit("."), "kind")
    first = sheets.select("file", command(F.col("file"), own, nameless | (F.lower("file") == F.lower(own))).alias("line"))
    met = numbered(sheets.select("name", "wave_md5", F.col("file").alias("sheet")).join(waves.select("file", "wave_md5"), "wave_md5"), ["sheet"], ["file"], "i")
    new = F.concat(F.coalesce("name", F.lit("")), F.when(F.col("i") > 0, F.concat(F.lit("["), F.col("i").cast("string"), F.lit("]"))).otherwise(""), F.lit(".awb"))
    return first.unionByName(met.select("file", command(F.col("file"), new, nameless | (F.col("file") == new)).alias("line")))
