"""Operators over an explicit order: islands, carried values, offsets, counters.

All are running values (scans.running), so a key may have any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import Running, before, running
from .staging import held, light


def _flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def _free(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that df has not got."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def sizes_by_next(df: DataFrame, group: list[str], offset: str, end: Column, order: list[str] | None = None, hot: int | None = None) -> DataFrame:
    """df with size: the next offset of the group less its own; the last ends at `end`. order: where offsets may repeat."""
    (after,) = _free(df, "after")
    ahead = running(df, group, order or [offset], {after: before(F.col(offset))}, hot, reverse=True)
    return ahead.withColumn("size", F.coalesce(F.col(f"{after}.v"), end) - F.col(offset)).drop(after)


def running_offsets(df: DataFrame, group: list[str], order: str, size: str, hot: int | None = None) -> DataFrame:
    return running(df, group, [order], {"offset": Running("sum", F.col(size), False)}, hot)


def islands(df: DataFrame, group: list[str], order: list[str], starts: Column, name: str = "island", hot: int | None = None) -> DataFrame:
    """df with the number of starts so far in its group; rows before the first are 0."""
    return running(df, group, order, {name: Running("sum", _flag(starts))}, hot)


def islands_after(df: DataFrame, group: list[str], order: list[str], ends: Column, name: str = "island", hot: int | None = None) -> DataFrame:
    """Islands that a row closes: the next row opens a new one."""
    return running(df, group, order, {name: Running("sum", _flag(ends), False)}, hot)


def islands_on_change(df: DataFrame, group: list[str], order: list[str], key: Column, ends: Column, name: str = "island", hot: int | None = None) -> DataFrame:
    """A new island where the key changes or is null, or after a row that ends one."""
    (last,) = _free(df, "last")
    told = F.struct(key.alias("k"), F.coalesce(ends, F.lit(False)).alias("e"))
    marked = running(df, group, order, {last: before(told)}, hot)
    first = F.col(f"{last}.v.k").isNull() | ~F.col(f"{last}.v.k").eqNullSafe(key) | F.coalesce(F.col(f"{last}.v.e"), F.lit(False))
    return islands(marked, group, order, first, name, hot).drop(last)


def carried(df: DataFrame, group: list[str], order: list[str], value: Column, name: str, initial: Column | None = None, hot: int | None = None) -> DataFrame:
    """df with the last known value up to each row; before the first, `initial`."""
    known = running(df, group, order, {name: Running("last", value)}, hot)
    return known if initial is None else known.withColumn(name, F.coalesce(name, initial))


def carried_or_first(df: DataFrame, group: list[str], order: list[str], value: Column, name: str, hot: int | None = None) -> DataFrame:
    """The last known value; before the first, the first known one."""
    (ahead,) = _free(df, "ahead")
    both = running(running(df, group, order, {ahead: Running("last", value)}, hot, reverse=True), group, order, {name: Running("last", value)}, hot)
    return both.withColumn(name, F.coalesce(name, ahead)).drop(ahead)


def one_shot(df: DataFrame, group: list[str], order: list[str], value: Column, uses: Column, name: str, hot: int | None = None) -> DataFrame:
    """A value that the next using row consumes: the latest one set since the using row before."""
    (run,) = _free(df, "run")
    marked = running(df, group, order, {run: Running("sum", _flag(uses), False)}, hot)
    return running(marked, [*group, run], order, {name: Running("last", value)}, hot).withColumn(name, F.when(uses, F.col(name))).drop(run)


def numbered(df: DataFrame, group: list[str], order: list[str | Column], name: str = "n", hot: int | None = None) -> DataFrame:
    """df with 0, 1, 2 ... in its group."""
    return running(df, group, order, {name: Running("sum", F.lit(1), False)}, hot)


def numbered_names(df: DataFrame, name: str, order: list[str], out: str = "out_name", width: int = 4, hot: int | None = None) -> DataFrame:
    """Repeated names told apart: the first stays, the others get #0001, #0002 ..."""
    (n,) = _free(df, "n")
    return numbered(df, [name], order, n, hot).withColumn(out, F.when(F.col(n) == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("#"), F.lpad(F.col(n).cast("string"), width, "0")))).drop(n)


def falls(df: DataFrame, group: list[str], order: list[str], value: str, name: str = "falls", hot: int | None = None) -> DataFrame:
    """Whether the value is less than that of the row before."""
    (last,) = _free(df, "last")
    return running(df, group, order, {last: before(F.col(value))}, hot).withColumn(name, F.coalesce(F.col(value) < F.col(f"{last}.v"), F.lit(False))).drop(last)


def without_repeated_blanks(lines: DataFrame, group: list[str], seq: str, line: str, hot: int | None = None) -> DataFrame:
    """Lines less blanks that follow a blank."""
    (last,) = _free(lines, "last")
    blank = F.trim(F.col(line)) == ""
    return running(lines, group, [seq], {last: before(blank)}, hot).filter(~(blank & F.coalesce(F.col(f"{last}.v"), F.lit(False)))).drop(last)


def first_flag(df: DataFrame, group: list[str], order: list[str], name: str = "is_first", hot: int | None = None) -> DataFrame:
    return numbered(df, group, order, name, hot).withColumn(name, F.col(name) == 0)


def section_sorted(lines: DataFrame, section: str, seq: str, line: str, hot: int | None = None) -> DataFrame:
    """Lines with rank: sections in order, in each first others then those that begin with a digit, by text, and comments last as they stood."""
    kind = F.when(F.col(line).startswith("#"), 2).when(F.col(line).rlike(r"^\d"), 1).otherwise(0)
    placed = numbered(lines, [section], [kind, F.when(kind < 2, F.lower(line)), F.col(seq)], "rank", hot)
    return placed.withColumn("rank", F.col("rank") + 1)


def ranked(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with 1, 2, 3 ... over all rows in order, without gathering them in one task.

    A range exchange sorts the rows over many tasks; a row's place is the count
    of the tasks before (as many numbers as tasks) and its own place there. The
    sorted rows are checkpointed, so that both passes see the same tasks.
    """
    spark = df.sparkSession
    keys = [f"__k{i}" for i in range(len(order))]
    rows = df.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)]).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    rows = held(rows)
    part = F.shiftright("__at", 33)
    before, offsets = 0, []
    for r in sorted(rows.groupBy(part.alias("p")).count().collect(), key=lambda r: r["p"]):
        offsets.append((r["p"], before - (r["p"] << 33) + 1))
        before += r["count"]
    shift = spark.createDataFrame(offsets or [(0, 0)], "__part long, __shift long")
    return rows.join(light(shift), part == F.col("__part")).withColumn(name, F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift", *keys)
