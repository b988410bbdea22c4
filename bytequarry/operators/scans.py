"""Running values over an order, whatever the size of a key.

Keys of at most `hot` rows are scanned by a window. A larger one is cut into
parts: a range exchange on (key, order) sorts its rows over many tasks, each
part is scanned by itself, its summary (sum, last value) is combined with
those of the parts before it, and a second pass adds what comes in from there.
Sums and last values are associative, so the result is that of one scan.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import held, light

#: Rows of a key that one task may scan.
HOT_ROWS = 2_000_000


class Running(NamedTuple):
    """A running value: kind `sum` (nulls count 0) or `last` (last value that is not null), with or without the row itself."""

    kind: str
    value: Column
    here: bool = True


def before(value: Column) -> Running:
    """The value of the row before, as a field `v`; null for the first row of a key."""
    return Running("last", F.struct(value.alias("v")), False)


def _over(keys: list[str], order: list[Column], names: list[str], columns: dict[str, Running]) -> list[Column]:
    by = Window.partitionBy(*keys).orderBy(*order)
    out = []
    for value, c in zip(names, columns.values(), strict=True):
        w = by.rowsBetween(Window.unboundedPreceding, 0 if c.here else -1)
        out.append(F.coalesce(F.sum(value).over(w), F.lit(0)) if c.kind == "sum" else F.last(value, ignorenulls=True).over(w))
    return out


def _same(a: DataFrame, b: DataFrame, keys: list[str], more: list[str] = []) -> Column:  # noqa: B006
    """Equal keys, null like any other value."""
    return reduce(lambda x, y: x & y, [*(a[k].eqNullSafe(b[k]) for k in keys), *(a[k] == b[k] for k in more)], F.lit(True))


def running(df: DataFrame, group: list[str], order: list[str | Column], columns: dict[str, Running], hot: int | None = None, reverse: bool = False) -> DataFrame:
    """df with the running values `columns` of each group in ascending order, nulls first, or with reverse in the opposite one.

    The order columns should tell the rows of a group apart: of rows that tie,
    any may come first, and rows that all tie stay in one task. group may be
    empty. A null key is a key like any other. Columns of df keep their names
    and places; one that is named in columns is replaced. hot: see HOT_ROWS.
    """
    keys, by, values = ([f"{x}{i}" for i in range(n)] for x, n in (("g", max(1, len(group))), ("k", len(order)), ("v", len(columns))))
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        *[c.alias(k) for k, c in zip(keys, [F.col(c) for c in group] or [F.lit(0)], strict=True)],
        *[as_column(c).alias(k) for k, c in zip(by, order, strict=True)],
        *[c.value.alias(v) for v, c in zip(values, columns.values(), strict=True)],
    )
    sorting = [F.col(k).desc() if reverse else F.col(k) for k in by]
    large = held(rows.groupBy(*keys).count().filter(F.col("count") > (HOT_ROWS if hot is None else hot)).select(*keys))
    shown = [*[F.col(f"row.`{c}`") for c in df.columns if c not in columns], *columns]
    within = lambda some: some.select("row", *[c.alias(n) for n, c in zip(columns, _over(keys, sorting, values, columns), strict=True)]).select(*shown)
    if large.isEmpty():
        return within(rows).select(*_names(df, columns))
    few = light(large)
    ordinary = within(rows.join(few, _same(rows, few, keys), "left_anti"))

    cut = rows.join(few, _same(rows, few, keys), "left_semi").repartitionByRange(*keys, *sorting).sortWithinPartitions(*keys, *sorting)
    cut = held(cut.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)).drop(*by))
    total = lambda v, c: F.sum(v) if c.kind == "sum" else F.max_by(v, F.when(F.col(v).isNotNull(), F.col("at")))
    parts = cut.groupBy("part", *keys).agg(*[total(v, c).alias(v) for v, c in zip(values, columns.values(), strict=True)])
    # one row for each part and key, of which there are at most as many as parts and large keys
    came = _over(keys, [F.col("part")], values, {n: c._replace(here=False) for n, c in columns.items()})
    came = held(parts.select("part", *keys, *[c.alias(f"from_{v}") for v, c in zip(values, came, strict=True)]))
    scanned = cut.select("row", "part", *keys, *[c.alias(f"own_{v}") for v, c in zip(values, _over(["part", *keys], [F.col("at")], values, columns), strict=True)])
    came = light(came)
    joined = scanned.join(came, _same(scanned, came, keys, ["part"]))
    patched = [F.col(f"own_{v}") + F.col(f"from_{v}") if c.kind == "sum" else F.coalesce(f"own_{v}", f"from_{v}") for v, c in zip(values, columns.values(), strict=True)]
    seamed = joined.select("row", *[p.alias(n) for n, p in zip(columns, patched, strict=True)]).select(*shown)
    return ordinary.unionByName(seamed).select(*_names(df, columns))


def _names(df: DataFrame, columns: dict[str, Running]) -> list[Column]:
    return [F.col(f"`{c}`") for c in [*df.columns, *[n for n in columns if n not in df.columns]]]
