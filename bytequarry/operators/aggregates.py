"""Grouped reports: promotion of constants, ordered joins, modes, thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def constant_values(long: DataFrame, entity: str, name: str, value: str) -> DataFrame:
    """(name, value): names that all entities have with one value, case aside; the value of the least entity is shown."""
    n = long.select(F.count_distinct(entity).alias("n"))
    per = long.groupBy(F.upper(name).alias("name")).agg(F.count_distinct(entity).alias("have"), F.count_distinct(F.upper(value)).alias("values"), F.min_by(value, entity).alias("value"))
    return per.filter("values = 1").join(F.broadcast(n), per["have"] == n["n"]).select("name", "value")


def unpivoted(df: DataFrame, entity: Column, cols: list[str]) -> DataFrame:
    """(entity, name, value) of the columns, as text."""
    return df.select(entity.alias("entity"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in cols])).alias("t")).select("entity", "t.name", "t.value")


def joined_in_order(df: DataFrame, group: list[str], order: str, text: Column, sep: str, name: str) -> DataFrame:
    """Texts of a group joined by their order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return df.groupBy(*group).agg(F.array_join(F.transform(rows, lambda x: x["t"]), sep).alias(name))


def character_counts(df: DataFrame, text: str) -> DataFrame:
    """(character, n): one pass over the characters, counted in each task before they move. (Counts of each text's distinct characters would read a text once for each.)"""
    each = df.select(F.explode(F.split(F.col(text), "")).alias("ch"))
    return each.filter(F.col("ch") != "").groupBy("ch").agg(F.count("*").alias("n"))


def mode(counts: DataFrame, value: str, n: str) -> DataFrame:
    """The most frequent value; the lowest of several."""
    best = counts.agg(F.max(F.struct(F.col(n).alias("n"))).alias("b"))
    return counts.join(F.broadcast(best), counts[n] == F.col("b.n")).agg(F.min(value).alias(value), F.max(n).alias(n))


def auto_threshold(best: DataFrame, score: str, spread: float = 0.5, scale: float = 0.65) -> DataFrame:
    """One row: (mean + spread * population deviation) * scale of the best scores."""
    return best.agg(((F.avg(score) + spread * F.stddev_pop(score)) * scale).alias("threshold"))


def last_wins(df: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, seq).alias(value))


def first_wins(df: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(value, seq).alias(value))


def any_active(df: DataFrame, group: list[str], flags: str, n: int) -> DataFrame:
    """For each place i of a flag array whether any row of the group has it set."""
    return df.groupBy(*group).agg(F.array(*[F.coalesce(F.bool_or(F.get(F.col(flags), F.lit(i))), F.lit(False)) for i in range(n)]).alias("active"))


def mean_vector(df: DataFrame, group: list[str], vector: str, dim: int) -> DataFrame:
    return df.groupBy(*group).agg(F.array(*[F.avg(F.get(F.col(vector), F.lit(i))) for i in range(dim)]).alias("mean"))


def byte_counts(df: DataFrame, data: str, mask: bytes = b"\0") -> DataFrame:
    """(byte, n): how often each value occurs in all blobs, each byte XORed with the mask's at its place. A task sends 256 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(256, np.int64)
        key = np.frombuffer(mask, np.uint8)
        for b in batches:
            for x in b.column(0).to_pylist():
                if x:
                    counts += np.bincount(np.frombuffer(x, np.uint8) ^ np.resize(key, len(x)), minlength=256)
        at = np.flatnonzero(counts)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["byte", "n"])

    return df.select(data).mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))


def merged_names(df: DataFrame, group: list[str], stem: str, name: str) -> DataFrame:
    """(group, stem, names): the distinct names of events that share a stem, in order."""
    return df.groupBy(*group, stem).agg(F.array_sort(F.collect_set(name)).alias("names"))
