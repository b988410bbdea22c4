"""Connected components by contraction, with partial aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the least node of its connected part.

    Each round gives every node the least of itself and its neighbours and
    contracts the edges to those; loops and repeats go. Each round is a
    grouped minimum and two joins of a shrinking table, each staged.
    """
    edges = staged(_oriented(edges), "edges")
    label: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = staged(both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n")).select(F.col("a").alias("node"), F.least("a", "least").alias("to"), "n"), "labels")
        ends = [to.select(F.col("node").alias(x), F.col("to").alias(y), F.col("n").alias(f"n_{x}")) for x, y in (("a", "x"), ("b", "y"))]
        moved = spread_join(spread_join(edges, ends[0], "a", "b", rows="n_a"), ends[1], "b", "a", rows="n_b")
        edges = staged(_oriented(moved.select(F.col("x").alias("a"), F.col("y").alias("b"))), "edges")
        if label is None:
            label = to.select("node", F.col("to").alias("component"))
        else:
            sizes = label.groupBy("component").agg(F.count("*").alias("n"))
            step = staged(to.select(F.col("node").alias("component"), "to").join(sizes, "component"), "steps")
            label = staged(spread_join(label, step, "component", "node", "left").select("node", F.coalesce("to", "component").alias("component")), "components")
    return label if label is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, without loops."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
