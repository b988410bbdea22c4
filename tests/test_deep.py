"""Chains, trees and nested tables deeper than any fixed bound."""

from pyspark.sql import functions as F

from bytequarry.operators import graph
from bytequarry.sources import utf_table


def test_deep_graphs(spark):
    n = 36
    edges = spark.createDataFrame([(i, 0, i + 1) for i in range(n)] + [(5, 1, 2)], "src long, ordinal int, dst long").coalesce(1).cache()
    roots = spark.createDataFrame([(0,)], "node long")
    assert sorted(r.depth for r in graph.reach(roots, edges).collect()) == list(range(n + 1))
    assert [r.leaf for r in graph.ordered_leaves(roots, edges.filter("dst <= 12"), F.col("dst") == 12).collect()] == [12]
    tree = spark.createDataFrame([(i, i - 1 if i else None, str(i)) for i in range(n)], "node long, parent long, name string").coalesce(1)
    assert graph.tree_paths(tree).count() == n
    own = spark.createDataFrame([(i, [str(i)]) for i in range(11)] + [(20, ["a"]), (21, ["b"])], "node long, values array<string>").coalesce(1)
    base = spark.createDataFrame([(i, i + 1) for i in range(10)] + [(20, 21), (21, 20)], "node long, base long").coalesce(1)
    got = {r.node: r["values"] for r in graph.inherited(own, base).collect()}
    assert got[0] == [str(i) for i in range(10, -1, -1)] and got[20] == ["b", "a"] and len(got) == 13


def test_deep_tables():
    data = utf_table.build("leaf", [("x", "string", "row")], [["end"]])
    for _ in range(40):
        data = utf_table.build("t", [("d", "data", "row")], [[data]])
    rows = list(utf_table._cells(data, []))
    assert len(rows) == 41 and rows[-1][9] == "end" and len(rows[-1][0]) == 40
