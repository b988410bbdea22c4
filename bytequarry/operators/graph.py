"""Object references: resolution, reachability, paths, orphans, printed trees."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import numbered
from .staging import held


def resolvable(target: Column) -> Column:
    """Whether a reference names something: not 0, not negative, not all ones."""
    return (target > 0) & (target != 0xFFFFFFFF)


def reach(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, node, depth): nodes that roots (node) reach over edges (src, dst), at the least depth.

    Each round joins the newly reached nodes with the edges and drops what was
    reached before, until nothing is new; cycles end there too.
    """
    edges = held(edges.select("src", "dst"))
    front = seen = held(roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")))
    for depth in count(1):
        step = front.select("root", F.col("node").alias("src")).join(edges, "src").select("root", F.col("dst").alias("node")).distinct()
        front = held(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def ordered_leaves(roots: DataFrame, edges: DataFrame, is_leaf: Column) -> DataFrame:
    """(root, leaf, place): leaves below each root in the order of a depth-first walk. edges: (src, ordinal, dst); is_leaf tests dst. A walk does not enter a node that it is below of."""
    front = roots.select(F.col("node").alias("root"), "node", F.array().cast("array<int>").alias("path"), F.array("node").alias("above"))
    out = None
    while True:
        step = front.join(edges, (front["node"] == edges["src"]) & ~F.array_contains("above", F.col("dst"))).select("root", F.col("dst").alias("node"), F.concat("path", F.array(F.col("ordinal").cast("int"))).alias("path"), F.concat("above", F.array("dst")).alias("above"), is_leaf.alias("leaf"))
        step = held(step)
        hit = step.filter("leaf").select("root", F.col("node").alias("leaf"), F.col("path").alias("place"))
        out = hit if out is None else out.unionByName(hit)
        front = step.filter("NOT leaf").drop("leaf")
        if front.isEmpty():
            return out


def first_leaves(roots: DataFrame, edges: DataFrame, is_leaf: Column) -> DataFrame:
    """(root, leaf, place): each leaf below a root once, where a depth-first walk meets it first; places count from 1. edges: (src, ordinal, dst); is_leaf tests dst. A walk does not enter a node that it is below of.

    Each node's list is worked out once, bottom up, from its children's lists
    by a grouped minimum, so nodes that many paths share cost nothing more.
    Nodes on cycles or above them have no list of their own; from roots among
    those, paths are walked until they come to a node that has.
    """
    edges = held(edges.select("src", F.col("ordinal").cast("long").alias("ordinal"), "dst", F.coalesce(is_leaf, F.lit(False)).alias("leaf")).dropna(subset=["src", "dst"]).distinct())
    inner = edges.select(F.col("src").alias("node")).distinct()
    # an edge to a node without edges of its own that is no leaf leads nowhere
    waiting = held(edges.filter("NOT leaf").join(inner, edges["dst"] == inner["node"], "left_semi").select("src", "dst"))
    open_, parts, lists = held(inner), [], None
    while True:
        ready = held(open_.join(waiting.select(F.col("src").alias("node")), "node", "left_anti"))
        if ready.isEmpty():
            break
        own = edges.join(ready.select(F.col("node").alias("src")), "src", "left_semi")
        met = own.filter("leaf").select("src", "ordinal", F.lit(0).cast("long").alias("within"), F.col("dst").alias("item"))
        if lists is not None:
            met = met.unionByName(own.filter("NOT leaf").join(lists.select(F.col("node").alias("dst"), "item", F.col("place").alias("within")), "dst").select("src", "ordinal", "within", "item"))
        first = met.groupBy("src", "item").agg(F.min(F.struct("ordinal", "within", "item")).alias("at")).select(F.col("src").alias("node"), "item", "at")
        parts.append(held(numbered(first, ["node"], ["at"], "place").select("node", "item", "place")))
        if len(parts) == 8:  # keeps plans short in deep graphs
            parts = [held(_united(parts))]
        lists = _united(parts)
        open_ = held(open_.join(ready, "node", "left_anti"))
        waiting = held(waiting.join(ready.select(F.col("node").alias("dst")), "dst", "left_anti"))
    if lists is None:
        lists = edges.limit(0).select(F.col("src").alias("node"), F.col("dst").alias("item"), F.lit(0).cast("long").alias("place"))
    asked = held(roots.select("node").dropna().distinct())
    found = asked.join(lists, "node").select(F.col("node").alias("root"), F.col("item").alias("leaf"), (F.col("place") + 1).alias("place"))
    tangled = held(asked.join(open_, "node", "left_semi"))
    return found if tangled.isEmpty() else found.unionByName(_tangled_leaves(tangled, edges, lists, open_))


def _tangled_leaves(roots: DataFrame, edges: DataFrame, lists: DataFrame, open_: DataFrame) -> DataFrame:
    """first_leaves of roots on or above cycles: paths through nodes without a list, each cut where it meets a node again or comes to a list."""
    kinds = edges.join(open_.select(F.col("node").alias("dst"), F.lit(True).alias("goes_on")), "dst", "left")
    front, hits = roots.select(F.col("node").alias("root"), "node", F.array().cast("array<long>").alias("path"), F.array("node").alias("above")), []
    while True:
        step = front.join(kinds, front["node"] == kinds["src"]).filter(~F.array_contains("above", F.col("dst")))
        step = held(step.select("root", F.col("dst").alias("node"), F.concat("path", F.array("ordinal")).alias("path"), F.concat("above", F.array("dst")).alias("above"), "leaf", "goes_on"))
        hits.append(step.filter("leaf").select("root", F.col("node").alias("item"), "path"))
        hits.append(step.filter("NOT leaf AND goes_on IS NULL").join(lists, "node").select("root", "item", F.concat("path", F.array("place")).alias("path")))
        front = step.filter("NOT leaf AND goes_on").select("root", "node", "path", "above")
        if front.isEmpty():
            break
    first = _united(hits).groupBy("root", "item").agg(F.min("path").alias("path"))
    return numbered(first, ["root"], ["path", "item"], "place").select("root", F.col("item").alias("leaf"), (F.col("place") + 1).alias("place"))


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def inherited(own: DataFrame, base: DataFrame) -> DataFrame:
    """(node, values): a node's base's values first, then its own, each once. own: (node, values); base: (node, base). A chain of bases ends where it would meet a node again."""
    state = own.select("node", "values", F.col("node").alias("at"), F.array("node").alias("met"))
    while True:
        up = state.join(base.select(F.col("node").alias("at"), "base"), "at").join(own.select(F.col("node").alias("base"), F.col("values").alias("more")), "base").filter(~F.array_contains("met", F.col("base")))
        moved = held(up.select("node", F.concat("more", "values").alias("values"), F.col("base").alias("at"), F.concat("met", F.array("base")).alias("met")))
        if moved.isEmpty():
            break
        state = held(state.join(moved.select("node").distinct(), "node", "left_anti").unionByName(moved))
    return state.select("node", F.array_distinct("values").alias("values"))


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(node, path) of a tree (node, parent, name), names joined by /; roots have a null parent."""
    front = nodes.filter("parent IS NULL").select("node", F.col("name").alias("path"), F.array("node").alias("above"))
    done = front.select("node", "path")
    while True:
        below = nodes.select("node", "parent", "name").join(front.select(F.col("node").alias("parent"), "path", "above"), "parent").filter(~F.array_contains("above", F.col("node")))
        front = held(below.select("node", F.concat("path", F.lit("/"), "name").alias("path"), F.concat("above", F.array("node")).alias("above")))
        if front.isEmpty():
            return done
        done = done.unionByName(front.select("node", "path"))


def printed(paths: DataFrame, name: str = "name", path: str = "path") -> DataFrame:
    """(path, line): two spaces for each level above."""
    return paths.select(path, F.concat(F.repeat(F.lit("  "), F.size(F.split(F.col(path), "/")) - 1), F.col(name)).alias("line"))


def orphans(nodes: DataFrame, visited: DataFrame) -> DataFrame:
    return nodes.join(visited.select("node").distinct(), "node", "left_anti")
