"""Sharding by a hierarchical weighted hash tree (region, rack, shard).

The descent starts at the root. At each level every child has a draw for the
key: an exponential waiting time at the rate of its subtree's weight, from a
hash of the key and the child's place in the tree. The child with the least
draw is entered, so the keys spread in proportion to the weights at each level,
and a key costs as many draws as the nodes on its way have children.

A child's draw depends on nothing but the key, its place and its weight. Where
weights change, a child that gains draws keys from its siblings, one that loses
gives them up, and below a child whose subtree is the same nothing moves. A
further shard gets a region of its own (`grown`), so it takes keys only into
itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_of

#: Hexadecimal digits of a node's hash that make its draw.
DIGITS = 13


@dataclass(frozen=True)
class Leaf:
    shard: int
    region: int
    rack: int
    weight: float = 1.0


def uniform_tree(shards: int, per_rack: int = 4, per_region: int = 8) -> list[Leaf]:
    """Equal shards, filled into racks and regions in order."""
    return [Leaf(i, i // per_region, i % per_region // per_rack) for i in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, alone in a region of its own; no other subtree changes."""
    return [*tree, Leaf(max((x.shard for x in tree), default=-1) + 1, max((x.region for x in tree), default=-1) + 1, 0, weight)]


def _draw(key: Column, place: str, weight: float) -> Column:
    """-ln(u) / weight for a u in (0, 1) of the hash's first digits."""
    u = (F.conv(F.left(F.md5(F.concat(key, F.lit(f"/{place}"))), F.lit(DIGITS)), 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    return -F.log(u) / F.lit(float(weight))


def shard_of(key: Column, tree: list[Leaf]) -> Column:
    """The shard (int) of a key, a text: the descent by least draws. Leaves of weight 0 get nothing."""
    leaves = [x for x in tree if x.weight > 0]
    if not leaves:
        raise ValueError("the tree has no leaf with a weight")

    def descend(inside: list[Leaf], above: tuple[int, ...]) -> Column:
        if len(above) == 3:
            return F.lit(inside[0].shard)
        children: dict[int, list[Leaf]] = {}
        for x in inside:
            children.setdefault((x.region, x.rack, x.shard)[len(above)], []).append(x)
        places = [(*above, name) for name in children]
        below = list(children.values())
        if len(below) == 1:
            return descend(below[0], places[0])
        draws = [_draw(key, ".".join(map(str, at)), sum(x.weight for x in some)) for at, some in zip(places, below, strict=True)]
        if len(above) == 2:
            return F.least(*[F.struct(d.alias("draw"), F.lit(some[0].shard).alias("shard")) for d, some in zip(draws, below, strict=True)])["shard"]
        entered = F.least(*[F.struct(d.alias("draw"), F.lit(i).alias("child")) for i, d in enumerate(draws)])["child"]
        out = descend(below[-1], places[-1])
        for i in range(len(below) - 2, -1, -1):
            out = F.when(entered == i, descend(below[i], places[i])).otherwise(out)
        return out

    return descend(leaves, ()).cast("int")


def gapless_slots(df: DataFrame, shard_col: str, order: list[str], name: str = "slot") -> DataFrame:
    """df with `name`: 0, 1, 2 ... within each shard, in the order given.

    A range exchange on (shard, order) spreads any shard over many tasks. A
    row's place is its task's offset plus its place there, less what stands
    before its shard; both come from counts by task and shard, whose number is
    at most tasks plus shards.
    """
    ranged = df.repartitionByRange(shard_col, *order).sortWithinPartitions(shard_col, *order)
    placed = staged(ranged.withColumn("__at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("part"), F.col(shard_col).alias("shard")).agg(F.count("*").alias("n"), F.min("__at").alias("first")).collect()
    seen: dict = {}
    starts = []
    for r in sorted(counts, key=lambda r: r["part"]):
        starts.append((r["part"], r["shard"], seen.get(r["shard"], 0) - r["first"]))
        seen[r["shard"]] = seen.get(r["shard"], 0) + r["n"]
    shift = placed.sparkSession.createDataFrame(starts or [(0, 0, 0)], "__part long, __shard int, __shift long")
    return placed.join(F.broadcast(shift), (part == F.col("__part")) & (F.col(shard_col) == F.col("__shard"))).withColumn(name, F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shard", "__shift")


def assign_shards(docs: DataFrame, tree: list[Leaf], larger: list[Leaf], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, size, text_crc32, law, shard, slot, grown_shard.

    The id and the tree alone decide (law `key`), so rows with one id share a
    shard; a null id is a key like any other. Size: UTF-8 bytes plus 1, a null
    text has none; text_crc32 is of the UTF-8 bytes. Slots follow the id, rows
    with one id their size and checksum. Other columns are not read. An empty
    table gives an empty result. Native expressions only.
    """
    text = text_of(text_col)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, tree).alias("shard"),
        shard_of(key, larger).alias("grown_shard"),
    )
    return gapless_slots(rows, "shard", [id_col, "size", "text_crc32"]).select(id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
