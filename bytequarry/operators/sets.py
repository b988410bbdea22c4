"""Set comparison: duplicates, differences, references, joins by set or by fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import held, light

def duplicate_groups(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """Rows that share their key with others: id, digest, group_size, first_id. Members meet by their group, never in pairs."""
    rows = df.select(F.col(id_col), key.alias("digest"))
    groups = rows.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(id_col).alias("first_id")).filter("group_size > 1")
    return rows.join(groups, "digest").select(id_col, "digest", "group_size", "first_id")


def first_of_each(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """The least id of each key."""
    return df.groupBy(key.alias("digest")).agg(F.min(id_col).alias(id_col))


def head_tail_key(data: Column, skip: int = 0) -> Column:
    """MD5 of what follows the first `skip` characters; null for shorter values."""
    return F.when(F.length(data) >= skip, F.md5(F.substring(data, F.lit(skip + 1), F.length(data))))


def diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Full-outer comparison by key: (key, status) with status extra_old, extra_new, changed or same."""
    o, n = old.select(F.col(key), F.col(digest).alias("__o")), new.select(F.col(key), F.col(digest).alias("__n"))
    status = F.when(F.col("__n").isNull(), "extra_old").when(F.col("__o").isNull(), "extra_new").when(F.col("__o") != F.col("__n"), "changed").otherwise("same")
    return o.join(n, key, "full_outer").select(key, status.alias("status"))


def unreferenced(items: DataFrame, references: DataFrame, on: str) -> DataFrame:
    return items.join(references.select(on).distinct(), on, "left_anti")


def _print(member: Column) -> list[Column]:
    """An order-free print of a set: its size, and sums of two hashes of each member in halves that can't overflow."""
    halves = [x for seed in (11, 12) for x in (F.xxhash64(F.lit(seed), member).bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(F.xxhash64(F.lit(seed), member), 32))]
    return [F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(halves)]]


def set_classes(members: DataFrame, owner: str, member: str) -> DataFrame:
    """(owner, set_id, n_members) of each owner whose set equals another's: set_id is the least such owner.

    Sets are never gathered: owners meet by a print of their set, made by
    partial aggregates, and each member of an owner is looked up among those
    of the least owner with its print. Owners that only seem equal go round
    again. Null members and owners don't count, and empty sets equal nothing.
    """
    rows = held(members.select(F.col(owner).alias("o"), F.col(member).alias("x")).dropna().distinct())
    prints = rows.groupBy("o").agg(*_print(F.col("x")))
    same = [c for c in prints.columns if c != "o"]
    open_, out = held(prints), None
    while True:
        groups = held(open_.groupBy(*same).agg(F.min("o").alias("first"), F.count("*").alias("owners")).filter("owners > 1").drop("owners"))
        if groups.isEmpty():
            break
        claimed = held(open_.join(light(groups), same).select("o", "first", "n"))
        asked = rows.join(claimed, "o")
        firsts = asked.filter("o = first").select("first", "x")
        found = asked.join(firsts, ["first", "x"]).groupBy("o", "first", "n").agg(F.count("*").alias("shared"))
        found = held(found.withColumn("right", F.col("shared") == F.col("n")))
        # a first one that nothing equals is in no class
        alone = found.filter("right").groupBy("first").agg(F.count("*").alias("owners")).filter("owners > 1").select("first")
        right = found.filter("right").join(alone, "first").select("o", F.col("first").alias("set_id"), F.col("n").alias("n_members"))
        out = right if out is None else out.unionByName(right)
        left = found.filter("NOT right OR right IS NULL").select("o").unionByName(claimed.select("o").join(found.select("o"), "o", "left_anti"))
        open_ = held(open_.join(left.distinct(), "o", "left_semi"))
    empty = rows.limit(0).select("o", F.col("o").alias("set_id"), F.lit(0).cast("long").alias("n_members"))
    return (empty if out is None else out).withColumnRenamed("o", owner)


def equal_sets(members: DataFrame, owner: str, member: str) -> DataFrame:
    """(set_id, owners, n_members): how many owners hold exactly the same set, where several do. Pairs are implied by the group."""
    return set_classes(members, owner, member).groupBy("set_id").agg(F.count("*").alias("owners"), F.max("n_members").alias("n_members")).select("set_id", "owners", "n_members")


def set_partners(members: DataFrame, owner: str, member: str, name: str) -> DataFrame:
    """(owner, set_id, n_members, partners): how many owners of another name hold the owner's very set; those with none are left out. name: a column of members, one value for each owner."""
    names = members.select(owner, F.col(name).alias("__name")).dropna().groupBy(owner).agg(F.min("__name").alias("__name"))
    named = held(set_classes(members, owner, member).join(names, owner, "left"))
    whole = named.groupBy("set_id").agg(F.count("*").alias("__all"))
    alike = named.groupBy("set_id", "__name").agg(F.count("*").alias("__same"))
    counted = alike.join(whole, "set_id").select(F.col("set_id").alias("__set"), F.col("__name").alias("__alike"), (F.col("__all") - F.col("__same")).alias("partners")).filter("partners > 0")
    return named.join(counted, (F.col("set_id") == F.col("__set")) & F.col("__name").eqNullSafe(F.col("__alike"))).select(owner, "set_id", "n_members", "partners")


def range_count(left: DataFrame, right: DataFrame, value: str, width: int) -> DataFrame:
    """For each distinct left value v: (v, rows, matches), matches being right rows in [v, v + width].

    Both sides are grouped by value first; buckets of `width` meet their own
    and the next one, so no value meets more than two buckets.
    """
    lo = left.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("rows"))
    hi = right.groupBy(F.col(value).alias("x")).agg(F.count("*").alias("n"))
    lo = lo.withColumn("b", F.explode(F.array(F.floor(F.col("v") / width), F.floor(F.col("v") / width) + 1)))
    hi = hi.withColumn("b", F.floor(F.col("x") / width))
    near = lo.join(hi, "b").filter(F.col("x").between(F.col("v"), F.col("v") + width))
    return near.groupBy("v").agg(F.max("rows").alias("rows"), F.sum("n").alias("matches"))


def range_join(left: DataFrame, right: DataFrame, value: str, other: str, width: int) -> DataFrame:
    """Rows of left and right with value <= other <= value + width, by buckets."""
    lo = left.withColumn("__b", F.explode(F.array(F.floor(F.col(value) / width), F.floor(F.col(value) / width) + 1)))
    hi = right.withColumn("__b", F.floor(F.col(other) / width))
    return lo.join(hi, "__b").filter(F.col(other).between(F.col(value), F.col(value) + width)).drop("__b")


def differing_pairs(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, pairs): ordered pairs of rows with one key and different values, counted from group sizes."""
    cells = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return cells.groupBy(key).agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("pairs")).filter("pairs > 0")


def fallback_lookup(df: DataFrame, levels: list[tuple[str, DataFrame, str]], value: str) -> DataFrame:
    """df with `value` from the first level that has one. A level: (key column, table of one row per key, its value column)."""
    names = []
    for i, (key, table, col) in enumerate(levels):
        names.append(f"__v{i}")
        df = df.join(table.select(F.col(key), F.col(col).alias(names[-1])), key, "left")
    return df.withColumn(value, F.coalesce(*names)).drop(*names)


def first_existing(items: DataFrame, present: DataFrame, item: str, options: list[str]) -> DataFrame:
    """For each item the first option for which item || option is present."""
    tried = items.select(item, F.posexplode(F.array(*map(F.lit, options))).alias("rank", "option"))
    hits = tried.join(present.select(F.col("path")), F.concat(item, "option") == F.col("path"), "left_semi")
    return hits.groupBy(item).agg(F.min_by("option", "rank").alias("option"))


def suffix_lookup(items: DataFrame, names: DataFrame, item: str, name: str) -> DataFrame:
    """Items joined with the longest known name that they end with, by every suffix that starts a path part."""
    parts = F.split(F.col(item), "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    tried = items.select(item, F.posexplode(suffixes).alias("rank", name))
    return tried.join(names.select(name), name).groupBy(item).agg(F.min_by(name, "rank").alias(name))


def key_spellings(items: DataFrame, table: DataFrame, item: str, key: str, value: str, spellings: list[Column]) -> DataFrame:
    """Items with the value found under the first spelling of their key that the table has."""
    tried = items.select(item, F.posexplode(F.array(*spellings)).alias("rank", key))
    return tried.join(table.select(key, value), key).groupBy(item).agg(F.min_by(value, "rank").alias(value))


def bundle(files: DataFrame, stem: Column, ext: Column, wanted: dict[str, bool]) -> DataFrame:
    """Files of one stem side by side: stem and a path column per extension; extensions marked True must be there."""
    cols = [F.min(F.when(ext == e, F.col("path"))).alias(e) for e in wanted]
    out = files.groupBy(stem.alias("stem")).agg(*cols)
    for e, needed in wanted.items():
        if needed:
            out = out.filter(F.col(e).isNotNull())
    return out


def with_implied_ids(ids: DataFrame, col: str, mask: int, mapping: dict[int, int]) -> DataFrame:
    """ids and, for each whose masked class is in mapping, the id with its class replaced (any bit of the mask counts)."""
    kind = F.col(col).bitwiseAND(F.lit(mask))
    implied = None
    for a, b in mapping.items():
        implied = F.when(kind == a, F.col(col) - a + b).otherwise(F.lit(None) if implied is None else implied)
    return ids.select(F.explode(F.array_compact(F.array(F.col(col), implied))).alias(col)).distinct()


def prefix_groups(df: DataFrame, id_col: str, keys: list[str], text: Column, n: int) -> DataFrame:
    """Rows that share their keys and the first n characters of a text with others: keys, prefix, id, first_id (the group's least), members. Pairs are implied by the group."""
    rows = df.select(*keys, F.left(text, F.lit(n)).alias("prefix"), F.col(id_col))
    groups = rows.groupBy(*keys, "prefix").agg(F.min(id_col).alias("first_id"), F.count("*").alias("members")).filter("members > 1")
    return rows.join(groups, [*keys, "prefix"])
