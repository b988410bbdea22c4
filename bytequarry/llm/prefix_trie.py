"""Conversation prefix trie, merged family first.

Conversations c with one base (c - c % 5) form a family; the turns of the base
and of its members meet in one task, where conversations are rebuilt and the
family's small trie is made, with sums over its subtrees. Only its nodes,
each once for a family, are shuffled to be merged.

A node that one family alone holds has its whole subtree there, so the
family's sums stand. The nodes that several families share take their
children's sums and add them up by doubling steps: after round k a node has
the sums of all nodes less than 2**k below it, so a trie of depth D takes
log2(D) rounds, however long its chains are.

A node's key is the sum of a 128-bit hash for each turn and its place; sums
can be taken for parts of a conversation apart, so conversations beyond LONG
turns are cut into segments that no task sees together.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import ranked
from .common import spread_join, staged, text_of
from .wordhash import mix

#: Conversations of a family stand in FAMILY consecutive numbers; at most MOST - 1 turns come from the base.
FAMILY, MOST = 5, 9
#: Turns of a family that one task may take; the conversations of larger families are cut into segments of SEGMENT turns.
LONG, SEGMENT = 20_000, 4096
#: Ids that are joined into one string of a node's members.
IDS = 1 << 16

NODES = "key binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, last_bytes long, n_children long, n_leaves long, saved_tokens long, ends string, open boolean"
_ROOT = bytes(16)
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def borrowed(conv_id: int) -> int:
    """How many turns a conversation takes from its base, if the base has as many."""
    return zlib.crc32(str(conv_id).encode()) % MOST


def turns(conversations: DataFrame) -> DataFrame:
    """(family, conv_id, turn, digest, bytes) of each row: 16 bytes for role and text, and the text's length in UTF-8."""
    role, text = text_of("role"), text_of("text")
    told = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    conv = F.col("conv_id").cast("long")
    rows = conversations.select(conv.alias("conv_id"), F.col("turn").alias("turn"), F.substring(told, 1, 16).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return rows.filter("conv_id IS NOT NULL").withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY)


def _step_hashes(digests: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes for turns with 16-byte digests (n x 2 words) at places from 1."""
    at = place.astype(np.uint64)
    return mix(digests[:, 0] + at * _STEP[0]), mix(digests[:, 1] ^ mix(at * _STEP[1]))


def _running(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums (mod 2**64) that begin anew at each of the runs."""
    total = np.cumsum(values)
    return total - np.repeat(total[first] - values[first], sizes)


def _words_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of 16-byte values as n x 2 unsigned words."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)


def _keys(k1: np.ndarray, k2: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(k1), [None, pa.py_buffer(np.ascontiguousarray(np.stack([k1, k2], 1)).tobytes())]).cast(pa.binary())


def _family_nodes(family: np.ndarray, conv: np.ndarray, digests: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Nodes of the tries of whole families, whose rows come by family, conversation and turn."""
    first = np.flatnonzero(np.diff(conv, prepend=conv[0] - 1))
    length = np.diff(first, append=len(conv))
    ids, fam = conv[first], family[first]
    h = np.array([borrowed(c) for c in ids.tolist()], np.int64)
    base = np.searchsorted(ids, fam) if np.all(ids[:-1] < ids[1:]) else pd.Index(ids).get_indexer(fam)
    base = np.where((base >= 0) & (base < len(ids)), base, 0)
    there = ids[base] == fam
    taken = np.where(there, np.minimum(h, length[base]), 0)
    own = np.maximum(0, length - h)
    # of each conversation: the root, what it takes from its base, its own rest
    starts = np.stack([np.zeros_like(first), first[base], first + h], 1).ravel()
    counts = np.stack([np.ones_like(first), taken, own], 1).ravel()
    ends = np.cumsum(counts)
    row = np.arange(ends[-1]) + np.repeat(starts - ends + counts, counts)
    turns_of = 1 + taken + own
    at = np.cumsum(turns_of) - turns_of
    depth = np.arange(len(row)) - np.repeat(at, turns_of)
    k1, k2 = _step_hashes(digests[row], depth)
    k1[at], k2[at] = 0, 0
    k1, k2 = _running(k1, at, turns_of), _running(k2, at, turns_of)
    f = np.repeat(fam, turns_of)
    order = np.lexsort((np.repeat(ids, turns_of), k2, k1, f))
    same = (np.diff(f[order]) == 0) & (np.diff(k1[order].view(np.int64)) == 0) & (np.diff(k2[order].view(np.int64)) == 0)
    begins = np.flatnonzero(np.concatenate(([True], ~same)))
    node = np.empty(len(row), np.int64)
    node[order] = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(row)))
    top = order[begins]  # the least conversation's entry
    n = np.bincount(node)
    above = np.where(depth[top] > 0, node[np.maximum(top - 1, 0)], -1)
    who, deep = np.repeat(ids, turns_of)[top], depth[top]
    last = np.where(deep > 0, size[row[top]], 0)
    inner = above >= 0
    children = np.bincount(above[inner], minlength=len(n))
    leaves, saved = (children == 0).astype(np.int64), (n - 1) * last
    by_depth = np.argsort(-deep, kind="stable")
    cuts = np.flatnonzero(np.diff(deep[by_depth], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(deep)], strict=True):
        level = by_depth[a:b]
        if deep[level[0]] > 0:
            np.add.at(leaves, above[level], leaves[level])
            np.add.at(saved, above[level], saved[level])
    ending: dict[int, list[str]] = {}
    for x, c in zip(node[at + turns_of - 1].tolist(), ids.tolist(), strict=True):  # ids ascend within a family
        ending.setdefault(x, []).append(str(c))
    missing = ~inner
    up = np.where(inner, above, 0)
    return pa.RecordBatch.from_arrays(
        [
            _keys(k1[top], k2[top]), pc.if_else(pa.array(missing), pa.scalar(None, pa.binary()), _keys(k1[top][up], k2[top][up])), pa.array(deep), pa.array(who), pa.array(who[up], pa.int64(), mask=missing), pa.array(n, pa.int64()), pa.array(last, pa.int64()),
            pa.array(children, pa.int64()), pa.array(leaves), pa.array(saved, pa.int64()), pa.array([",".join(ending[i]) if i in ending else None for i in range(len(n))], pa.string()), pa.array(np.zeros(len(n), bool)),
        ],
        names=[c.split()[0] for c in NODES.split(", ")],
    )


def _family_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of families, from rows (family, conv_id, digest, bytes) in order; the last family of a batch waits for the next."""
    held: list[pa.RecordBatch] = []

    def made(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        n = lambda c: t.column(c).to_numpy()
        return _family_nodes(n("family"), n("conv_id"), _words_of(t.column("digest")), n("bytes"))

    for b in batches:
        if not b.num_rows:
            continue
        family = b.column("family").to_numpy()
        cut = int(np.argmax(family == family[-1]))
        if cut == 0 and held and held[-1].column("family")[-1].as_py() == family[-1]:
            held.append(b)
            continue
        if cut:
            held.append(b.slice(0, cut))
        if held:
            yield made(held)
        held = [b.slice(cut)]
    if held:
        yield made(held)


def _segment_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, segment, place, digest) to (conv_id, segment, h1, h2) of each, as they come; Spark sums them."""
    for b in batches:
        if b.num_rows:
            h1, h2 = _step_hashes(_words_of(b.column("digest")), b.column("place").to_numpy())
            run = np.flatnonzero((np.diff(b.column("conv_id").to_numpy(), prepend=-1) != 0) | (np.diff(b.column("segment").to_numpy(), prepend=-1) != 0))
            run = np.union1d([0], run).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("conv_id").take(pa.array(run)), b.column("segment").take(pa.array(run)), pa.array(np.add.reduceat(h1, run).view(np.int64)), pa.array(np.add.reduceat(h2, run).view(np.int64))], names=["conv_id", "segment", "h1", "h2"])


def _starts(parts: pd.DataFrame) -> pd.DataFrame:
    """Of a conversation's segments, some thousandth of its turns: the hash sums before each."""
    parts = parts.groupby("segment", as_index=False).agg({"conv_id": "first", "h1": lambda x: np.sum(x.to_numpy()), "h2": lambda x: np.sum(x.to_numpy())}).sort_values("segment")
    for c in ("h1", "h2"):
        v = parts[c].to_numpy()
        parts[c] = np.cumsum(v) - v
    return parts[["conv_id", "segment", "h1", "h2"]]


def _segment_nodes(t: pa.Table) -> pa.Table:
    """The nodes of one segment of a conversation: rows (place, digest, bytes, conv_id, turns, h1, h2)."""
    t = t.sort_by("place")
    n = lambda c: t.column(c).to_numpy()
    place, conv = n("place"), n("conv_id")
    s1, s2 = _step_hashes(_words_of(t.column("digest")), place)
    k1, k2 = np.cumsum(s1) + n("h1").view(np.uint64), np.cumsum(s2) + n("h2").view(np.uint64)
    nothing = lambda kind: pa.nulls(len(place), kind)
    last = place == n("turns")
    return pa.Table.from_arrays(
        [
            _keys(k1, k2), _keys(k1 - s1, k2 - s2), pa.array(place), pa.array(conv), nothing(pa.int64()), pa.array(np.ones(len(place), np.int64)), pa.array(n("bytes")),
            nothing(pa.int64()), nothing(pa.int64()), nothing(pa.int64()), pa.array([str(c) if x else None for c, x in zip(conv.tolist(), last.tolist(), strict=True)], pa.string()), pa.array(np.ones(len(place), bool)),
        ],
        names=[c.split()[0] for c in NODES.split(", ")],
    )


def _long_nodes(rows: DataFrame, segment: int) -> DataFrame:
    """Nodes of the conversations of large families, one row for each conversation and depth, without gathering a conversation anywhere."""
    placed = ranked(rows, [F.col("conv_id"), F.col("turn"), F.col("digest")])  # nulls first
    convs = placed.groupBy("conv_id", "family").agg(F.min("place").alias("start"), F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST
    bases = convs.filter("conv_id = family").select("family", F.col("n").alias("of_base"))
    convs = staged(convs.join(bases, "family", "left").withColumn("h", h).withColumn("taken", F.least(F.col("h"), F.coalesce("of_base", F.lit(0)))).drop("of_base"), "long-conversations")
    own = spread_join(placed.select("conv_id", "place", "digest", "bytes"), convs, "conv_id", "place").withColumn("i", F.col("place") - F.col("start"))
    heads = own.filter(f"conv_id = family AND i < {MOST - 1}").select("family", "i", "digest", "bytes")
    lent = convs.join(heads, "family").filter("i < taken").select("conv_id", (F.col("i") + 1).alias("place"), "digest", "bytes", "n", "h", "taken")
    kept = own.filter("i >= h").select("conv_id", (F.col("i") - F.col("h") + F.col("taken") + 1).alias("place"), "digest", "bytes", "n", "h", "taken")
    rebuilt = lent.unionByName(kept).select("conv_id", "place", "digest", "bytes", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns"), F.floor(F.col("place") / segment).alias("segment"))
    rebuilt = staged(rebuilt, "long-turns")
    sums = rebuilt.select("conv_id", "segment", "place", "digest").mapInArrow(_segment_sums, "conv_id long, segment long, h1 long, h2 long")
    before = sums.groupBy("conv_id").applyInPandas(_starts, "conv_id long, segment long, h1 long, h2 long")
    nodes = rebuilt.join(before, ["conv_id", "segment"]).groupBy("conv_id", "segment").applyInArrow(_segment_nodes, NODES)
    none = lambda kind: F.lit(None).cast(kind)
    total = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    roots = convs.select(F.lit(_ROOT).alias("key"), none("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", none("long").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("last_bytes"), *[none("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")], F.when(total == 0, F.col("conv_id").cast("string")).alias("ends"), F.lit(True).alias("open"))
    return nodes.unionByName(roots)


def family_nodes(conversations: DataFrame, long: int = LONG, segment: int = SEGMENT) -> DataFrame:
    """Staged nodes of each family's trie (NODES); those of families of more than `long` rows come for each conversation, without sums and marked open."""
    rows = staged(turns(conversations), "turns")
    large = staged(rows.groupBy("family").agg(F.count("*").alias("n")).filter(F.col("n") > long), "large-families")
    some = not large.isEmpty()
    small = spread_join(rows, large, "family", "digest", "left_anti") if some else rows
    ordered = small.repartition("family").sortWithinPartitions("family", "conv_id", F.col("turn").asc_nulls_first(), "digest")
    nodes = ordered.select("family", "conv_id", "digest", "bytes").mapInArrow(_family_tries, NODES)
    if some:
        nodes = nodes.unionByName(_long_nodes(spread_join(rows, large, "family", "digest", "left_semi"), segment))
    return staged(nodes, "family-nodes")


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ids) in order of key and ids to (key, ends_sha256), a string at a time."""
    at, sha = None, None
    out: list[tuple[bytes, str]] = []
    for b in batches:
        for key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if key != at:
                if sha:
                    out.append((at, sha.hexdigest()))
                at, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.string()), strict=True)], names=["key", "sha"])
            out = []
    if sha:
        out.append((at, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.string()), strict=True)], names=["key", "sha"])


def _ends(nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """Staged (key, sha) of the shared nodes where conversations end: ids are joined in ranges of IDS numbers, the strings hashed in turn."""
    ending = nodes.filter("ends IS NOT NULL").select("key", "ends")
    some = staged(ending.groupBy("key").agg(F.count("*").alias("n")).join(shared.select("key"), "key", "left_semi"), "shared-ends")
    ids = spread_join(ending, some, "key", "ends").select("key", F.explode(F.split("ends", ",").cast("array<long>")).alias("conv_id"))
    strings = ids.groupBy("key", F.floor(F.col("conv_id") / IDS).alias("range")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    ordered = strings.repartition("key").sortWithinPartitions("key", "range").select("key", "ids")
    return staged(ordered.mapInArrow(_hashed_ids, "key binary, sha string"), "ends")


def _subtree_sums(shared: DataFrame, deepest: int) -> DataFrame:
    """shared with n_leaves and saved_tokens summed over each node's subtree of shared nodes, in log2(deepest) rounds of a grouped sum and two joins by key."""
    now = shared.select("key", F.col("parent").alias("up"), "depth", "n_leaves", "saved_tokens")
    step = 1
    while step <= deepest:
        given = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"), F.count("*").alias("n"))
        summed = now.join(given, "key", "left").select("key", "up", "depth", (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"), F.coalesce("n", F.lit(0)).alias("n"))
        summed = staged(summed, "subtree-sums")
        far = F.col("depth") >= 2 * step
        ahead = staged(summed.filter("n > 0").select(F.col("key").alias("up"), F.col("up").alias("further"), "n"), "jumps")
        moved = spread_join(summed.filter(far).drop("n"), ahead, "up", "key").select("key", F.col("further").alias("up"), "depth", "n_leaves", "saved_tokens")
        now = moved.unionByName(summed.filter(~far).select("key", F.lit(None).cast("binary").alias("up"), "depth", "n_leaves", "saved_tokens"))
        step *= 2
        if step <= deepest:
            now = staged(now, "subtree-rounds")
    return now.select("key", "n_leaves", "saved_tokens")


def prefix_trie(conversations: DataFrame, long: int = LONG, segment: int = SEGMENT) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation c takes the first crc32(c) % 9 turns of conversation
    c - c % 5 (signed remainder) and goes on with its own after as many. Turns
    are ordered by number, null first, and where numbers repeat by the hash of
    role and text. Null role or text is empty; rows without a conv_id belong
    to none; repeated rows are turns of their own. Conversations of no turn
    count at the root. An empty table has no node. Other columns are not read.
    """
    nodes = family_nodes(conversations, long, segment)
    most = lambda c: F.max(c).alias(c)
    merged = nodes.groupBy("key").agg(
        most("parent"), most("depth"), F.min("conv_id").alias("conv_id"), most("parent_conv_id"), F.sum("n_convs").alias("n_convs"), most("last_bytes"), most("n_children"), most("n_leaves"), most("saved_tokens"), most("ends"), (F.max("open") | (F.count("*") > 1)).alias("shared")
    )
    merged = staged(merged, "nodes")
    # what a shared node has from its children: their number, and the sums of those whose subtrees are complete
    closed = lambda c: F.sum(F.when(~F.col("shared"), F.col(c)).otherwise(0))
    below = merged.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("kids"), closed("n_leaves").alias("leaves"), closed("saved_tokens").alias("saved"))
    own = F.col("last_bytes") * (F.col("n_convs") - 1)
    shared = merged.filter("shared").drop("n_children", "n_leaves", "saved_tokens", "parent_conv_id", "ends", "shared").join(below, "key", "left")
    shared = staged(shared.select("key", "parent", "depth", "conv_id", "n_convs", F.coalesce("kids", F.lit(0)).alias("n_children"), F.when(F.col("kids").isNull(), 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"), (own + F.coalesce("saved", F.lit(0))).alias("saved_tokens")), "shared-nodes")
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    sums = _subtree_sums(shared, deepest)
    parents = staged(shared.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("of_parent"), F.col("n_children").alias("n")), "parents")
    nobody = F.lit(hashlib.sha256().hexdigest())
    rest = spread_join(merged.filter("NOT shared"), parents, "parent", "key", "left").select("conv_id", "depth", F.coalesce("of_parent", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.sha2(F.coalesce("ends", F.lit("")), 256).alias("ends_sha256"))
    whole = shared.drop("n_leaves", "saved_tokens").join(sums, "key").join(_ends(nodes, shared), "key", "left")
    whole = spread_join(whole, parents, "parent", "key", "left").select("conv_id", "depth", F.col("of_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", nobody).alias("ends_sha256"))
    return rest.unionByName(whole)
