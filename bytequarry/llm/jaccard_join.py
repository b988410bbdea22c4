"""N-gram Jaccard join by chosen paths.

The set of a text is that of its WORDS-word sequences. It is embedded as SLOTS
minhash tokens (slot, value), so that sets of Jaccard similarity s share a
share s of them. A run starts with all sets in one node. Each node samples
tokens by a hash of its path, each with chance 1 / (threshold * SLOTS); a set
goes to the child of each sampled token it holds. A pair at the threshold thus
stays together in one child on average, while pairs below it thin out. Nodes of
at most BUCKET sets are compared by brute force; larger ones are split on. A
child with half of its parent's sets or more is dense: its sets are alike, so
splitting it would not part them, and it is compared by brute force, in pairs
of blocks. Runs are repeated until a pair at the threshold shares a leaf with
the chance asked for, at the depth that the splitting reached.

A pair counts in the least leaf that it shares, so nothing has to be gathered
to find repeats of a pair, and pairs are never listed: a leaf gives counts of
links and the edges of a spanning forest. Sketches of a byte a slot drop most
pairs before the sets themselves are compared. Copies of a text are one set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_of, fits, marked, numbered, spread_join, staged, text_of
from .components import components
from .wordhash import _ranges, blocks, mix, ngram_hashes, words

WORDS = 5
THRESHOLD = 0.8
SLOTS = 64
#: Sets that are compared by brute force in one task.
BUCKET = 512
TARGET_RECALL = 0.999
#: Levels at which splitting ends; what is still large is compared in blocks.
DEEPEST = 8
#: Standard deviations by which a sketch may fall short of the threshold.
SLACK = 4.0


def shingle_sets(texts: list[bytes], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' word n-grams, first index of each text's): a text of fewer words is one n-gram, one without words none."""
    w = words(texts)
    h = ngram_hashes(w.hash, n)
    full = np.flatnonzero(w.doc[: len(h)] == w.doc[n - 1 :]) if len(h) else np.zeros(0, np.int64)
    size = np.diff(w.doc_first)
    short = np.flatnonzero((size > 0) & (size < n))
    owner = np.concatenate([w.doc[full], short])
    value = np.concatenate([h[full], mix(_ranges(w.hash, w.doc_first[short], w.doc_first[short + 1], 1))])
    order = np.argsort(owner, kind="stable")
    return value[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n], x[n:] | np.uint64(1)


def signatures(texts: list[bytes]) -> list[bytes | None]:
    """SLOTS minhashes (little-endian 32 bits) of each text's set; None without words."""
    out: list[bytes | None] = []
    flip, times = _seeds(SLOTS)
    for i, j in blocks(texts):
        value, first = shingle_sets(texts[i:j])
        some = np.flatnonzero(np.diff(first))
        sig = np.zeros((j - i, SLOTS), "<u4")
        if len(some):
            for s in range(SLOTS):
                sig[some, s] = np.minimum.reduceat((value ^ flip[s]) * times[s], first[some]) >> np.uint64(32)
        has = np.diff(first) > 0
        out += [sig[d].tobytes() if has[d] else None for d in range(j - i)]
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(signatures(b.column(2).to_pylist()), pa.binary())], names=["doc_id", "tid", "sig"])


def runs_needed(recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold shares a leaf at this depth with the chance `recall`."""
    stays = 1.0
    for _ in range(depth):
        stays = 1 - math.exp(-stays)
    return math.ceil(math.log(1 - recall) / math.log(1 - stays))


def _paths(threshold: float, runs: range | None):
    """Rows (uid, sig, parent): the children that each set goes to; for the first level the runs are the parents."""
    chance = np.uint64(int((1 << 64) / (threshold * SLOTS)))
    slot = mix(np.arange(1, SLOTS + 1, dtype=np.uint64) << np.uint64(33))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u4").reshape(-1, SLOTS).astype(np.uint64)
            token = mix(sig ^ slot)
            uid = b.column("uid").to_numpy()
            parents = [mix(np.full(len(uid), r + 1, np.uint64)) for r in runs] if runs is not None else [b.column("bucket").to_numpy().view(np.uint64)]
            for parent in parents:
                key = mix(token ^ mix(parent)[:, None])
                row, col = np.nonzero(key < chance)
                child = mix(key[row, col] ^ parent[row]).view(np.int64)
                cols = [pa.array(child), pa.array(uid[row])]
                names = ["bucket", "uid"]
                if runs is None:
                    cols, names = [*cols, b.column("n").take(pa.array(row))], [*names, "above"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _leaves(texts: DataFrame, threshold: float, runs: range, limit: int) -> tuple[DataFrame, DataFrame, int]:
    """(leaves (bucket, uid, n), texts that were in a node too large at the first level, levels)."""
    signed = texts.select("uid", "sig")
    level = staged(signed.mapInArrow(_paths(threshold, runs), "bucket long, uid long"), "paths").distinct()
    depth, leaves, crowded = 1, None, None
    while True:
        sized = staged(_sized(level, "node"), "nodes")
        dense = F.lit(False) if depth == 1 else F.col("n") * 2 >= F.col("above")
        ends = (F.col("n") <= limit) | dense | F.lit(depth >= DEEPEST)
        leaf = sized.filter(ends).select("bucket", "uid", "n")
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        large = sized.filter(~ends).select("bucket", "uid", "n")
        if depth == 1:
            crowded = large.select("uid").distinct()
        if large.isEmpty():
            return leaves, crowded, depth
        depth += 1
        level = staged(large.join(signed, "uid").mapInArrow(_paths(threshold, None), "bucket long, uid long, above long"), "paths").groupBy("bucket", "uid").agg(F.max("above").alias("above"))


def _sized(rows: DataFrame, name: str) -> DataFrame:
    """rows (bucket, uid, ...) of the buckets that hold more than one, with the bucket's count n; a bucket of any size is spread."""
    counts = staged(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), f"{name}-counts")
    return spread_join(rows, counts, "bucket", "uid")


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """rows (bucket, uid, ...) with their count n in the bucket, dealt to pairs of blocks: (bucket, i, j, own, ...), sorted by them."""
    parts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("uid"), parts).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "n")
    return dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "uid")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows of one (bucket, i, j)."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy() for c in ("bucket", "i", "j")]
        cut = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in cols], axis=0)))
        for a, z in zip(cut, np.append(cut[1:], b.num_rows), strict=True):
            now = tuple(int(c[a]) for c in cols)
            if now != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(b.slice(a, z - a))
    if held:
        yield key, pa.Table.from_batches(held)


def _met_before(leaves: pa.ChunkedArray, bucket: int) -> np.ndarray:
    """(rows, rows): whether two rows share a leaf less than this one, where they are compared instead."""
    lists = leaves.combine_chunks()
    value, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
    n = len(lists)
    row = np.repeat(np.arange(n), np.diff(ends, prepend=0))
    before = value < bucket
    value, row = value[before], row[before]
    _, column, times = np.unique(value, return_inverse=True, return_counts=True)
    shared = times > 1
    keep = shared[column]
    column, row = (np.cumsum(shared) - 1)[column[keep]], row[keep]
    met = np.zeros((n, n), bool)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for at in range(0, int(shared.sum()), 2048):
        lo, hi = np.searchsorted(column, [at, at + 2048])
        part = np.zeros((n, 2048), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        met |= part @ part.T > 0
    return met


def _pairs(key: tuple, t: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group's rows whose sketches agree in `least` slots and whose least common leaf this is."""
    bucket, i, j = key
    n = t.num_rows
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(n, SLOTS)
    own = t.column("own").to_numpy()
    here = ~_met_before(t.column("leaves"), bucket)
    if i != j:
        here &= own[:, None] != own
    left, right = [], []
    for a in range(n - 1):
        others = np.flatnonzero(here[a, a + 1 :]) + a + 1
        if len(others):
            alike = others[(sketch[others] == sketch[a]).sum(axis=1) >= least]
            left.append(np.full(len(alike), a, np.int64))
            right.append(alike)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _least_matches(threshold: float) -> int:
    return max(1, math.floor(SLOTS * threshold - SLACK * math.sqrt(SLOTS * threshold * (1 - threshold))))


def _candidates(threshold: float):
    """The sets that a leaf has a pair to verify for: (bucket, uid)."""
    least = _least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, uids = [], []
        for key, t in _groups(batches):
            a, b = _pairs(key, t, least)
            if len(a):
                found = t.column("uid").to_numpy()[np.unique(np.concatenate([a, b]))]
                uids.append(found)
                buckets.append(np.full(len(found), key[0], np.int64))
            if len(uids) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets)), pa.array(np.concatenate(uids))], names=["bucket", "uid"])
                buckets, uids = [], []
        if uids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets)), pa.array(np.concatenate(uids))], names=["bucket", "uid"])

    return run


def common_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Size of the intersection of sets[a] and sets[b] for each pair; sets are sorted and distinct."""
    n = np.array([len(s) for s in sets])
    whole = np.concatenate(sets)
    values, where, times = np.unique(whole, return_inverse=True, return_counts=True)
    shared = times > 1
    width = int(shared.sum())
    if len(a) * (15e-6 + float(n[a].mean() + n[b].mean()) * 30e-9) < len(sets) ** 2 * width / 5e9:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    column = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(sets)), n)
    keep = shared[where]
    col, owner = column[where[keep]], owner[keep]
    total = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    for at in range(0, width, 4096):
        lo, hi = np.searchsorted(col, [at, at + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[lo:hi], col[lo:hi] - at] = 1
        total += part @ part.T
    return total[a, b].astype(np.int64)


def _verify(threshold: float):
    """Per leaf: (uid, links, to): links found for a set, and its edges to the least set of its part of the leaf."""
    least = _least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t in _groups(batches):
            a, b = _pairs(key, t, least)
            if not len(a):
                continue
            texts, sets = t.column("text").to_pylist(), []
            for i, j in blocks(texts):
                value, first = shingle_sets(texts[i:j])
                sets += [np.unique(value[x:y]) for x, y in zip(first[:-1], first[1:], strict=True)]
            size = np.array([len(s) for s in sets])
            near = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
            a, b = a[near], b[near]
            if not len(a):
                continue
            common = common_counts(sets, a, b)
            linked = common >= threshold * (size[a] + size[b] - common) - 1e-9
            a, b = a[linked], b[linked]
            if not len(a):
                continue
            uid, mult = t.column("uid").to_numpy(), t.column("mult").to_numpy()
            links = np.zeros(len(uid), np.int64)
            np.add.at(links, a, mult[b])
            np.add.at(links, b, mult[a])
            root = np.arange(len(uid))
            while True:  # the least row of each part, for rows are sorted by uid
                low = np.minimum(root[a], root[b])
                old = root.copy()
                np.minimum.at(root, a, low)
                np.minimum.at(root, b, low)
                root = root[root]
                if (root == old).all():
                    break
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(uid[at]), pa.array(links[at]), pa.array(uid[root[at]])], names=["uid", "links", "to"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = TARGET_RECALL, bucket: int = BUCKET) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links.

    Two rows are linked when the sets of WORDS-word sequences of their lower
    case texts (words: runs of bytes other than space and 0x09-0x0D) have a
    Jaccard similarity of `threshold` or more; links are verified on the sets.
    A text of fewer than WORDS words is one sequence. n_links counts a row's
    links to other rows, copies too; class_id is the least id of its connected
    part (nulls don't count; a part of null ids alone has a null class). A
    text without words, or null, has no links and is a class of its own.
    An empty table gives an empty result. Other columns are not read.
    """
    sha = F.substring(F.unhex(F.sha2("text", 256)), 1, 16)
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    lower = F.encode(F.lower("text"), "UTF-8")
    signed = staged(raw.select("doc_id", sha.alias("tid"), lower.alias("text")).mapInArrow(_sign, "doc_id long, tid binary, sig binary"), "signatures")
    grouped = signed.filter("sig IS NOT NULL").groupBy("tid").agg(F.first("sig").alias("sig"), F.count("*").alias("mult"))
    texts = staged(grouped.withColumn("uid", F.monotonically_increasing_id()), "texts")

    runs = runs_needed(recall, 1)
    leaves, crowded, depth = _leaves(texts, threshold, range(runs), bucket)
    while runs_needed(recall, depth) > runs:  # deeper splitting parts more pairs: the sets it held get more runs
        more = range(runs, runs_needed(recall, depth))
        crowd = texts.join(staged(crowded, "crowded"), "uid", "left_semi")
        leaves_2, crowded, depth_2 = _leaves(crowd, threshold, more, bucket)
        leaves, runs, depth = leaves.unionByName(leaves_2), more.stop, max(depth, depth_2)

    leaves = staged(leaves, "leaves")
    lists = leaves.groupBy("uid").agg(F.collect_set("bucket").alias("leaves"))
    sketch = F.unhex(F.regexp_replace(F.hex("sig"), "(..)......", "$1"))
    known = staged(texts.join(lists, "uid").select("uid", "tid", "mult", sketch.alias("sketch"), "leaves"), "sketches")
    dealt = _in_blocks(leaves.join(known.select("uid", "sketch", "leaves"), "uid"), bucket)
    found = staged(dealt.mapInArrow(_candidates(threshold), "bucket long, uid long").distinct(), "candidates")

    wanted = staged(known.join(found.select("uid").distinct(), "uid", "left_semi").select("tid", "mult"), "candidate-texts")
    whole = _wanted_texts(raw, wanted, sha).select("tid", lower.alias("text")).groupBy("tid").agg(F.first("text").alias("text"))
    whole = staged(known.join(whole, "tid").drop("tid"), "candidate-sets")
    verified = staged(_in_blocks(_sized(found, "candidate").join(whole, "uid"), bucket).mapInArrow(_verify(threshold), "uid long, links long, to long"), "links")

    links = verified.groupBy("uid").agg(F.sum("links").alias("links"))
    parts = components(verified.select(F.col("uid").alias("a"), F.col("to").alias("b"))).select(F.col("node").alias("uid"), "component")
    named = texts.select("uid", "tid", "mult").join(parts, "uid", "left").join(links, "uid", "left")
    named = staged(named.select("tid", "mult", F.coalesce("component", "uid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links")), "named-texts")
    rows = staged(spread_join(signed.filter("sig IS NOT NULL").select("doc_id", "tid"), named, "tid", "doc_id", rows="mult").select("doc_id", "component", "n_links"), "classed")
    classes = staged(rows.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")), "classes")
    some = spread_join(rows, classes, "component", "doc_id").select("doc_id", "class_id", "n_links")
    none = signed.filter("sig IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return some.unionByName(none)


def _wanted_texts(raw: DataFrame, wanted: DataFrame, sha: Column) -> DataFrame:
    """(tid, text) of the texts wanted. Where they don't fit a broadcast, a staged copy is numbered, one row of each text is chosen by its number, and only that moves."""
    if fits(wanted):
        return raw.select(sha.alias("tid"), "text").join(F.broadcast(wanted), "tid", "left_semi")
    copy = staged(raw.select(F.monotonically_increasing_id().alias("uid"), "text"), "held-texts")
    named = copy.select("uid", sha.alias("tid"))
    firsts = spread_join(named, wanted, "tid", "uid", "left_semi", "mult").groupBy("tid").agg(F.min("uid").alias("uid"))
    return marked(copy, staged(firsts.select("uid", "tid"), "wanted-rows")).filter("tid IS NOT NULL").select("tid", "text")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their own columns, of each class only the row with the least id.

    Of rows that repeat the least id one stays; a null id is larger than any
    other. Null, empty and wordless texts are near no other and stay; an empty
    table gives an empty one. The rows are numbered in a staged copy, so names of docs' columns
    can't clash with any.
    """
    held = numbered(docs, "numbered-documents")
    classed = near_duplicates(held.select("uid", column_of("row", text_col).alias("text")), "uid", "text")
    rows = held.select("uid", column_of("row", id_col).alias("id")).join(classed.filter("n_links > 0").select(F.col("doc_id").alias("uid"), "class_id"), "uid")
    rows = staged(rows, "near-duplicates")
    stays = rows.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("uid"))).alias("first")).select(F.col("first.uid").alias("uid"))
    return marked(held, staged(rows.select("uid").join(stays, "uid", "left_anti"), "near-duplicates-gone"), "left_anti").select("row.*")
