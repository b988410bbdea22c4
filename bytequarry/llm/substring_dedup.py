"""Substring dedup: suffix automata of reference shards, documents streamed for matching statistics.

A window of WINDOW consecutive words is redundant when the same words also
start earlier; every word of a redundant window is removed.

Shards by content. Every window has an anchor: the least hash among its
GRAM-word sequences. Equal windows have equal anchors, so a window can only
repeat if its anchor occurs twice, which the Golomb-coded fingerprint exchange
of exact_dedup finds out for a few bytes an anchor. All occurrences of an
anchor go to the shard of the document where it occurs first. A shard streams
its spans in order through an automaton of the earlier ones, takes the maximal
spans whose matching statistics reach WINDOW as redundant, and adds only what
is new. So a document meets the automata of the shards that hold something of
it, not those of the whole corpus, and no automaton is larger than what
HOT occurrences of the anchors in SHARD_BYTES of text bring.

Anchors with more than HOT occurrences (a passage that a third of all
documents share) would make a shard without bound. Their windows are grouped
by a 128-bit hash instead, with partial aggregates in each task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, staged, text_of
from .exact_dedup import CHUNK, FINGERPRINT_BITS, PER_OWNER, _answer, golomb_decode, golomb_encode
from .suffix_automaton import SuffixAutomaton
from .wordhash import blocks, mix, ngram_hashes, sliding, words

WINDOW = 20
GRAM = 6
#: Occurrences up to which an anchor's windows go to an automaton.
HOT = 256
#: Bytes of a document whose anchors share a shard; a longer one has several shards.
SHARD_BYTES = 1 << 16

_NONE = np.uint64((1 << 64) - 1)


def _anchors(w, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(for each window its anchor's hash, whether it lies in one document, whether each gram is an anchor)."""
    h = ngram_hashes(w.hash, gram)
    if len(w.hash) < window:
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(len(h), bool)
    wide = window - gram + 1
    least = sliding(h, wide, np.minimum)
    valid = w.doc[: len(least)] == w.doc[window - 1 :]
    # a gram is an anchor if some valid window that covers it has no lesser one
    edge = np.zeros(wide - 1, np.uint64)
    most = sliding(np.concatenate([edge, np.where(valid, least, np.uint64(0)), edge]), wide, np.maximum)
    return least, valid, most == h


def _list_anchors(shift: int, window: int, gram: int):
    """Per partition: Golomb-coded anchor fingerprints for each owner, with the rows that hold them, packed beside."""
    drop = np.uint64(64 - FINGERPRINT_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, uids = [], []
        for b in batches:
            texts, ids = b.column(1).to_pylist(), b.column(0).to_numpy()
            for i, j in blocks(texts):
                w = words(texts[i:j])
                _, _, is_anchor = _anchors(w, window, gram)
                at = np.flatnonzero(is_anchor)
                fps.append((ngram_hashes(w.hash, gram)[at] >> drop).astype(np.int64))
                uids.append(ids[i:j][w.doc[at]])
        if not fps or not sum(map(len, fps)):
            return
        fp, uid = np.concatenate(fps), np.concatenate(uids)
        order = np.lexsort((uid, fp))
        fp, uid = fp[order], uid[order]
        values, first, times = np.unique(fp, return_index=True, return_counts=True)
        src, owners, out = TaskContext.get().partitionId(), values >> shift, []
        cuts = np.flatnonzero(np.diff(owners, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(values)], strict=True):
            for chunk, i in enumerate(range(a, b, CHUNK)):
                j = min(b, i + CHUNK)
                base, k, unary, low = golomb_encode(values[i:j])
                rows = uid[first[i] : first[j - 1] + times[j - 1]]
                out.append((src, int(owners[a]), chunk, j - i, base, k, unary, low, np.packbits(times[i:j] > 1).tobytes(), zlib.compress(times[i:j].astype("<u4").tobytes(), 1), zlib.compress(rows.astype("<i8").tobytes(), 1)))
        names = ["src", "owner", "chunk", "n", "base", "k", "unary", "low", "twice", "times", "rows"]
        types = [pa.int32()] * 4 + [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        for i in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 64], strict=True), types, strict=True)], names=names)

    return run


def _rows_told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per source: (fingerprint, row, times) of the anchors that the owners' bitmaps mark. A row lies in one source, so each pair comes once."""
    for lists in batches:
        for r in lists.itertuples():
            keep = np.unpackbits(np.frombuffer(r.bitmap, np.uint8))[: r.n] > 0
            times = np.frombuffer(zlib.decompress(r.times), "<u4").astype(np.int64)
            values = np.repeat(golomb_decode(r.n, r.base, r.k, r.unary, r.low), times)
            rows = np.frombuffer(zlib.decompress(r.rows), "<i8")
            keep = np.repeat(keep, times)
            values, rows = values[keep], rows[keep]
            # both are sorted, rows within their values
            first = np.flatnonzero(np.append(True, (values[1:] != values[:-1]) | (rows[1:] != rows[:-1]))) if len(rows) else np.zeros(0, np.int64)
            yield pd.DataFrame({"fp": values[first], "uid": rows[first], "times": np.diff(np.append(first, len(rows)))})


def _route(window: int, gram: int):
    """Per document with repeated anchors: its spans for the shards, and its windows with hot anchors."""
    drop = np.uint64(64 - FINGERPRINT_BITS)
    names = ["shard", "doc_id", "uid", "start", "words", "h1", "h2", "n"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def put(out: list[list], *columns: list) -> None:
        for col, v in zip(out, columns, strict=True):
            col.extend(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 32):
                b = whole.slice(i, 32)
                out: list[list] = [[] for _ in names]
                texts = b.column("text").to_pylist()
                for d in range(b.num_rows):
                    doc_id, uid = b.column("doc_id")[d].as_py(), b.column("uid")[d].as_py()
                    found = b.column("anchors")[d].values
                    fps, shards = found.field("fp").to_numpy(), found.field("shard").to_numpy(zero_copy_only=False)
                    order = np.argsort(fps)
                    fps, shards = fps[order], shards[order]
                    w = words([texts[d]])
                    least, _, _ = _anchors(w, window, gram)
                    fp = (least >> drop).astype(np.int64)
                    at = np.minimum(np.searchsorted(fps, fp), len(fps) - 1)
                    known = np.flatnonzero(fps[at] == fp)
                    shard = shards[at[known]]
                    # shard -1: a hot anchor, whose windows go one by one
                    hot = known[shard == -1]
                    if len(hot):
                        h1 = ngram_hashes(w.hash, window)[hot]
                        h2 = ngram_hashes(mix(w.hash), window)[hot]
                        # a window that the document repeats is asked for once; the runs of all of them go along
                        once = np.unique(h1 ^ (h2 * np.uint64(3)), return_index=True)[1]
                        k = len(once)
                        put(out, [None] * k, [doc_id] * k, [uid] * k, hot[once].tolist(), [None] * k, h1[once].astype(np.int64).tolist(), h2[once].astype(np.int64).tolist(), [None] * k)
                        cut = np.flatnonzero(np.append(True, hot[1:] > hot[:-1] + 1))
                        k, ends = len(cut), np.append(cut[1:], len(hot))
                        put(out, [None] * k, [doc_id] * k, [uid] * k, hot[cut].tolist(), [None] * k, [None] * k, [None] * k, (ends - cut).tolist())
                    cold, shard = known[shard >= 0], shard[shard >= 0]
                    if not len(cold):
                        continue
                    order = np.lexsort((cold, shard))
                    cold, shard = cold[order], shard[order]
                    cut = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (cold[1:] > cold[:-1] + 1)))
                    last = np.append(cut[1:], len(cold)) - 1
                    ids = (w.hash >> np.uint64(1)).astype("<i8")
                    for a, z in zip(cut, last, strict=True):
                        put(out, [int(shard[a])], [doc_id], [uid], [int(cold[a])], [ids[cold[a] : cold[z] + window].tobytes()], [None], [None], [None])
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return run


class _Shard:
    """Spans of one shard, in order, against an automaton of what came before."""

    def __init__(self, window: int) -> None:
        self.window, self.automaton = window, SuffixAutomaton()

    def redundant(self, ids: list[int]) -> list[int]:
        """The windows (by their starts) of a span that also start earlier; the span is known from then on."""
        k, sam = self.window, self.automaton
        ends = sam.match(ids) if sam.last else [0] * len(ids)
        gone = {e - k + 1 for e, n in enumerate(ends) if n >= k}
        new = [s for s in range(len(ids) - k + 1) if s not in gone]
        i = 0
        while i < len(new):
            j = i
            while j + 1 < len(new) and new[j + 1] <= new[j] + k:
                j += 1
            first = new[i]
            for e, n in enumerate(sam.add(ids[first : new[j] + k])):
                if n >= k:
                    gone.add(first + e - k + 1)
            i = j + 1
        return sorted(gone)


def _stream(window: int):
    """Rows sorted by (shard, doc_id, uid, start): the starts of redundant windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, state = None, None
        for b in batches:
            uids, starts = [], []
            for s, uid, start, data in zip(*(b.column(c).to_pylist() for c in ("shard", "uid", "start", "words")), strict=True):
                if s != shard:
                    shard, state = s, _Shard(window)
                gone = state.redundant(np.frombuffer(data, "<i8").tolist())
                # runs of starts: (first, number)
                if gone:
                    g = np.array(gone) + start
                    cut = np.flatnonzero(np.append(True, g[1:] > g[:-1] + 1))
                    uids += [uid] * len(cut)
                    starts += [{"first": int(g[a]), "n": int(z - a)} for a, z in zip(cut, np.append(cut[1:], len(g)), strict=True)]
            if uids:
                yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array([x["first"] for x in starts], pa.int64()), pa.array([x["n"] for x in starts], pa.int64())], names=["uid", "first", "n"])

    return run


def redundant_windows(texts: DataFrame, rows: int, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(uid, first, n): runs of n consecutive windows from word `first` on that also start earlier, less the windows at `first` of rows with n = 0. texts: (doc_id, uid, parts, text)."""
    owners = 6
    while (1 << owners) * PER_OWNER < rows * 64 and owners < 24:
        owners += 1
    schema = "src int, owner int, chunk int, n int, base long, k int, unary binary, low binary, twice binary, times binary, rows binary"
    listed = texts.select("uid", F.encode("text", "UTF-8").alias("text"))
    sent = staged(listed.mapInArrow(_list_anchors(FINGERPRINT_BITS - owners, window, gram), schema), "anchor-lists")
    to_owner = sent.select("src", "owner", "chunk", "n", "base", "k", "unary", "low", "twice")
    answers = staged(to_owner.groupBy("owner").applyInPandas(_answer, "src int, owner int, chunk int, bitmap binary"), "anchor-answers")
    told = staged(sent.join(answers, ["src", "owner", "chunk"]).mapInPandas(_rows_told, "fp long, uid long, times long"), "repeated-anchors")

    # an anchor's shard is the document in which it occurs first: a row's number stands for it
    named = told.join(texts.select("doc_id", "uid", "parts"), "uid")
    homes = named.groupBy("fp").agg(F.sum("times").alias("n"), F.min(F.struct("doc_id", "uid", "parts")).alias("home"))
    # a very long document has several shards: a window has one anchor, so it meets its like in any case
    several = F.shiftrightunsigned(F.xxhash64("home.uid", F.pmod(F.xxhash64("fp"), F.col("home.parts"))), 1)
    shard = F.when(F.col("n") > HOT, F.lit(-1).cast("long")).when(F.col("home.parts") > 1, several).otherwise(F.col("home.uid"))
    homes = staged(homes.select("fp", "n", shard.alias("shard")), "anchor-shards")
    anchors = staged(spread_join(told.select("fp", "uid"), homes, "fp", "uid").groupBy("uid").agg(F.collect_list(F.struct("fp", "shard")).alias("anchors")), "document-anchors")
    routes = texts.withColumn("text", F.encode("text", "UTF-8")).join(anchors, "uid").select("doc_id", "uid", "text", "anchors")
    routed = staged(routes.mapInArrow(_route(window, gram), "shard long, doc_id long, uid long, start long, words binary, h1 long, h2 long, n long"), "routed-spans")

    spans = routed.filter("shard IS NOT NULL").select("shard", "doc_id", "uid", "start", "words")
    in_order = spans.repartition("shard").sortWithinPartitions("shard", "doc_id", "uid", "start")
    cold = in_order.mapInArrow(_stream(window), "uid long, first long, n long")

    # of a hot window all occurrences are redundant but the earliest, so one row for each distinct window says all; n = 0 marks it
    runs = routed.filter("n IS NOT NULL").select("uid", F.col("start").alias("first"), "n")
    earliest = routed.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "uid", "start")).alias("at"))
    stays = earliest.select(F.col("at.uid").alias("uid"), F.col("at.start").alias("first"), F.lit(0).cast("long").alias("n"))
    return staged(cold.unionByName(runs).unionByName(stays), "redundant-windows")


def _strip(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, gone, kept = [], [], []
            texts, runs = b.column("text").to_pylist(), b.column("runs")
            for i, j in blocks(texts):
                w = words(texts[i:j])
                for d in range(j - i):
                    lo, hi = int(w.doc_first[d]), int(w.doc_first[d + 1])
                    gone_at = np.zeros(hi - lo + 1, np.int64)
                    if runs[i + d].is_valid:
                        first, n = (runs[i + d].values.field(c).to_numpy() for c in ("first", "n"))
                        for f, k in zip(first[n > 0].tolist(), n[n > 0].tolist(), strict=True):
                            gone_at[f : f + k] = 1
                        gone_at[first[n == 0]] = 0
                        at = np.flatnonzero(gone_at)
                        gone_at[:] = 0
                        gone_at[at] = 1
                        gone_at[at + window] -= 1
                    left = np.flatnonzero(np.cumsum(gone_at)[:-1] == 0) + lo
                    counts.append(hi - lo)
                    gone.append(hi - lo - len(left))
                    kept.append(b" ".join([w.data[x:y] for x, y in zip(w.begin[left].tolist(), w.end[left].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array([k.decode() for k in kept], pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return run


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text, kept_sha256.

    Words are runs of bytes other than space and 0x09-0x0D, unchanged; a null
    text has none. Windows are judged on the input. Of equal windows the one
    with the smaller doc_id, or the earlier start, stays; a null id is smaller
    than any other, and rows that repeat an id stand in the order in which they were numbered.
    kept_text joins the kept words by one space. Texts of fewer than `window`
    words come out whole. An empty table gives an empty result. Other columns
    are not read.
    """
    parts = F.ceil((F.octet_length(text_of(text_col)) + 1) / SHARD_BYTES)
    texts = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), parts.alias("parts"), text_of(text_col).alias("text")), "numbered-texts")
    runs = redundant_windows(texts, texts.count(), window)
    by_row = staged(runs.groupBy("uid").agg(F.collect_list(F.struct("first", "n")).alias("runs")), "document-runs")
    joined = texts.withColumn("text", F.encode("text", "UTF-8")).join(by_row, "uid", "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(_strip(window), "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
