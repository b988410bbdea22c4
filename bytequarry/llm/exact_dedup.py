"""Exact dedup by a Golomb-coded fingerprint exchange.

Every source partition sends each owner of a fingerprint range the sorted
distinct fingerprints it holds, Golomb-Rice coded. The owner answers every
source with a bitmap over its list (1: also held elsewhere, or twice there).
Only rows whose fingerprint got a 1 have their text shuffled, where equal
bytes are grouped; a fingerprint collision thus never drops a row.

What moves: about 30 bits for each distinct fingerprint and source, one bit
back, and the texts of suspects. A text that a third of all rows share is one
fingerprint from each source and one partial aggregate from each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, fits, marked, numbered, spread_join, staged, text_of

#: Bits of a fingerprint. N rows give about N * N / 2**49 false suspects, which the byte check clears.
FINGERPRINT_BITS = 48
#: Fingerprints in one coded list; longer lists are cut into chunks.
CHUNK = 1 << 18
#: Fingerprints that an owner is meant to hold.
PER_OWNER = 1 << 18
#: Rows that a source is meant to have, so that its lists don't grow short as owners grow many.
PER_SOURCE = 1 << 21
#: Lists that hold a fingerprint, beyond which its texts are dealt to several tasks.
LISTS = 8

PAYLOAD = "src int, owner int, chunk int, n int, base long, k int, unary binary, low binary, twice binary"


def golomb_encode(values: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """Sorted distinct values as (first value, k, unary quotients, k-bit remainders) of their gaps."""
    gaps = np.diff(values.astype(np.int64))
    if not len(gaps):
        return int(values[0]), 0, b"", b""
    k = max(0, int(np.log2(max(1.0, gaps.mean()))))
    ends = np.cumsum((gaps >> k) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    low = ((gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1).astype(np.uint8) if k else np.zeros(0, np.uint8)
    return int(values[0]), k, np.packbits(unary).tobytes(), np.packbits(low).tobytes()


def golomb_decode(n: int, base: int, k: int, unary: bytes, low: bytes) -> np.ndarray:
    """The n values that golomb_encode was given."""
    out = np.full(n, base, np.int64)
    if n > 1:
        ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[: n - 1]
        gaps = (np.diff(ends, prepend=-1) - 1) << k
        if k:
            bits = np.unpackbits(np.frombuffer(low, np.uint8))[: (n - 1) * k].reshape(n - 1, k)
            gaps = gaps + bits.astype(np.int64) @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64))
        out[1:] += np.cumsum(gaps)
    return out


def _send(shift: int):
    """Per source partition: its sorted distinct fingerprints, coded for each owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy(zero_copy_only=False) for b in batches if b.num_rows]
        if not held:
            return
        values, times = np.unique(np.concatenate(held), return_counts=True)
        src, rows = TaskContext.get().partitionId(), []
        owners = values >> shift
        cuts = np.flatnonzero(np.diff(owners, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(values)], strict=True):
            for chunk, i in enumerate(range(a, b, CHUNK)):
                j = min(b, i + CHUNK)
                base, k, unary, low = golomb_encode(values[i:j])
                rows.append((src, int(owners[a]), chunk, j - i, base, k, unary, low, np.packbits(times[i:j] > 1).tobytes()))
        names = [c.split()[0] for c in PAYLOAD.split(", ")]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        for i in range(0, len(rows), 512):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 512], strict=True), types, strict=True)], names=names)

    return run


def _answer(lists: pd.DataFrame) -> pd.DataFrame:
    """Per owner: for each list it got, a bitmap of the fingerprints that some other list, or the same source twice, holds."""
    values = [golomb_decode(r.n, r.base, r.k, r.unary, r.low) for r in lists.itertuples()]
    twice = [np.unpackbits(np.frombuffer(r.twice, np.uint8))[: r.n] for r in lists.itertuples()]
    known, where = np.unique(np.concatenate(values), return_inverse=True)
    times = np.bincount(where, minlength=len(known)) + np.bincount(where, weights=np.concatenate(twice), minlength=len(known))
    hit, at, out = (times > 1)[where], 0, []
    for v in values:
        out.append(np.packbits(hit[at : at + len(v)]).tobytes() if hit[at : at + len(v)].any() else None)
        at += len(v)
    return lists[["src", "owner", "chunk"]].assign(bitmap=out).dropna()


def _suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per source: the fingerprints of its own lists that the answers mark."""
    for lists in batches:
        found = [golomb_decode(r.n, r.base, r.k, r.unary, r.low)[np.unpackbits(np.frombuffer(r.bitmap, np.uint8))[: r.n] > 0] for r in lists.itertuples()]
        if found:
            yield pd.DataFrame({"fp": np.unique(np.concatenate(found))})


def suspects(fingerprints: DataFrame, rows: int, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """Staged table (fp, n) of the fingerprints that more than one row holds, by the exchange; n: lists that hold it. fingerprints: one column fp of `bits` bits."""
    owners = 4
    while (1 << owners) * PER_OWNER < rows and owners < 24:
        owners += 1
    # few sources with long lists: neighbouring partitions share a source, without an exchange
    sources = max(fingerprints.sparkSession.sparkContext.defaultParallelism, -(-rows // PER_SOURCE))
    sent = staged(fingerprints.coalesce(sources).mapInArrow(_send(bits - owners), PAYLOAD), "fingerprint-lists")
    answers = sent.groupBy("owner").applyInPandas(_answer, "src int, owner int, chunk int, bitmap binary")
    told = sent.join(answers, ["src", "owner", "chunk"]).mapInPandas(_suspects, "fp long")
    return staged(told.groupBy("fp").agg(F.count("*").alias("n")), "suspect-fingerprints")


def _judged(texts: DataFrame, held: bool = False) -> DataFrame:
    """(uid, doc_id, keep_id, group_size, kept, text_sha256) of (uid, doc_id, text). Only its own staged table is read for uid, so texts may number its rows anew each time, unless they are held: staged with their numbers."""
    sha = F.sha2("text", 256)
    fp = F.conv(F.substring("sha", 1, FINGERPRINT_BITS // 4), 16, 10).cast("long")
    rows = staged(texts.select("doc_id", F.unhex(sha).alias("sha"), "uid"), "text-hashes")
    listed = rows.select(fp_of_binary("sha").alias("fp"))
    suspect = suspects(listed, rows.count())

    shuffled = _suspect_texts(texts, rows, suspect, held).select("doc_id", "text", sha.alias("sha")).withColumn("fp", fp).drop("sha")
    if not held:
        shuffled = shuffled.join(F.broadcast(suspect), "fp", "left_semi") if fits(suspect) else shuffled
    groups = shuffled.groupBy("fp", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")).filter("n > 1")
    groups = groups.select(F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "n")
    # one text for each digest; two would mean a SHA-256 collision
    groups = groups.groupBy("sha").agg(F.max("keep_id").alias("keep_id"), F.max("n").alias("n"), F.count("*").alias("texts"))
    groups = staged(groups.withColumn("n", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts with one SHA-256")).cast("long")).otherwise(F.col("n"))).drop("texts"), "duplicate-groups")

    # of rows that repeat the kept id as well, the first stays
    last = spread_join(rows, groups, "sha", "uid").filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("sha").agg(F.min("uid").alias("keep_uid"))
    keepers = staged(groups.join(last, "sha"), "keepers")
    alone = F.col("n").isNull()
    return spread_join(rows, keepers, "sha", "uid", "left").select(
        "uid",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _suspect_texts(texts: DataFrame, rows: DataFrame, suspect: DataFrame, held: bool) -> DataFrame:
    """The texts whose fingerprint is suspect. Where the suspects fit a broadcast, texts that aren't held come whole, to be filtered by it; else suspects are told to the tasks by row number, and the other texts stay where they are."""
    if fits(suspect) and not held:
        return texts
    if not held:
        texts = staged(texts, "held-texts")
        rows = staged(texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), "uid"), "held-hashes")
    listed = rows.select("uid", fp_of_binary("sha").alias("fp"))
    return marked(texts, staged(spread_join(listed, suspect, "fp", "uid", "left_semi", least=LISTS).select("uid"), "suspect-rows"), "left_semi")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are; null counts as empty. Of equal
    texts the row with the largest id stays; a null id is smaller than any
    other. Rows that repeat both id and text share keep_id, and exactly one of
    them is kept. An empty table gives an empty result. Other columns are not
    read, so their names can't clash.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), F.monotonically_increasing_id().alias("uid"))
    return _judged(texts).select(F.col("doc_id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def fp_of_binary(col: str):
    """The fingerprint of a binary SHA-256: its first FINGERPRINT_BITS bits."""
    return F.conv(F.hex(F.substring(F.col(col), 1, FINGERPRINT_BITS // 8)), 16, 10).cast("long")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_duplicates drops, with their own columns.

    The rows are numbered in a staged copy, and each task learns the numbers
    of those to drop, so no text that is no suspect is shuffled. A null text
    is an empty one; an empty table gives an empty one with its columns.
    """
    held = numbered(docs, "numbered-documents")
    texts = held.select("uid", column_of("row", id_col).alias("doc_id"), F.coalesce(column_of("row", text_col).cast("string"), F.lit("")).alias("text"))
    gone = staged(_judged(texts, held=True).filter(~F.col("kept")).select("uid"), "dropped")
    return marked(held, gone, "left_anti").select("row.*")
