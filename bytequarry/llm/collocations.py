"""Phrase collocation mining: merged count-min sketches, exact counts of the survivors, scores, subsumption.

The first pass makes a count-min sketch of all words and pairs in each task, a
further one of the longer phrases whose pairs may all be frequent. Sketches
are summed cell by cell, and of a sum only a bit a cell is kept: whether it
reaches the least count. A cell holds at least what any of its phrases has, so
no frequent phrase is lost. The last pass counts those phrases exactly, by
their words, whose cells and whose shorter parts all reach the least count. A
noisy sketch costs time there, never a result.

What moves: the sketches (bounded by ROWS, MAX_BITS and one for each task,
tasks growing with the text), and the survivors' partial counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import spread_join, staged, text_of
from .wordhash import mix, range_hashes

#: Rows of the sketch; cells of a row lie between 2**MIN_BITS and 2**MAX_BITS, one for each BYTES_PER_CELL of text.
ROWS, MIN_BITS, MAX_BITS, BYTES_PER_CELL = 3, 16, 23, 16
#: Bytes of text in a task and its sketch, beyond the tasks that the cluster runs at once.
BYTES_PER_SKETCH = 4 << 30
#: Bytes of text that are worked on at once; longer texts are cut where pieces end.
BLOCK = (1 << 20) - (1 << 16)
#: Distinct phrases whose counts a task keeps before it hands them on.
COMBINED = 1 << 19
#: Phrases that are added to a sketch at once.
STRIDE = 1 << 15
#: Cells of a part of the sketch, that is of a row of the exchange.
PART_BITS = 16

#: Fixed: A to Z become small, tabs spaces, and bytes that end a piece line feeds.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, folded text that ends with a line feed) of about BLOCK bytes, from batches of (lang, text)."""
    waiting: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def flush(lang: str) -> Iterator[tuple[str, bytes]]:
        data, start = b"\n".join([*waiting.pop(lang), b""]), 0
        sizes.pop(lang)
        while len(data) - start > 2 * BLOCK and (cut := data.find(b"\n", start + BLOCK)) >= 0:
            yield lang, data[start : cut + 1]
            start = cut + 1
        if start < len(data):
            yield lang, data[start:]

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if text:
                waiting.setdefault(lang, []).append(text.translate(_FOLD))
                sizes[lang] = sizes.get(lang, 0) + len(text) + 1
                if sizes[lang] >= BLOCK:
                    yield from flush(lang)
        while sum(sizes.values()) > 4 * BLOCK:
            yield from flush(max(sizes, key=sizes.get))
    for lang in list(waiting):
        yield from flush(lang)


class _Words:
    """The words of a block: where they stand, their pieces, and hashes of the phrases that start at each."""

    def __init__(self, lang: str, data: bytes):
        self.buf = np.frombuffer(data, np.uint8)
        self.inside = (self.buf != 32) & (self.buf != 10)
        edges = np.flatnonzero(np.diff(self.inside.view(np.int8), prepend=0, append=0))
        self.begin, self.end = edges[::2], edges[1::2]
        self.piece = np.cumsum(self.buf == 10, dtype=np.int32)[self.begin]
        self.seed = np.uint64(zlib.crc32(lang.encode()) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)

    def __len__(self) -> int:
        return len(self.begin)

    def phrases(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, hashes, whether the phrase lies in one piece) for each start that has as many words after it."""
        word = mix(range_hashes(self.buf, self.begin, self.end) ^ self.seed)
        h = word
        for n in range(1, min(longest, len(self)) + 1):
            if n > 1:
                h = mix(h[:-1] * np.uint64(0xD1342543DE82EF95) + word[n - 1 :])
            yield n, h, self.piece[: len(h)] == self.piece[n - 1 :]


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((h & np.uint64(0xFFFFFFFF)) + np.uint64(row) * ((h >> np.uint64(32)) | np.uint64(1)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _kind(least: int) -> type:
    """Of a cell: holds the least count and STRIDE more."""
    return np.uint16 if least < STRIDE else np.uint32


def _living(w: _Words, maps: dict, bits: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, hashes, starts) of the phrases whose shorter parts are all heavy and whose own cells are; what has no map is taken for heavy."""
    alive = None
    for n, h, whole in w.phrases(longest):
        at = np.flatnonzero(whole if alive is None else whole & alive[:-1] & alive[1:])
        if n in maps:
            for row in range(ROWS):
                c = _cells(h[at], row, bits)
                at = at[(maps[n][row][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 > 0]
        if not len(at):
            return
        alive = np.zeros(len(h), bool)
        alive[at] = True
        yield n, h, at


def _sketched(bits: int, sizes: range, known, least: int):
    """Per task: its sketch in parts (part, cells). A cell that reaches the least count is no longer added to, so small integers do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((ROWS, 1 << bits), _kind(least))
        one = sketch.dtype.type(1)
        for lang, data in _blocks(batches):
            for n, h, at in _living(_Words(lang, data), known.value, bits, sizes[-1]):
                h = h[at if n in sizes else at[:0]]
                for i in range(0, len(h), STRIDE):
                    for row in range(ROWS):
                        c = _cells(h[i : i + STRIDE], row, bits)
                        np.add.at(sketch[row], c[sketch[row][c] < least], one)
        flat = sketch.reshape(-1, 1 << min(bits, PART_BITS))
        for i in range(0, len(flat), 16):
            some = [(j, np.minimum(flat[j], least).tobytes()) for j in range(i, min(i + 16, len(flat))) if flat[j].any()]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([j for j, _ in some], pa.int32()), pa.array([c for _, c in some], pa.binary())], names=["part", "cells"])

    return run


def _merged(least: int):
    """Sums parts that come sorted, so that one is held at a time: (part, a bit for each cell that reaches the least count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["part", "heavy"])
        for b in batches:
            for part, cells in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if part != at:
                    if at is not None:
                        yield done()
                    at, total = part, 0
                total = total + np.frombuffer(cells.as_buffer(), _kind(least)).astype(np.uint64)
        if at is not None:
            yield done()

    return run


def heavy_cells(texts: DataFrame, bits: int, tasks: int, sizes: range, known, least: int) -> np.ndarray:
    """ROWS bitmaps, packed, of the cells where phrases of `sizes` words come to `least` over all tasks of (lang, text); at most ROWS * 2**(MAX_BITS - 3) bytes. known: a broadcast of maps of shorter phrases."""
    sent = texts.coalesce(tasks).mapInArrow(_sketched(bits, sizes, known, least), "part int, cells binary")
    merged = sent.repartition("part").sortWithinPartitions("part").mapInArrow(_merged(least), "part int, heavy binary")
    part = 1 << min(bits, PART_BITS)
    out = np.zeros((ROWS << bits) // 8, np.uint8).reshape(-1, part // 8)
    for r in merged.toLocalIterator():
        out[r["part"]] = np.frombuffer(r["heavy"], np.uint8)
    return out.reshape(ROWS, -1)


def heavy_maps(texts: DataFrame, bits: int, tasks: int, longest: int, least: int):
    """A broadcast of the bitmaps for each number of words. Words and pairs have a sketch, longer phrases another one, which only those enter whose pairs are all heavy."""
    context, maps = texts.sparkSession.sparkContext, {}
    for sizes in (range(1, min(longest, 2) + 1), range(3, longest + 1)):
        if len(sizes):
            found = heavy_cells(texts, bits, tasks, sizes, context.broadcast(dict(maps)), least)
            maps |= dict.fromkeys(sizes, found)
    return context.broadcast(maps)


def _summed(rows: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(rows).group_by(["lang", "words", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "words", "phrase", "n"])


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts added up over the blocks of a task, as far as COMBINED rows reach."""
    held, rows, least = [], 0, 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows - least > COMBINED:
            total = _summed(held)
            if total.num_rows > COMBINED:
                yield from total.to_batches(1 << 16)
                held, rows, least = [], 0, 0
            else:
                held, rows, least = total.to_batches(), total.num_rows, total.num_rows
    if held:
        yield from _summed(held).to_batches(1 << 16)


def _counted(heavy, bits: int, longest: int):
    """Per task: (lang, words, phrase, n) of the phrases whose cells and shorter parts are heavy, counted by their words; with 0 words the number of all."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = heavy.value
        for lang, data in _blocks(batches):
            w = _Words(lang, data)
            if not len(w):
                continue
            lengths = w.end - w.begin
            kept = w.inside.copy()
            kept[w.end] = True  # one separator after each word
            joined, first_byte = np.where(w.inside, w.buf, 32).astype(np.uint8)[kept], np.concatenate(([0], np.cumsum(lengths + 1)))
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(w), [None, pa.py_buffer(offsets), pa.py_buffer(w.buf[w.inside])])
            single = words.dictionary_encode().indices.to_numpy().astype(np.int64)
            yield _batch(lang, 0, pa.array([""]), [len(w)])
            ids = single
            for n, h, at in _living(w, maps, bits, longest):
                key = single[at] if n == 1 else ids[at] << 32 | single[at + n - 1]
                code, _ = pd.factorize(key)
                count = np.bincount(code)
                where = np.empty(len(count), np.int64)
                where[code[::-1]] = at[::-1]
                ids = np.zeros(len(h), np.int64)
                ids[at] = code
                sizes = first_byte[where + n] - 1 - first_byte[where]
                ends = np.cumsum(sizes)
                bytes_at = np.arange(ends[-1]) + np.repeat(first_byte[where] - ends + sizes, sizes)
                phrases = pa.Array.from_buffers(pa.large_string(), len(where), [None, pa.py_buffer(np.concatenate(([0], ends))), pa.py_buffer(joined[bytes_at])])
                for i in range(0, len(where), 1 << 16):
                    yield _batch(lang, n, phrases[i : i + (1 << 16)].cast(pa.string()), count[i : i + (1 << 16)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _combined(counts(batches))

    return run


def _batch(lang: str, words: int, phrases: pa.Array, counts) -> pa.RecordBatch:
    size = len(phrases)
    return pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array(np.full(size, words, np.int32)), phrases, pa.array(counts, pa.int64())], names=["lang", "words", "phrase", "n"])


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100) -> DataFrame:
    """Staged table (lang, words, phrase, n): how often each phrase of 1 to `longest` words occurs, for those that do `least` times or more; with words 0 the number of all words of a lang.

    Text: null is empty; A to Z are lower-cased; pieces end at any of
    . , ; : ! ? and U+000A to U+000D, words at spaces and tabs. Lang: null is
    `und`. Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(MIN_BITS, int(size // BYTES_PER_CELL).bit_length()), MAX_BITS)
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // BYTES_PER_SKETCH))
    heavy = heavy_maps(texts, bits, tasks, longest, least)
    counted = texts.coalesce(tasks).mapInArrow(_counted(heavy, bits, longest), "lang string, words int, phrase string, n long")
    return staged(counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "phrase-counts")


def _keyed(lang: str, phrase):
    """One key of lang and phrase; phrases hold no line feed, so it is unambiguous."""
    return F.concat(F.col(lang), F.lit("\n"), phrase)


def scored(counts: DataFrame) -> DataFrame:
    """Staged (lang, words, phrase, a, l, r, n, score) for each phrase of two words and more of phrase_counts.

    score: floor(1000 * a * n / (l * r)) of the cut with the lowest one, the
    earliest of equal ones, in decimals of 38 digits.
    """
    phrases = counts.filter("words >= 2")
    word = F.split("phrase", " ")
    part = lambda at, size: F.array_join(F.slice(word, at, size), " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    sides = F.array(F.struct(F.lit(True).alias("first"), part(F.lit(1), F.col("k")).alias("p")), F.struct(F.lit(False).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("p")))
    parts = cuts.withColumn("s", F.explode(sides)).select("lang", "words", "phrase", F.col("n").alias("a"), "k", "s.first", _keyed("lang", F.col("s.p")).alias("part"))
    # the parts of frequent phrases are frequent, so each is found; those that begin many phrases are dealt to several tasks
    asked = parts.groupBy("part").agg(F.count("*").alias("asked"))
    known = staged(counts.filter("words >= 1").select(_keyed("lang", F.col("phrase")).alias("part"), F.col("n").alias("f")).join(asked, "part"), "phrase-parts")
    looked = spread_join(parts, known, "part", "phrase", rows="asked").groupBy("lang", "words", "phrase", "a", "k").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    langs = counts.filter("words = 0").select("lang", F.col("n").alias("all_words"))
    langs = staged(langs.join(phrases.groupBy("lang").agg((F.count("*") * 10).alias("asked")), "lang"), "phrase-langs")
    with_n = spread_join(looked, langs, "lang", "phrase", rows="asked")
    score = F.expr("(cast(a as decimal(16,0)) * cast(1000 as decimal(4,0)) * cast(all_words as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r", F.col("all_words").alias("n")))
    return staged(with_n.groupBy("lang", "words", "phrase", "a").agg(best.alias("b")).select("lang", "words", "phrase", "a", "b.l", "b.r", "b.n", "b.score"), "phrase-scores")


def subsumed(counts: DataFrame, share: int = 100) -> DataFrame:
    """(lang, phrase) inside a longer phrase that has `share` per cent of its count or more.

    Phrases one word longer say all: a still longer one's count is at most
    that of a phrase between the two, which then holds the phrase as well.
    """
    word = F.split("phrase", " ")
    inner = F.array(*[F.array_join(F.slice(word, F.lit(i), F.col("words") - 1), " ") for i in (1, 2)])
    longer = counts.filter("words >= 3").select("lang", F.explode(inner).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    held = counts.filter("words >= 2").join(longer, ["lang", "phrase"])
    return held.filter(F.col("longer").cast("decimal(22,0)") * 100 >= F.col("n").cast("decimal(22,0)") * share).select("lang", "phrase")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100, share: int = 100, top: int = 2000) -> DataFrame:
    """The `top` phrases of each lang: lang, rank, phrase, a, l, r, n, score, by score and count descending, then phrase.

    Phrases have 2 to `longest` words and occur `least` times or more; those
    that `subsumed` names are left out. See phrase_counts for words, nulls and
    empty tables. Repeated rows count as often as they stand there.
    """
    counts = phrase_counts(docs, text_col, lang_col, longest, least)
    left = scored(counts).join(subsumed(counts, share), ["lang", "phrase"], "left_anti")
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
