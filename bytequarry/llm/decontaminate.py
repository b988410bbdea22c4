"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may appear with up to k = m * RATE edits. Cut into
k + 1 pieces, at least one piece of it then stands unedited in the document. An
Aho-Corasick automaton of all pieces finds the exact hits in one pass; each hit
names a place where the item may stand, and Myers' bit-parallel distance
verifies it there, first on the piece's neighbourhood: pieces form a tree, and
a run of p pieces has a budget of p - 1 edits, so one of two halves must keep
its budget if the whole keeps its own. A hit climbs until a budget is broken;
some hit of a true match climbs to the root.

A piece that many items share (a question's stem) would cost a climb for each of
them at each hit. There the items are judged together: an item's edits are at
least the sum of its segments' least distances, each in its own window, and one
numpy pass of Myers' algorithm gives a segment's for all items at once. Items
whose sum breaks the budget can't stand there; the others are verified one by
one as a whole. Nothing else drops a hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Edits allowed for each character of an item.
RATE = 0.08
#: Characters of items whose automaton one pass holds; more items take more passes.
BLOCK_CHARS = 4_000_000
#: From this many places on, those of a piece are judged together. It changes the work alone, never a result.
MANY = 32
#: Characters of a segment (bits of a word) and rows of one numpy pass.
SEGMENT, ROWS = 64, 4096


def normal(text: Column) -> Column:
    """Lower case letters and digits, everything between as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def myers_best(pattern: str, masks: dict[str, int], text: str, start: int, end: int) -> tuple[int, int]:
    """(least edit distance of the pattern to any part of text[start:end], the first end of such a part)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, at = m, start
    for i in range(start, end):
        eq = masks.get(text[i], 0)
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & full
        up = minus | (full & ~(d0 | plus))
        down = plus & d0
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up <<= 1
        down <<= 1
        plus = (down | ~(d0 | up)) & full
        minus = up & d0
        if score < best:
            best, at = score, i + 1
    return best, at


@lru_cache(maxsize=4096)
def _masks(pattern: str) -> dict[str, int]:
    """Where each character stands, as bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


@lru_cache(maxsize=4096)
def _paths(pieces: int) -> list[list[tuple[int, int]]]:
    """For each piece the runs [lo, hi) of pieces that hold it, from the smallest of two or more up to the whole."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(pieces)]
    runs = [(0, pieces)]
    while runs:
        lo, hi = runs.pop()
        if hi - lo > 1:
            for i in range(lo, hi):
                out[i].insert(0, (lo, hi))
            mid = (lo + hi) // 2
            runs += [(lo, mid), (mid, hi)]
    return out


def least_distances(rows: np.ndarray, sizes: np.ndarray, windows: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Least edit distance of each segment to any part of its window.

    Row i holds the codes of a segment in its last sizes[i] places, zeros before
    them; its window is windows[which[i]]. Code 0 in a window is a character
    that no segment has. Zeros before a segment match anything at no cost, so
    all distances stand at the highest bit.
    """
    seen = np.unique(windows)
    local = np.searchsorted(seen, windows)
    best = np.empty(len(rows), np.int64)
    one, ones = np.uint64(1), ~np.uint64(0)
    for i in range(0, len(rows), ROWS):
        part, size, at = rows[i : i + ROWS], sizes[i : i + ROWS], which[i : i + ROWS]
        n = len(part)
        before = np.packbits(part == 0, axis=1, bitorder="little").view("<u8").ravel()
        table = np.empty((len(seen), n), np.uint64)
        for c, code in enumerate(seen):
            table[c] = before | np.packbits(part == code, axis=1, bitorder="little").view("<u8").ravel() if code else before
        alike = (at == at[0]).all()
        cells = None if alike else (local[at].T * n + np.arange(n)).copy()
        plus, minus = before ^ ones, np.zeros(n, np.uint64)
        d0, up, down, eq = (np.empty(n, np.uint64) for _ in range(4))
        score = size.astype(np.int16)
        least = score.copy()
        for t in range(windows.shape[1]):
            if alike:
                eq = table[local[at[0], t]]
            else:
                np.take(table, cells[t], out=eq, mode="clip")
            np.bitwise_and(eq, plus, out=d0)
            d0 += plus
            d0 ^= plus
            d0 |= eq
            d0 |= minus
            np.bitwise_or(d0, plus, out=up)
            np.invert(up, out=up)
            up |= minus
            np.bitwise_and(plus, d0, out=down)
            score += up.view(np.int64) < 0
            score -= down.view(np.int64) < 0
            np.minimum(least, score, out=least)
            up <<= one
            down <<= one
            np.bitwise_or(d0, up, out=plus)
            np.invert(plus, out=plus)
            plus |= down
            np.bitwise_and(up, d0, out=minus)
        best[i : i + ROWS] = least
    return best


class _Segments:
    """The items of a matcher, cut into segments of SEGMENT characters, as arrays."""

    def __init__(self, items: list[tuple[int, str]], budgets: list[int]) -> None:
        self.budgets = np.array(budgets, np.int64)
        self.counts = np.array([-(-len(p) // SEGMENT) for _, p in items], np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        known: dict[str, int] = {}
        self.ids = np.array([known.setdefault(p[i : i + SEGMENT], len(known)) for _, p in items for i in range(0, len(p), SEGMENT)], np.int64)
        points = np.frombuffer("".join(known).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.alphabet = np.unique(points)
        self.sizes = np.array([len(s) for s in known], np.int64)
        kind = np.uint8 if len(self.alphabet) < 256 else np.uint32
        self.rows = np.zeros((len(known), SEGMENT), kind)
        self.rows[np.arange(SEGMENT) >= SEGMENT - self.sizes[:, None]] = np.searchsorted(self.alphabet, points) + 1

    def coded(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, 0).astype(self.rows.dtype)

    def order(self, items: np.ndarray) -> list[int]:
        """The segments' numbers, those that tell most items apart first."""
        told = []
        for j in range(int(self.counts[items].max())):
            has = items[self.counts[items] > j]
            told.append((-len(np.unique(self.ids[self.first[has] + j])), j))
        return [j for _, j in sorted(told)]

    def near(self, items: np.ndarray, starts: np.ndarray, order: list[int], text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the items, of budgets alike, that may stand in the text about their starts.

        With a piece unedited at its place and k edits in all, no other part stands more than k places from its own.
        """
        k = int(self.budgets[items].max())
        left = self.budgets[items].copy()
        for j in order:
            has = np.flatnonzero(self.counts[items] > j)
            if not len(has):
                continue
            ids = self.ids[self.first[items[has]] + j]
            begins, which = np.unique(starts[has] + j * SEGMENT - k, return_inverse=True)
            pairs, back = np.unique(ids * len(begins) + which, return_inverse=True)
            ids, which = pairs // len(begins), pairs % len(begins)
            place = begins[:, None] + np.arange(SEGMENT + 2 * k)
            windows = np.where((place >= 0) & (place < len(text)), text[np.clip(place, 0, len(text) - 1)], 0)
            left[has] -= least_distances(self.rows[ids], self.sizes[ids], windows, which)[back]
            items, starts, left = items[left >= 0], starts[left >= 0], left[left >= 0]
            if len(items) < MANY:
                break
        return items, starts


class _Group:
    """The places of a piece that many items share, in classes of budgets within a factor of two."""

    def __init__(self, places: list[tuple[int, int]], offsets: list[int], segments: _Segments) -> None:
        items, offs = np.array([i for i, _ in places], np.int64), np.array(offsets, np.int64)
        size = np.frexp(segments.budgets[items])[1]
        self.classes = [(items[size == s], offs[size == s], segments.order(items[size == s])) for s in np.unique(size)]


class Matcher:
    """The pieces of some items, given in normal form, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE) -> None:
        self.items: list[tuple[int, str]] = []
        self.budgets: list[int] = []
        self.pieces = ahocorasick.Automaton()
        self.groups: dict[int, _Group] = {}
        where: dict[str, list[tuple[int, int]]] = {}
        for item_id, pattern in items:
            if not pattern:
                continue
            k = int(len(pattern) * rate)
            for i in range(k + 1):
                where.setdefault(pattern[len(pattern) * i // (k + 1) : len(pattern) * (i + 1) // (k + 1)], []).append((len(self.items), i))
            self.items.append((item_id, pattern))
            self.budgets.append(k)
        for number, (piece, places) in enumerate(where.items()):
            self.pieces.add_word(piece, (number, len(piece), places))
        if where:
            self.pieces.make_automaton()

    @cached_property
    def segments(self) -> _Segments:
        return _Segments(self.items, self.budgets)

    def _cut(self, item: int, i: int) -> int:
        return len(self.items[item][1]) * i // (self.budgets[item] + 1)

    def _whole(self, item: int, start: int, text: str) -> tuple[int, int]:
        pattern, k = self.items[item][1], self.budgets[item]
        return myers_best(pattern, _masks(pattern), text, max(0, start - k), min(len(text), start + len(pattern) + k))

    def _climbs(self, item: int, leaf: int, start: int, end: int, text: str, done: dict[int, int]) -> tuple[int, int] | None:
        """The item's best place about start, if runs of pieces keep their budgets from the leaf's to the whole."""
        pattern, best, at = self.items[item][1], 0, end
        for lo, hi in _paths(self.budgets[item] + 1)[leaf]:
            k, a, b = hi - lo - 1, self._cut(item, lo), self._cut(item, hi)
            run = pattern[a:b]
            best, at = myers_best(run, _masks(run), text, max(0, start + a - k), min(len(text), start + b + k))
            if k == self.budgets[item]:
                done[item] = start
            if best > k:
                return None
        return best, at

    def _together(self, number: int, places: list[tuple[int, int]], begin: int, text: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, start) of the places of a piece, hit at begin, where the item may stand and wasn't looked for before."""
        if number not in self.groups:
            self.groups[number] = _Group(places, [self._cut(*p) for p in places], self.segments)
        for items, offs, order in self.groups[number].classes:
            starts = begin - offs
            new = last[items] != starts
            items, starts = items[new], starts[new]
            if len(items):
                last[items] = starts
                items, starts = self.segments.near(items, starts, order, text)
                yield from zip(items.tolist(), starts.tolist(), strict=True)

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item's place in items, distance, end) at each start where an item stands in a text in normal form."""
        if not self.items or not text:
            return
        done: dict[int, int] = {}
        coded = last = None
        for end, (number, n, places) in self.pieces.iter(text):
            begin = end + 1 - n
            if len(places) >= MANY:
                if coded is None:
                    coded, last = self.segments.coded(text), np.full(len(self.items), np.iinfo(np.int64).min)
                for item, start in self._together(number, places, begin, coded, last):
                    best, at = self._whole(item, start, text)
                    done[item] = start
                    if best <= self.budgets[item]:
                        yield item, best, at
                continue
            for item, leaf in places:
                start = begin - self._cut(item, leaf)
                if done.get(item) == start:
                    continue  # the whole item was looked for there
                if found := self._climbs(item, leaf, start, end + 1, text, done):
                    yield item, *found

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end) of each item that a text in normal form holds; its best place, or the first of them."""
        found: dict[int, tuple[int, int]] = {}
        for item, best, at in self.matches(text):
            found[item] = min(found.get(item, (best, at)), (best, at))
        return sorted((self.items[i][0], d, e) for i, (d, e) in found.items())

    def holds(self, text: str) -> bool:
        """Whether a text in normal form holds any item; the first one found ends the search."""
        return next(self.matches(text), None) is not None


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK_CHARS, streamed to the driver; a test set is bounded by its makers, not by the corpus."""
    held, size = [], 0
    for r in benchmark.select(F.col(item_col).cast("long").alias("i"), normal(text_of(text_col)).alias("t")).distinct().toLocalIterator():
        held.append((r["i"], r["t"]))
        size += len(r["t"])
        if size >= BLOCK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, end): each item that each row of docs holds within its error budget.

    Texts are compared as lower case letters and digits, anything between as
    one space; `end` is where the best match ends in that form. Null texts are
    empty and hold nothing; an item without a letter or digit is held by
    nothing. Rows that repeat an id answer for themselves. Rows without a leak
    give no row; empty tables give none. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normal(text_of(text_col)).alias("text"))
    schema, out = "doc_id long, item_id long, distance long, end long", None
    for items in _blocks(benchmark, item_col, item_text_col):
        held = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value, rate)
            for b in batches:
                found = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in matcher.find(t)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["doc_id", "item_id", "distance", "end"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """docs with their own columns, less the rows that hold an item; each row is judged where it stands, without a join.

    Null texts are empty and stay, as does every row where the benchmark is
    empty; an empty table gives an empty one. Rows that repeat are judged alike.
    """
    for items in _blocks(benchmark, item_col, item_text_col):
        held = docs.sparkSession.sparkContext.broadcast(items)
        at = len(docs.columns)

        def run(batches: Iterator[pa.RecordBatch], held=held, at=at) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value, rate)
            for b in batches:
                clean = pa.array([not matcher.holds(t) for t in b.column(at).to_pylist()], pa.bool_())
                yield pa.RecordBatch.from_arrays(b.columns[:at], names=b.schema.names[:at]).filter(clean)

        docs = docs.select("*", normal(text_of(text_col)).alias("__normal")).mapInArrow(run, docs.schema)
    return docs
