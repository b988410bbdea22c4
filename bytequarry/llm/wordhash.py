"""Words, and hashes of words and word n-grams, for many texts at once with numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D of the UTF-8
text. All hashes are 64-bit polynomials, taken for any range from prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Bytes of text that are worked on at once; one longer text is worked on whole.
BLOCK = 1 << 20
_BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_MASK = (1 << 64) - 1


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        np.multiply.accumulate(np.full(n - 1, base, np.uint64), out=out[1:])
    return out


def _table(base: int, n: int) -> np.ndarray:
    size = BLOCK
    while size < n:
        size *= 2
    return _powers(base, size + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _ranges(values: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """Polynomial hash of values[begin:end] for many ranges."""
    base = _BASE[which]
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _table(base, n)[:n], out=sums[1:])
    return (sums[end] - sums[begin]) * _table(pow(base, -1, 1 << 64), n)[begin]


def range_hashes(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of buf[begin:end], bytes, for many ranges; alike for equal bytes wherever they stand."""
    return mix(_ranges(buf.astype(np.uint64) + np.uint64(1), begin, end, 0) ^ (end - begin).astype(np.uint64))


@dataclass
class Words:
    """Words of some texts: text[first:last] are those with numbers doc_first[d] to doc_first[d + 1]."""

    data: bytes
    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    doc_first: np.ndarray
    hash: np.ndarray


def words(texts: list[bytes]) -> Words:
    data = b" ".join(texts) + b" "
    buf = np.frombuffer(data, np.uint8)
    inside = np.ones(len(buf) + 1, bool)
    inside[1:] = (buf != 32) & ((buf < 9) | (buf > 13))
    inside[0] = False
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    firsts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=firsts[1:])
    doc_first = np.searchsorted(begin, firsts)
    doc = np.repeat(np.arange(len(texts)), np.diff(doc_first))
    h = mix(_ranges(buf.astype(np.uint64) + np.uint64(1), begin, end, 0) ^ (end - begin).astype(np.uint64))
    return Words(data, begin, end, doc, doc_first, h)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values; empty if there are fewer."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    begin = np.arange(len(h) - n + 1)
    return mix(_ranges(h, begin, begin + n, 1))


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK bytes each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if texts:
        yield start, len(texts)


def sliding(h: np.ndarray, width: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over each `width` consecutive values."""
    span = 1
    while span * 2 <= width:
        h = op(h[:-span], h[span:])
        span *= 2
    return op(h[: len(h) - (width - span)], h[width - span :]) if width > span else h
