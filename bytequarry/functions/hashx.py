"""Hashes of names: rolling 32-bit hashes, Jenkins' one in bulk on Arrow's buffers and FNV as native expressions, CRC-64 by Arrow."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK32 = 0xFFFFFFFF


def byte_values(text: Column) -> Column:
    """The UTF-8 bytes of a text as array<bigint>; empty for an empty text."""
    digits = F.hex(F.encode(text, "UTF-8"))
    n = (F.length(digits) / 2).cast("int")
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint"))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(each)


def fold_path(text: Column) -> Column:
    """A-Z to lower case and backslash to slash; other characters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\\", "abcdefghijklmnopqrstuvwxyz/")


def _mask(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK32))


def joaat(text: Column, seed: int | Column = 0, finish: bool = True) -> Column:
    """Jenkins' one-at-a-time hash of the folded text, as an unsigned 32-bit value in BIGINT.

    finish=False gives the rolling state, which seeds the hash of what follows.
    """

    start = F.lit(seed).cast("bigint") if isinstance(seed, int) else seed.cast("bigint")
    return (_joaat if finish else _joaat_rolling)(text.cast("string"), start)


#: Bytes as joaat takes them.
_FOLDED = np.frombuffer(bytes(range(256)).lower().replace(b"\\", b"/"), np.uint8).astype(np.uint32)


def _rolled(texts: pa.Array, starts: pa.Array, step: Callable[[np.ndarray, np.ndarray], np.ndarray], back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit states after all bytes of each text, which are null): one step for the k-th bytes of all texts that have so many, from the last byte on if back."""
    null = np.asarray(texts.is_null()) | np.asarray(starts.is_null())
    data = texts.fill_null("").cast(pa.binary()).cast(pa.large_binary())
    at = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    every = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    long = np.diff(at)
    order = np.argsort(-long, kind="stable")
    first, long = (at[1:] - 1 if back else at[:-1])[order], long[order]
    h = (np.asarray(starts.fill_null(0)).astype(np.int64) & MASK32).astype(np.uint32)[order]
    for k in range(int(long[0]) if len(long) else 0):
        n = np.searchsorted(-long, -k, "left")
        h[:n] = step(h[:n], _FOLDED[every[first[:n] - k if back else first[:n] + k]])
    out = np.empty(len(h), np.int64)
    out[order] = h
    return out, null


def _joaat_step(h: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = h + b
    h += h << 10
    return h ^ h >> 6


@F.arrow_udf(T.LongType())
def _joaat_rolling(texts: pa.Array, starts: pa.Array) -> pa.Array:
    h, null = _rolled(texts, starts, _joaat_step)
    return pa.array(h, mask=null)


@F.arrow_udf(T.LongType())
def _joaat(texts: pa.Array, starts: pa.Array) -> pa.Array:
    h, null = _rolled(texts, starts, _joaat_step)
    h = h.astype(np.uint32)
    h += h << 3
    h ^= h >> 11
    h += h << 15
    return pa.array(h.astype(np.int64), mask=null)


@F.arrow_udf(T.LongType())
def _joaat_back(texts: pa.Array, states: pa.Array) -> pa.Array:
    inverse = np.uint32(pow(1 + (1 << 10), -1, 1 << 32))

    def step(h: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (h ^ h >> 6 ^ h >> 12 ^ h >> 18 ^ h >> 24 ^ h >> 30) * inverse - b

    h, null = _rolled(texts, states, step, back=True)
    return pa.array(h, mask=null)


def _xor_undone(h: Column, shift: int) -> Column:
    """x of h = x ^ x >> shift, in 32 bits."""
    out = h
    for s in range(shift, 32, shift):
        out = out.bitwiseXOR(F.shiftrightunsigned(h, s))
    return out


def joaat_state(value: Column) -> Column:
    """The rolling state of which joaat's end makes the value."""
    h = _times32(value.cast("bigint"), pow(1 + (1 << 15), -1, 1 << 32))
    return _times32(_xor_undone(h, 11), pow(1 + (1 << 3), -1, 1 << 32))


def joaat_without_suffix(state: Column, suffix: Column) -> Column:
    """The rolling state before a known suffix, folded as joaat folds it."""
    return _joaat_back(suffix.cast("string"), state.cast("bigint"))


def low29(value: Column) -> Column:
    return value.bitwiseAND(F.lit(0x1FFFFFFF))


def affine_hash(text: Column, seed: int = 0, times: int = 141) -> Column:
    """h = (h + byte) * times, modulo 2**32."""
    return F.aggregate(byte_values(text), F.lit(seed).cast("bigint"), lambda h, b: _mask(_mask(h + b) * times))


FNV32_PRIME = 0x01000193
FNV32_BASIS = 0x811C9DC5
_INVERSE = pow(FNV32_PRIME, -1, 1 << 32)


def _times32(h: Column, by: int) -> Column:
    """h * by modulo 2**32 without leaving BIGINT."""
    high, low = by >> 16, by & 0xFFFF
    return _mask(_mask(F.shiftleft(_mask(h * high), 16)) + h * low)


def fnv1(text: Column, seed: int | Column = FNV32_BASIS) -> Column:
    """32-bit FNV-1: multiply, then xor each byte. seed: the hash of what stands before."""
    start = F.lit(seed) if isinstance(seed, int) else seed
    return F.aggregate(byte_values(text), start.cast("bigint"), lambda h, b: _times32(h, FNV32_PRIME).bitwiseXOR(b))


def fnv1_without_suffix(value: Column, suffix: Column) -> Column:
    """The FNV-1 state before a known suffix."""
    return F.aggregate(F.reverse(byte_values(suffix)), value.cast("bigint"), lambda h, b: _times32(h.bitwiseXOR(b), _INVERSE))


@lru_cache(maxsize=4)
def _crc64_table(poly: int) -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (poly if i & 1 else 0)
        out.append(i)
    return out


def crc64_of(data: bytes, poly: int = 0xC96C5795D7870F42, start: int = (1 << 64) - 1, end: int = (1 << 64) - 1) -> int:
    table, crc = _crc64_table(poly), start
    for b in data:
        crc = table[(crc ^ b) & 255] ^ crc >> 8
    return crc ^ end


@F.pandas_udf(T.StringType())
def crc64(data: pd.Series) -> pd.Series:
    """CRC-64/XZ of BINARY as 16 hex digits."""
    return data.map(lambda x: f"{crc64_of(bytes(x)):016x}", na_action="ignore")
