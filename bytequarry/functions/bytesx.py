"""Typed reads and edits of BINARY columns as plain Column expressions.

Nothing here uses reverse, position or locate: on BINARY they go through
STRING and give wrong answers for bytes of 0x80 and more.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Offset = int | Column


def _at(offset: Offset, more: int = 1) -> Column:
    return F.lit(offset + more) if isinstance(offset, int) else offset.cast("int") + more


def slice_bytes(data: Column, offset: Offset, size: Offset) -> Column:
    """size bytes from a zero-based offset; shorter at the end of data."""
    return F.substring(data, _at(offset), _at(size, 0))


def u8(data: Column, offset: Offset) -> Column:
    return F.conv(F.hex(F.substring(data, _at(offset), F.lit(1))), 16, 10).cast("bigint")


def _uint(data: Column, offset: Offset, n: int, big: bool) -> Column:
    """Unsigned integer of n bytes; null where data ends before."""
    spots = range(n) if big else range(n - 1, -1, -1)
    digits = F.concat(*[F.hex(F.substring(data, _at(offset, 1 + i), F.lit(1))) for i in spots])
    value = F.conv(digits, 16, 10)
    return F.when(F.length(digits) == 2 * n, value.cast("decimal(20,0)") if n == 8 else value.cast("bigint"))


def u16(data: Column, offset: Offset, big: bool = False) -> Column:
    return _uint(data, offset, 2, big)


def u24(data: Column, offset: Offset, big: bool = False) -> Column:
    return _uint(data, offset, 3, big)


def u32(data: Column, offset: Offset, big: bool = False) -> Column:
    return _uint(data, offset, 4, big)


def u64(data: Column, offset: Offset, big: bool = False) -> Column:
    """As DECIMAL(20,0), for Spark has no unsigned long."""
    return _uint(data, offset, 8, big)


def signed(value: Column, bits: int) -> Column:
    return F.when(value >= 1 << (bits - 1), value - (1 << bits)).otherwise(value)


def u32_guess(data: Column, offset: Offset) -> tuple[Column, Column]:
    """(value, is big-endian): the byte order that gives the smaller value."""
    be, le = u32(data, offset, True), u32(data, offset)
    return F.least(be, le), be < le


def u32_unless_over(data: Column, offset: Offset, limit: int) -> Column:
    """Little-endian, unless that is more than limit."""
    le = u32(data, offset)
    return F.when(le > limit, u32(data, offset, True)).otherwise(le)


def bit_field(value: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND((1 << bits) - 1)


def set_bits(value: Column, bits: int = 32) -> Column:
    """Positions of the one bits, from the lowest."""
    return F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.getbit(value.cast("bigint"), i) == 1)


def swap32(value: Column) -> Column:
    part = lambda at, to: F.shiftleft(F.shiftrightunsigned(value, at).bitwiseAND(255), to)
    return part(0, 24) + part(8, 16) + part(16, 8) + part(24, 0)


def rotate_right8(value: Column, by: int) -> Column:
    by %= 8
    return F.shiftrightunsigned(value, by).bitwiseOR(F.shiftleft(value, 8 - by)).bitwiseAND(255)


def clamp16(value: Column) -> Column:
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), value))


def scaled_offset(value: Column, flags: Column, unit: int = 0x800) -> Column:
    """An offset in units of sectors where the flag's lowest bit says so."""
    return F.when(flags.bitwiseAND(1) != 0, value * unit).otherwise(value)


def zstring(data: Column, offset: Offset, size: Offset) -> Column:
    """Text of a fixed field, up to its first NUL."""
    return F.split_part(F.decode(slice_bytes(data, offset, size), "UTF-8"), F.lit("\0"), F.lit(1))


def nibble_swap(data: Column) -> Column:
    @F.pandas_udf("binary")
    def run(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda x: ((v := np.frombuffer(x, np.uint8)) << 4 | v >> 4).tobytes(), na_action="ignore")

    return run(data)


def patch(data: Column, offset: Offset, new: Column) -> Column:
    """data with new written over it from offset."""
    at = _at(offset, 0)
    return F.concat(F.substring(data, F.lit(1), at), new, F.substring(data, at + F.length(new) + 1, F.length(data)))


def le_bytes(value: Column, n: int) -> Column:
    """The integer's n low bytes, lowest first."""
    each = [F.lpad(F.hex(F.shiftrightunsigned(value.cast("bigint"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(n)]
    return F.unhex(F.concat(*each))


def from_base64(text: Column) -> Column:
    """The bytes of base-64 text; null where it is none."""
    return F.try_to_binary(text, F.lit("base64"))


def contains_any(data: Column, needles: list[bytes]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(data, F.lit(n)) for n in needles])


def byte_at_most(value: Column, limit: int) -> Column:
    return value.between(0, limit)


def looks_textual(data: Column) -> Column:
    """No byte below 0x09; bytes of 0x80 and more only as valid UTF-8 that does not begin in the first three bytes."""
    text = F.decode(data, "ISO-8859-1")
    low = text.rlike("[\\x00-\\x08]")
    high = text.rlike("[\\x80-\\xFF]")
    early = F.substring(text, 1, 3).rlike("[\\x80-\\xFF]")
    return ~low & (~high | (~early & F.is_valid_utf8(data.cast("string"))))


def concat_in_order(group_bytes: Column) -> Column:
    """Bytes of an array of structs (seq, payload), joined by seq: as hexadecimal text, which is joined in one pass."""
    return F.unhex(F.array_join(F.transform(F.array_sort(group_bytes), lambda x: F.hex(x["payload"])), ""))
