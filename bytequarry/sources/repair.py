"""Payloads put right: trimmed, joined from deflated chunks, cut at silent windows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import bytesx

CUT_SCHEMA = "part int, offset long, payload binary, error string"


def riff_trimmed(data: Column) -> Column:
    """STRUCT<payload, state> of a RIFF file: cut to the size in its head where zeros or under 4 bytes follow. state: fine, trimmed, truncated, extra, other."""
    size = bytesx.u32(data, 4) + 8
    have = F.length(data)
    tail = bytesx.u32(data, size)
    state = (
        F.when(~F.coalesce(bytesx.slice_bytes(data, 0, 4) == F.lit(b"RIFF"), F.lit(False)), "other").when(size == have, "fine").when(size > have, "truncated")
        .when(tail.isNull() | (tail == 0), "trimmed").otherwise("extra")
    )
    return F.struct(F.when(state == "trimmed", bytesx.slice_bytes(data, 0, size)).otherwise(data).alias("payload"), state.alias("state"))


def chunked_asset(data: bytes) -> Iterator[tuple]:
    """Deflated chunks behind a table of (packed size, size): head words, largest chunk, packed and full size, 64 bits each."""
    if data[:8] != bytes.fromhex("C1832A9E00000000"):
        raise ValueError("other signature")
    most, _, full = struct.unpack_from("<3Q", data, 8)
    if not most:
        raise ValueError("chunks of no size")
    n = -(-full // most)
    at, out = 0x20 + 16 * n, bytearray()
    for i in range(n):
        packed, size = struct.unpack_from("<QQ", data, 0x20 + 16 * i)
        out += _inflated(data[at : at + packed], size)
        at += packed
    yield (0, 0, bytes(out))


def padded_chunks(data: bytes) -> Iterator[tuple]:
    """Deflated chunks, each a size and its data, padded to 0x80; the head has a flag of 0x10000, their number, the full size and their sizes."""
    flag, n, _ = struct.unpack_from("<III", data, 0)
    if flag != 0x10000:
        raise ValueError("other signature")
    at, out = -(-(12 + 4 * n) // 128) * 128, bytearray()
    for _ in range(n):
        size = struct.unpack_from("<I", data, at)[0]
        out += _inflated(data[at + 4 : at + 4 + size])
        at = -(-(at + 4 + size) // 128) * 128
    yield (0, 0, bytes(out))


def _inflated(data: bytes, size: int | None = None) -> bytes:
    try:
        out = zlib.decompress(data)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if size is not None and len(out) != size:
        raise ValueError("chunk of another size")
    return out


def silent_cuts(first: int = 0x8000, step: int = 0x4000) -> Callable[[bytes], Iterator[tuple]]:
    """Parts of a big file that begin where a window starts with four zero bytes; after a cut the next window is `first` away, else `step`."""

    def run(data: bytes) -> Iterator[tuple]:
        begin, at, part = 0, first, 0
        while at < len(data):
            if data[at : at + 4] == b"\0\0\0\0":
                yield (part, begin, data[begin:at])
                begin, part, at = at, part + 1, at + first
            else:
                at += step
        yield (part, begin, data[begin:])

    return run
