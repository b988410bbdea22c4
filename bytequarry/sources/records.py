"""Parsers of record formats: messages, tags, banks, name tables, embedded objects.

Each gives tuples for blobs.parsed and has a *_SCHEMA to go with it.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import parsed
from .repair import CUT_SCHEMA, chunked_asset, padded_chunks, silent_cuts

# --- messages of tag, length, value ----------------------------------------------

TLV_SCHEMA = "path_in array<int>, field_no int, wire_type int, int_value decimal(20,0), data binary, text string, error string"


def varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, next offset) of 7-bit groups, lowest first."""
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        shift += 7
        at += 1
        if not b & 128:
            return value, at
        if shift >= 70:
            raise ValueError("varint too long")


def zigzag(value: int) -> int:
    return value >> 1 ^ -(value & 1)


def textual(data: bytes) -> bool:
    """No byte below 0x09; high bytes only as UTF-8 that does not begin in the first three bytes."""
    if any(b < 9 for b in data):
        return False
    high = next((i for i, b in enumerate(data) if b >= 128), None)
    if high is None:
        return True
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return high >= 3


def messages(data: bytes, path: list[int] | None = None) -> Iterator[tuple]:
    """Fields of a message without a schema; what is not text is taken for a message if it parses as one, at any depth. Of a message that is damaged the fields before that come first."""
    whole: list[tuple] = []
    try:
        _fields(data, whole)
        damage = None
    except (ValueError, IndexError) as e:
        damage = e
    held = [(path or [], iter(whole))]
    while held:
        path, left = held[-1]
        got = next(left, None)
        if got is None:
            held.pop()
            continue
        number, wire, value, body = got
        text = body.decode() if body is not None and textual(body) else None
        yield (path, number, wire, value, body, text)
        if body is not None and text is None:
            inner: list[tuple] = []
            try:
                _fields(body, inner)
            except (ValueError, IndexError):
                continue
            held.append(([*path, number], iter(inner)))
    if damage:
        raise damage


def _fields(data: bytes, out: list[tuple]) -> None:
    """Put (field, wire type, number, bytes) of one level into out. Raises ValueError where the data is no message."""
    from decimal import Decimal

    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = varint(data, at)
            out.append((number, wire, Decimal(value), None))
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            if at + n > len(data):
                raise ValueError("field out of the data")
            out.append((number, wire, Decimal(int.from_bytes(data[at : at + n], "little")), None))
            at += n
        elif wire == 2:
            n, at = varint(data, at)
            if at + n > len(data):
                raise ValueError("field out of the data")
            out.append((number, wire, None, data[at : at + n]))
            at += n
        else:
            raise ValueError(f"wire type {wire}")


def tlv_lines(rows: DataFrame, key: str) -> DataFrame:
    """TLV rows with their printed line: two spaces a level, the field in hex, its value."""
    value = F.coalesce("text", F.col("int_value").cast("string"), F.lit("(message)"))
    return rows.select(key, F.concat(F.repeat(F.lit("  "), F.size("path_in")), F.lower(F.hex("field_no")), F.lit(": "), value).alias("line"))


# --- length-prefixed tags ----------------------------------------------------------

TAGS_SCHEMA = "file string, subsong long, seq int, name string, value string, error string"


def external_tags(data: bytes) -> Iterator[tuple]:
    """Signature EXTERNALTAGS, then records: name, subsong, size of the whole record, (tag, value) pairs."""
    if data[:12] != b"EXTERNALTAGS":
        raise ValueError("other signature")
    at = 12

    def text() -> str:
        nonlocal at
        n = struct.unpack_from("<I", data, at)[0]
        if at + 4 + n > len(data):
            raise ValueError("text out of the data")
        at += 4 + n
        return data[at - n : at].decode()

    while at < len(data):
        base, file = at, text()
        subsong, size = struct.unpack_from("<II", data, at)
        at += 8
        seq = 0
        while at < base + size:
            name = text()
            yield (file, subsong, seq, "ALBUMARTIST" if name == "ALBUM ARTIST" else name, text())
            seq += 1
        if size == 0:
            raise ValueError("record of no size")


def joined_tags(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per tag of a file: repeated values joined by ", " in order."""
    x = F.array_sort(F.collect_list(F.struct("seq", "value")))
    return rows.groupBy(*keys, "name").agg(F.min("seq").alias("seq"), F.array_join(F.transform(x, lambda v: v["value"]), ", ").alias("value"))


# --- banks and stream headers --------------------------------------------------------

BANK_SCHEMA = "chunk string, offset long, size long, object_no int, object_type int, object_id long, error string"


def sound_bank(data: bytes) -> Iterator[tuple]:
    """Chunks (id, size) and, of the HIRC chunk, its objects (type, size, id). Byte order: that which makes the first size smaller."""
    order = ">" if struct.unpack_from(">I", data, 4)[0] < struct.unpack_from("<I", data, 4)[0] else "<"
    at = 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4].decode("latin-1"), struct.unpack_from(order + "I", data, at + 4)[0]
        yield (name, at, size, None, None, None)
        if name == "HIRC":
            n = struct.unpack_from(order + "I", data, at + 8)[0]
            o = at + 12
            for i in range(n):
                kind, length, number = struct.unpack_from(order + "BII", data, o)
                yield (name, o, length, i, kind, number)
                o += 5 + length
        at += 8 + size


DETAILS_SCHEMA = "chunk string, object_no int, object_type int, object_id long, field string, value long, text string, error string"
# What the modes of sounds, and the scopes and actions of events, are called.
SOUND_MODES = {0: "Bank", 1: "Stream", 2: "Prefetch"}
EVENT_SCOPES = {1: "Game object by Switch/Trigger", 2: "Global", 3: "Game object by refid", 4: "Game object by State", 5: "All", 9: "All except refid"}
EVENT_ACTIONS = {
    1: "Stop", 2: "Pause", 3: "Resume", 4: "Play", 5: "Trigger", 6: "Mute", 7: "UnMute", 8: "Set Voice Pitch", 9: "Reset Voice Pitch", 10: "Set Voice Volume", 11: "Reset Voice Volume", 12: "Set Bus Volume", 13: "Reset Bus Volume",
    14: "Set Voice Low-pass Filter", 15: "Reset Voice Low-pass Filter", 16: "Enable State", 17: "Disable State", 18: "Set State", 19: "Set Game Parameter", 20: "Reset Game Parameter", 25: "Set Switch", 26: "Enable/Disable Bypass", 27: "Reset Bypass Effect", 28: "Break", 30: "Seek",
}


def bank_details(data: bytes) -> Iterator[tuple]:
    """Fields of a bank's chunks (version and id, settings, names, platform) and of its sounds, event actions and event sequences, codes with their names; other objects have none."""
    order = ">" if struct.unpack_from(">I", data, 4)[0] < struct.unpack_from("<I", data, 4)[0] else "<"
    word = lambda at: struct.unpack_from(order + "I", data, at)[0]
    at = 0
    while at + 8 <= len(data):
        name, size, o = data[at : at + 4].decode("latin-1"), word(at + 4), at + 8
        if name == "BKHD":
            yield (name, None, None, None, "version", word(o), None)
            yield (name, None, None, None, "id", word(o + 4), None)
        elif name == "STMG":
            for i in range(word(o + 8)):
                yield (name, i, None, word(o + 12 + 12 * i), "setting", word(o + 16 + 12 * i), None)
        elif name == "PLAT":
            yield (name, None, None, None, "platform", None, data[o + 4 : o + 4 + word(o)].split(b"\0")[0].decode("utf-8", "replace"))
        elif name == "INIT":
            n, o = word(o), o + 4
            for i in range(n):
                length = word(o + 4)
                yield (name, i, None, None, "name", struct.unpack_from(order + "H", data, o)[0], data[o + 8 : o + 8 + length].split(b"\0")[0].decode("utf-8", "replace"))
                o += 8 + length
        elif name == "HIRC":
            n, o = word(o), o + 4
            for i in range(n):
                kind, length, number = struct.unpack_from(order + "BII", data, o)
                body = o + 9
                if kind == 2:
                    yield (name, i, kind, number, "mode", data[body + 4], SOUND_MODES.get(data[body + 4]))
                    yield (name, i, kind, number, "source", word(body + 5), None)
                elif kind == 3:
                    yield (name, i, kind, number, "scope", data[body], EVENT_SCOPES.get(data[body]))
                    yield (name, i, kind, number, "action", data[body + 1], EVENT_ACTIONS.get(data[body + 1]))
                    yield (name, i, kind, number, "target", word(body + 2), None)
                elif kind == 4:
                    for k in range(data[body]):
                        yield (name, i, kind, number, f"action{k}", word(body + 1 + 4 * k), None)
                o += 5 + length
        at += 8 + size


WAVES_SCHEMA = "stream_no int, stream_id long, tag_no int, tag_type int, tag_offset long, tag_size long, channel int, samples long, rate int, codec int, error string"


def wave_container(data: bytes) -> Iterator[tuple]:
    """ADAT (little-endian) or TADA (big-endian): streams of 29 bits with 3 bits of tag count, tags of 8, 28 and 28 bits; the channels of 0x48 tags."""
    order = {b"ADAT": "<", b"TADA": ">"}.get(data[:4])
    if not order:
        raise ValueError("other signature")
    flags, n = struct.unpack_from(order + "II", data, 4)
    at = 16 + (2 * n if flags & 0x10000 else 0)
    heads = struct.unpack_from(f"{order}{n}I", data, at)
    at += 4 * n
    for s, head in enumerate(heads):
        for t in range(head >> 29):
            tag = struct.unpack_from(order + "Q", data, at)[0]
            at += 8
            kind, size, offset = tag >> 56, tag >> 28 & 0xFFFFFFF, tag & 0xFFFFFFF
            yield (s, head & 0x1FFFFFFF, t, kind, offset, size, None, None, None, None)
            if kind == 0x48:
                channels = struct.unpack_from(order + "I", data, offset + 8)[0]
                for c in range(channels):
                    number, samples, _, rate, codec = struct.unpack_from(order + "IIhHB", data, offset + 12 + 16 * c)
                    yield (s, number, t, kind, offset, size, c, samples, rate, codec)


IDS_SCHEMA = "stream_id long, offset long, size long, error string"


def stream_ids(stream_kind: int, sound_kind: int) -> Callable[[bytes], Iterator[tuple]]:
    """KTSR banks: (id, offset, size) of chunks of the stream kind, and of sounds whose flags say that they lie in another file."""

    def run(data: bytes) -> Iterator[tuple]:
        extra = data[:4] in (b"ASRS", b"TSRS")
        at = 16 if extra else 0
        if data[at : at + 4] != b"KTSR":
            raise ValueError("other signature")
        at += 0x40
        while at + 12 < len(data):
            kind, size, number = struct.unpack_from("<III", data, at)
            if not kind:
                return
            if not size:
                raise ValueError("chunk of no size")
            if kind == stream_kind:
                offset, n = struct.unpack_from("<II", data, at + 12)
                yield (number, offset + at, n)
            elif kind == sound_kind:
                flags, _, head, _ = struct.unpack_from("<IIII", data, at + 12)
                if flags & 0x10000:
                    head = struct.unpack_from("<I", data, at + head)[0]
                    offset, n = struct.unpack_from("<II", data, at + head + 0x34)
                    yield (number, offset + 16 * extra, n)
            at += size

    return run


# --- tables of strings -----------------------------------------------------------------

STRINGS_SCHEMA = "seq int, text string, error string"


def trailing_strings(data: bytes) -> Iterator[tuple]:
    """BXM: NUL-ended Shift-JIS strings that fill the end of the file; their size is in the head."""
    if data[:4] not in (b"BXM\0", b"XML\0"):
        raise ValueError("other signature")
    version, _, _, n = struct.unpack_from(">IHHI", data, 4)
    if version:
        raise ValueError("version")
    for i, s in enumerate(data[len(data) - n :].split(b"\0")[: -1 if data[-1:] == b"\0" else None]):
        yield (i, s.decode("shift_jis", "replace"))


def sized_names(data: bytes) -> Iterator[tuple]:
    """Assets with a name table: count, then hashes, big-endian sizes, and the names one after the other."""
    if data[:4] != b"\0\0\0\0":
        raise ValueError("other signature")
    n = struct.unpack_from("<I", data, 8)[0] + 1
    at = 0x3C + 8 * n
    sizes = struct.unpack_from(f">{n}H", data, at)
    at += 2 * n
    for i, size in enumerate(sizes):
        if at + size > len(data):
            raise ValueError("name out of the data")
        yield (i, data[at : at + size].decode("utf-8", "replace"))
        at += size


ASSET_SCHEMA = "pack string, name string, extension string, payload binary, names array<string>, error string"


def wrapped_asset(data: bytes) -> Iterator[tuple]:
    """A record with a type hash, name, payload and pack name, each padded to 4 bytes; banks have a list of names."""
    # Type hashes of the two kinds.
    kinds = {bytes.fromhex("5E7C17DBD169FF1F"): "wem", bytes.fromhex("1E89BCD1966DD285"): "bnk"}
    if struct.unpack_from("<4I", data, 0) != (0, 0, 0, 1) or (ext := kinds.get(data[20:28])) is None:
        raise ValueError("other record")
    at = 28

    def field() -> bytes:
        nonlocal at
        n = struct.unpack_from("<I", data, at)[0]
        begin = at + 4
        if begin + n > len(data):
            raise ValueError("field out of the data")
        at = -(-(begin + n) // 4) * 4
        return data[begin : begin + n]

    name, payload, _, pack = field().decode(), field(), field(), field().decode()
    names = []
    if ext == "bnk":
        n = struct.unpack_from("<I", data, at)[0]
        at += 4
        names = [field().decode() for _ in range(n)]
    yield (pack, name, ext, payload, names)


def loop_points(data: bytes) -> tuple[int, int] | None:
    """Start and end of a .pos file: two little-endian words."""
    return struct.unpack_from("<II", data, 0) if len(data) >= 8 else None


# --- embedded objects ---------------------------------------------------------------------

CARVED_SCHEMA = "offset long, magic string, payload binary, crc long, error string"


def fsb5_size(data: bytes, at: int) -> int:
    """Size of a sample bank: head by version, then three tables."""
    if at + 24 > len(data):
        return 0
    version, _, heads, names, body = struct.unpack_from("<5I", data, at + 4)
    base = {0: 0x40, 1: 0x3C}.get(version)
    return base + heads + names + body if base else 0


def sized_by_field(offset: int, form: str = "<I", plus: int = 0) -> Callable[[bytes, int], int]:
    def run(data: bytes, at: int) -> int:
        return struct.unpack_from(form, data, at + offset)[0] + plus if at + offset + struct.calcsize(form) <= len(data) else 0

    return run


def riff_size(data: bytes, at: int) -> int:
    return sized_by_field(4, "<I", 8)(data, at)


def carved(sizes: dict[bytes, Callable[[bytes, int], int]], step: int = 1, most: int | None = None) -> Callable[[bytes], Iterator[tuple]]:
    """Objects in unknown data: at each multiple of `step` a magic, then the size that its probe finds; the scan goes on after the object. A size of 0, or beyond the data, is no object."""

    def run(data: bytes) -> Iterator[tuple]:
        at = 0
        while at < len(data):
            spots = [x for x in (_find(data, m, at, step) for m in sizes) if x >= 0]
            if not spots:
                return
            at = min(spots)
            magic = next(m for m in sizes if data.startswith(m, at))
            size = sizes[magic](data, at)
            if not size or at + size > len(data) or most and size > most:
                at += step
                continue
            payload = data[at : at + size]
            yield (at, magic.decode("latin-1"), payload, zlib.crc32(payload))
            at += -(-size // step) * step
    return run


def _find(data: bytes, magic: bytes, at: int, step: int) -> int:
    while (at := data.find(magic, at)) >= 0 and at % step:
        at += 1
    return at


def first_copies(rows: DataFrame, key: str) -> DataFrame:
    """Carved rows less those whose checksum an earlier one of the file has."""
    first = rows.groupBy(key, "crc").agg(F.min("offset").alias("offset"))
    return rows.join(first, [key, "crc", "offset"], "left_semi")


def ogg_pages(data: bytes) -> Iterator[tuple]:
    """(offset, serial, sequence, flags, payload) of Ogg pages, wherever they lie; a page whose checksum fails is none."""
    at = 0
    while (at := data.find(b"OggS", at)) >= 0 and at + 27 <= len(data):
        _, version, flags, _, serial, seq, crc, n = struct.unpack_from("<4sBBqIIIB", data, at)
        lengths = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lengths)
        if version or len(lengths) < n or end > len(data) or _ogg_crc(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            at += 1
            continue
        yield (at, serial, seq, flags, data[at + 27 + n : end])
        at = end


PAGES_SCHEMA = "offset long, serial long, sequence long, flags int, payload binary, error string"
_ogg_table: list[int] = []


def _ogg_crc(data: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, highest bit first, without inversion."""
    if not _ogg_table:
        for i in range(256):
            c = i << 24
            for _ in range(8):
                c = (c << 1 ^ (0x04C11DB7 if c & 1 << 31 else 0)) & 0xFFFFFFFF
            _ogg_table.append(c)
    crc = 0
    for b in data:
        crc = crc << 8 & 0xFFFFFFFF ^ _ogg_table[crc >> 24 ^ b]
    return crc


# --- loop tables of fixed records ---------------------------------------------------

LOOPS_SCHEMA = "name string, looped boolean, loop_start long, loop_end long, error string"


def loop_records(kind: str, start: int = 0, count: int | None = None) -> Callable[[bytes], Iterator[tuple]]:
    """Records of loops: "boot" (id, name, flag, start, end), "dt" (start, length, number, id, flag; names are made of the number), "tbb" (start, name, id, flag, end). Records without a name go."""
    form = {"boot": "<H12sHii", "dt": "<iiIHH", "tbb": "<i12sHHi"}[kind]
    width = struct.calcsize(form)

    def run(data: bytes) -> Iterator[tuple]:
        n = count if count is not None else (len(data) - start) // width
        for i in range(n):
            x = struct.unpack_from(form, data, start + i * width)
            if kind == "dt":
                yield (f"ed{x[2]:04}", bool(x[4]), x[0], x[0] + x[1])
                continue
            name = x[1].strip(b"\0").decode()
            if name:
                yield (name, bool(x[2] if kind == "boot" else x[3]), x[3] if kind == "boot" else x[0], x[4])

    return run


# --- sections of sound definitions ----------------------------------------------------

SECTIONS_SCHEMA = "section string, idx int, parent int, kind string, offset long, a long, b long, text string, error string"


def sound_sections(data: bytes) -> Iterator[tuple]:
    """SXDF: sections of id and size behind a head of 0x60 bytes. Names (their hash, and what they name), waves and sequences (their places), tones (range) with subs (range) and items (a wave or a sequence), variables (their least and most in thousandths). Offsets count from the word that holds them."""
    if data[:4] != b"SXDF":
        raise ValueError("other signature")
    end, at = struct.unpack_from("<I", data, 8)[0], 0x60

    def text(place: int) -> str:
        stop = data.find(b"\0", place)
        return data[place : stop if stop >= 0 else len(data)].decode("utf-8", "replace")

    def tones(base: int, n: int) -> Iterator[tuple]:
        for i in range(n):
            place = base + 16 * i
            _, least, most, subs, rel = struct.unpack_from("<IHHII", data, place)
            yield ("TONE", i, None, "tone", place, least, most, None)
            for j in range(subs):
                sub = place + 12 + rel + 16 * j
                _, _, low, high, items, own = struct.unpack_from("<IHHHHI", data, sub)
                yield ("TONE", j, i, "sub", sub, low, high, None)
                for k in range(items):
                    item = sub + 12 + own + 12 * k
                    _, note, number, _, _ = struct.unpack_from("<HhIHH", data, item)
                    yield ("TONE", k, j, "seqd" if note < 0 else "wave", item, number, note, None)

    while at + 8 <= min(end, len(data)):
        name, size = data[at : at + 4].decode("latin-1"), struct.unpack_from("<I", data, at + 4)[0]
        n, base = struct.unpack_from("<I", data, at + 12)[0] if size >= 8 else 0, at + 16
        if name in ("NAME", "LVRN", "RXFN"):
            named = {"NAME": "reqd", "LVRN": "lvar", "RXFN": "rxdf"}[name]
            for i in range(n):
                rel, code, number = struct.unpack_from("<III", data, base + 12 * i)
                yield (name, i, None, named, base + 12 * i, code, number, text(base + 12 * i + rel))
        elif name == "TONE":
            yield from tones(base, n)
        elif name == "WAVE":
            for i in range(n):
                yield (name, i, None, "wave", base + 4 * i + struct.unpack_from("<I", data, base + 4 * i)[0], None, None, None)
        elif name == "SEQD":
            for i in range(n):
                place = base + 4 * i + struct.unpack_from("<I", data, base + 4 * i)[0]
                length, rel = struct.unpack_from("<II", data, place + 12)
                yield (name, i, None, "seqd", place + 16 + rel, length, None, None)
        elif name == "LVAR":
            for i in range(n):
                least, most = struct.unpack_from("<ff", data, base + 32 * i + 24)
                yield (name, i, None, "lvar", base + 32 * i, round(least * 1000), round(most * 1000), None)
        at += 8 + size


def block_runs(head: int = 0x48, body: int = 0x44, tail: int = 0x45) -> Callable[[bytes], Iterator[tuple]]:
    """Runs of blocks (a flag byte, 24 bits of size, big-endian) in unknown data, found every 4 bytes: a head of under 0xFF bytes, bodies, a tail. A run that another flag breaks ends there."""

    def run(data: bytes) -> Iterator[tuple]:
        at, part, begin = 0, 0, None
        while at + 4 <= len(data):
            word = int.from_bytes(data[at : at + 4], "big")
            flag, size = word >> 24, word & 0xFFFFFF
            if begin is None:
                if flag == head and 4 <= size < 0xFF:
                    begin, at = at, at + size
                else:
                    at += 4
                continue
            if flag in (head, body, tail) and size >= 4:
                at += size
                if flag != tail:
                    continue
                stop = at
            else:
                stop, at = at, at + 4
            yield (part, begin, data[begin:stop])
            part, begin = part + 1, None
        if begin is not None:
            yield (part, begin, data[begin:])

    return run


def bitpacked_head(data: bytes, at: int = 0) -> bool:
    """Whether bit-packed audio may begin there: a version's page head, then version, channels and rate that go together."""
    if len(data) - at < 0x50:
        return False
    if data[at] == 0x48 and not any(data[at + 1 : at + 10]):
        version, at = 1, at + 10
    elif data[at] == 8:
        version, at = 0, at + 1
    else:
        return False
    head = int.from_bytes(data[at : at + 2], "big")
    return head >> 14 == version and head >> 11 & 7 != 0 and not (head >> 9 & 3 == 3 and head >> 1 & 0xFF > 10)


def carved_valid(plausible: Callable[[bytes, int], bool], size_of: Callable[[bytes, int], int], step: int = 1) -> Callable[[bytes], Iterator[tuple]]:
    """Objects in unknown data without a mark: at each multiple of `step` a test of plausibility, then one that reads the whole object and tells its size, 0 for none. The scan goes on after an object."""

    def run(data: bytes) -> Iterator[tuple]:
        at = 0
        while at < len(data):
            size = size_of(data, at) if plausible(data, at) else 0
            if size <= 0 or at + size > len(data):
                at += step
                continue
            payload = data[at : at + size]
            yield (at, "", payload, zlib.crc32(payload))
            at += -(-size // step) * step

    return run


# --- msgpack --------------------------------------------------------------------------------

JSON_SCHEMA = "json string, error string"


def msgpack_value(data: bytes, at: int = 0) -> tuple[object, int]:
    """(value, next offset) of a msgpack item; bytes become hex text, extensions their hex."""
    t = data[at]
    at += 1
    if t < 0x80:
        return t, at
    if t >= 0xE0:
        return t - 256, at

    def number(form: str) -> tuple[object, int]:
        return struct.unpack_from(form, data, at)[0], at + struct.calcsize(form)

    if t <= 0x8F or t in (0xDE, 0xDF):
        n, at = (t & 15, at) if t <= 0x8F else number(">H" if t == 0xDE else ">I")
        out = {}
        for _ in range(n):
            k, at = msgpack_value(data, at)
            out[k if isinstance(k, str) else json.dumps(k)], at = msgpack_value(data, at)
        return out, at
    if t <= 0x9F or t in (0xDC, 0xDD):
        n, at = (t & 15, at) if t <= 0x9F else number(">H" if t == 0xDC else ">I")
        items = []
        for _ in range(n):
            v, at = msgpack_value(data, at)
            items.append(v)
        return items, at
    if t <= 0xBF or 0xD9 <= t <= 0xDB:
        n, at = (t & 31, at) if t <= 0xBF else number({0xD9: ">B", 0xDA: ">H", 0xDB: ">I"}[t])
        return data[at : at + n].decode("utf-8", "replace"), at + n
    if t in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[t], at
    if 0xC4 <= t <= 0xC6:
        n, at = number({0xC4: ">B", 0xC5: ">H", 0xC6: ">I"}[t])
        return data[at : at + n].hex(), at + n
    if 0xC7 <= t <= 0xC9 or 0xD4 <= t <= 0xD8:
        n, at = number({0xC7: ">B", 0xC8: ">H", 0xC9: ">I"}[t]) if t <= 0xC9 else (1 << (t - 0xD4), at)
        return data[at + 1 : at + 1 + n].hex(), at + 1 + n
    forms = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
    if t in forms:
        return number(forms[t])
    raise ValueError(f"msgpack type {t:02x}")


def msgpack(data: bytes) -> Iterator[tuple]:
    value, _ = msgpack_value(data)
    yield (json.dumps(value, ensure_ascii=False),)


PARSERS: dict[str, tuple[Callable[[bytes], Iterator[tuple]], str]] = {
    "tlv": (messages, TLV_SCHEMA),
    "external_tags": (external_tags, TAGS_SCHEMA),
    "sound_bank": (sound_bank, BANK_SCHEMA),
    "bank_details": (bank_details, DETAILS_SCHEMA),
    "wave_container": (wave_container, WAVES_SCHEMA),
    "trailing_strings": (trailing_strings, STRINGS_SCHEMA),
    "sized_names": (sized_names, STRINGS_SCHEMA),
    "wrapped_asset": (wrapped_asset, ASSET_SCHEMA),
    "fsb5_carve": (carved({b"FSB5": fsb5_size}), CARVED_SCHEMA),
    "riff_carve": (carved({b"RIFF": riff_size}, 4), CARVED_SCHEMA),
    "ogg_pages": (ogg_pages, PAGES_SCHEMA),
    "msgpack": (msgpack, JSON_SCHEMA),
    "chunked_asset": (chunked_asset, CUT_SCHEMA),
    "padded_chunks": (padded_chunks, CUT_SCHEMA),
    "silent_cuts": (silent_cuts(), CUT_SCHEMA),
    "sound_sections": (sound_sections, SECTIONS_SCHEMA),
    "block_runs": (block_runs(), CUT_SCHEMA),
    "loop_records_dt": (loop_records("dt"), LOOPS_SCHEMA),
    "loop_records_tbb": (loop_records("tbb"), LOOPS_SCHEMA),
}


def read(files: DataFrame, kind: str, path: str = "path", content: str = "content") -> DataFrame:
    """Rows of a named parser over blobs."""
    parser, schema = PARSERS[kind]
    return parsed(files, path, content, parser, schema)
