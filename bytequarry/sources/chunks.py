"""Chunk streams: a blob to ordered chunks (seq, id, channel, type, payload)."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import gathered

SCHEMA = "seq int, offset long, id string, channel int, type long, payload binary, error string"
_TYPES = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
Chunk = tuple[str, int, int, int, int, int]  # id, channel, type, payload's begin and end, next chunk


@dataclass(frozen=True)
class Dialect:
    """How to read the chunk at an offset; None ends the stream. keep: ids whose payloads are cut out, others are passed over."""

    read: Callable[[bytes, int, bool], Chunk | None]
    big: Callable[[bytes], bool] = lambda data: False
    start: int = 0
    keep: tuple[str, ...] = ()
    spans: Callable[[bytes], Iterator[tuple[str, int, int, int, int]]] | None = None  # (id, channel, type, begin, end), where a table or the file's head rules


def _trimmed(data: bytes, at: int, big: bool) -> Chunk | None:
    """Big-endian head: id, size of the rest, bytes to skip, padding, channel, type."""
    if at + 16 > len(data):
        return None
    magic, size, skip, pad, channel, _, kind = struct.unpack_from(">4sIHHBBH", data, at)
    end = at + 8 + size
    return magic.decode("latin-1"), channel, kind, at + 8 + skip, min(end - pad, len(data)), end


def _blocks(data: bytes, at: int, big: bool) -> Chunk | None:
    """Head of four words: type, size with the head, unused, id; type 0 is 16 bytes of padding."""
    if at + 16 > len(data):
        return None
    kind, size, _, number = struct.unpack_from(">4I" if big else "<4I", data, at)
    if kind and size < 16:
        raise ValueError("bad block size")
    size = 16 if kind == 0 else size
    return f"{kind:08x}", 0, number, at + 16, min(at + size, len(data)), at + size


def _tagged(ids: tuple[str, ...], with_head: bool = True, align: int = 1):
    """Id and size words; other ids, or a size of 0, end the stream."""

    def read(data: bytes, at: int, big: bool) -> Chunk | None:
        if at + 8 > len(data):
            return None
        name, size = data[at : at + 4].decode("latin-1"), struct.unpack_from(">I" if big else "<I", data, at + 4)[0]
        if not size or ids and name not in ids or with_head and size < 8:
            return None
        end = at + (size if with_head else size + 8)
        return name, 0, 0, at + 8, min(end, len(data)), -(-end // align) * align

    return read


def _guessed(data: bytes, at: int, big: bool) -> Chunk | None:
    """Id and size words, the size in the byte order that makes it smaller; an id or a size of 0 ends the stream. The payload is the whole chunk."""
    if at + 8 > len(data):
        return None
    raw = data[at + 4 : at + 8]
    size = min(int.from_bytes(raw, "big"), int.from_bytes(raw, "little"))
    if not size or not any(data[at : at + 4]):
        return None
    return data[at : at + 4].decode("latin-1"), 0, 0, at, min(at + size, len(data)), at + size


SECTOR = 0x930


def _sectors(data: bytes, at: int, big: bool) -> Chunk | None:
    """0x930-byte sectors whose word at 0x10 is file, channel, submode, coding; type is that word."""
    if at + SECTOR > len(data):
        return None
    word = int.from_bytes(data[at + 16 : at + 20], "big")
    return f"{word >> 24:02x}", word >> 16 & 255, word, at, at + SECTOR, at + SECTOR


def _id_then_u24(data: bytes, at: int, big: bool) -> Chunk | None:
    """One byte of id, three of size."""
    if at + 4 > len(data):
        return None
    size = int.from_bytes(data[at + 1 : at + 4], "little")
    return f"{data[at]:02x}", 0, 0, at + 4, min(at + 4 + size, len(data)), at + 4 + size


def _pairs(data: bytes, at: int, big: bool) -> Chunk | None:
    """Sizes of a video and an audio part, then both; the audio part is the payload, the video part's size the type."""
    if at + 8 > len(data):
        return None
    video, audio = struct.unpack_from("<II", data, at)
    begin = at + 8 + video
    return "audi", 0, video, begin, min(begin + audio, len(data)), begin + audio


_smaller_big = lambda data: len(data) >= 8 and int.from_bytes(data[4:8], "big") < int.from_bytes(data[4:8], "little")
# The chunk ids of the dialects.
TRIMMED = Dialect(_trimmed)
BLOCKS = Dialect(_blocks, _smaller_big)
SECTORS = Dialect(_sectors)
SCHL = Dialect(_tagged(("SCHl", "SCCl", "SCDl", "SCEl", "SHEN", "SCEN", "SDEN", "SEEN", "MVhd", "MVIh", "kVGT", "MADk", "MADm", "MADe", "fVGT", "pQGT", "TGVk", "TGVf", "MPCh", "pIQT", "AVP6", "AVhd", "AV0K", "AV0F", "MV0K", "MV0F")), keep=("SCHl", "SCCl", "SCDl", "SCEl"))
SNH1 = Dialect(_tagged(("1SNh", "1SNl", "1SNd", "1SNe", "kVGT", "fVGT", "MADk", "MADm", "MADe", "uVGT", "TGVk", "TGVf")), keep=("1SNh", "1SNl", "1SNd", "1SNe"))
RIFF_CHUNKS = Dialect(_tagged((), False, 2), start=12)
BYTE_CHUNKS = Dialect(_id_then_u24)
VIDEO_AUDIO_PAIRS = Dialect(_pairs)
XA10, AD10, AU00 = (Dialect(_guessed, keep=ids) for ids in (("Xa10",), ("Ad10", "Ad11"), ("VLC0", "au00", "au01")))


def _film(data: bytes) -> Iterator[tuple[str, int, int, int, int]]:
    """Head with an FDSC and an STAB chunk; the table's entries are offset, size and two words, of which all ones marks audio."""
    if data[:4] != b"FILM" or data[16:20] != b"FDSC":
        raise ValueError("other signature")
    at = 16 + struct.unpack_from(">I", data, 20)[0]
    if data[at : at + 4] != b"STAB":
        raise ValueError("no sample table")
    size, _, n = struct.unpack_from(">III", data, at + 4)
    base = at + 16 + size
    for i in range(n):
        offset, length, info, _ = struct.unpack_from(">4I", data, at + 16 + 16 * i)
        yield ("audi" if info == 0xFFFFFFFF else "vide", 0, info, base + offset, base + offset + length)


def _mul(data: bytes) -> Iterator[tuple[str, int, int, int, int]]:
    """A head of 0x800 or 0x2000 bytes, then blocks of type and size, padded to 16, behind a head of 16; type 0 is audio. The file's head goes with the audio."""
    big = int.from_bytes(data[:4], "big") < int.from_bytes(data[:4], "little")
    head = next((h for h in (0x800, 0x2000) if any(data[h : h + 8])), None)
    if head is None:
        raise ValueError("unknown start")
    yield "head", 0, 0, 0, head
    at = head
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(">II" if big else "<II", data, at)
        size = -(-size // 16) * 16 + 16
        yield ("audi" if kind == 0 else "vide", 0, kind, at, min(at + size, len(data)))
        at += size


def _xav(data: bytes) -> Iterator[tuple[str, int, int, int, int]]:
    """XAVS: a head of 0x18 bytes, then chunks of one byte of id and three of size; ids A, a and b are audio, 0x5F ends."""
    if data[:4] != b"XAVS":
        raise ValueError("other signature")
    yield "head", 0, 0, 0, 0x18
    at = 0x18
    while at + 4 <= len(data):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "little")
        size = 4 if kind in (0x21, 0x5F) else size + 4
        if kind not in (0x41, 0x61, 0x62, 0x56, 0x21, 0x5F):
            raise ValueError("unknown chunk")
        yield ("vide" if kind in (0x56, 0x21) else "audi", 0, kind, at, min(at + size, len(data)))
        at += size


def _ipus(data: bytes) -> Iterator[tuple[str, int, int, int, int]]:
    """IPUS: frames of a fixed size, each with the sizes of its video and audio parts."""
    if data[:4] != b"IPUS":
        raise ValueError("other signature")
    frame, test = struct.unpack_from("<II", data, 12)
    at = {1: 0x14, 0x40: 0x40}.get(test)
    if at is None or not frame:
        raise ValueError("unknown format")
    while at + 8 <= len(data):
        video, audio = struct.unpack_from("<II", data, at)
        yield "vide", 0, 0, at + 0x40, at + 0x40 + video
        if audio:
            yield "audi", 0, 0, at + 0x40 + video, at + 0x40 + video + audio
        at += frame


def _smv(data: bytes) -> Iterator[tuple[str, int, int, int, int]]:
    """Blocks that name the size of the next one (the first has 0x800), their video's size, and their audio's place and size."""
    at, size = 0, 0x800
    while at + 16 <= len(data) and size:
        after, video, place, audio = struct.unpack_from("<4I", data, at)
        if video:
            yield "vide", 0, 0, at + 16, at + 16 + video
        if audio:
            yield "audi", 0, 0, at + place, at + place + audio
        at, size = at + size, after


def _smk(data: bytes) -> Iterator[tuple[str, int, int, int, int]]:
    """Tables of frame sizes (two flag bits) and frame types behind a head of 0x68 bytes; a frame has a palette if bit 0 says so, then an audio packet for each of bits 1 to 7."""
    if data[:3] != b"SMK":
        raise ValueError("other signature")
    n, trees = struct.unpack_from("<I", data, 12)[0], struct.unpack_from("<I", data, 0x34)[0]
    sizes, kinds = struct.unpack_from(f"<{n}I", data, 0x68), data[0x68 + 4 * n : 0x68 + 5 * n]
    at = 0x68 + 5 * n + trees
    for size, kind in zip(sizes, kinds, strict=True):
        spot = at + (4 * data[at] if kind & 1 else 0)
        for track in range(7):
            if kind >> (track + 1) & 1:
                length = struct.unpack_from("<I", data, spot)[0]
                yield "audi", track, kind, spot, spot + length
                spot += length
        at += size & ~3
        yield "vide", 0, kind, spot, at


def _bink(data: bytes) -> Iterator[tuple[str, int, int, int, int]]:
    """Head with the number of frames and tracks, then frame offsets whose lowest bit marks key frames; a frame begins with a size and packet for each track."""
    if data[:3] not in (b"BIK", b"KB2"):
        raise ValueError("other signature")
    second = data[:3] == b"KB2" and data[3] >= 0x69
    frames, flags, tracks = struct.unpack_from("<I", data, 8)[0], *struct.unpack_from("<II", data, 0x24)
    at = 0x2C + (12 if flags & 4 else 0) + (24 if flags & 0x10000 else 0) + 4 * second + 8 * tracks
    ids = struct.unpack_from(f"<{tracks}I", data, at)
    offsets = [x & ~1 for x in struct.unpack_from(f"<{frames + 1}I", data, at + 4 * tracks)]
    for begin, end in zip(offsets, offsets[1:], strict=False):
        for number in ids:
            size = struct.unpack_from("<I", data, begin)[0]
            yield "audi", number, 0, begin + 4, begin + 4 + size
            begin += 4 + size
        yield "vide", 0, 0, begin, end


def _siff(data: bytes) -> Iterator[tuple[str, int, int, int, int]]:
    """Big-endian heads up to the body, then little-endian blocks of size and flags: 1 four bytes of motion, 4 an audio part whose size counts its own four bytes; what is left is video."""
    if data[:4] != b"SIFF" or data[8:16] != b"VBV1VBHD":
        raise ValueError("other signature")
    at = 0x1C + struct.unpack_from(">I", data, 0x10)[0]
    yield "head", 0, 0, 0, at
    while at + 6 <= len(data):
        size, flags = struct.unpack_from("<IH", data, at)
        if flags & 2 or size < 6:
            raise ValueError("unknown flag")
        begin = at + 6 + (4 if flags & 1 else 0)
        if flags & 4:
            length = struct.unpack_from("<I", data, begin)[0]
            yield "audi", 0, flags, begin + 4, begin + length
            begin += length
        if begin < at + size:
            yield "vide", 0, flags, begin, min(at + size, len(data))
        at += size


def _str(data: bytes) -> Iterator[tuple[str, int, int, int, int]]:
    """A head of 0x800 bytes with the sizes of the first video group and of audio blocks, then audio and video by turns; a group names the next one's size."""
    if data[:4] != b"str\0":
        raise ValueError("other signature")
    video, block, first = struct.unpack_from("<I", data, 0x18)[0], *struct.unpack_from("<II", data, 0x2C)
    if not video or not block or not first:
        raise ValueError("no video, or no audio")
    yield "head", 0, 0, 0, 0x800
    at, audio = 0x800, first
    while at < len(data):
        yield "audi", 0, 0, at, min(at + audio, len(data))
        at += audio
        if at >= len(data):
            return
        if data[at : at + 15] != b"GroupOfDataInfo" or not video:
            raise ValueError("no group of data")
        after = struct.unpack_from("<I", data, at + 0x28)[0]
        yield "vide", 0, 0, at, min(at + video, len(data))
        at, video, audio = at + video, after, block


def _vid1(order: str):
    def spans(data: bytes) -> Iterator[tuple[str, int, int, int, int]]:
        """A head of 0x20 bytes and one of 12, chunks VIDH and AUDH, then frames: a head of 0x20 bytes and chunks of id and size, of which AUDD is audio."""
        word = lambda at: struct.unpack_from(order + "I", data, at)[0]
        mark = lambda x: x if order == ">" else x[::-1]
        if data[:4] != mark(b"VID1") or data[0x2C:0x30] != mark(b"VIDH"):
            raise ValueError("other signature")
        at = 0x2C + word(0x30)
        if data[at : at + 4] != mark(b"AUDH"):
            raise ValueError("no audio")
        after = at + word(at + 4)
        yield "head", 0, 0, at, after
        at = after
        while at + 8 <= len(data):
            name, size = mark(data[at : at + 4]), word(at + 4)
            if name == b"FRAM":
                at += 0x20
                continue
            if size < 8:
                return
            yield ("audi" if name == b"AUDD" else "vide", 0, 0, at, min(at + size, len(data)))
            at += size

    return spans


def _hvqm4(data: bytes) -> Iterator[tuple[str, int, int, int, int]]:
    """A head of 0x44 bytes, then blocks that name the size of the one before, their own, and the number of their frames; a frame has type (0 audio), format and size, audio a count of samples first and its tracks one after the other."""
    if data[:6] != b"HVQM4 " or data[6:9] not in (b"1.3", b"1.5") or struct.unpack_from(">I", data, 0x10)[0] != 0x44:
        raise ValueError("other signature")
    blocks, tracks = struct.unpack_from(">I", data, 0x18)[0], 1 + data[0x3F]
    yield "head", 0, 0, 0, 0x44
    at, last = 0x44, 0
    for _ in range(blocks):
        before, size, videos, audios, flags = struct.unpack_from(">5I", data, at)
        if before != last or flags not in (0, 0x01000000):
            raise ValueError("bad block")
        at, last = at + 20, size
        for _ in range(videos + audios):
            kind, form, length = struct.unpack_from(">HHI", data, at)
            at += 8
            if kind == 0:
                part, rest = divmod(length - 4, tracks)
                if rest:
                    raise ValueError("audio of uneven tracks")
                for t in range(tracks):
                    yield "audi", t, form, at + 4 + part * t, at + 4 + part * (t + 1)
            else:
                yield "vide", 0, form, at, at + length
            at += length


#: Sizes of the packets of discs, of the audio frames at their ends, and of what counts of a frame.
PACKET, FRAME, HEARD = 0x4400, 0x600, 0x41C


def _packets(data: bytes) -> Iterator[tuple[str, int, int, int, int]]:
    """Packets of one size that end with an audio frame for each of two channels."""
    for at in range(0, len(data), PACKET):
        audio = at + PACKET - 2 * FRAME
        yield "vide", 0, 0, at, min(audio, len(data))
        for channel in (0, 1):
            begin = audio + FRAME * channel
            if begin < len(data):
                yield "audi", channel, 0, begin, min(begin + HEARD, len(data))


FILM, MUL, XAV, IPUS, SMV, SMK, BINK, SIFF, STR, VID1, VID1_LE, HVQM4, PACKETS = (Dialect(_trimmed, spans=f) for f in (_film, _mul, _xav, _ipus, _smv, _smk, _bink, _siff, _str, _vid1(">"), _vid1("<"), _hvqm4, _packets))
#: Dialects by name.
DIALECTS = {"trimmed": TRIMMED, "blocks": BLOCKS, "sectors": SECTORS, "schl": SCHL, "snh1": SNH1, "riff": RIFF_CHUNKS, "bytes": BYTE_CHUNKS, "pairs": VIDEO_AUDIO_PAIRS, "film": FILM, "mul": MUL, "xav": XAV, "ipus": IPUS, "smv": SMV, "smk": SMK, "bink": BINK, "siff": SIFF, "str": STR, "vid1": VID1, "vid1_le": VID1_LE, "xa10": XA10, "ad10": AD10, "au00": AU00, "packets": PACKETS, "hvqm4": HVQM4}


def read_chunks(data: bytes, dialect: Dialect) -> Iterator[tuple]:
    if dialect.spans:
        seq = 0
        try:
            for seq, (name, channel, kind, begin, end) in enumerate(dialect.spans(data)):
                yield (seq, begin, name, channel, kind, data[begin:end], None)
        except (ValueError, struct.error) as e:
            yield (seq, 0, None, None, None, None, str(e))
        return
    big, at, seq = dialect.big(data), dialect.start, 0
    while at < len(data):
        try:
            got = dialect.read(data, at, big)
        except ValueError as e:
            yield (seq, at, None, None, None, None, str(e))
            return
        if got is None:
            return
        name, channel, kind, begin, end, after = got
        take = not dialect.keep or name in dialect.keep
        yield (seq, at, name, channel, kind, data[begin:end] if take else None, None)
        if after <= at:
            return
        at, seq = after, seq + 1


def walk(files: DataFrame, path: str, content: str, dialect: Dialect | str) -> DataFrame:
    """One row per chunk: path and SCHEMA. Order is in seq. A bad chunk ends its file with one row of error. dialect: one, or the column that holds the name of one."""
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = (DIALECTS[x.as_py()] for x in b.column("dialect")) if isinstance(dialect, str) else repeat(dialect, b.num_rows)
            rows = ((k.as_py(), *row) for k, data, form in zip(b.column(0), b.column(1), forms, strict=True) if data.is_valid for row in read_chunks(data.as_py(), form))
            yield from gathered(rows, [b.schema.field(0).type, *_TYPES], [path, *names])

    kind = files.schema[path].dataType.simpleString()
    return files.select(F.col(path), F.col(content), *([F.col(dialect).alias("dialect")] if isinstance(dialect, str) else [])).mapInArrow(run, f"{path} {kind}, {SCHEMA}")


def build_trimmed(chunks: list[tuple[str, int, int, bytes]], skip: int = 0x18, align: int = 32) -> bytes:
    """The TRIMMED form of (id, channel, type, payload)."""
    out = b""
    for name, channel, kind, payload in chunks:
        pad = -(8 + skip + len(payload)) % align
        out += struct.pack(">4sIHHBBH", name.encode("latin-1"), skip + len(payload) + pad, skip, pad, channel, 0, kind) + bytes(skip - 8) + payload + bytes(pad)
    return out


def packed(df: DataFrame, path: str, seq: str, channel: str, payload: str, name: str = "@SFA") -> DataFrame:
    """(path, content): payloads of each path in order as one TRIMMED stream."""
    run = F.udf(lambda items: build_trimmed([(name, x["c"], 0, bytes(x["p"])) for x in items]), "binary")
    rows = df.groupBy(path).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(channel).alias("c"), F.col(payload).alias("p")))).alias("x"))
    return rows.select(path, run("x").alias("content"))
