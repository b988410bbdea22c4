"""Directories that a Layout can't say: names made of what the payload shows, several tables, checks, ciphers.

A reader takes the directory's bytes and the body's (the same where one file
holds both) and yields entries (name, offset, size, packed size, codec). It
raises ValueError where the data is not of its kind. The values here are fixed
values of the formats. Assemblers at the end give payloads that lie in many
pieces.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

Entry = tuple[str, int, int, int, str]
Reader = Callable[[bytes, bytes], Iterator[Entry]]
READERS: dict[str, Reader] = {}


def reader(f: Reader) -> Reader:
    READERS[f.__name__] = f
    return f


def _plain(name: str, offset: int, size: int) -> Entry:
    return name, offset, size, size, "copy"


def _text(data: bytes, at: int, size: int | None = None) -> str:
    """Text up to its NUL, in a field of `size` bytes if given."""
    if not 0 <= at <= len(data):
        raise ValueError("text out of the data")
    end = data.find(b"\0", at, len(data) if size is None else at + size)
    return data[at : end if end >= 0 else len(data) if size is None else at + size].decode("utf-8", "replace")


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def _smaller_order(data: bytes, at: int) -> str:
    """The byte order that makes a word smaller."""
    return ">" if struct.unpack_from(">I", data, at)[0] < struct.unpack_from("<I", data, at)[0] else "<"


@reader
def cave_bin(data: bytes, body: bytes) -> Iterator[Entry]:
    """Records of 0x114 bytes: full size, packed size, offset, name; packed size 0: stored, unequal: packed by an own scheme, equal: none."""
    order = {b"\x17\x01\x09\xc0": "<", b"\xc0\x09\x01\x17": ">"}.get(data[:4])
    _need(order is not None, "other signature")
    for i in range(struct.unpack_from(order + "I", data, 12)[0]):
        full, packed, offset = struct.unpack_from(order + "3I", data, 0x24 + 0x114 * i + 4)
        name = _text(data, 0x24 + 0x114 * i + 16, 0x104)
        if not packed:
            yield _plain(name, offset, full)
        elif packed != full:
            yield _plain(f"{name}.z", offset, packed)


@reader
def entis_noa(data: bytes, body: bytes) -> Iterator[Entry]:
    """Entries behind "DirEntry" at 0x40; each names a chunk "filedata" of its own size, whose content follows its head of 16 bytes."""
    _need(data[:5] == b"Entis" and data[0x10:0x22] == b"ERISA-Archive file" and data[0x40:0x48] == b"DirEntry", "other signature")
    at = 0x54
    for _ in range(struct.unpack_from("<I", data, 0x50)[0]):
        size, _, offset, _, _, n = struct.unpack_from("<4Q2I", data, at)
        name, at = _text(data, at + 40, n), at + 40 + n
        spot = offset + 0x40
        _need(body[spot : spot + 8] == b"filedata" and struct.unpack_from("<Q", body, spot + 8)[0] == size, "chunk of another size")
        yield _plain(name, spot + 16, size)


@reader
def platinum_pkz(data: bytes, body: bytes) -> Iterator[Entry]:
    """Records of 0x20 bytes; names and the packers' names lie behind them."""
    _need(data[:4] == b"pkzl", "other signature")
    n, start = struct.unpack_from("<II", data, 0x10)
    codecs = {"ZStandard": "zstd", "None": "copy", "OodleKraken": "oodle"}
    for i in range(n):
        name, kind, full, offset, packed = struct.unpack_from("<IIQQQ", data, start + 0x20 * i)
        packer = _text(data, start + 0x20 * n + kind)
        _need(packer in codecs, f"packer {packer}")
        yield _text(data, start + 0x20 * n + name), offset, full, packed, codecs[packer]


@reader
def torus_pak(data: bytes, body: bytes) -> Iterator[Entry]:
    """Records of checksum, offset and size; a payload that begins with !ZLS is deflated behind its full size, and its kind shows once it is unpacked."""
    _need(data[:4] == b"PAK\0", "other signature")
    order = _smaller_order(data, 4)
    for i in range(struct.unpack_from(order + "I", data, 4)[0]):
        crc, offset, size = struct.unpack_from(order + "3I", data, 8 + 12 * i)
        if body[offset : offset + 4] != b"!ZLS":
            yield _plain(f"{i:08}_{crc:08x}.dat", offset, size)
            continue
        full = struct.unpack_from("<I", body, offset + 4)[0]
        try:
            head = zlib.decompressobj().decompress(body[offset + 8 : offset + size], 8)
        except zlib.error:
            head = b""
        ext = "file" if head[:4] == b"maxa" else "hnk" if head[4:8] == b"\x70\x00\x04\x00" else "zdat"
        yield f"{i:08}_{crc:08x}.{ext}", offset + 8, full, size - 8, "zlib"


@reader
def redspark_pack(data: bytes, body: bytes) -> Iterator[Entry]:
    """Big-endian offsets and sizes; a nested pack is rsp, what follows one is bin, the others are rsd."""
    _need(data[:4] == b"PACK", "other signature")
    nested = False
    for i in range(struct.unpack_from(">I", data, 4)[0]):
        offset, size = struct.unpack_from(">II", data, 8 + 8 * i)
        pack = body[offset : offset + 4] == b"PACK"
        yield _plain(f"{i:02}.{'rsp' if pack else 'bin' if nested else 'rsd'}", offset, size)
        nested = nested or pack


@reader
def cavia_fpk(data: bytes, body: bytes) -> Iterator[Entry]:
    """Records of 16 bytes with an extension in reversed characters."""
    _need(data[:4] == b"fpk\0", "other signature")
    n, table, base = struct.unpack_from("<I", data, 8)[0], struct.unpack_from("<I", data, 0x14)[0], struct.unpack_from("<I", data, 0x28)[0]
    for i in range(n):
        _, offset, size, ext = struct.unpack_from("<3I4s", data, table + 16 * i)
        yield _plain(f"{i:04}.{ext.rstrip(bytes(1))[::-1].decode('latin-1') if ext.strip(bytes(1)) else 'bin'}", offset + base, size)


@reader
def fpk(data: bytes, body: bytes) -> Iterator[Entry]:
    """Records of 0x30 bytes; sizes that differ mark a packed payload."""
    for i in range(struct.unpack_from("<I", data, 4)[0]):
        at = 0x10 + 0x30 * i
        _, offset, packed, size = struct.unpack_from("<4I", data, at + 0x20)
        name = _text(data, at, 0x20)
        yield _plain(name if packed == size else f"{name}.z", offset, size)


@reader
def irem_fat(data: bytes, body: bytes) -> Iterator[Entry]:
    """Records of 12 or 16 bytes, as the place of the names tells; empty ones go."""
    _need(data[:4] == b"FAT ", "other signature")
    n = struct.unpack_from("<I", data, 4)[0]
    table, names, base = struct.unpack_from("<3I", data, 0xF4)
    width = (names - table) // max(1, n)
    _need(width in (12, 16) or not n, "unknown format")
    for i in range(n):
        offset, size = struct.unpack_from("<II", data, table + width * i)
        if size:
            yield _plain(_text(data, struct.unpack_from("<I", data, table + width * (i + 1) - 4)[0]), offset + base, size)


@reader
def premium_agency_pa(data: bytes, body: bytes) -> Iterator[Entry]:
    """Records of name and size, and an array of offsets beside them."""
    _need(data[:4] == b"PAA\0", "other signature")
    n, table, offsets = struct.unpack_from("<3I", data, 8)
    for i in range(n):
        name, size = struct.unpack_from("<II", data, table + 16 * i)
        yield _plain(_text(data, name), struct.unpack_from("<I", data, offsets + 4 * i)[0], size)


@reader
def capcom_sspr(data: bytes, body: bytes) -> Iterator[Entry]:
    """Records of name, offset, name's size and size; little-endian files hold at9, others at3."""
    _need(data[:4] == b"SSPR", "other signature")
    order = _smaller_order(data, 4)
    for i in range(struct.unpack_from(order + "I", data, 8)[0]):
        name, offset, n, size = struct.unpack_from(order + "4I", data, 0x10 + 16 * i)
        yield _plain(_text(data, name, n) + (".at9" if order == "<" else ".at3"), offset, size)


@reader
def capcom_arc(data: bytes, body: bytes) -> Iterator[Entry]:
    """Big-endian records of 0x50 bytes; a payload that begins with MSFC is msf."""
    _need(data[:4] == b"\0CRA", "other signature")
    for i in range(struct.unpack_from(">H", data, 6)[0]):
        at = 8 + 0x50 * i
        _, size, _, offset = struct.unpack_from(">4I", data, at + 0x40)
        yield _plain(_text(data, at, 0x40) + (".msf" if body[offset : offset + 4] == b"MSFC" else ".bin"), offset, size)


@reader
def platinum_dat(data: bytes, body: bytes) -> Iterator[Entry]:
    """Four arrays by pointers; names of one length that stands before them; .z entries are deflated, whose full size nothing tells."""
    _need(data[:4] == b"DAT\0", "other signature")
    order = _smaller_order(data, 4)
    n, offsets, _, names, sizes = struct.unpack_from(order + "5I", data, 4)
    width = struct.unpack_from(order + "I", data, names)[0]
    for i in range(n):
        name = _text(data, names + 4 + width * i, width)
        size = struct.unpack_from(order + "I", data, sizes + 4 * i)[0]
        ext = name.rpartition(".")[2]
        yield name + (".wdat" if ext == "dat" else ""), struct.unpack_from(order + "I", data, offsets + 4 * i)[0], size, size, "zlib" if ext == "z" else "copy"


@reader
def harmonix_ark(data: bytes, body: bytes) -> Iterator[Entry]:
    """Version 2: records, names, name offsets in one file; version 3: names, name offsets, records of a file of their own. A record: offset, its name's and its folder's place, size, full size."""
    version = struct.unpack_from("<I", data, 0)[0]
    if version == 2:
        n, table = struct.unpack_from("<I", data, 4)[0], 8
        names = 8 + 20 * n
        places = names + 8 + struct.unpack_from("<I", data, names)[0]
    elif version == 3:
        names = 16
        places = names + 8 + struct.unpack_from("<I", data, names)[0]
        table = places + 4 * struct.unpack_from("<I", data, places - 4)[0]
        n, table = struct.unpack_from("<I", data, table)[0], table + 4
    else:
        raise ValueError(f"version {version}")
    word = lambda i: _text(data, names + 4 + struct.unpack_from("<I", data, places + 4 * i)[0])
    for i in range(n):
        offset, file, folder, size, _ = struct.unpack_from("<5I", data, table + 20 * i)
        yield _plain(f"{word(folder)}/{word(file)}", offset, size)


@reader
def gt_lib(data: bytes, body: bytes) -> Iterator[Entry]:
    """Records of 0x30 bytes; the size stands in the payload's own head, at a place that the kind tells."""
    _need(data[:4] == b"BGML", "other signature")
    n, start = struct.unpack_from("<II", data, 0x10)
    for i in range(n):
        name, kind, _, _, offset = struct.unpack_from("<5I", data, start + 0x30 * i)
        ext, at = {3: ("sxd1", 8), 0x103: ("sxd1", 8), 4: ("szd1", 4), 0x104: ("szd1", 4)}.get(kind, (None, 0))
        _need(ext is not None, f"kind {kind:x}")
        yield _plain(f"{_text(data, name)}.{ext}", offset, struct.unpack_from("<I", body, offset + at)[0])


@reader
def dat_nr(data: bytes, body: bytes) -> Iterator[Entry]:
    """Directory and payloads with their nibbles swapped; codec `nibbles` turns a payload back."""
    n, width, _ = struct.unpack_from("<3I", data, 0)
    _need(12 <= width <= 64 and 12 + n * width <= len(data), "records out of the data")
    table = swapped_nibbles(data[12 : 12 + n * width])
    for i in range(n):
        _, size, offset = struct.unpack_from("<3I", table, width * i)
        yield f"{i:02}.", offset, size, size, "nibbles"


@reader
def sec_dat(data: bytes, body: bytes) -> Iterator[Entry]:
    """Sector numbers; the size stands in the payload's second word and is filled to a sector."""
    for i in range(len(data) // 4):
        sector = struct.unpack_from("<I", data, 4 * i)[0]
        if sector != 0xFFFFFFFF:
            _need(sector * 0x800 + 8 <= len(body), "sector out of the data")
            size = struct.unpack_from("<I", body, sector * 0x800 + 4)[0]
            yield _plain(f"music{i:03}.spm", sector * 0x800, -(-size // 0x800) * 0x800)


@reader
def koei_link(data: bytes, body: bytes) -> Iterator[Entry]:
    """Offsets and sizes; payloads of two known kinds, whichever way round their mark stands."""
    _need(data[:4] == b"LINK", "other signature")
    kinds = {b"_DBW": "wbd", b"WBD_": "wbd", b"_HBW": "wbh", b"WBH_": "wbh"}
    for i in range(struct.unpack_from("<I", data, 4)[0]):
        offset, size = struct.unpack_from("<II", data, 0x10 + 8 * i)
        if kind := kinds.get(body[offset : offset + 4]):
            yield _plain(f"{i:02}.{kind}", offset, size)


@reader
def listed_tracks(data: bytes, body: bytes) -> Iterator[Entry]:
    """A text list of lines `mode x<offset> x<size>` over a disc image, numbers after x in hexadecimal."""
    for i, line in enumerate(data.decode("latin-1").splitlines()):
        words = line.split()
        _need(len(words) >= 3 and words[1][:1] == words[2][:1] == "x", "line of another form")
        offset = int(words[1][1:], 16)
        yield _plain(f"{i:03}__{offset:08x}.adpcm", offset, int(words[2][1:], 16))


@reader
def yeti_gear(data: bytes, body: bytes) -> Iterator[Entry]:
    """Parallel arrays of offset, size, name's checksum and whether it is packed: then chunks of a power of two, deflated where that is shorter, behind their ends."""
    _need(data[:16] == b"[ GEAR BigFile ]", "other signature")
    n = struct.unpack_from("<I", data, 0x18)[0]
    at = 0x20
    offsets, sizes, names = struct.unpack_from(f"<{n}Q", data, at), struct.unpack_from(f"<{n}I", data, at + 8 * n), struct.unpack_from(f"<{n}I", data, at + 12 * n)
    for i in range(n):
        offset, size = offsets[i], sizes[i]
        if not data[at + 16 * n + i]:
            yield _plain(f"{names[i]:08x}", offset, size)
            continue
        count = -(-size // (1 << body[offset]))
        end = struct.unpack_from("<I", body, offset + 1 + 4 * (count - 1))[0] if count else 0
        yield f"{names[i]:08x}", offset, size, 1 + 4 * count + end, "chunks"


@reader
def sound_bin_fat(data: bytes, body: bytes) -> Iterator[Entry]:
    """Folders of (id, offset, size) over one body, the first with their ids, those of languages without. Ids of class 0x10 go, and objects of class 0x20 of no audible type."""
    order = _smaller_order(data, 0)
    dirs, at = struct.unpack_from(order + "I", data, 0x1C)[0], 0x20
    for folder in ("sound", "English", "French", "German", "Italian", "Spanish"):
        for _ in range(dirs):
            if at + 4 > len(data):
                return
            at += 4 if folder == "sound" else 0
            n = struct.unpack_from(order + "I", data, at)[0]
            at += 4
            for _ in range(n):
                number, offset, size = struct.unpack_from(order + "3I", data, at)
                at += 12
                kind = number >> 24 & 0xF0
                known = kind == 0x20 and body[offset : offset + 4] in (b"\x01\x1b\x02\x00", b"\x00\x02\x1b\x01")
                if kind != 0x10 and not (known and struct.unpack_from(order + "I", body, offset + 0x28)[0] not in (1, 5, 6)):
                    yield _plain(f"{folder}/{number:08x}.bao", offset, size)


@reader
def scimitar_forge(data: bytes, body: bytes) -> Iterator[Entry]:
    """Sections that name the next one; each has a table of offsets, hashes and sizes, and one of names. Old versions wrap a payload in a head of its own, later ones in a word or nothing."""
    _need(data[:9] == b"scimitar\0", "other signature")
    version, info = struct.unpack_from("<II", data, 9)
    alone = struct.unpack_from("<I", data, 29)[0] == 1
    wide = version >= 0x1B
    place = struct.unpack_from("<Q", data, info + 12 + (8 if wide else 4) + 8 + 8)[0]
    met = set()
    while 0 < place < len(data) and place not in met:
        met.add(place)
        n, _, _, after, _, _, names, _ = struct.unpack_from("<IIQqIIQQ", data, place)
        at, row, record = place + 48, 20 if wide else 16, 0x30 + 0x110 if version >= 0x1D else 0x2C + 0x80 + (20 if wide else 16)
        for i in range(n):
            offset, _, code, *rest = struct.unpack_from(f"<{row // 4}I", data, at + row * i)
            size, spot = rest[-1], names + record * i
            if version >= 0x1D:
                name = f"{code:08x}_{data[spot + 4 : spot + 12].hex()}"
            else:
                size = struct.unpack_from("<I", data, spot)[0]
                name = _text(data, spot + 0x2C, 0x80) or f"{code:08x}"
            if not wide:
                _need(body[offset : offset + 8] == b"FILEDATA", "payload without a head")
                own = struct.unpack_from("<I", body, offset + 8 + 0x80 + 0xFF + 4)[0]
                offset, size = offset + 8 + 0x80 + 0xFF + 16 + 36 + 1, own or size
            elif version <= 0x1C and not alone:
                offset, size = offset + 4, size - 4
            packed = body[offset : offset + 4] in (b"\x33\xaa\xfb\x57", b"\x99\xfa\x04\x10", b"\x41\xfa\x99\x00")
            yield _plain(name + (".compressed" if packed else ""), offset, size)
        place = after


@reader
def dunia_fat(data: bytes, body: bytes) -> Iterator[Entry]:
    """FAT2, FAT3 and DAT2 directories of either byte order: records by the version, in which the low bits of sizes tell the packer and the high ones of packed sizes go on with the offset."""
    kind, order = {b"3TAF": (3, "<"), b"FAT3": (3, ">"), b"2TAF": (2, "<"), b"FAT2": (2, ">"), b"DAT2": (0, "<"), b"2TAD": (0, ">")}.get(data[:4], (None, ""))
    _need(kind is not None, "other signature")
    version, flags, at = 0, 0, 4
    if kind:
        version, flags = struct.unpack_from(order + "II", data, 4)
        at = 20 if kind == 2 and version >= 9 else 12
    n = struct.unpack_from(order + "I", data, at)[0]
    at += 4
    late = kind == 2 and version >= 9
    swapped = late and flags & 0xFF in (2, 3)
    order = ">" if swapped else order
    chunked = late and flags >> 8 & 0xFF == 4
    for _ in range(n):
        if kind == 0:
            offset, size, code = struct.unpack_from(order + "3I", data, at)
            at += 12
            yield _plain(f"{code:08x}", offset, size)
            continue
        if late:
            code, size, offset, packed = struct.unpack_from(order + "Q3I", data, at)
            at += 20
            high, low = code >> 32, code & MAX32
            name = f"{high:08x}{low:08x}" if swapped else f"{low:08x}{high:08x}"
        elif kind == 2:
            size, _, code, packed, offset = struct.unpack_from(order + "IIQII", data, at)
            at += 24
            name = f"{code & MAX32:08x}"
        else:
            code, size, packed, offset = struct.unpack_from(order + "4I", data, at)
            at += 16
            name = f"{code:08x}"
        bits = kind
        offset, packed = offset << bits | packed >> (32 - bits), packed & (1 << 32 - bits) - 1
        packer, size = size & (1 << bits) - 1, size >> bits
        if not size:
            if packed:
                yield _plain(name, offset, packed)
        elif kind == 3 or chunked and packer == 2:
            yield name, offset, size, packed, f"aligned:{offset & 15}"
        else:
            yield name, offset, size, packed, ("lzma", "lzo", "copy", "xmem")[packer] if late else "oodle" if version == 6 else "lzo"


@reader
def torus_hnk(data: bytes, body: bytes) -> Iterator[Entry]:
    """Blocks of size, type and flag; a header block (0x71) gives folder and name to those that follow. Blocks of sound folders, by their types."""
    at, folder, name = 0, ".", "root"
    ends = {0x90: "", 0x91: ".raw", 0x92: "", 0x93: ".asset"}
    while at + 8 <= len(data):
        size, kind, _ = struct.unpack_from("<IHH", data, at)
        at += 8
        if kind == 0x71:
            fn, nn = struct.unpack_from("<HH", data, at + 6)
            folder, name = _text(data, at + 10, fn), _text(data, at + 10 + fn, nn)
        elif kind not in (0x70, 0x72, 2) and folder.endswith("Squeak"):
            yield _plain(f"{folder}/{name}{ends.get(kind & 0xFF, '.bin')}", at, size)
        at += size


@reader
def koei_rdb(data: bytes, body: bytes) -> Iterator[Entry]:
    """Records of ids and flags, each followed by its payload: as it is, or in deflated chunks. Records of payloads that lie elsewhere give no entry."""
    _need(data[:8] in (b"_DRK0000", b"PDRK0000", b"IDRK0000"), "other signature")
    at = 0 if data[:4] == b"IDRK" else struct.unpack_from("<I", data, 8)[0]
    while at + 56 <= len(data) and data[at : at + 8] == b"IDRK0000":
        whole, size, full, extra, name, kind, flags, _, more = struct.unpack_from("<QQQIIIIII", data, at + 8)
        spot = at + 56 + 12 * more + extra
        if size and not flags & 0x30000:
            packers = {0: "copy", 0x100000: "sized_zlib", 0x400000: "sized_zlib_short", 0x200000: "lz4"}
            yield f"{name:08x}.{kind:08x}", spot, full, size, packers.get(flags & 0x700000, "encrypted")
        at = spot + size
        at += -at % 4 if data[:4] == b"_DRK" else -whole % 16


@reader
def abbp(data: bytes, body: bytes) -> Iterator[Entry]:
    """A directory and payloads as DATA chunks under a keystream from the first byte of each chunk's key; payloads have a checksum of 16 bytes before them."""
    _need(data[:4] == b"ABBP", "other signature")
    base = 0x40 + struct.unpack_from("<Q", data, 0x18)[0]
    table = keyed_chunk(data[0x40:])
    at = 20
    for _ in range(struct.unpack_from("<I", table, 16)[0]):
        _, offset, _, n = struct.unpack_from("<IQII", table, at)
        name, at = table[at + 20 : at + 20 + n].decode("utf-8", "replace"), at + 20 + n
        size = struct.unpack_from("<I", body, base + offset + 8)[0]
        yield f"{name}.bytes", base + offset, size - 16, 32 + size, "keyed"


@reader
def kces_sectors(data: bytes, body: bytes) -> Iterator[Entry]:
    """Sector numbers in a row over a disc file, each payload up to the next; a number that isn't larger ends them. Kinds by their marks."""
    # The marks of kinds.
    kinds = {b"\0\0\1\xba": "pss", b"\1\0d\x08": "vig", b"ef\1\0": "swp", b"wp\2\0": "swp", b"VISA": "vis", b"P2BT": "p2bt", b"MOVE": "move", b"GbTs": "gbts"}
    for i in range(len(data) // 4 - 1):
        a, b = (x * 0x800 for x in struct.unpack_from("<II", data, 4 * i))
        if b <= a:
            return
        if len(body) % 0x800:
            b = min(b, len(body))
        yield _plain(f"{i:04}.{kinds.get(body[a : a + 4], 'dat')}", a, b - a)


@reader
def keyed_pack(data: bytes, body: bytes) -> Iterator[Entry]:
    """Tables under a key of 0x80 bytes that rise by 6: their places, up to a word over 0x10000, which begins the first; each a count, a bit for each file, and offsets and sizes. Payloads lie behind the zeros after the last table."""
    _need(data[2:4] == b"\xff\xff", "not keyed")
    plain = bytes(b ^ (0x79 + 6 * (i & 0x7F)) & 255 for i, b in enumerate(data[:0x8000]))
    at, places = 8, []
    while (value := struct.unpack_from("<I", plain, at)[0]) <= 0x10000 or value == MAX32:
        if value != MAX32:
            places.append(value)
        at += 4
    found, end = [], at
    for place in places:
        n = struct.unpack_from("<H", plain, at + place)[0]
        spot = at + place + 2 + -(-n // 8)
        found += [struct.unpack_from("<II", plain, spot + 8 * i) for i in range(n)]
        end = spot + 8 * n
    while end < len(plain) and not plain[end]:
        end += 1
    real = [(o, n) for o, n in found if MAX32 not in (o, n) and n]
    for i, (offset, size) in enumerate(real):
        yield _plain(f"{i:03}.enc", offset + end, size)


MAX32 = 0xFFFFFFFF


def keyed_chunk(data: bytes) -> bytes:
    """The plain content of a DATA chunk: a head of 32 bytes with its size and key, then bytes under key * 5 + 1 again and again."""
    _need(data[:4] == b"DATA", "no chunk")
    size, packed, key = struct.unpack_from("<I", data, 8)[0], data[12], data[24]
    _need(packed == 0, "packed chunk")
    out = bytearray(data[32 : 32 + size])
    for i in range(len(out)):
        key = (key * 5 + 1) & 255
        out[i] ^= key
    return bytes(out)


def sized_chunks(data: bytes, short: bool) -> bytes:
    """Deflated chunks, each behind its size: a word, or half of one and eight more bytes."""
    at, out = 0, b""
    while at + 4 <= len(data):
        n = struct.unpack_from("<H" if short else "<I", data, at)[0]
        at += 10 if short else 4
        out += zlib.decompress(data[at : at + n])
        at += n
    return out


def aligned_chunks(data: bytes, phase: int) -> bytes:
    """Chunks of up to 0x10000 bytes, deflated or (size 0) as they are: rows of 16 bytes hold their sizes, six in the first row and eight in others, each row followed by its chunks at places of one phase of 16."""
    n, out, row, first = struct.unpack_from("<H", data, 0)[0], b"", 0, 2
    while n > 0:
        at = row + 16
        here = min(n, 8 - first)
        for size in struct.unpack_from(f"<{here}H", data, row + 2 * first):
            take = size or 0x10000
            out += zlib.decompressobj(-15).decompress(data[at : at + take]) if size else data[at : at + take]
            at += take
            at += (phase - (at + phase)) % 16
        n, row, first = n - here, at, 0
    return out


def stepped_chunks(data: bytes) -> bytes:
    """Chunks of 2**bits bytes behind their ends: a byte of bits, the ends, the chunks; one shorter than it should be is deflated."""
    size, n = 1 << data[0], 0
    ends: list[int] = []
    while 1 + 4 * n + (ends[-1] if ends else -1) != len(data):
        if 5 + 4 * n > len(data):
            raise ValueError("chunks without an end")
        ends.append(struct.unpack_from("<I", data, 1 + 4 * n)[0])
        n += 1
    out, begin, base = b"", 0, 1 + 4 * n
    for end in ends:
        part = data[base + begin : base + end]
        out += part if len(part) == size else zlib.decompress(part)
        begin = end
    return out


def executable_table(start: int, count: int, flagged: bool = True) -> Reader:
    """A table inside an executable over a disc file: (offset with two flag bits below, a word, size), or (sector, size). Flags 3 mark what is packed by an own scheme, 1 what is not there."""

    def read(data: bytes, body: bytes) -> Iterator[Entry]:
        for i in range(count):
            if flagged:
                offset, _, size = struct.unpack_from("<3I", data, start + 12 * i)
                flags, offset = offset & 3, (offset >> 2) * 0x800
            else:
                offset, size = struct.unpack_from("<II", data, start + 8 * i)
                flags, offset = 0, offset * 0x800
            if offset and size and flags != 1:
                yield _plain(f"{'compressed/' if flags == 3 else ''}{i:08}.", offset, size)

    return read


def loaded_table(start: int, wide: bool = False) -> Reader:
    """A table inside a loaded executable over a disc file: id, type, (a word), size, sector, name's address, six words. Addresses less the load address, plus the head's size, are places in the file; both stand at 0x38."""

    def read(data: bytes, body: bytes) -> Iterator[Entry]:
        head, load = struct.unpack_from("<II", data, 0x38)
        form = struct.Struct("<3I" if wide else "<2I")
        at = start + 4
        for i in range(struct.unpack_from("<I", data, start)[0]):
            at += form.size
            size, sector, name = struct.unpack_from("<3I", data, at)
            at += 36
            yield _plain(_text(data, name - load + head) or f"{i:04}.bin", sector * 0x800, size)

    return read


READERS |= {"tecmo_table": executable_table(0x40, 6), "tecmo_sectors": executable_table(0, 6, flagged=False), "kces_table": loaded_table(0x40), "kces_table_wide": loaded_table(0x40, wide=True)}


def swapped_nibbles(data: bytes) -> bytes:
    return bytes((b << 4 | b >> 4) & 255 for b in data)


# --- payloads in pieces ---------------------------------------------------------


def stripped_blocks(data: bytes) -> Iterator[tuple]:
    """SFH: blocks with a head of 16 bytes each, of a length that the mode tells; the file's last 16 bytes are none, the whole is cut to its clean size."""
    _need(data[:4] == b"\0SFH", "other signature")
    mode, clean = struct.unpack_from(">II", data, 4)
    block = {0x10000: 0x10010, 0x10001: 0x20000}.get(mode)
    _need(block is not None, f"mode {mode:x}")
    out, end, at = bytearray(), len(data) - 16, 0
    while at < end:
        out += data[at + 16 : min(at + block, end)]
        at += block
    yield (0, 0, bytes(out[:clean]))


def stream_runs(data: bytes) -> Iterator[tuple]:
    """SWVR files: each begins at a block of that mark and holds the blocks up to the next one; fillers at the ends of sectors are a word long, words of zero are passed over."""
    at, part, begin, held = 0, 0, 0, b""
    begun = False
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if not any(name) or not size:
            at += 4
            continue
        if name == b"LLIF" and ((at + 4) % 0x6000 == 0 or (at + 4) % 0x10000 == 0 or size > 0x100000):
            size = 4
        _need(size <= 0x100000, "bad size")
        if name == b"RVWS":
            if begun:
                yield (part, begin, held)
                part += 1
            begun, begin, held = True, at, b""
        if begun:
            held += data[at : at + size]
        at += size
    if begun:
        yield (part, begin, held)


def chunked_files(data: bytes) -> Iterator[tuple]:
    """CTRL: files as SHOC chunks, begun by a head (extension reversed, size) and followed by stored or deflated parts, whose content lies behind 0x2C more bytes; fillers go."""
    _need(data[:4] == b"CTRL", "other signature")
    at = struct.unpack_from(">I", data, 4)[0]
    number, size, held, begun = 0, 0, bytearray(), 0

    def done() -> Iterator[tuple]:
        nonlocal number
        if size:
            yield (number, begun, bytes(held[:size]))
            number += 1

    while at + 20 <= len(data):
        kind, length = struct.unpack_from(">4sI", data, at)
        _need(length >= 16, "chunk of no size")
        if kind in (b"SHOC", b"SONO"):
            part = data[at + 16 : at + 20]
            if part == b"SHDR":
                yield from done()
                size, begun = struct.unpack_from(">I", data, at + 32)[0], at
                held.clear()
            elif part == b"Zdat":
                n = struct.unpack_from(">I", data, at + 20)[0]
                try:
                    held += zlib.decompress(data[at + 24 + 0x2C : at + 24 + 0x2C + n])
                except zlib.error as e:
                    raise ValueError(str(e)) from e
            elif part in (b"Rdat", b"SDAT"):
                held += data[at + 20 + 0x2C : at + 20 + 0x2C + length - 0x40]
            else:
                raise ValueError("unknown part")
        elif kind not in (b"FILL", b"PADD"):
            raise ValueError("unknown chunk")
        at += length
    yield from done()
