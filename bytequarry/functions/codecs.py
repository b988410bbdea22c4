"""Byte codecs with caller-supplied keys, as Arrow UDF makers; AES-CBC is native.

A codec that fails on a row gives null there, so one bad blob never fails a job.
"""

from __future__ import annotations

import hashlib
import lzma
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _mapped(f: Callable[[bytes], bytes]):
    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda x: f(bytes(x)), na_action="ignore")

    return run


def xor_bytes(data: bytes, key: bytes, start: int = 0, end: int | None = None) -> bytes:
    """XOR with a repeating key whose first byte meets data[start]."""
    out = np.frombuffer(data, np.uint8).copy()
    part = out[start:end]
    part ^= np.resize(np.frombuffer(key, np.uint8), len(part))
    return out.tobytes()


def xor_key(data: Column, key: bytes, start: int = 0, end: int | None = None) -> Column:
    return _mapped(lambda x: xor_bytes(x, key, start, end))(data)


def xor_leading_key(data: Column, size: int = 4) -> Column:
    """The first `size` bytes are the key of what follows."""
    return _mapped(lambda x: xor_bytes(x[size:], x[:size]) if len(x) >= size else b"")(data)


def positional_key(base: int) -> bytes:
    """256 key bytes: the base with bits of the position mixed in."""
    i = np.arange(256)
    return (base ^ ((i // 2 % 4) << 1) ^ ((i // 32 % 8) << 5)).astype(np.uint8).tobytes()


def positional_base(data: bytes) -> int:
    """The most frequent byte once the position is taken out; the lowest of several."""
    plain = np.frombuffer(xor_bytes(data, positional_key(0)), np.uint8)
    return int(np.bincount(plain, minlength=256).argmax())


def xor_positional(data: Column, base: int | None = None) -> Column:
    """XOR with positional_key; without a base, the one positional_base finds."""
    return _mapped(lambda x: xor_bytes(x, positional_key(positional_base(x) if base is None else base)) if x else x)(data)


def lcg_stream(n: int, seed: int, step: int) -> bytes:
    """seed, seed * step, seed * step**2 ... modulo 256; the powers repeat."""
    out, k = bytearray(), seed & 255
    for _ in range(min(n, 256)):
        out.append(k)
        k = k * step & 255
    if n > 256:  # after eight doublings an even step is 0; an odd one repeats within 128
        out += bytes(out[128:256]) * (-(-(n - 256) // 128))
    return bytes(out[:n])


def xor_lcg(data: Column, seed: int, step: int) -> Column:
    return _mapped(lambda x: xor_bytes(x, lcg_stream(len(x), seed, step)) if x else x)(data)


def feedback_state(name: str, seed: int, times: int = 141) -> int:
    for c in name:
        seed = (seed + ord(c)) * times & (1 << 64) - 1
    return seed


def feedback_xor(data: bytes, state: int, times: int = 141, encrypt: bool = False) -> bytes:
    """Each byte meets a shifting part of a 64-bit state that takes in the cipher byte."""
    out = bytearray(data)
    for i, v in enumerate(data):
        out[i] = v ^ (state >> (i & 31) & 255)
        state = (state + (out[i] if encrypt else v)) * times & (1 << 64) - 1
    return bytes(out)


def xor_feedback(data: Column, state: int) -> Column:
    return _mapped(lambda x: feedback_xor(x, state))(data)


def video_unmasked(data: bytes, masks: tuple[bytes, bytes, bytes], plain: bool = False) -> bytes:
    """A video payload whose bytes from 0x40 on are masked, the first 0x100 of these by what follows them; shorter ones are as they are. plain: mask it instead."""
    if len(data) - 0x40 < 0x200:
        return data
    out = np.frombuffer(data, np.uint8).copy()
    body, first, second = out[0x40:], np.frombuffer(masks[0], np.uint8), np.frombuffer(masks[1], np.uint8)
    n = len(body) - 0x100
    rows = np.zeros((-(-n // 32), 32), np.uint8)

    def forward() -> None:
        # the lead is masked by the running XOR of what follows it once plain
        lead = np.bitwise_xor.accumulate(np.concatenate([first[None], body[0x100:0x200].reshape(8, 32)]), axis=0)[1:]
        body[:0x100] ^= lead.ravel()

    def rest() -> None:
        rows.ravel()[:n] = body[0x100:]
        if plain:  # cipher = plain ^ mask, mask of the next row = plain ^ second
            masked = rows ^ np.concatenate([second[None], rows[:-1] ^ second])
            rows[:] = masked
        else:  # each row is needed in plain for the next
            mask = second
            for r in rows:
                r ^= mask
                mask = r ^ second
        body[0x100:] = rows.ravel()[:n]

    if plain:
        forward()
        rest()
    else:
        rest()
        forward()
    return out.tobytes()


def audio_unmasked(data: bytes, masks: tuple[bytes, bytes, bytes]) -> bytes:
    """An audio payload whose bytes from 0x140 on are masked; its own inverse."""
    out = np.frombuffer(data, np.uint8).copy()
    out[0x140:] ^= np.resize(np.frombuffer(masks[2], np.uint8), max(0, len(out) - 0x140))
    return out.tobytes()


def unmask_stream(data: Column, kind: Column, masks: tuple[bytes, bytes, bytes]) -> Column:
    """Payloads of @SFV and @SFA chunks without their masks; others as they are. masks: two of video and one of audio, 32 bytes each, which the caller has."""

    @F.pandas_udf("binary")
    def run(blobs: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else video_unmasked(bytes(d), masks) if k == "@SFV" else audio_unmasked(bytes(d), masks) if k == "@SFA" else bytes(d) for d, k in zip(blobs, kinds, strict=True)])

    return run(data, kind)


_REVERSED = np.array([int(f"{i:08b}"[::-1], 2) for i in range(256)], np.uint8)


def bit_reverse_xor(data: Column, key: bytes, key_first: bool = False) -> Column:
    """Reverse the bits of each byte and XOR with the key, after it or (key_first) before."""

    def run(x: bytes) -> bytes:
        if not x:
            return x
        if key_first:
            return _REVERSED[np.frombuffer(xor_bytes(x, key), np.uint8)].tobytes()
        return xor_bytes(_REVERSED[np.frombuffer(x, np.uint8)].tobytes(), key)

    return _mapped(run)(data)


def xor_rotate(data: Column, key: bytes, by: int) -> Column:
    """XOR with the key, then rotate each byte right."""

    def run(x: bytes) -> bytes:
        v = np.frombuffer(xor_bytes(x, key), np.uint8).astype(np.uint16)
        return ((v >> by | v << (8 - by)) & 255).astype(np.uint8).tobytes()

    return _mapped(run)(data)


def name_key(name: str) -> bytes:
    """MD5 of the rot13 of a name."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    turned = name.translate(str.maketrans(letters + letters.upper(), letters[13:] + letters[:13] + letters[13:].upper() + letters[:13].upper()))
    return hashlib.md5(turned.encode()).digest()


@F.pandas_udf(T.BinaryType())
def xor_by_name(data: pd.Series, name: pd.Series) -> pd.Series:
    """XOR of each row with the key of its own name."""
    return pd.Series([None if d is None or n is None else xor_bytes(bytes(d), name_key(n)) for d, n in zip(data, name, strict=True)])


def lzss_bytes(data: bytes) -> bytes:
    """16-bit little-endian commands: (n, 0xFF) copies n + 1 bytes; others repeat (low 5 bits) + 3 bytes from (next 11 bits) + 1 back, zeros beyond what is there."""
    out, at = bytearray(), 0
    while at + 2 <= len(data):
        low, high = data[at], data[at + 1]
        at += 2
        if high == 0xFF:
            out += data[at : at + low + 1]
            at += low + 1
        else:
            word = high << 8 | low
            n, back = (word & 31) + 3, (word >> 5 & 0x7FF) + 1
            begin = len(out) - back
            got = bytes(out[begin : begin + n]) if begin >= 0 else b""
            out += got + bytes(n - len(got))
    return bytes(out)


class _Bits:
    """Bits of flag bytes, highest first; a flag byte is taken from the stream when the one before is used up."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.left, self.flags = data, 0, 0, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def bit(self) -> int:
        if not self.left:
            self.flags, self.left = self.byte(), 8
        self.left -= 1
        return self.flags >> self.left & 1


def gprs_bytes(data: bytes) -> bytes:
    """Flag bits among bytes: 0 a literal byte; 10 a byte that says how far back (256 less it; 0 ends); 11 a byte and four bits that say it less 255. Then a length: 1, doubled with a new bit added for each pair of a 1 and that bit, and one more byte than it is copied."""
    bits, out = _Bits(data), bytearray()
    while True:
        if not bits.bit():
            out.append(bits.byte())
            continue
        if not bits.bit():
            low = bits.byte()
            if not low:
                return bytes(out)
            back = 256 - low
        else:
            far = bits.byte() - 256
            for _ in range(4):
                far = 2 * far + bits.bit()
            back = 255 - far
        n = 1
        while bits.bit():
            n = 2 * n + bits.bit()
        if back > len(out):
            raise ValueError("copy from before the data")
        for _ in range(n + 1):
            out.append(out[-back])
        if bits.at >= len(data):
            return bytes(out)


def inflate_bytes(data: bytes, kind: str) -> bytes | None:
    try:
        if kind in ("zlib", "deflate"):
            return zlib.decompressobj(15 if kind == "zlib" else -15).decompress(data)
        if kind == "lzma":
            return lzma.decompress(data)
        if kind == "zstd":
            import zstandard

            return zstandard.ZstdDecompressor().decompressobj().decompress(data)
        if kind == "lzss":
            return lzss_bytes(data)
        if kind == "gprs":
            return gprs_bytes(data)
        if kind in ("chunks", "keyed", "sized_zlib", "sized_zlib_short") or str(kind).startswith("aligned:"):
            from ..sources import archives

            if kind == "keyed":
                return archives.keyed_chunk(data)[16:]
            if kind == "chunks":
                return archives.stepped_chunks(data)
            return archives.aligned_chunks(data, int(kind[8:])) if kind.startswith("aligned:") else archives.sized_chunks(data, kind.endswith("short"))
        if kind == "nibbles":
            return bytes((b << 4 | b >> 4) & 255 for b in data)
        return data if kind in ("copy", "", None) else None
    except Exception:
        return None


#: Codecs that inflate_bytes knows; others give null and the error unsupported_codec.
CODECS = ("copy", "zlib", "deflate", "lzma", "zstd", "lzss", "gprs", "nibbles", "chunks", "keyed", "sized_zlib", "sized_zlib_short")


def inflate(data: Column, kind: str = "zlib") -> Column:
    return _mapped(lambda x: inflate_bytes(x, kind))(data)


@F.pandas_udf(T.BinaryType())
def inflate_by(data: pd.Series, kind: pd.Series) -> pd.Series:
    """Each row by the codec that it names."""
    return pd.Series([None if d is None else inflate_bytes(bytes(d), k) for d, k in zip(data, kind, strict=True)])


def aes_cbc(data: Column, key: Column, iv: bytes) -> Column:
    """AES-CBC with PKCS padding; native."""
    return F.aes_decrypt(F.concat(F.lit(iv), data), key, F.lit("CBC"), F.lit("PKCS"))


def aes_ctr(data: Column, key: bytes, start: int = 1) -> Column:
    """AES-CTR with a little-endian counter in the block's low bytes.

    Spark has no CTR mode: each counter block is encrypted alone (ECB, whose
    padding block is cut off) and XORed with the data.
    """
    hexed = F.hex(data)
    n = F.ceil(F.length(data) / 16).cast("int")

    def block(i: Column) -> Column:
        counter = F.rpad(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned((i + (start - 1)).cast("bigint"), 8 * k).bitwiseAND(255)), 2, "0") for k in range(8)]), 32, "0")
        return F.substring(F.hex(F.aes_encrypt(F.unhex(counter), F.lit(key), F.lit("ECB"), F.lit("PKCS"))), 1, 32)

    stream = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), block), "")

    @F.pandas_udf("binary")
    def mixed(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else bytes(p ^ q for p, q in zip(bytes.fromhex(x), bytes.fromhex(y), strict=False)) for x, y in zip(a, b, strict=True)])

    return mixed(hexed, stream)


@F.pandas_udf(T.StringType())
def shift_jis(data: pd.Series) -> pd.Series:
    """Shift-JIS text, which Spark's decode does not offer."""
    return data.map(lambda x: bytes(x).decode("shift_jis", "replace"), na_action="ignore")


@F.pandas_udf(T.FloatType())
def f32_be(data: pd.Series) -> pd.Series:
    return data.map(lambda x: float(np.frombuffer(bytes(x)[:4], ">f4")[0]) if len(x) >= 4 else None, na_action="ignore").astype("float32")


def radix_text(alphabet: str, per: int = 3, big: bool = True):
    """Text packed as base-len(alphabet) digits, `per` in each 16-bit word."""
    base = len(alphabet)

    def run(x: bytes) -> str:
        out = []
        for w in np.frombuffer(x[: len(x) // 2 * 2], ">u2" if big else "<u2").tolist():
            digits = []
            for _ in range(per):
                w, d = divmod(w, base)
                digits.append(alphabet[d])
            out += reversed(digits)
        return "".join(out)

    @F.pandas_udf("string")
    def decode(data: pd.Series) -> pd.Series:
        return data.map(lambda x: run(bytes(x)), na_action="ignore")

    return decode


def first_difference(kind: str = "exact", tolerance: float = 0):
    """UDF of (left, right): the first offset at which they differ, null if nowhere. kind: exact, s16, f32; values are signed and little-endian."""
    types = {"exact": ("u1", 1), "s16": ("<i2", 2), "f32": ("<f4", 4)}
    dtype, width = types[kind]

    @F.pandas_udf("long")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(left, right, strict=True):
            if a is None or b is None:
                out.append(None)
                continue
            n = min(len(a), len(b)) // width * width
            x, y = np.frombuffer(bytes(a)[:n], dtype).astype(float), np.frombuffer(bytes(b)[:n], dtype).astype(float)
            at = np.flatnonzero(np.abs(x - y) > tolerance)
            out.append(int(at[0]) * width if len(at) else (n if len(a) != len(b) else None))
        return pd.Series(out, dtype="Int64")

    return run


def ima_adpcm(data: bytes, predictor: int = 0, index: int = 0) -> np.ndarray:
    """4-bit IMA ADPCM (low nibble first) to signed 16-bit samples. Steps follow the standard's rule: each about 1.1 times the one before."""
    steps = _IMA
    out = np.zeros(2 * len(data), np.int16)
    for i in range(2 * len(data)):
        code = data[i >> 1] >> 4 * (i & 1) & 15
        step = steps[index]
        diff = step >> 3
        for bit, shift in ((4, 0), (2, 1), (1, 2)):
            if code & bit:
                diff += step >> shift
        predictor = max(-32768, min(32767, predictor - diff if code & 8 else predictor + diff))
        index = max(0, min(len(steps) - 1, index + (2 * (code & 7) - 6 if code & 4 else -1)))
        out[i] = predictor
    return out


# Fixed values of the IMA ADPCM standard.
_IMA = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190,
    209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499,
    2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350,
    22385, 24623, 27086, 29794, 32767,
)


def samples_of(kind: str = "ima", big: bool = False):
    """UDF of BINARY to array<short>: "ima" (4 bits a sample, low nibble first), "pcm16" or "pcm8" (unsigned)."""

    def run(data: bytes) -> np.ndarray:
        if kind == "ima":
            return ima_adpcm(data)
        if kind == "pcm16":
            return np.frombuffer(data[: len(data) // 2 * 2], ">i2" if big else "<i2").astype(np.int16)
        return ((np.frombuffer(data, np.uint8).astype(np.int16) - 128) << 8).astype(np.int16)

    @F.pandas_udf("array<short>")
    def decode(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda x: run(bytes(x)), na_action="ignore")

    return decode
