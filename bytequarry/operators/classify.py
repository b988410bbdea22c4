"""Content by signature: rules of (offset, bytes, kind), checked in order; file heads with parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bytesx

# Leading signatures and the kinds they stand for.
SIGNATURES: list[tuple[int, bytes, str]] = [
    (0, b"@UTF", "acb-acf"), (0, b"OggS", "ogg"), (0, b"AFS2", "awb"), (0, b"AKB ", "akb"), (0, b"AFS\0", "afs"),
    (0, b"BKHD", "bnk"), (0, b"AKPK", "apk"), (0, b"sabf", "sab"), (0, b"Unit", "unity"), (0, b"MThd", "midi"),
    (0, b"CPK ", "cpk"), (0, b"CRID", "usm"), (0, b"srcd", "srcd"), (0, b"KTSC", "ktsc"), (0, b"RIFF", "riff"),
    (0, b"RIFX", "rifx"), (0, b"XWAV", "xwv"), (0, b"caff", "caf"), (0, b"\x89PNG", "png"), (0, b"ID3\x03", "mp3"),
    (0, b"ID3\x04", "mp3"), (0, b"PK\x03\x04", "zip"), (4, b"ftyp", "mp4"),
]
# Second words of the KTSR signature.
KTSR_KINDS = {0x777B481A: "ktsl2asbin", 0x0294DDFC: "ktsl2stbin", 0xC638E69E: "ktsl2gcbin"}


def by_signature(head: Column, rules: list[tuple[int, bytes, str]] = SIGNATURES) -> Column:
    """The kind of the first rule that fits, or null."""
    out = F.lit(None).cast("string")
    for offset, magic, kind in reversed(rules):
        out = F.when(bytesx.slice_bytes(head, offset, len(magic)) == F.lit(magic), kind).otherwise(out)
    return out


def audio_head(head: Column) -> Column:
    """STRUCT<kind, channels, rate, folder> of a file's first 0x60 bytes; kind is null for unknown or shorter than 16 bytes."""
    first = bytesx.u32(head, 0, True)
    is_adx = first.bitwiseAND(F.lit(0xFFFF0000)) == 0x80000000
    is_hca = first.bitwiseAND(F.lit(0x7F7F7F7F)) == 0x48434100
    magic = bytesx.slice_bytes(head, 0, 4)
    ktsr = F.lit(None).cast("string")
    for value, kind in KTSR_KINDS.items():
        ktsr = F.when(bytesx.u32(head, 4, True) == value, kind).otherwise(ktsr)
    kind = F.when(magic == F.lit(b"KTSR"), ktsr).when(is_hca, "hca").when(is_adx, "adx").otherwise(by_signature(head))
    xwav = F.when(bytesx.u8(head, 0x27) > 1, F.lit(6)).otherwise(bytesx.u8(head, 0x47))
    channels = F.when(magic == F.lit(b"AKB "), bytesx.u8(head, 0x0D)).when(magic == F.lit(b"RIFF"), bytesx.u16(head, 0x16)).when(magic == F.lit(b"RIFX"), bytesx.u16(head, 0x16, True)).when(magic == F.lit(b"XWAV"), xwav).when(is_hca, bytesx.u16(head, 0x0C)).when(is_adx, bytesx.u8(head, 0x07))
    rate = F.when(is_adx, bytesx.u32(head, 8, True))
    some = lambda c: F.when(c > 0, c)
    sub = F.concat(F.when(magic == F.lit(b"AKB "), F.concat(bytesx.u16(head, 0x0E).cast("string"), F.lit("-"))).otherwise(""), F.coalesce(F.concat(some(channels).cast("string"), F.lit("ch")), F.lit("")), F.coalesce(F.concat(F.lit("-"), some(rate).cast("string")), F.lit("")))
    folder = F.when(sub == "", kind).otherwise(F.concat(kind, F.lit("/"), sub))
    fields = F.struct(kind.alias("kind"), channels.alias("channels"), rate.alias("rate"), folder.alias("folder"))
    empty = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("bigint").alias("channels"), F.lit(None).cast("bigint").alias("rate"), F.lit(None).cast("string").alias("folder"))
    return F.when((F.length(head) >= 16) & kind.isNotNull(), fields).otherwise(empty)


def with_extension(entries: DataFrame, payload: str = "payload", out: str = "extension", rules: list[tuple[int, bytes, str]] = SIGNATURES, default: str = "bin") -> DataFrame:
    """Entries with the extension that their first bytes suggest."""
    return entries.withColumn(out, F.coalesce(by_signature(bytesx.slice_bytes(F.col(payload), 0, 16), rules), F.lit(default)))
