import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bytequarry.functions import bytesx, codecs, hashx, textx


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


def test_integer_reads_are_byte_safe(spark):
    data = bytes([0xC3, 0xA9, 0x01, 0x02, 0xFF, 0x80, 0x00, 0x7F])
    d = F.col("d")
    assert one(spark, bytesx.u32(d, 0, True), d=data) == int.from_bytes(data[:4], "big")
    assert one(spark, bytesx.u32(d, 0), d=data) == int.from_bytes(data[:4], "little")
    assert one(spark, bytesx.u16(d, 4), d=data) == 0x80FF
    assert one(spark, bytesx.u64(d, 0, True), d=data) == int.from_bytes(data, "big")
    assert one(spark, bytesx.u32(d, 6), d=data) is None
    assert one(spark, bytesx.signed(bytesx.u8(d, 4), 8), d=data) == -1
    assert one(spark, bytesx.patch(d, 1, F.lit(b"\xff\xfe")), d=data) == data[:1] + b"\xff\xfe" + data[3:]
    assert one(spark, bytesx.nibble_swap(d), d=data) == bytes((b >> 4 | b << 4) & 255 for b in data)
    assert one(spark, bytesx.contains_any(d, [b"\x46"]), d=b"\xc3\x46")
    assert one(spark, bytesx.set_bits(F.lit(0b1010).cast("bigint"))) == [1, 3]
    assert one(spark, bytesx.swap32(F.lit(0x11223344).cast("bigint"))) == 0x44332211
    assert one(spark, bytesx.rotate_right8(F.lit(0b10000001).cast("bigint"), 1)) == 0b11000000


def joaat(data: bytes, seed: int = 0) -> int:
    h = seed
    for b in data:
        h = h + b & 0xFFFFFFFF
        h = h + (h << 10) & 0xFFFFFFFF
        h ^= h >> 6
    h = h + (h << 3) & 0xFFFFFFFF
    h ^= h >> 11
    return h + (h << 15) & 0xFFFFFFFF


def test_joaat_of_many_texts_at_once(spark):
    rows = [(0, "ab\\C", 0), (1, "", 5), (2, None, 1), (3, "x", None), (4, "é" * 3000, 7), (5, "Ab/c", 0), (6, "zz", (1 << 32) - 1)]
    df = spark.createDataFrame(rows, "k int, t string, s long").coalesce(1)
    state = hashx.joaat(F.col("t"), F.col("s"), finish=False)
    got = df.select("k", "t", "s", hashx.joaat(F.col("t"), F.col("s")).alias("h"), hashx.joaat_without_suffix(state, F.col("t")).alias("back"))
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    for r in got.collect():
        none = r.t is None or r.s is None
        assert r.h == (None if none else joaat(r.t.lower().replace("\\", "/").encode(), r.s)) and r.back == (None if none else r.s)


@pytest.mark.parametrize("text", ["", "a", "The Quick\\Brown", "äöü€", "x" * 300])
def test_rolling_hashes(spark, text):
    folded = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ\\", "abcdefghijklmnopqrstuvwxyz/")).encode()
    assert one(spark, hashx.joaat(F.col("t")), t=text) == joaat(folded)
    h = 0
    for b in text.encode():
        h = (h + b) * 141 & 0xFFFFFFFF
    assert one(spark, hashx.affine_hash(F.col("t")), t=text) == h
    f = hashx.FNV32_BASIS
    for b in text.encode():
        f = f * hashx.FNV32_PRIME & 0xFFFFFFFF ^ b
    assert one(spark, hashx.fnv1(F.col("t")), t=text) == f


def test_prefix_state_and_suffix_peel(spark):
    whole = one(spark, hashx.joaat(F.lit("abcdef")))
    assert one(spark, hashx.joaat(F.lit("def"), hashx.joaat(F.lit("abc"), finish=False))) == whole
    assert one(spark, hashx.fnv1_without_suffix(hashx.fnv1(F.lit("abcdef")), F.lit("def"))) == one(spark, hashx.fnv1(F.lit("abc")))


def test_crc64_known_answer(spark):
    assert one(spark, hashx.crc64(F.col("d")), d=b"123456789") == "995dc9bbdf1939fa"


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=700), st.binary(min_size=1, max_size=9))
def test_xor_twice_is_identity(data, key):
    assert codecs.xor_bytes(codecs.xor_bytes(data, key), key) == data
    state = codecs.feedback_state("name", 7)
    assert codecs.feedback_xor(codecs.feedback_xor(data, state, encrypt=True), state) == data
    stream = codecs.lcg_stream(len(data), 0x5F, 0x15)
    k, want = 0x5F, bytearray()
    for _ in data:
        want.append(k)
        k = k * 0x15 & 255
    assert stream == bytes(want)


def test_codecs(spark):
    plain = b"hello " * 40
    assert codecs.inflate_bytes(zlib.compress(plain), "zlib") == plain
    assert codecs.inflate_bytes(plain, "oodle") is None
    assert codecs.inflate_bytes(b"junk", "zlib") is None
    assert codecs.lzss_bytes(bytes([3, 0xFF]) + b"abcd" + struct.pack("<H", (4 - 1) << 5 | 1)) == b"abcdabcd"
    assert codecs.lzss_bytes(bytes([0, 0xFF]) + b"a" + struct.pack("<H", (9 - 1) << 5)) == b"a\0\0\0"
    enc = codecs.xor_bytes(bytes(300), codecs.positional_key(0x42))
    assert codecs.positional_base(enc) == 0x42
    assert one(spark, codecs.xor_positional(F.col("d")), d=enc) == bytes(300)
    assert one(spark, codecs.xor_by_name(F.col("d"), F.col("n")), d=b"\0" * 20, n="nOm") == (hashlib.md5(b"aBz").digest() * 2)[:20]
    assert one(spark, codecs.bit_reverse_xor(F.col("d"), b"\x01"), d=b"\x80\x01") == b"\x00\x81"
    assert one(spark, codecs.first_difference()(F.col("a"), F.col("b")), a=b"abc", b=b"abd") == 2


def test_aes_ctr_against_the_block_cipher(spark):
    key, data = bytes(range(16)), bytes(range(40))
    blocks = [one(spark, F.aes_encrypt(F.col("c"), F.lit(key), F.lit("ECB"), F.lit("PKCS")), c=bytearray((i).to_bytes(8, "little") + bytes(8)))[:16] for i in (1, 2, 3)]
    want = bytes(a ^ b for a, b in zip(data, b"".join(blocks), strict=False))
    assert one(spark, codecs.aes_ctr(F.col("d"), key), d=data) == want


def test_text_rules(spark):
    rows = spark.createDataFrame([("track2",), ("track11",), ("Track100",)], ["n"])
    assert [r.n for r in rows.orderBy(textx.natural_key(F.col("n"))).collect()] == ["track2", "track11", "Track100"]
    assert one(spark, textx.camel_split(F.lit("aBcD1"))) == "a_bc_d1"
    tags = lambda n: tuple(one(spark, textx.filename_tags(F.lit(n))))
    assert tags("01 - A - T - U") == (1, "A", "T - U")
    assert tags("01 T") == (1, None, "T")
    assert tags("A - T") == (None, "A", "T")
    assert tags("T") == (None, None, "T")
    assert one(spark, textx.renamed(F.lit("d/aXb.c.txt"), [("^a", "Z"), (".c$", ""), ("X", "Y")])) == "d/ZYb.txt"
    assert one(spark, textx.renamed(F.lit("d/a12.txt"), [("*(\\d+)", "n\\1")])) == "d/an12.txt"
    assert one(spark, textx.hex_suffix_to_decimal(F.lit("BGM_1F"))) == "BGM_031"
    path = lambda u, **k: one(spark, textx.url_path(F.lit(u), **k))
    assert path("https://x.org/a/b.png?v=1") == "a/b.png"
    assert path("https://x.org/a/b.png", cut="?") == "b.png"
    assert path("https://x.org/a/b.png", cut="/a/", out="o/") == "o/b.png"
    assert path("https://x.org/a/get?f=c.bin&x=2", filevar="f") == "a/c.bin"
    assert path("https://x.org/") == "index"
    assert one(spark, textx.common_prefix(F.lit("abcd"), F.lit("abxd"))) == 2
    assert one(spark, textx.name_tokens(F.lit("a-b c:d/e"))) == ["a", "b", "c:d/e"]


def test_a_loop_that_ends_at_zero_is_played(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (8.0, None)], "v double, e double")
    seconds = textx.loop_seconds(F.col("v"), F.col("v") / 4, F.col("e"), F.lit(1), F.lit(2), F.lit(10))
    assert [r[0] for r in rows.select(seconds).collect()] == [10.0, 8.0, 24.0, 8.0]
