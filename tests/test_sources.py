import binascii
import json
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bytequarry.operators import classify, demux, timing
from bytequarry.sources import blobs, chunks, lines, records, toc, utf_table
from bytequarry.sources.layouts import LAYOUTS


def test_table_round_trip_and_nesting(spark):
    inner = utf_table.build("in", [("v", "u8", "row")], [[200]])
    cols = [("id", "u32", "row"), ("name", "string", "row"), ("sub", "data", "row"), ("k", "s16", "default"), ("f", "f32", "row"), ("big", "u64", "row")]
    blob = utf_table.build("out", cols, [[7, "é", inner, 1.5, 2**64 - 1], [8, "b", b"", 2.5, 1]], {"k": -3})
    t = utf_table.parse(blob)
    assert t.rows == [[7, "é", inner, -3, 1.5, 2**64 - 1], [8, "b", b"", -3, 2.5, 1]]
    assert t.value(0, "id", "u8") is None and t.value(5, "id") is None and t.value(0, "nope") is None
    df = spark.createDataFrame([("a", blob), ("bad", b"@UTF" + b"\0" * 40), ("n", None)], "path string, content binary")
    cells = utf_table.cells(df)
    deep = cells.filter("size(table_path) = 1").first()
    assert (deep.table_path, deep.table, int(deep.int_value)) == (["sub[0]"], "in", 200)
    assert cells.filter("error IS NOT NULL").count() == 1
    assert utf_table.parse(utf_table.build("z", [("a", "u8", "row")], [])).rows == []
    assert utf_table.pivoted(cells.filter("path = 'a'"), "path", ["id", "name"]).orderBy("row").first()["name"] == "é"


@settings(max_examples=20, deadline=None)
@given(st.lists(st.binary(max_size=50), max_size=8))
def test_flat_archive_round_trip(payloads):
    items = [(f"n{i}", p) for i, p in enumerate(payloads)]
    data = toc.build_flat(items)
    assert [(e["name"], data[e["offset"] : e["offset"] + e["size"]]) for e in toc.read_entries(toc.FLAT, data)] == items


def test_layouts(spark):
    arc = b"\0CRA\0\0\0\1" + b"one".ljust(64, b"\0") + struct.pack(">IIII", 0, 4, 0, 0x58) + b"DATA"
    dlcp = b"\0CLD" + bytes(8) + struct.pack(">I", 2) + b"\1a" + struct.pack(">I", 28) + b"\1b" + struct.pack(">I", 31) + b"xyz12"
    par = b"DAT\0" + struct.pack("<5I", 2, 0x20, 0x28, 0x30, 0x3C) + bytes(8) + struct.pack("<2I", 0x44, 0x46) + b"aaa\0bbb\0" + struct.pack("<I", 4) + b"a.x\0b.y\0" + struct.pack("<2I", 2, 3) + b"hiyou"
    z = zlib.compress(b"plain" * 9)
    df = spark.createDataFrame([("arc", arc), ("dlcp", dlcp), ("par", par)], "path string, content binary")
    got = lambda p, k: [(r.name, bytes(r.payload)) for r in toc.entries(df.filter(F.col("path") == p), "path", "content", LAYOUTS[k]).orderBy("idx").collect()]
    assert got("arc", "capcom_arc") == [("one.bin", b"DATA")]
    assert got("dlcp", "capcom_dlcp") == [("a", b"xyz"), ("b", b"12")]
    assert [p for _, p in got("par", "platinum_dat")] == [b"hi", b"you"]
    assert [n for n, _ in got("par", "platinum_dat")] == ["a.x", "b.y"]
    assert toc.entries(df, "path", "content", LAYOUTS["capcom_arc"]).filter("error IS NOT NULL").count() == 2
    lay = toc.Layout(count=1, table=0, stride=12, fields={"offset": (0, "u32"), "packed": (4, "u32"), "size": (8, "u32"), "full": (8, "u32")}, packed_codec="zlib")
    blob = spark.createDataFrame([("z", struct.pack("<3I", 12, len(z), 45) + z)], "path string, content binary")
    assert bytes(toc.entries(blob, "path", "content", lay).first()["payload"]) == b"plain" * 9


def test_marks_entries_and_trees():
    read = lambda k, d, n=None: [(e["name"], e["offset"], e["size"]) for e in toc.found_entries(LAYOUTS[k], d, bytes(n) if n else d)]
    wave = b"junk" + (b"G1ROM FILESYSTEM" + struct.pack("<I", 2)).ljust(0x40, b"\0") + struct.pack("<4I", 0, 0, 0, 9) + bytes(48) + struct.pack("<4I", 0, 0, 0xC0, 4) + b"f".ljust(48, b"\0") + b"DATA"
    assert read("atomiswave", wave) == [("f", 4 + 0xC0, 4)] and wave[4 + 0xC0 :] == b"DATA"
    midi = struct.pack("<3I", 12, 24, 2) + struct.pack("<6I", 0, 0, 1, 0, 0, 0) + struct.pack("<6I", 0, 0, 2, 0, 24, 3) + b"abc"
    assert read("bigrp_midi", midi) == [("00000001", 60, 3)]
    link = b"LINK" + struct.pack("<3I", 2, 0, 0) + struct.pack("<4I", 32, 4, 36, 4) + b"x..._DBW"
    assert read("koei_link", link) == [("01.wbd", 36, 4)]
    g1l = b"_L1G" + bytes(16) + struct.pack("<4I", 3, 40, 36, 40) + bytes(4) + b"four"
    assert read("koei_g1l", g1l) == [("00000000", 40, 4), ("00000001", 36, 4)]
    fhd = b"\0DHF" + bytes(8) + struct.pack("<6I", 1, 0x30, 0x34, 0, 0x38, 0x40) + bytes(12) + struct.pack("<I", 5) + bytes(4) + struct.pack("<2I", 0x44, 0x47) + struct.pack("<I", 2) + b"d/\0n\0"
    assert read("tecmo_fhd", fhd, 0x2000) == [("d/n", 0x1000, 5)]
    noa = b"Entis".ljust(16, b"\0") + b"ERISA-Archive file".ljust(0x30, b"\0") + b"DirEntry" + bytes(8) + struct.pack("<I", 1) + struct.pack("<4QII", 3, 0, 0x3D, 0, 0, 1) + b"n" + b"filedata" + struct.pack("<Q", 3) + b"abc"
    assert read("entis_noa", noa) == [("n", 0x8D, 3)]
    with pytest.raises(ValueError, match="another size"):
        read("entis_noa", noa.replace(struct.pack("<Q", 3) + b"abc", struct.pack("<Q", 4) + b"abc"))
    garc = b"GARC" + bytes(16) + struct.pack("<I", 0x18) + b"FILE" + struct.pack("<4I", 0, 1, 0, 0x2C) + struct.pack("<6I", 0, 2, 0x46, 0x44, 0, 0) + b"f\0ab"
    assert read("loco_garc", garc) == [("f", 0x46, 2)]
    names = b"r\0a\0"
    tree = struct.pack("<III", 0, 1 << 31 | 1, 0) + struct.pack("<III", 2, 1 << 30 | 7, 99) + names
    assert list(toc.tree_entries(tree, 0, 24, 12)) == [("r/a", 99, 7, "zlib")]


def test_trimmed_demux_is_the_inverse_of_mux(spark):
    rows = [("@SFA", c, 0, bytes([c]) * n) for n in (1, 40, 7) for c in (0, 1)] + [("@SFV", 0, 0, b"v"), ("@SFA", 0, 1, b"head")]
    df = spark.createDataFrame([("f", chunks.build_trimmed(rows))], "path string, content binary")
    out = demux.streams(chunks.walk(df, "path", "content", chunks.TRIMMED).filter("id = '@SFA' AND type = 0"), ["path", "channel"])
    assert {r.channel: bytes(r.payload) for r in out.collect()} == {c: bytes([c]) * 48 for c in (0, 1)}


def test_block_streams(spark):
    b = lambda kind, size, number, body=b"": struct.pack("<4I", kind, size, 0, number) + body
    data = b(0x10, 16, 0x20001) + b(0x20001, 20, 0, b"aaaa") + b(0x20001, 20, 0, b"pad!") + b(0x20001, 20, 5, b"bbbb") + b(0xF0, 16, 0) + b(0, 16, 0) + b(0x10, 16, 0x20001) + b(0x20001, 20, 0, b"cccc") + b(0x30001, 20, 0, b"xxxx")
    df = spark.createDataFrame([("f", data)], "path string, content binary")
    walked = chunks.walk(df, "path", "content", chunks.BLOCKS)
    out = demux.block_streams(walked, "path", padded=(0x20001,))
    good = demux.streams(out.filter("error IS NULL"), ["path", "stream", "part"])
    assert {(r.stream, r.part): bytes(r.payload) for r in good.collect()} == {(0x20001, 0): b"aaaabbbb", (0x20001, 1): b"cccc"}
    assert out.filter("error IS NOT NULL").count() == 1
    assert demux.block_streams(walked, "path", subtype=3).count() == 1


def test_sector_streams(spark):
    s = lambda chan, sub, fill: bytes(16) + bytes([1, chan, sub, 0]) + bytes([fill]) * (chunks.SECTOR - 20)
    data = s(0, 4, 1) + s(1, 4, 2) + s(0, 0x84, 3) + s(0, 4, 4) + s(0, 8, 5)
    df = spark.createDataFrame([("f", data)], "path string, content binary")
    out = demux.sector_streams(chunks.walk(df, "path", "content", chunks.SECTORS), "path")
    assert sorted((r.channel, r.part, bytes(r.payload)[-1]) for r in out.collect()) == [(0, 0, 1), (0, 0, 3), (0, 1, 4), (1, 0, 2)]


def test_spans_of_table_and_head_dialects():
    audio = lambda d, x: b"".join(r[5] for r in chunks.read_chunks(d, x) if r[2] in ("audi", "head"))
    film = b"FILM" + bytes(12) + b"FDSC" + struct.pack(">I", 8) + b"STAB" + struct.pack(">III", 32, 0, 2) + struct.pack(">8I", 0, 2, 0xFFFFFFFF, 1, 2, 2, 0, 1) + b"aavv"
    assert audio(film, chunks.FILM) == b"aa"
    mul = b"\0\0\xbb\x80" + bytes(0x7FC) + struct.pack(">II", 0, 4) + bytes(8) + b"aaaa" + bytes(12) + struct.pack(">II", 1, 16) + bytes(8) + b"v" * 16
    assert audio(mul, chunks.MUL) == mul[: 0x800 + 32]
    xav = b"XAVS" + bytes(20) + b"A\2\0\0aa" + b"V\1\0\0v" + b"_\0\0\0"
    assert audio(xav, chunks.XAV)[24:] == b"A\2\0\0aa_\0\0\0"
    ipus = b"IPUS" + bytes(8) + struct.pack("<II", 0x50, 1) + struct.pack("<II", 4, 3) + bytes(0x38) + b"vvvvaaa" + bytes(9)
    assert audio(ipus, chunks.IPUS) == b"aaa"
    smv = (struct.pack("<4I", 0, 2, 18, 3) + b"vvaaa").ljust(0x800, b"\0")
    assert audio(smv, chunks.SMV) == b"aaa"
    smk = (b"SMK2" + bytes(8) + struct.pack("<I", 1)).ljust(0x68, b"\0") + struct.pack("<I", 16 | 1) + bytes([0b111]) + bytes([1, 0, 0, 0]) + struct.pack("<I", 5) + b"a" + struct.pack("<I", 6) + b"bb" + b"v"
    got = [(r[3], r[5]) for r in chunks.read_chunks(smk, chunks.SMK) if r[2] == "audi"]
    assert got == [(0, struct.pack("<I", 5) + b"a"), (1, struct.pack("<I", 6) + b"bb")]
    bink = (b"BIKi" + bytes(4) + struct.pack("<I", 2)).ljust(0x28, b"\0") + struct.pack("<I", 1) + bytes(8) + struct.pack("<I", 7) + struct.pack("<3I", 0x44 | 1, 0x4C, 0x51) + struct.pack("<I", 3) + b"aaav" + struct.pack("<I", 1) + b"b"
    assert [(r[3], r[5]) for r in chunks.read_chunks(bink, chunks.BINK) if r[2] == "audi"] == [(7, b"aaa"), (7, b"b")]
    assert next(chunks.read_chunks(b"no", chunks.FILM))[6]


def test_repairs(spark):
    from bytequarry.sources import repair

    riff = b"RIFF" + struct.pack("<I", 4) + b"WAVE"
    df = spark.createDataFrame([("a", riff), ("b", riff + bytes(9)), ("c", riff[:9]), ("d", riff + b"junk"), ("e", b"x")], "k string, d binary")
    got = {r.k: (r.x.state, bytes(r.x.payload)) for r in df.select("k", repair.riff_trimmed(F.col("d")).alias("x")).collect()}
    assert got == {"a": ("fine", riff), "b": ("trimmed", riff), "c": ("truncated", riff[:9]), "d": ("extra", riff + b"junk"), "e": ("other", b"x")}
    z = [zlib.compress(p) for p in (b"x" * 100, b"y" * 50)]
    asset = bytes.fromhex("C1832A9E00000000") + struct.pack("<3Q", 100, 0, 150) + struct.pack("<4Q", len(z[0]), 100, len(z[1]), 50) + b"".join(z)
    assert list(repair.chunked_asset(asset)) == [(0, 0, b"x" * 100 + b"y" * 50)]
    pad = lambda b: b + bytes(-len(b) % 128)
    gz = pad(struct.pack("<5I", 0x10000, 2, 150, 0, 0)) + b"".join(pad(struct.pack("<I", len(p)) + p) for p in z)
    assert list(repair.padded_chunks(gz)) == [(0, 0, b"x" * 100 + b"y" * 50)]
    assert [p for p, _, _ in repair.silent_cuts(4, 2)(b"abcdefgh" + bytes(4) + b"zz")] == [0, 1]


def test_messages(spark):
    v = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + v(n >> 7)
    inner = b"\x08" + v(1)
    msg = b"\x08\x96\x01" + b"\x12\x05hello" + b"\x1a" + v(len(inner)) + inner + b"\x25" + struct.pack("<I", 9) + b"\x29" + struct.pack("<Q", 10)
    rows = list(records.messages(msg))
    assert [(tuple(r[0]), r[1], r[2], None if r[3] is None else int(r[3]), r[5]) for r in rows] == [((), 1, 0, 150, None), ((), 2, 2, None, "hello"), ((), 3, 2, None, None), ((3,), 1, 0, 1, None), ((), 4, 5, 9, None), ((), 5, 1, 10, None)]
    df = spark.createDataFrame([("m", msg), ("bad", b"\x0b")], "path string, content binary")
    assert records.read(df, "tlv").filter("error IS NOT NULL").count() == 1
    lines_ = [r.line for r in records.tlv_lines(records.read(df.filter("path = 'm'"), "tlv"), "path").collect()]
    assert lines_[:4] == ["1: 150", "2: hello", "3: (message)", "  1: 1"]


def test_tags_join_in_order(spark):
    t = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
    body = t("ARTIST") + t("a") + t("TITLE") + t("é") + t("ARTIST") + t("b") + t("ALBUM ARTIST") + t("c")
    data = b"EXTERNALTAGS" + t("f.x") + struct.pack("<II", 2, len(t("f.x")) + 8 + len(body)) + body
    df = spark.createDataFrame([("m", data)], "path string, content binary")
    out = {r.name: r.value for r in records.joined_tags(records.read(df, "external_tags"), ["path", "file", "subsong"]).collect()}
    assert out == {"ARTIST": "a, b", "TITLE": "é", "ALBUMARTIST": "c"}


def test_banks_ids_and_names():
    bank = b"BKHD" + struct.pack("<III", 8, 1, 2) + b"HIRC" + struct.pack("<I", 4 + 9 + 2) + struct.pack("<I", 1) + struct.pack("<BII", 2, 6, 99) + b"zz"
    assert list(records.sound_bank(bank)) == [("BKHD", 0, 8, None, None, None), ("HIRC", 16, 15, None, None, None), ("HIRC", 28, 6, 0, 2, 99)]
    wave = b"ADAT" + struct.pack("<III", 0, 1, 0) + struct.pack("<I", 1 << 29 | 5) + struct.pack("<Q", 0x55 << 56 | 64 << 28 | 100)
    assert list(records.wave_container(wave)) == [(0, 5, 0, 0x55, 100, 64, None, None, None, None)]
    ids = b"KTSR" + bytes(0x3C) + struct.pack("<5I", 7, 20, 42, 4, 8) + bytes(16)
    assert list(records.stream_ids(7, 8)(ids)) == [(42, 0x44, 8)]
    bxm = b"BXM\0" + struct.pack(">IHHI", 0, 0, 0, 4) + b"a\0b\0"
    assert list(records.trailing_strings(bxm)) == [(0, "a"), (1, "b")]
    names = bytes(8) + struct.pack("<I", 1) + bytes(0x30) + bytes(16) + struct.pack(">HH", 2, 1) + b"xyz"
    assert list(records.sized_names(names)) == [(0, "xy"), (1, "z")]


def test_carving(spark):
    fsb = b"FSB5" + struct.pack("<5I", 1, 0, 0, 0, 4) + bytes(0x3C - 24) + b"DATA"
    blob = b"noise FSB5 junk" + fsb + b"zz" + fsb
    df = spark.createDataFrame([("b", blob)], "path string, content binary")
    got = records.read(df, "fsb5_carve")
    assert [r.offset for r in got.orderBy("offset").collect()] == [15, 15 + 64 + 2]
    assert records.first_copies(got, "path").count() == 1
    page = bytearray(b"OggS" + struct.pack("<BBqIIIB", 0, 2, 0, 77, 0, 0, 1) + b"\3abc")
    page[22:26] = struct.pack("<I", records._ogg_crc(bytes(page)))
    assert list(records.ogg_pages(b"xx" + bytes(page) + b"OggS")) == [(2, 77, 0, 2, b"abc")]


def test_msgpack_and_json(spark):
    packed = b"\x83\xa1a\x01\xa1b\x93\xc3\xc0\xcb" + struct.pack(">d", 1.5) + b"\xa1c\xc4\x02\xff\x00"
    assert json.loads(next(records.msgpack(packed))[0]) == {"a": 1, "b": [True, None, 1.5], "c": "ff00"}
    df = spark.createDataFrame([("p", '{"RawData": [1, 255, 0]}', '{"Groups":[{"Name":"g","OrderedEntries":[{"Name":"x","Offset":1,"Size":2}]}]}', b"abcd", '<r><File CrcHex="0A" Path="p/q"/></r>')], "path string, j string, t string, content binary, x string")
    assert bytes(blobs.json_bytes(df, "j").first()["content"]) == b"\x01\xff\x00"
    assert bytes(blobs.json_toc(df, "t").first()["payload"]) == b"bc"
    assert tuple(blobs.xml_files(df, "x").first()) == (10, "p/q")


def test_address_lists(spark):
    text = ["# c", "out: o", "prefix: http://a.b/x", "one.bin", "name: n.bin", "two.bin", "three.bin", "cut: /x/", "^%02i#9#11^.png", "http://q.r/s.t?u=1", "three.bin"]
    df = spark.createDataFrame([("f", i, s) for i, s in enumerate(text)], "file string, seq int, line string")
    got = [(r.url, r.path) for r in lines.addresses(df, ["file"]).orderBy("seq", "place").collect()]
    assert got == [("http://a.b/x/one.bin", "o/x/one.bin"), ("http://a.b/x/two.bin", "o/n.bin"), ("http://a.b/x/three.bin", "o/x/three.bin"), ("http://a.b/x/09.png", "o/09.png"), ("http://a.b/x/10.png", "o/10.png"), ("http://a.b/x/11.png", "o/11.png"), ("http://q.r/s.t?u=1", "o/s.t"), ("http://a.b/x/three.bin", "o/three.bin")]


def test_signatures(spark):
    heads = {"a": b"OggS" + bytes(20), "b": b"\x80\x00\x00\x20\x03\x12\x04\x02" + struct.pack(">I", 44100) + bytes(8), "c": b"RIFF" + bytes(18) + b"\2\0" + bytes(8), "d": b"KTSR\x77\x7b\x48\x1a" + bytes(16), "e": bytes(4) + b"ftyp" + bytes(16), "f": b"Og", "g": bytes(30), "h": b"\xc8\xc3\xc1\0" + bytes(8) + b"\2\0" + bytes(8)}
    df = spark.createDataFrame(list(heads.items()), "k string, d binary")
    got = {r.k: tuple(r.x) for r in df.select("k", classify.audio_head(F.col("d")).alias("x")).collect()}
    assert got["a"][0] == "ogg" and got["a"][3] == "ogg"
    assert got["b"] == ("adx", 2, 44100, "adx/2ch-44100")
    assert got["c"][:2] == ("riff", 2) and got["c"][3] == "riff/2ch"
    assert got["d"][0] == "ktsl2asbin" and got["e"][0] == "mp4"
    assert got["f"][0] is None and got["g"][0] is None
    assert got["h"][:2] == ("hca", 2)


def test_timing(spark):
    head = bytes(8) + struct.pack("<I", 500)
    note = bytes([0, 0, 0, 10, 240])
    plain = head + note + note + b"\x83"
    assert timing.track_seconds(plain) == ((480 + 10) * 500000 / 480e6 + 1, False)
    loop = head + note + bytes([0x82, 0, 0]) + note + bytes([0x82, 0, 0]) + b"\x83"
    assert timing.track_seconds(loop) == (2 * 0.5 - 0.25, True)
    ref = head + bytes([0x81, 0, 20, 1]) + b"\x83" + bytes(3) + note + b"\x83"
    assert timing.walk(ref, 500).steps == 240 * 500000
    df = spark.createDataFrame([("a", plain), ("b", b"")], "k string, content binary")
    assert {r.k: r.error is None for r in timing.durations(df, "k", "content").collect()} == {"a": True, "b": True}
    assert binascii.crc32(b"123456789") == 0xCBF43926


def test_many_entries_without_sizes():
    """Sizes by the next offset cost time in proportion to the entries."""
    n = 60_000
    data = b"_L1G" + bytes(16) + struct.pack("<I", n) + struct.pack(f"<{n}I", *[0x18 + 4 * n + i for i in range(n)]) + bytes(n)
    got = toc.read_entries(LAYOUTS["koei_g1l"], data)
    assert len(got) == n and {e["size"] for e in got} == {1}


def test_codes_of_the_lz_stream():
    from bytequarry.functions.codecs import gprs_bytes, inflate_bytes
    from bytequarry.plans.samples import gprs_twice

    assert gprs_bytes(gprs_twice("abcdefgh")) == b"abcdefghabcdefgh"
    assert inflate_bytes(b"\x80", "gprs") is None


def test_message_nesting_is_followed_to_the_end():
    data = b"\x08\x01"
    for _ in range(60):
        data = b"\x0a" + bytes([len(data) & 127 | 128, len(data) >> 7]) + data if len(data) > 127 else b"\x0a" + bytes([len(data)]) + data
    rows = list(records.messages(data))
    assert max(len(r[0]) for r in rows) == 60


def test_tracks_of_any_length():
    from bytequarry.plans.samples import track

    long = track([(1, 2)] * 200_000, -1, 500)
    assert timing.walk(long, 500).steps == 200_000 * 2 * 500_000
    again = bytes(12) + bytes([0x81]) + struct.pack(">HB", 12, 1) + b"\x83"
    with pytest.raises(ValueError, match="plays itself"):
        timing.walk(again, 1)
    # parts of parts, each of 200 events that play the next one, are worked out once each
    deep = b"".join(bytes([0x81]) + struct.pack(">HB", 12 + 4 * 200 * (k + 1), 200) for k in range(20) for _ in range(200)) + bytes([0, 60, 100, 1, 1]) * 200 + b"\x83"
    assert timing.walk(bytes(12) + deep[: 4 * 1] + deep[4:], 1).steps >= 200**20


@pytest.mark.parametrize("k, name", [(300, "0000012c_2c01000000000000"), (65535, "0000ffff_ffff000000000000"), (65536, "00010000_0010000000000000"), (1199999, "00124f7f_7f12000000000000")])
def test_hashes_of_large_keys_are_those_of_the_sql(k, name):
    from bytequarry.plans import samples

    layout, write, _, _ = samples.SAMPLES["scimitar_1d"]
    data, _ = write([(f"n{k}.bin", b"text")])
    assert [e["name"] for e in toc.found_entries(LAYOUTS[layout], data, data)] == [name]


def test_codes_of_banks_have_their_names():
    from bytequarry.plans import samples

    items = [(f"n{k}.bin", b"text") for k in (6, 7, 8)]
    found = [r[4:] for r in records.bank_details(samples.event_bank(items)) if r[4] in ("mode", "scope", "action")]
    assert found == [x for mode in ("Bank", "Stream", "Prefetch") for x in (("mode", ("Bank", "Stream", "Prefetch").index(mode), mode), ("scope", 2, "Global"), ("action", 4, "Play"))]
