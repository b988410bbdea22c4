"""Samples cut short, with bytes turned, or of nothing at all: a reader gives entries or says what is wrong, and never more."""

import random
import struct

import pytest

from bytequarry.functions.codecs import inflate_bytes
from bytequarry.plans import samples
from bytequarry.sources import archives, chunks, records, repair, toc, utf_table
from bytequarry.sources.layouts import LAYOUTS

ITEMS = [(f"n{k}.bin", f"some text {k} of it ".encode() * (1 + k % 3)) for k in range(11, 17)]
#: What blobs.parsed and toc.entries make an error row of.
KNOWN = (ValueError, KeyError, IndexError, struct.error)


def damaged(data, seed):
    r = random.Random(seed)
    yield b""
    for _ in range(12):
        yield data[: r.randrange(len(data))]
    for _ in range(25):
        out = bytearray(data)
        for _ in range(r.randint(1, 4)):
            out[r.randrange(min(len(out), 400))] = r.randrange(256)
        yield bytes(out)


@pytest.mark.parametrize("name", samples.SAMPLES)
def test_archives(name):
    layout, write, _, head = samples.SAMPLES[name]
    for items in (ITEMS, ITEMS[:1]):
        directory, body = write(items)
        body = directory if body is None else body
        whole = []
        for e in toc.found_entries(LAYOUTS[layout], directory, body):
            cut = body[e["offset"] : e["offset"] + e["packed"]]
            whole.append((cut if e["codec"] == "copy" else inflate_bytes(cut, e["codec"]))[head:].rstrip(b"\0"))
        assert whole == [p for _, p in items]
    one = directory is body
    for d in damaged(directory, name):
        try:
            for e in toc.found_entries(LAYOUTS[layout], d, d if one else body):
                if e["codec"] != "copy" and 0 <= e["offset"] < len(body):
                    inflate_bytes(body[e["offset"] : e["offset"] + max(0, e["packed"])], e["codec"])
        except KNOWN:
            pass


@pytest.mark.parametrize("name", samples.STREAMS)
def test_streams(name):
    data = samples.STREAMS[name]([p for _, p in ITEMS])
    for d in damaged(data, name):
        rows = list(chunks.read_chunks(d, chunks.DIALECTS[name]))
        assert len(rows) <= len(d) + 1 and all(r[6] is None for r in rows[:-1])


PARSED = {
    "message": (records.messages, lambda: samples.message(7, "name", 3, "kind")),
    "tags": (records.external_tags, lambda: samples.external_tags(ITEMS)),
    "bank": (records.sound_bank, lambda: samples.sound_bank(ITEMS)),
    "details": (records.bank_details, lambda: samples.event_bank(ITEMS)),
    "waves": (records.wave_container, lambda: samples.wave_container("<")(ITEMS)),
    "ids": (records.stream_ids(samples.STREAM_KIND, samples.SOUND_KIND), lambda: samples.ktsr(ITEMS)),
    "strings": (records.trailing_strings, lambda: samples.trailing_strings(ITEMS)),
    "names": (records.sized_names, lambda: samples.sized_names(ITEMS)),
    "asset": (records.wrapped_asset, lambda: samples.wrapped_asset("n", b"payload", "p", True)),
    "sections": (records.sound_sections, lambda: samples.sound_sections(ITEMS)),
    "runs": (records.block_runs(), lambda: samples.block_run(ITEMS)),
    "loops": (records.loop_records("tbb"), lambda: samples.loop_record("tbb", ITEMS)),
    "msgpack": (records.msgpack, lambda: samples.msgpack(7, "name", 1.5)),
    "ogg": (records.ogg_pages, lambda: samples.ogg(ITEMS)),
    "chunked": (repair.chunked_asset, lambda: samples.chunked_asset(b"some text " * 40)),
    "padded": (repair.padded_chunks, lambda: samples.padded_chunks(b"some text " * 40)),
    "stripped": (archives.stripped_blocks, lambda: samples.stripped_blocks(b"some text " * 40)),
    "files": (archives.chunked_files, lambda: samples.chunked_files(ITEMS)),
    "swvr": (archives.stream_runs, lambda: samples.stream_runs(ITEMS)),
    "table": (lambda d: iter(utf_table.parse(d).rows), lambda: samples.cue_sheet("n", b"payload", True)),
}


@pytest.mark.parametrize("name", PARSED)
def test_records(name):
    parser, write = PARSED[name]
    data = write()
    assert list(parser(data))
    for d in damaged(data, name):
        try:
            for i, _ in enumerate(parser(d)):
                assert i < 100_000
        except KNOWN:
            pass
