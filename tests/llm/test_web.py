import base64
import gzip
import hashlib
import io
import itertools
import random
import time
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bytequarry.llm import block_labeller, html_blocks, html_extract, transcripts, warc_zip

PAGES = "page_id long, url string, html string, digest string, first long, package string"


# --- archives ---------------------------------------------------------------------


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directory_reads_both_forms_and_the_standard_library(wide):
    f = io.BytesIO()
    w = warc_zip.StoredZipWriter(f, wide)
    items = {"archive/data.warc.gz": b"abc" * 100, "é": b"", "indexes/i": b"PK\x05\x06" + b"x" * 30}
    for k, v in items.items():
        w.add(k, v)
    w.close()
    z = warc_zip.ZipDirectory(f)
    assert {k: z.read(m) for k, m in z.members.items()} == items
    with zipfile.ZipFile(f) as std:
        assert {n: std.read(n) for n in std.namelist()} == items and std.testzip() is None
    g = io.BytesIO()
    with zipfile.ZipFile(g, "w") as std:
        std.writestr("a", b"1")
        std.writestr(zipfile.ZipInfo("b"), b"2" * 9, zipfile.ZIP_DEFLATED)
        std.comment = b"with PK\x05\x06 inside"
    z = warc_zip.ZipDirectory(g)
    assert z.read(z.members["a"]) == b"1"
    with pytest.raises(ValueError, match="not stored"):
        z.read(z.members["b"])
    with pytest.raises(ValueError):
        warc_zip.ZipDirectory(io.BytesIO(b"no archive"))


@pytest.fixture(scope="module")
def pages(spark):
    long, short = "<p>é" + "x" * 200, "<p>s"
    rows = [(i, f"http://h/{i} ü\r\nX: y", long if i % 3 == 0 else f"{long}{i}" if i % 3 == 1 else short) for i in range(30)]
    rows += [(100, None, None), (101, "", ""), (102, "u", None), (None, "u", long), (0, "again", long), (103, "v", "y" * 300_000), (None, None, "only null ids" * 20), (None, None, "only null ids" * 20)]
    return spark.createDataFrame([(*r, "d", 5, "p") for r in rows], PAGES)


@pytest.mark.parametrize("wide", [False, True])
def test_round_trip(spark, pages, tmp_path, monkeypatch, wide):
    monkeypatch.setattr(warc_zip, "RECORDS_A_READ", 4)
    packages = warc_zip.write_packages(pages, f"file://{tmp_path}", wide)
    got = warc_zip.read_packages(packages, with_payload=True).collect()
    rows = pages.collect()
    assert packages.agg(F.sum("records")).first()[0] == len(rows) == len(got)
    first = {}
    for r in rows:
        if r.page_id is not None and len((r.html or "").encode()) >= 100:
            first[r.html] = min(r.page_id, first.get(r.html, r.page_id))
    key = lambda p, b, d, t, f: str((p, b, d, t, f))
    want = []
    for r in rows:
        b = (r.html or "").encode()
        f = first.get(r.html)
        revisit = f is not None and r.page_id != f
        want.append(key(r.page_id, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    assert sorted(want) == sorted(key(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert {hashlib.sha256(bytes(r.payload)).hexdigest() for r in got if r.payload is not None} == {r.payload_digest for r in got}


def test_no_pages(pages):
    assert warc_zip.archive_round_trip(pages.limit(0)).count() == 0


def test_damage_is_seen():
    data = warc_zip.write_record("response", "<urn:page:1>", "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc_zip.read_record(data)["payload"] == b"payload"
    assert warc_zip.read_record(data)["error"] is None
    assert warc_zip.read_record(data.replace(b"payload\r\n", b"peyload\r\n"))["error"] == "payload is not what its digest says"
    assert warc_zip.read_record(data[:-12])["error"] == "block is cut short" and warc_zip.read_record(b"x")["error"] == "no WARC record"


def test_a_package_of_another_writer(spark, tmp_path):
    """Records of two archives; one is indexed by timestamped CDXJ with quoted numbers, packed by gzip, the other by CDX letters; digests are SHA-1 in base 32."""
    def record(uri, payload, kind="response", digest=None):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + payload
        digest = digest or base64.b32encode(hashlib.sha1(payload).digest()).decode()
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {uri}\r\nWARC-Target-URI: http://a.org/\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(block)}\r\n\r\n"
        return gzip.compress(head.encode() + block + b"\r\n\r\n")

    one = [record("<urn:uuid:1>", b"first"), record("<urn:uuid:2>", b"second", digest="A" * 32)]
    two = [record("<urn:uuid:3>", b"third")]
    cdxj = f'org,a)/ 20200102030405 {{"url": "http://a.org/", "offset": "0", "length": "{len(one[0])}", "filename": "one.warc.gz"}}\n'
    cdxj += f'org,a)/{{x}} 20200102030406 {{"offset": {len(one[0])}, "length": {len(one[1])}, "filename": "one.warc.gz"}}\n'
    cdx = f" CDX N b a m s k r M S V g\norg,a)/ 20200102030407 http://a.org/ text/html 200 X - - {len(two[0])} 0 two.warc.gz\n"
    with open(tmp_path / "x.wacz", "wb") as f:
        z = warc_zip.StoredZipWriter(f)
        z.add("archive/one.warc.gz", b"".join(one))
        z.add("archive/two.warc.gz", b"".join(two))
        z.add("indexes/index.cdxj.gz", gzip.compress(cdxj.encode()))
        z.add("indexes/index.cdx", cdx.encode())
        z.add("indexes/index.idx", b"!meta 0 {}\n")
        z.close()
    got = warc_zip.read_packages(spark.createDataFrame([(f"file://{tmp_path}/x.wacz",)], "package string"), with_payload=True).collect()
    found = {r.record_id: (bytes(r.payload), r.error) for r in got}
    assert found == {"<urn:uuid:1>": (b"first", None), "<urn:uuid:2>": (b"second", "payload is not what its digest says"), "<urn:uuid:3>": (b"third", None)}
    assert all(r.page_id is None and r.url == "http://a.org/" for r in got)


def test_index_lines():
    line = warc_zip.index_line("https://M.Example.org:8080/A b?q=1", "<u>", "0", 7, 9, "d.warc.gz")
    assert line.split(" ")[0] == "org,example,m:8080)/a%20b?q=1" and line.split(" ")[1] == "20240101000000"
    assert list(warc_zip.index_spans(line.encode())) == [("d.warc.gz", 7, 9)]
    assert list(warc_zip.index_spans(b'urn:x {"offset": 1, "length": 2, "filename": "f"}')) == [("f", 1, 2)]
    assert warc_zip.sort_key("http://[bad") and warc_zip.sort_key("") == ")/"


# --- extraction ----------------------------------------------------------------------


def texts(html):
    return [b.text for b in html_blocks.leaf_blocks(html)]


def test_blocks():
    assert texts("<p>a <b>b</b>\n c&amp;amp;&nbsp;d<p>e<br>f</div><li>g") == ["a b c&amp; d", "e f", "g"]
    assert texts("<script>x</script >y<style>p{}</style><!-- z --><title>t</title>w") == ["y", "w"]
    assert texts('<div title="a>b">c</div>< d <e') == ["c", "< d <e"]
    assert texts("") == [] and texts("<script>never closed") == [] and texts("plain") == ["plain"]
    b = html_blocks.leaf_blocks('<nav class="Top Menu"><a href=x>yes</a> no</nav>')[0]
    assert b.path == (("nav", "top menu"),) and b.linked == 3


def slow_blocks(tokens):
    """Texts of blocks from ready tokens, by plain search of the stack."""
    stack, out, parts = [], [], []
    at = lambda names: max((i for i, x in enumerate(stack) if x in names), default=-1)

    def close():
        if text := " ".join("".join(parts).split()):
            out.append((text, tuple(x for x in stack_then if x in html_blocks.BLOCK)))
        parts.clear()

    stack_then = []
    for kind, name in tokens:
        if kind == "text":
            if not parts:
                stack_then = list(stack)
            parts.append(name)
            continue
        if name in html_blocks.BLOCK:
            close()
        if kind == "end":
            found = at([name])
            if found < 0 or (name not in html_blocks.CELLS and found < at(["td", "th", "caption"])):
                continue
            if name not in html_blocks.BLOCK and at(html_blocks.BLOCK) > found:
                stack[found] = ""
            else:
                del stack[found:]
            continue
        if name in html_blocks.ENDS:
            found = at(html_blocks.ENDS[name])
            if found >= 0 and found >= at(["table"] if name in html_blocks.CELLS else html_blocks.SCOPES):
                del stack[found:]
        if name in html_blocks.ENDS_P and at(["p"]) > at(html_blocks.SCOPES):
            del stack[at(["p"]) :]
        stack.append(name)
    close()
    return out


NAMES = ["p", "div", "li", "ul", "b", "i", "table", "tr", "td", "tbody", "h1", "article", "dt", "dl"]
TOKENS = st.lists(st.one_of(st.tuples(st.just("text"), st.sampled_from(["x", " y ", "\n", "z"])), st.tuples(st.sampled_from(["start", "end"]), st.sampled_from(NAMES))), max_size=40)


@settings(max_examples=300, deadline=None)
@given(TOKENS)
def test_blocks_against_a_slow_parser(tokens):
    html = "".join({"text": n, "start": f"<{n}>", "end": f"</{n}>"}[k] for k, n in tokens)
    assert [(b.text, tuple(x for x, _ in b.path)) for b in html_blocks.leaf_blocks(html)] == [(t, p[-html_blocks.STEPS :]) for t, p in slow_blocks(tokens)]


def test_odd_markup():
    assert texts("a<!-->b<!--->c<!-- x --!>d<!--never") == ["abcd"]
    assert texts("<p title=don't>x</p><p title='a>b' class=\"c\">y") == ["x", "y"]
    assert texts('<p title="never closed>x</p><p>y') == ["x", "y"]
    assert texts("<a href=/x/>t</a> u</><?php y ?>") == ["t u"]
    assert html_blocks.leaf_blocks("<a href=/x/>t</a>u")[0].linked == 1
    assert html_blocks.leaf_blocks("<a href=x><p>in</a>out")[0].linked == 2


@pytest.mark.parametrize("part", ["<a ", '<a b="', "<div>x", "<i>x", "</i><div>", "<!--a-->", "<i><p></i>", "<li>x<ul>", "<p title=don't>x"])
def test_time_grows_with_the_page(part):
    began = time.process_time()
    for end in ("", ">", '">'):
        html_blocks.leaf_blocks(part * (300_000 // len(part)) + end)
    assert time.process_time() - began < 12


SHAPES = {
    "in the body": ("<html><body><h1>Storm hits coast</h1><p>The storm reached the coast on Monday night.</p><p>Thousands of people lost power as trees fell.</p><p>Officials said repairs would take days.</p></body></html>", 4),
    "a list": ('<html><body><nav><a href="/">Home</a></nav><article><h1>How to bake bread</h1><p>Follow these steps.</p><ol><li>Mix the flour and the water.</li><li>Let the dough rest for an hour.</li><li>Bake it until it is brown.</li></ol></article><footer>Copyright 2020</footer></body></html>', 5),
    "bare divisions": ("<html><body><div>The river rose quickly after the rain last week.</div><div>Many farmers moved their animals to higher ground before dawn.</div><div>The water has now begun to fall, the council said.</div></body></html>", 3),
    "laid out by a table": ("<html><body><table width=100%><tr><td>Home | News</td></tr><tr><td><h2>Old page</h2><p>This is the story of a small village in the hills.</p><p>It was built by farmers long ago, and few have left since.</p></td></tr><tr><td>Copyright 2001</td></tr></table></body></html>", 3),
    "sections": ('<html><body><header><a href="/">Site</a></header><main><section><h2>First part</h2><p>Words of the first part go here.</p></section><section><h2>Second part</h2><p>Words of the second part go here.</p><ul><li>one point</li><li>another point</li></ul></section></main><aside><h3>Related</h3><ul><li><a href=x>Other story</a></li></ul></aside></body></html>', 6),
    "definitions": ('<html><body><div class="menu"><a href="/">Home</a></div><div id="content"><h1>Glossary</h1><dl><dt>Alloy</dt><dd>A metal made of two or more others.</dd><dt>Ore</dt><dd>Rock that holds a metal.</dd></dl></div><form><label>Search</label><input></form></body></html>', 5),
    "quotations and cells": ("<html><body><header><h2><a href=/>The Daily</a></h2><nav><ul><li><a href=/w>World</a></li><li><a href=/s>Sport</a></li></ul></nav></header><article><header><h1>Mayor resigns</h1></header><p>The mayor resigned on Tuesday after a long debate.</p><blockquote><p>I have done what I could.</p></blockquote><table><tr><th>Year</th><th>Votes</th></tr><tr><td>2019</td><td>51 percent</td></tr></table><pre>end of report</pre></article><section class=comments><p>Great news, thanks!</p></section><footer><p>All rights reserved</p></footer></body></html>", 8),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes_written_by_hand(shape):
    html, lines = SHAPES[shape]
    got = html_extract.extract([html], block_labeller.trained())[0].split("\n")
    every = texts(html)
    skipped = {"Home", "Home | News", "Copyright 2001", "Copyright 2020", "Site", "Related", "Other story", "Search", "The Daily", "World", "Sport", "Great news, thanks!", "All rights reserved"}
    assert len(got) == lines and got == [t for t in every if t not in skipped]


def test_gradients():
    pages = [(block_labeller.features(b), l) for b, l in block_labeller.made_pages(4, 9)]
    net = block_labeller.Labeller()
    rng = np.random.default_rng(0)
    net.params["word"] = rng.normal(0, 0.1, net.params["word"].shape)
    x, y = [p[0] for p in pages], [p[1] for p in pages]
    _, grads = net.gradients(x, y)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, h = net.params[name][at], 1e-5
        net.params[name][at] = old + h
        up, _ = net.gradients(x, y)
        net.params[name][at] = old - h
        down, _ = net.gradients(x, y)
        net.params[name][at] = old
        assert abs((up - down) / (2 * h) - g[at]) < 1e-4 * max(1, abs(g[at])), name


def test_held_out_accuracy():
    net = block_labeller.trained()
    held = block_labeller.made_pages(200, 77)
    got = np.concatenate(net.scores([block_labeller.features(b) for b, _ in held])) >= 0.5
    assert (got == np.concatenate([l for _, l in held])).mean() > 0.985


def test_extraction(spark):
    page = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="ad">Buy this now please.</div><article><h1>Head line</h1><p><b>First &amp; only.<br><p>Second one here, with words.</article><footer>&copy; them</footer></body></html>'
    rows = spark.createDataFrame([(1, "u", page, "t", 1, None), (2, None, None, None, None, None), (None, "v", "", None, None, None), (1, "u", page, "t", 1, None)], "page_id long, url string, html string, text string, n_chars long, x string")
    got = html_extract.extract_text(rows).collect()
    want = "Head line\nFirst & only.\nSecond one here, with words."
    assert sorted((str(r.page_id), r.url, r.text, r.n_chars) for r in got if r.page_id == 1) == [("1", "u", want, len(want))] * 2
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id != 1)
    assert html_extract.extract_text(rows.limit(0)).count() == 0


# --- transcripts ------------------------------------------------------------------------


def talk(conv, r):
    """Turns of one conversation: users ask briefly, assistants answer at length."""
    rows = [("system", "be kind and brief")] if r.random() < 0.3 else []
    for _ in range(r.randint(1, 4)):
        rows.append(("user", "what is " + "word " * r.randint(1, 5) + "?"))
        rows.append(("assistant", "\n".join("answer " * r.randint(5, 30) for _ in range(r.randint(1, 4)))))
    return [(conv, i, role, text) for i, (role, text) in enumerate(rows)]


CONV = "conv_id long, turn long, role string, text string"


def lines_of(spark, rows, **more):
    return transcripts.in_order(transcripts.observed(spark.createDataFrame(rows, CONV), **more))


def in_their_order(ordered, model):
    return sorted(transcripts.recover(ordered, model).collect(), key=lambda x: (x.conv_id is not None, x.conv_id or 0, x.turn is not None, x.turn or 0, x.uid, x.line))


def test_roles_of_held_out_conversations(spark):
    """Fitted on marked transcripts, read without any mark: breaks and roles by lengths, kinds and turn-taking alone; and with marks, whole."""
    r = random.Random(4)
    rows = [x for c in range(200) for x in talk(c, r)]
    df = spark.createDataFrame([(*x, 1, "z") for x in rows], f"{CONV}, code int, declared string")
    model = transcripts.fit(transcripts.in_order(transcripts.observed(df.filter("conv_id % 2 = 0"))))
    got = transcripts.recover(transcripts.in_order(transcripts.observed(df.filter("conv_id % 2 = 1"))), model).collect()
    assert len(got) == sum(len(x[3].split("\n")) for x in rows if x[0] % 2)
    assert np.mean([g.role == g.declared for g in got]) > 0.9
    marked = transcripts.written(df)
    model = transcripts.fit(transcripts.in_order(transcripts.observed(marked.filter("conv_id % 2 = 0"))))
    got = transcripts.recover(transcripts.in_order(transcripts.observed(marked.filter("conv_id % 2 = 1"))), model)
    turns = {(t.conv_id, t.number): (t.role, t.rendered) for t in transcripts.turns_of(got).collect()}
    want, number = {}, {}
    for c, _, role, text in rows:
        if c % 2:
            number[c] = number.get(c, -1) + 1
            want[c, number[c]] = (role, f"<|{role}|>\n{text}")
    assert turns == want


def test_whole_transcripts_are_parsed(spark):
    """A transcript in one text, with a marker-like line inside an answer."""
    r = random.Random(9)
    model = transcripts.fit(transcripts.in_order(transcripts.observed(transcripts.written(spark.createDataFrame([x for c in range(60) for x in talk(c, r)], CONV)))))
    raw = [(1, "User: what is it?\n### Assistant:\nanswer answer answer answer answer\nResult: answer answer answer answer\nHuman: what is word word?\n<|assistant|>\nanswer answer answer answer answer answer"), (2, None)]
    ordered = transcripts.in_order(transcripts.observed(spark.createDataFrame(raw, "conv_id long, text string").selectExpr("conv_id", "cast(0 as long) AS turn", "text"), role_col=None))
    lines = transcripts.recover(ordered, model)
    turns = {t.number: (t.role, t.rendered) for t in transcripts.turns_of(lines.filter("conv_id = 1")).collect()}
    assert turns == {0: ("user", "<|user|>\nwhat is it?"), 1: ("assistant", "<|assistant|>\nanswer answer answer answer answer\nResult: answer answer answer answer"), 2: ("user", "<|user|>\nwhat is word word?"), 3: ("assistant", "<|assistant|>\nanswer answer answer answer answer answer")}
    assert [x.marker for x in in_their_order(ordered, model) if x.conv_id == 1] == ["User: ", "### Assistant:", "", "", "Human: ", "<|assistant|>", ""]


def test_seams_keep_the_best_score(spark):
    r = random.Random(6)
    rows = [(5, i, role, text) for i, (_, _, role, text) in enumerate(x for c in range(60) for x in talk(c, r))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ordered = lines_of(spark, rows)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ordered.rdd.getNumPartitions() > 1
    model = transcripts.fit(ordered)
    codes = np.array([x.code for x in sorted(ordered.collect(), key=lambda x: (x.turn, x.line))])
    score = model.scores(codes)
    path = lambda p: model.start[p[0]] + score[np.arange(len(p)), p].sum() + model.step[p[:-1], p[1:]].sum()
    got = in_their_order(ordered, model)
    states = np.array([2 * model.roles.index(x.role) + (not x.begins) for x in got])
    assert abs(path(states) - path(transcripts.viterbi(score, model.start, model.step))) < 1e-6
    assert [x.number for x in got] == (np.cumsum([x.begins for x in got]) - 1).tolist()


def test_recovery_is_the_best_path_of_all(spark):
    """The query against every path there is, on short transcripts."""
    r = random.Random(11)
    rows = [(c, i, r.choice(["user", "assistant"]), r.choice(["what is it?", "words of an answer here", "", "User: hm", "- a point"])) for c in range(30) for i in range(r.randint(1, 4))]
    ordered = lines_of(spark, rows)
    model = transcripts.fit(ordered)
    by = {}
    for x in sorted(ordered.collect(), key=lambda x: (x.conv_id, x.turn, x.line)):
        by.setdefault(x.conv_id, []).append(x.code)
    got = {}
    for x in in_their_order(ordered, model):
        got.setdefault(x.conv_id, []).append(2 * model.roles.index(x.role) + (not x.begins))
    for c, codes in by.items():
        score, n = model.scores(np.array(codes)), len(codes)
        total = lambda p: model.start[p[0]] + sum(score[i, p[i]] for i in range(n)) + sum(model.step[p[i], p[i + 1]] for i in range(n - 1))  # noqa: B023, E731
        assert abs(total(got[c]) - max(map(total, itertools.product(range(4), repeat=n)))) < 1e-9


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n, s = rng.integers(1, 6), 3
        score, start, step = rng.normal(size=(n, s)), rng.normal(size=s), rng.normal(size=(s, s))
        total = lambda p: start[p[0]] + score[range(n), p].sum() + sum(step[p[i], p[i + 1]] for i in range(n - 1))  # noqa: B023, E731
        every = [list(map(int, np.base_repr(i, s).zfill(n)[-n:])) for i in range(s**n)]
        assert transcripts.viterbi(score, start, step).tolist() == max(every, key=total)


def test_transcript_edges(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, "assistant", ""), (None, None, None, "x"), (None, 3, "user", "User: hello"), (2, 0, None, "long " * 20_000), (3, 0, "user", "Question: kept in its answer")]
    ordered = lines_of(spark, rows)
    got = transcripts.recover(ordered, transcripts.fit(ordered)).collect()
    assert len(got) == len(rows)
    assert any((r.rendered, r.marker) == ("<|user|>\nhello", "User: ") for r in got)
    assert all(r.marker + r.rendered.removeprefix(f"<|{r.role}|>").removeprefix("\n") in {x[3] or "" for x in rows} for r in got)
    empty = lines_of(spark, rows)
    empty = transcripts.in_order(transcripts.observed(spark.createDataFrame(rows, CONV).limit(0)))
    assert transcripts.recover(empty, transcripts.fit(empty)).count() == 0 and transcripts.written(spark.createDataFrame(rows, CONV)).count() == len(rows)


def test_unsound_packages_give_rows(spark, tmp_path):
    """A file that is no package, indexes that can't be read, lines without a place, archives that are absent: each a row, and the sound records as well."""
    record = warc_zip.write_record("response", "urn:uuid:1", "http://h/", b"hello", warc_zip.hashlib.sha256(b"hello").hexdigest(), None)
    line = lambda name, offset, length: f'h)/ 2020 {{"filename": "{name}", "offset": {offset}, "length": {length}}}\n'.encode()
    good = line("a.warc", 0, len(record))

    def package(name, members, kind=zipfile.ZIP_STORED):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for n, data in members:
                z.writestr(zipfile.ZipInfo(n), data, kind if n.startswith("indexes") else zipfile.ZIP_STORED)

    (tmp_path / "none.wacz").write_bytes(b"not a package")
    (tmp_path / "empty.wacz").write_bytes(b"")
    package("deflated.wacz", [("archive/a.warc", record), ("indexes/i.cdxj", good)], zipfile.ZIP_DEFLATED)
    package("bzip.wacz", [("archive/a.warc", record), ("indexes/i.cdxj", good)], zipfile.ZIP_BZIP2)
    package("absent.wacz", [("archive/a.warc", record), ("indexes/i.cdxj", line("b.warc", 0, 9) + good)])
    package("far.wacz", [("archive/a.warc", record), ("indexes/i.cdxj", line("a.warc", 0, 10**9) + line("a.warc", -1, 5) + good)])
    package("letters.wacz", [("archive/a.warc", record), ("indexes/i.cdx", b" CDX N b a\ncom,h)/ 2020 http://h/\n"), ("indexes/j.cdxj", b"h)/ 2020 {bad\nh)/ 2020 [1]\n" + good)])
    package("gz.wacz", [("archive/a.warc", record), ("indexes/i.cdx.gz", b"\x1f\x8bnothing"), ("indexes/j.cdxj", good)])
    uris = [f"file://{p}" for p in tmp_path.glob("*.wacz")] + [f"file://{tmp_path}/missing.wacz"]
    rows = warc_zip.read_packages(spark.createDataFrame([(u,) for u in uris], "package string"), with_payload=True).collect()
    assert [bytes(r.payload) for r in rows if r.error is None] == [b"hello"] * 5
    said = sorted(r.error for r in rows if r.error)
    assert len(said) == 1 + 1 + 1 + 1 + 1 + 2 + 3 + (1 if "indexes/i.cdx.gz".endswith(warc_zip.INDEXES) else 0)
    assert sum(e.startswith("package: ") for e in said) == 3
