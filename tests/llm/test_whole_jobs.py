"""Tests of the operators beyond the bounds that once cut their work short."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from bytequarry.llm import html_blocks, language_id, packing, transcripts


def sounds(seed):
    r = random.Random(seed)
    parts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzäöüñéçø", k=3)) for _ in range(8)]
    return lambda n: " ".join("".join(r.choices(parts, k=r.randint(1, 3))) for _ in range(n))


def test_a_rare_language_has_a_class(spark):
    common, rare = sounds(1), sounds(2)
    rows = [(i, common(20), "aa", "h.aa") for i in range(400)] + [(1000 + i, rare(60), "rr", "h.rr") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    languages, table = language_id.fit(df, rows=4)
    assert languages == ["aa", "rr"] and len(table) == 3
    got = {r.doc_id: r for r in language_id.identify(df, (languages, table)).collect()}
    assert all(got[1000 + i].language == "rr" and got[1000 + i].kept for i in range(3))


def test_more_than_64_languages(spark):
    rows = [(10 * l + i, text(60), f"l{l:03d}", f"h{l}.x") for l in range(70) for text in [sounds(l)] for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.fit(df)
    assert len(model[0]) == 70
    hidden = df.withColumn("truth", F.col("lang")).withColumn("lang", F.lit(None).cast("string"))
    got = language_id.identify(hidden, model).join(df.select("doc_id", F.col("lang").alias("truth")), "doc_id").collect()
    assert len(got) == 280 and sum(r.language == r.truth and r.kept for r in got) == 280


def test_more_sources_than_queues(spark, tokens_path, monkeypatch):
    monkeypatch.setattr(packing, "TOKENS_AT_ONCE", 50)
    rows = [(i, f"text number {i} of its source " * (1 + i % 5), None if i % 30 == 29 else f"s{i % 30}") for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for targets in (None, {"s3": 0.5}):
        got = packing.pack(df, tokens_path, 64, targets).collect()
        at, spans = {}, {}
        for r in got:
            assert r.source == rows[r.doc_id][2]
            at.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
            spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert at.keys() == {i for i, _, _ in rows}
        for pieces in at.values():
            pieces.sort()
            assert [s for s, _, _ in pieces] == [sum(n for _, n, _ in pieces[:i]) for i in range(len(pieces))]
            assert sum(n for _, n, _ in pieces) == pieces[0][2]
        for s, x in spans.items():
            x.sort()
            assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))]
            assert sum(n for _, n in x) == 64 or s == max(spans)
        if targets:
            early = [r for r in got if r.sequence_id < 2]
            assert abs(sum(r.length for r in early if r.source == "s3") / 128 - 0.5) < 0.05


def test_more_than_16_roles(spark):
    rows = [(c, i, f"r{(c + i) % 20:02d}", f"word {i}") for c in range(40) for i in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ordered = transcripts.in_order(transcripts.observed(df))
    model = transcripts.fit(ordered)
    assert len(model.roles) == 20 and transcripts.recover(ordered, model).count() == len(rows)


def test_added_tokens_as_the_library_finds_them(spark, tokens_path, tmp_path):
    from tokenizers import Tokenizer

    from bytequarry.llm.queries import queries

    library = Tokenizer.from_file(tokens_path)
    texts = ["a <|endoftext|> is text", "<|endoftext|>", "a  <|endoftext|><|endoftext|>\n b c d e", "one two three four <|endoftext| > five", "plain words of no note here"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in want[0]
    own = packing.ChunkTokenizer(tokens_path, added=True)
    assert [np.frombuffer(own.ids(t), own.dtype).tolist() for t in texts] == want
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries()["op1_packing"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in got} == {i: (len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for i, x in enumerate(want)}


def test_only_raw_text_elements_are_skipped():
    texts = lambda html: [b.text for b in html_blocks.leaf_blocks(html)]
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["so x=2 holds"]
    for name in ("math", "svg", "object", "audio", "video", "canvas"):
        assert texts(f"<article><p>one <{name}>within<p>two</article><p>three") == ["one within", "two", "three"]
        assert texts(f"<p>one</p><{name} class=x><p>fallback</p></{name}><p>two") == ["one", "fallback", "two"]
    assert texts("<p>one<xmp>a <b>c</b> &amp;\n d</xmp>two<xmp>never <i>closed") == ["one", "a <b>c</b> &amp; d", "two", "never <i>closed"]
    assert texts("<svg><title>t</title><style>p{}</style><text>label</text></svg><script>x</script>") == ["label"]


def test_counts_over_the_seams_of_tasks(spark):
    r = random.Random(8)
    rows = [(None if c == 0 else c, i, r.choice(["a", "b", "c", None]), f"w {i}") for c in range(40) for i in range(r.randint(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    ordered = transcripts.in_order(transcripts.observed(df))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert ordered.rdd.getNumPartitions() > 10
    moves, before = np.full((7, 6), 0.5), (-1, None)
    for c, _, role, _ in rows:  # one line each
        if role and before[0] != c:
            moves[6, 2 * "abc".index(role)] += 1
        elif role and before[1]:
            moves[2 * "abc".index(before[1]), 2 * "abc".index(role)] += 1
        before = (c, role)
    want = np.log(moves / moves.sum(axis=1, keepdims=True))
    model = transcripts.fit(ordered)
    assert np.allclose(model.step[::2, ::2], want[:6:2, ::2]) and np.allclose(model.start[::2], want[6, ::2])


def test_a_rare_source_with_a_long_text(spark, tokens_path):
    """A source of a billionth of a corpus's tokens: one document of more than a million tokens, beside many other queues."""
    import resource
    import time

    plan = packing.Schedule([10**15, 2 * 10**6, *([10**12] * 50)], [1.0, 2e-9, *([1e-3] * 50)], 1024)
    began, before = time.process_time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    doc, at, size, place = plan.pieces(np.array([1]), np.array([0]), np.array([1_300_000]), 1024)
    assert size.sum() == 1_300_000 and (np.diff(place) > 0).all() and (doc == 0).all()
    assert time.process_time() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20


def test_targets_of_sources_without_a_name(spark, tokens_path):
    rows = [(i, "some words of text here " * 4, (None, "", "s")[i % 3]) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(df, tokens_path, 64, {None: 0.5, "": 0.25}).filter("sequence_id < 4").groupBy("source").agg(F.sum("length").alias("n")).collect()
    share = {r.source: r.n / 256 for r in got}
    assert abs(share[None] - 0.5) < 0.05 and abs(share[""] - 0.25) < 0.05


def test_tiny_sources_share_queues(spark, tokens_path):
    rows = [(i, "word " * 40, "big") for i in range(400)] + [(1000 + i, f"tiny {i}", f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = packing.pack(df, tokens_path, 64).collect()
    assert {r.doc_id for r in got} == {i for i, _, _ in rows}
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
        assert r.source == ("big" if r.doc_id < 1000 else f"t{r.doc_id - 1000}")
    assert all(sum(r.length for r in x) == 64 for s, x in by.items() if s < max(by))
    tiny = [sum(r.length for r in x if r.source != "big") / 64 for s, x in sorted(by.items()) if s < max(by)]
    assert max(tiny) - min(tiny) < 0.08
