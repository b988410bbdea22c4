import numpy as np
from pyspark.sql import functions as F

from bytequarry.operators import aggregates, graph, manifest, names, ordered, sets, similar
from bytequarry.streaming import events


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_sets(spark):
    m = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "a")], "o int, x string")
    assert rows(sets.equal_sets(m, "o", "x"), "set_id", "owners", "n_members") == [(1, 2, 2)]
    a = spark.createDataFrame([(1,), (300,), (256,)], "v int")
    got = rows(sets.range_join(a, a.withColumnRenamed("v", "w"), "v", "w", 256), "v", "w")
    assert got == sorted((x, y) for x in (1, 300, 256) for y in (1, 300, 256) if x <= y <= x + 256)
    d = sets.diff(spark.createDataFrame([("k", "1"), ("l", "1"), ("o", "1")], "k string, d string"), spark.createDataFrame([("k", "2"), ("l", "1"), ("n", "1")], "k string, d string"), "k", "d")
    assert rows(d, "k", "status") == [("k", "changed"), ("l", "same"), ("n", "extra_new"), ("o", "extra_old")]
    items, present = spark.createDataFrame([("a",), ("b",)], "i string"), spark.createDataFrame([("a.y",), ("a.z",)], "path string")
    assert rows(sets.first_existing(items, present, "i", [".x", ".y", ".z"]), "i", "option") == [("a", ".y")]
    n = sets.suffix_lookup(spark.createDataFrame([("x/y/z",)], "p string"), spark.createDataFrame([("z",), ("y/z",)], "n string"), "p", "n")
    assert rows(n, "p", "n") == [("x/y/z", "y/z")]
    ids = spark.createDataFrame([(0x20000001,)], "id long")
    assert rows(sets.with_implied_ids(ids, "id", 0x50000000 | 0x20000000, {0x20000000: 0x30000000}), "id") == [(0x20000001,), (0x30000001,)]


def test_order(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, "a", None, "b", None])], "seq int, v string").withColumn("g", F.lit(1))
    assert [r.c for r in ordered.carried_or_first(df, ["g"], ["seq"], F.col("v"), "c").orderBy("seq").collect()] == ["a", "a", "a", "b", "b"]
    use = ordered.one_shot(df, ["g"], ["seq"], F.col("v"), F.col("v").isNull(), "c").orderBy("seq")
    assert [r.c for r in use.collect()] == [None, None, "a", None, "b"]
    isl = spark.createDataFrame([(1, "a", False), (2, "a", True), (3, "a", False), (4, "b", False)], "s int, k string, e boolean").withColumn("g", F.lit(1))
    assert [r.island for r in ordered.islands_on_change(isl, ["g"], ["s"], F.col("k"), F.col("e")).orderBy("s").collect()] == [1, 1, 2, 3]
    lines = spark.createDataFrame([(i, s) for i, s in enumerate(["a", "", "", "b", ""])], "seq int, line string").withColumn("g", F.lit(1))
    assert [r.line for r in ordered.without_repeated_blanks(lines, ["g"], "seq", "line").orderBy("seq").collect()] == ["a", "", "b", ""]
    sec = spark.createDataFrame([(0, "2x"), (1, "b"), (2, "# c"), (3, "A")], "seq int, line string").withColumn("s", F.lit(1))
    assert [r.line for r in ordered.section_sorted(sec, "s", "seq", "line").orderBy("rank").collect()] == ["A", "b", "2x", "# c"]


def test_rank_over_tasks(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("v"))
    got = ordered.ranked(df, [F.col("v")]).collect()
    assert sorted((r.v, r.place) for r in got) == [(i, i + 1) for i in range(500)]
    assert ordered.ranked(df.limit(0), [F.col("v")]).count() == 0


def test_names(spark):
    one = spark.range(1)
    assert set(one.select(names.subsequences(F.lit("a_b_c")).alias("x")).first()["x"]) == {"a", "b", "c", "a_b", "b_c", "a_b_c"}
    made = lambda *forms: [r["name"] for r in names.expanded(spark.createDataFrame([(f,) for f in forms], "f string"), "f").collect()]
    assert sorted(made("x%[ab]_%02d^3^")) == [f"x{c}_{i:02d}" for c in "ab" for i in range(3)]
    assert sorted(made("%c")) == list("abcdefghijklmnopqrstuvwxyz") and made() == []
    assert len(made("%2x:16:")) == 16 and made("%s_x") == ["%s_x"]
    assert made("a%09d^2^", "b%012X:16:^32^") == ["a000000000", "a000000001", "b000000000000", "b000000000010"]
    assert names.expanded(spark.createDataFrame([("%07d",)], "f string"), "f").count() == 10_000_000
    words = spark.createDataFrame([(0, "# no"), (1, "fooBar x-y"), (2, "FOOBAR")], "seq int, line string")
    got = {r.word: r.original for r in names.word_list(words, "line").collect()}
    assert got["foobar"] == "FOOBAR" and "foo_bar" in got and "x" in got and "no" not in got
    alone = {r.word: r.alone for r in names.word_list(words.unionByName(spark.createDataFrame([(3, "x x"), (4, "é\U0001F600y\n"), (5, ""), (6, None)], "seq int, line string")), "line").collect()}
    assert alone == {"foobar": False, "foo_bar": True, "x": True, "y": True}
    cand = names.candidates(spark.createDataFrame([("a",)], "word string"), spark.createDataFrame([("p_%s",)], "template string"))
    from bytequarry.functions.hashx import joaat, low29

    known = cand.select(joaat(F.col("name")).alias("hash"))
    assert rows(names.recovered(cand, known), "name") == [("p_a",)]
    assert rows(names.recovered(cand, known.select(low29(F.col("hash")).alias("hash")), fuzzy=True), "name") == [("p_a",)]
    assert rows(names.recovered(cand, cand.select(F.crc32("name").alias("hash")), hasher=F.crc32), "name") == [("p_a",)]
    assert rows(names.number_names(spark, "%08x", 254, 257), "name") == [("000000fe",), ("000000ff",), ("00000100",)]
    ab = spark.createDataFrame([("a",), ("b",)], "p string")
    assert rows(names.combinations(ab, "p", 2), "name") == [("a_a",), ("a_b",), ("b_a",), ("b_b",)]
    assert rows(names.combinations(ab, "p", 2, repeat=False), "name") == [("a_b",), ("b_a",)]
    assert names.swap_list([2, 0, 1]) == [(0, 1), (1, 2)]
    from bytequarry.functions.hashx import fnv1

    letters = spark.createDataFrame([("a",), ("b",)], "letter string")
    triples = spark.createDataFrame([("ab", "a"), ("ba", "b")], "pair string, next string")
    want = one.select(fnv1(F.lit("abab")).alias("hash"))
    assert rows(names.frontier_search(letters, triples, want, 4), "name") == [("abab",)]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (2, 0, 4), (3, 0, 5), (3, 1, 4)], "src long, ordinal int, dst long")
    roots = spark.createDataFrame([(1,)], "node long")
    assert rows(graph.reach(roots, edges), "node", "depth") == [(1, 0), (2, 1), (3, 1), (4, 2), (5, 2)]
    leaves = graph.ordered_leaves(roots, edges, F.col("dst") >= 4)
    assert [r.leaf for r in leaves.orderBy("place").collect()] == [4, 5, 4]
    tree = spark.createDataFrame([(1, None, "r"), (2, 1, "a"), (3, 2, "b")], "node long, parent long, name string")
    assert rows(graph.tree_paths(tree), "path") == [("r",), ("r/a",), ("r/a/b",)]
    own = spark.createDataFrame([(1, ["x"]), (2, ["y", "x"])], "node long, values array<string>")
    base = spark.createDataFrame([(1, 2)], "node long, base long")
    assert rows(graph.inherited(own, base), "node", "values") == [(1, ["y", "x"]), (2, ["y", "x"])]


def test_similarity(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, i % 3, v[i].tolist()) for i in range(60)], "vec long, label int, e array<double>")
    old, similar.BLOCK_ROWS = similar.BLOCK_ROWS, 7
    got = {r.vec: (r.match_id, r.score) for r in similar.best_matches(df, df, "vec", "e", "label").collect()}
    similar.BLOCK_ROWS = old
    s = np.round(similar.cosine(v, v), 6)
    for i in range(60):
        c = [j for j in range(60) if j != i and j % 3 == i % 3]
        best = max(c, key=lambda j: (s[i, j], -j))
        assert got[i] == (best, s[i, best])
    pairs = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.85), (1, 2, 2, 0.1)], "p int, l int, r int, s double")
    assert rows(similar.one_to_one(pairs, "p", "l", "r", "s"), "l", "r") == [(1, 1), (2, 2)]
    assert similar.dtw(np.eye(3), np.eye(3)) == 0


def test_playlist(spark):
    t = spark.createDataFrame([("d", 1, "f1", "A", "x"), ("d", 2, "f2", "a", "y"), ("d", 3, "f3", "A", None)], "dir string, n int, file string, artist string, title string")
    out = manifest.playlist(t, ["dir"], ["n"], "file", {"artist": "ARTIST", "title": "TITLE"})
    assert [r.line for r in out.orderBy("seq").collect()] == ["# @ARTIST@ A", "# %TITLE% x", "f1", "# %TITLE% y", "f2", "f3"]


def test_text_sink(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "seq int, line string")
    manifest.write_text(df, str(tmp_path / "m"), ["seq"], bom=True, crlf=True)
    data = b"".join(p.read_bytes() for p in (tmp_path / "m").glob("part-*"))
    assert data == "﻿a\r\nb\r\n".encode()
    files = spark.createDataFrame([("x/y.bin", b"12")], "name string, payload binary")
    assert rows(manifest.write_payloads(files, str(tmp_path / "out")), "name", "size") == [("x/y.bin", 2)]
    assert (tmp_path / "out/x/y.bin").read_bytes() == b"12"


def test_aggregates(spark):
    df = spark.createDataFrame([("ab",), ("ba",), ("c",)], "t string")
    assert tuple(aggregates.mode(aggregates.character_counts(df, "t"), "ch", "n").first()) == ("a", 2)
    f = spark.createDataFrame([(1, [True, False]), (1, [False, False])], "g int, f array<boolean>")
    assert aggregates.any_active(f, ["g"], "f", 2).first()["active"] == [True, False]


def test_stream(spark, tmp_path):
    schema = "ts timestamp, user_id int, value double"
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' ts, 1 user_id, 2D value UNION ALL SELECT timestamp'2024-01-01 05:00:00', 1, 3D").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = events.tumbling(events.events_stream(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName("hours").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.total) for r in spark.table("hours").collect()] == [(1, 2.0)]


def test_characters_are_counted_in_one_pass(spark):
    import time

    from bytequarry.operators import aggregates

    many = "".join(map(chr, range(0x4E00, 0x4E00 + 20_000)))
    rows = spark.createDataFrame([(many,), ("ab" + many[0],), ("",), (None,)], "t string")
    began = time.monotonic()
    got = {r.ch: r.n for r in aggregates.character_counts(rows, "t").collect()}
    assert got == dict.fromkeys(many, 1) | {"a": 1, "b": 1, many[0]: 2}
    assert time.monotonic() - began < 20
