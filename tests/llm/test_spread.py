"""Rows dealt anew by each plan, clashing names, and the ways beyond a broadcast."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bytequarry.llm import common, exact_dedup, jaccard_join, language_id, substring_dedup, warc_zip

from test_dedup import brute_links, brute_spans

SF = Path("/root/testdata/sf0.001")


@pytest.fixture
def by_shuffle(monkeypatch):
    """No table fits a broadcast, and two rows make a key hot."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT_SHARE", 10**9)
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    monkeypatch.setattr(common.spread_join, "__defaults__", ("inner", "n", 1))


def test_spread_join(spark, by_shuffle):
    left = spark.createDataFrame([(i % 3 if i % 5 else None, i) for i in range(40)], "k int, uid long")
    right = common.staged(left.filter("k < 2").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 10), "right")
    key = lambda df: sorted(map(str, df.collect()))
    for how in ("inner", "left", "left_semi"):
        got = common.spread_join(left, right, "k", "uid", how)
        assert key(got) == key(left.join(right, "k", how))


def test_copies_by_shuffle(docs, corpus, by_shuffle):
    got = exact_dedup.exact_duplicates(docs).collect()
    assert sum(r.kept for r in got) == len({t or "" for _, t, *_ in corpus}) and len(got) == len(corpus)


def test_near_copies_by_shuffle(docs, corpus, by_shuffle):
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(docs, bucket=3).collect()), key=str)
    assert got == brute_links([(r[0], r[1]) for r in corpus])


@pytest.mark.parametrize("size", [1 << 16, 100])
def test_repeats_by_shuffle(docs, corpus, by_shuffle, monkeypatch, size):
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", size)
    ordered = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.strip_repeats(docs).collect()), key=str)
    assert got == brute_spans([(r[0], r[1]) for r in ordered], 20)


def test_archive_by_shuffle(spark, by_shuffle):
    rows = [(i, f"http://h/{i}", "x" * 200 if i % 2 else f"page {i}") for i in range(30)]
    got = warc_zip.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert Counter((r.record_type, r.refers_to) for r in got) == {("response", None): 16, ("revisit", 1): 14}
    assert all(r.error is None for r in got)


@pytest.mark.parametrize("how", ["left", "left_semi", "left_anti"])
@pytest.mark.parametrize("most", [0, 1 << 24])
def test_marks_reach_rows_where_they_stand(spark, monkeypatch, how, most):
    monkeypatch.setattr(common, "BROADCAST_BYTES", most)
    held = common.numbered(spark.range(0, 200, 1, 5).select("id", F.create_map(F.lit("k"), F.col("id")).alias("m"), F.array("id").alias("uid")), "rows")
    marks = common.staged(held.filter("row.id % 3 = 0 AND row.id < 160").select("uid", (F.col("row.id") * 2).alias("twice"), F.lit("x").alias("s")), "marks")
    got = common.marked(held, marks, how)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    want = {i: (i * 2, "x") if i % 3 == 0 and i < 160 else (None, None) for i in range(200)}
    if how == "left":
        assert {r.row.id: (r.twice, r.s) for r in got.collect()} == want
    else:
        assert sorted(r.row.id for r in got.collect()) == [i for i, v in want.items() if (v[0] is not None) == (how == "left_semi")]
        assert got.columns == held.columns


def test_only_suspects_move(spark, docs, by_shuffle, monkeypatch):
    """Beyond a broadcast: texts that are asked for a byte check, and those alone, are given to the exchange."""
    seen = []
    real = exact_dedup._suspect_texts
    monkeypatch.setattr(exact_dedup, "_suspect_texts", lambda *a: seen.append(real(*a)) or seen[-1])
    exact_dedup.exact_duplicates(docs).collect()
    texts = Counter(r.text or "" for r in docs.collect())
    assert Counter(r.text for r in seen[0].collect()) == Counter({t: n for t, n in texts.items() if n > 1})
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    wanted = []
    real_wanted = jaccard_join._wanted_texts
    monkeypatch.setattr(jaccard_join, "_wanted_texts", lambda *a: wanted.append(real_wanted(*a)) or wanted[-1])
    jaccard_join.near_duplicates(docs).collect()
    assert "Exchange" not in wanted[0]._jdf.queryExecution().executedPlan().toString()
    assert wanted[0].count() < docs.count() / 2


@pytest.fixture
def moving(spark):
    """Rows that every plan may deal anew, with columns whose names the operators use inside."""
    if not SF.exists():
        pytest.skip("no tables here")
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df.withColumns({"__uid": F.lit(1), "__gone": F.lit(2), "uid": F.lit(3), "row": F.lit("r"), "ll": F.lit(4), "host": F.lit("h"), "n": F.lit(5)})


def test_rows_that_are_dealt_anew(moving):
    dealt = moving.repartition(7)
    texts = Counter(r.text or "" for r in moving.select("text").collect())
    left = exact_dedup.drop_exact_duplicates(dealt)
    assert left.columns == moving.columns
    assert Counter(r.text or "" for r in left.collect()) == Counter(dict.fromkeys(texts, 1))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(substring_dedup.strip_repeats(dealt)) == key(substring_dedup.strip_repeats(moving))
    near = jaccard_join.drop_near_duplicates(dealt)
    assert near.columns == moving.columns and key(near) == key(jaccard_join.drop_near_duplicates(moving))


def test_unknown_languages_of_rows_that_are_dealt_anew(spark, moving):
    odd = moving.limit(9).withColumn("text", F.lit("qq xx zz ww vv kk jj qx zq xw wq " * 30)).withColumn("doc_id", F.col("doc_id") + 1_000_000).withColumn("lang", F.lit(None).cast("string"))
    model = language_id.fit(moving)
    every = moving.unionByName(odd)
    left = language_id.drop_unknown(every.repartition(7), model)
    assert left.columns == moving.columns
    want = Counter(r.doc_id for r in language_id.identify(every, model).filter("kept").collect())
    assert Counter(r.doc_id for r in left.collect()) == want and 0 < sum(want.values()) < every.count()


def test_one_row_of_a_class_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (3, text), (5, text.replace("w7", "x")), (None, text), (None, None), (9, "other words than these are")]
    got = [r.doc_id for r in jaccard_join.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == [3, 9, None]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Session())
